"""PNG images in binary columns: written and read through zlib chunks, unfiltered by numpy, hashed by cosines."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: Pixels in a row of a page's picture; side of the picture that is hashed, and of its kept block of low frequencies;
#: pictures that are unfiltered together.
WIDTH, SIDE, LOW, TOGETHER = 64, 32, 8, 512


class BadImage(ValueError):
    """A stream that isn't a whole, undamaged PNG that is supported."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered(rows: np.ndarray, bpp: int) -> np.ndarray:
    """All five filters of every row of bytes: (filter, row, byte)."""
    left = np.zeros_like(rows)
    left[:, bpp:] = rows[:, :-bpp]
    up = np.zeros_like(rows)
    up[1:] = rows[:-1]
    corner = np.zeros_like(rows)
    corner[1:, bpp:] = rows[:-1, :-bpp]
    average = ((left.astype(np.uint16) + up) // 2).astype(np.uint8)
    return np.stack([rows, rows - left, rows - up, rows - average, rows - _paeth(left, up, corner)])


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = b.astype(np.int16) - c, a.astype(np.int16) - c
    pa_, pb, pc = np.abs(p[0]), np.abs(p[1]), np.abs(p[0] + p[1])
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def encode(pixels: np.ndarray, kinds: np.ndarray | None = None) -> bytes:
    """PNG of 8-bit pixels (height, width) or (height, width, channels). Of each row the filter with the least sum of
    absolute differences is taken, or that given in ``kinds``."""
    pixels = np.ascontiguousarray(pixels, dtype=np.uint8)
    h, w, n = (*pixels.shape, 1)[:3]
    rows = pixels.reshape(h, w * n)
    every = filtered(rows, n)
    if kinds is None:
        kinds = np.abs(every.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    raw = np.concatenate([np.asarray(kinds, np.uint8)[:, None], every[kinds, np.arange(h)]], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _chunk(b"IEND", b"")


#: First row, step of rows, first column and step of columns of the seven passes of an interlaced picture.
PASSES = ((0, 8, 0, 8), (0, 8, 4, 8), (4, 8, 0, 4), (0, 4, 2, 4), (2, 4, 0, 2), (0, 2, 1, 2), (1, 2, 0, 1))


def parts_of(w: int, h: int, interlaced: int) -> list[tuple[int, int, tuple[int, int, int, int]]]:
    """(width, height, place) of each part of a picture that is filtered by itself and isn't empty."""
    if not interlaced:
        return [(w, h, (0, 1, 0, 1))]
    every = [(-(-(w - x) // dx), -(-(h - y) // dy), (y, dy, x, dx)) for y, dy, x, dx in PASSES]
    return [p for p in every if p[0] > 0 and p[1] > 0]


def row_bytes(w: int, depth: int, colour: int) -> int:
    return -(-w * depth * CHANNELS[colour] // 8)


def inflate(data: bytes) -> tuple[tuple[int, int, int, int, int], bytes, bytes]:
    """((width, height, depth, colour, interlaced), palette, filtered rows) of a PNG, after every check a reader must
    make."""
    if data[:8] != SIGNATURE:
        raise BadImage("signature")
    at, head, body, palette, ended = 8, None, [], b"", False
    while at < len(data):
        if at + 12 > len(data):
            raise BadImage("cut short")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data):
            raise BadImage("cut short")
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise BadImage(f"checksum of {kind.decode('latin-1')}")
        at += 12 + size
        if head is None and kind != b"IHDR":
            raise BadImage("no header")
        if kind == b"IHDR":
            if size != 13 or head is not None:
                raise BadImage("header")
            head = struct.unpack(">IIBBBBB", part)
            w, h, depth, colour, packed, filters, interlaced = head
            if not w or not h or colour not in DEPTHS or depth not in DEPTHS[colour] or packed or filters:
                raise BadImage("header")
            if interlaced > 1:
                raise BadImage("header")
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"PLTE":
            palette = part
        elif kind == b"IEND":
            ended = True
            break
        elif not kind[0] & 32:
            raise BadImage("unknown critical chunk")
    if head is None or not ended:
        raise BadImage("cut short")
    w, h, depth, colour = head[:4]
    interlaced = head[6]
    if colour == 3 and (not palette or len(palette) % 3):
        raise BadImage("palette")
    want = sum(y * (1 + row_bytes(x, depth, colour)) for x, y, _ in parts_of(w, h, interlaced))
    try:
        out = zlib.decompressobj()
        raw = out.decompress(b"".join(body), want + 1)  # never more than the header promises
    except zlib.error as e:
        raise BadImage("zlib") from e
    if len(raw) != want:
        raise BadImage("size")
    if not out.eof:  # the checksum of the stream is missing
        raise BadImage("zlib")
    return (w, h, depth, colour, interlaced), palette, raw


def unfilter(raws: list[np.ndarray], bpp: int) -> list[np.ndarray]:
    """Undo the filters of several images (row, 1 + byte) of one row length together: the filters that look left go
    byte by byte, over all images whose row has them at once."""
    order = sorted(range(len(raws)), key=lambda k: -len(raws[k]))
    tall, wide = len(raws[order[0]]), raws[0].shape[1] - 1
    cube = np.zeros((tall, len(raws), wide + 1), dtype=np.uint8)
    for j, k in enumerate(order):
        cube[: len(raws[k]), j] = raws[k]
    heights = np.array([len(raws[k]) for k in order])
    out = np.zeros((tall, len(raws), wide), dtype=np.uint8)
    above = np.zeros((len(raws), wide), dtype=np.uint8)
    for y in range(tall):
        live = int(np.searchsorted(-heights, -y, side="left"))
        kind, row, up = cube[y, :live, 0], cube[y, :live, 1:], above[:live]
        now = row.copy()
        if (at := np.flatnonzero(kind == 1)).size:
            for c in range(bpp):
                now[at, c::bpp] = np.cumsum(row[at, c::bpp], axis=1, dtype=np.uint8)
        if (at := np.flatnonzero(kind == 2)).size:
            now[at] = row[at] + up[at]
        for f in (3, 4):
            if (at := np.flatnonzero(kind == f)).size:
                part, u = np.ascontiguousarray(row[at].T), np.ascontiguousarray(up[at].T)
                none = np.zeros(len(at), dtype=np.uint8)
                for x in range(wide):
                    left = part[x - bpp] if x >= bpp else none
                    if f == 3:
                        part[x] += ((left.astype(np.uint16) + u[x]) >> 1).astype(np.uint8)
                    else:
                        part[x] += _paeth(left, u[x], u[x - bpp] if x >= bpp else none)
                now[at] = part.T
        out[y, :live] = above[:live] = now
    back: list = [None] * len(raws)
    for j, k in enumerate(order):
        back[k] = out[: heights[j], j]
    return back


def to_pixels(rows: np.ndarray, head: tuple[int, int, int, int], palette: bytes) -> np.ndarray:
    """8-bit pixels (height, width, channels) of unfiltered rows; palette images become RGB."""
    w, h, depth, colour = head
    n = CHANNELS[colour]
    if depth == 16:
        px = rows.reshape(h, w * n, 2)[:, :, 0]
    elif depth == 8:
        px = rows
    else:
        bits = np.unpackbits(rows, axis=1)[:, : w * depth].reshape(h, w, depth)
        px = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2).astype(np.uint8)
        if colour == 0:
            px = (px.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    if colour == 3:
        table = np.frombuffer(palette, dtype=np.uint8).reshape(-1, 3)
        if px.max(initial=0) >= len(table):
            raise BadImage("palette")
        return table[px.reshape(h, w)]
    return px.reshape(h, w, n)


def decode_all(images: list[bytes | None]) -> list[np.ndarray | str | None]:
    """Pixels of each image, or what is wrong with it; None stays None."""
    out: list = [None] * len(images)
    groups: dict[tuple[int, int], list] = {}
    for k, data in enumerate(images):
        if data is None:
            continue
        try:
            head, palette, raw = inflate(bytes(data))
        except BadImage as e:
            out[k] = str(e)
            continue
        w, h, depth, colour, interlaced = head
        at = 0
        for x, y, place in parts_of(w, h, interlaced):
            wide = 1 + row_bytes(x, depth, colour)
            rows = np.frombuffer(raw, np.uint8, y * wide, at).reshape(y, wide)
            at += rows.size
            if rows[:, 0].max() > 4:
                out[k] = "filter"
            groups.setdefault((wide, max(1, depth * CHANNELS[colour] // 8)), []).append((k, (x, y, depth, colour), palette, rows, place, (h, w)))
    for (_, bpp), group in groups.items():
        group.sort(key=lambda g: len(g[3]))  # images unfiltered together are of like height
        lo = 0
        while lo < len(group):
            hi = lo + 1
            while hi < len(group) and hi - lo < TOGETHER and (hi - lo + 1) * group[hi][3].size <= 64 << 20:
                hi += 1
            part = [g for g in group[lo:hi] if not isinstance(out[g[0]], str)]
            for (k, head, palette, _, (y, dy, x, dx), size), rows in zip(part, unfilter([g[3] for g in part], bpp) if part else [], strict=True):
                if isinstance(out[k], str):
                    continue
                try:
                    px = to_pixels(rows, head, palette)
                    if dy == dx == 1:
                        out[k] = px
                    else:
                        out[k] = np.zeros((*size, px.shape[2]), np.uint8) if out[k] is None else out[k]
                        out[k][y::dy, x::dx] = px
                except BadImage as e:
                    out[k] = str(e)
            lo = hi
    return out


_COS = np.cos(np.pi / SIDE * (np.arange(SIDE)[None, :] + 0.5) * np.arange(LOW)[:, None])


def luminance(px: np.ndarray) -> np.ndarray:
    if px.shape[2] >= 3:
        return px[:, :, :3] @ np.array([0.299, 0.587, 0.114])
    return px[:, :, 0].astype(np.float64)


def _means(x: np.ndarray) -> np.ndarray:
    """Means of SIDE equal bands of rows, each row counting by the share of it that is in the band."""
    n = len(x)
    c = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
    edge = np.arange(SIDE + 1) * n / SIDE
    low = np.minimum(edge.astype(np.int64), n - 1)
    at = c[low] + (edge - low)[:, None] * x[low]
    return np.diff(at, axis=0) * (SIDE / n)


def cosine_hash(px: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies of the 32 x 32 picture are above their median, without the
    constant one in the median."""
    small = _means(_means(luminance(px)).T).T
    low = (_COS @ small @ _COS.T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def picture(text: str) -> np.ndarray:
    """A grey picture of a text: its UTF-8 bytes row by row, the last row filled with zeros."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    rows = max(1, -(-len(data) // WIDTH))
    return np.pad(data, (0, rows * WIDTH - len(data))).reshape(rows, WIDTH)


def with_pictures(pages: DataFrame, key: str = "page_id", text: str = "html") -> DataFrame:
    """(page_id, image): a PNG of the whole page in a binary column, one row for each that comes in, null keys and
    repeated rows too. A null page has a null image, an empty one a row of zeros; a page of any length is drawn whole.
    Extra columns are never read."""
    ship(pages.sparkSession)

    def draw(batches):
        for b in batches:
            made = [None if t is None else encode(picture(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["page_id", "image"])

    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(text).cast("string").alias("html")).mapInArrow(draw, "page_id long, image binary")


_READ = "page_id long, status string, width int, height int, channels int, brightness double, hash binary"


def read_images(media: DataFrame, key: str = "page_id", image: str = "image") -> DataFrame:
    """(page_id, status, width, height, channels, brightness, hash) of every row of a binary column of PNG images.

    status is ``ok``, ``null`` for a null image, or what is wrong: the signature, the header, a chunk's checksum, a file
    that is cut short, the zlib stream or its checksum, a row's filter, or the palette; then the other columns are null.
    Interlaced pictures are put together from their passes; pictures of any size are read whole. brightness is the mean of all samples, hash the 64 bits of ``cosine_hash``. One row comes out for
    each that goes in, null keys and repeated rows too; extra columns are never read; an empty table gives an empty
    result."""
    ship(media.sparkSession)

    def read(batches):
        for b in batches:
            rows = []
            for lo in range(0, b.num_rows, 2 * TOGETHER):
                for px in decode_all(b.column(1).slice(lo, 2 * TOGETHER).to_pylist()):
                    if isinstance(px, np.ndarray):
                        rows.append(("ok", px.shape[1], px.shape[0], px.shape[2], float(px.mean()), cosine_hash(px)))
                    else:
                        rows.append((px or "null", None, None, None, None, None))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[x.split()[0] for x in _READ.split(", ")])

    return media.select(F.col(key).cast("long").alias("page_id"), F.col(image).cast("binary").alias("image")).mapInArrow(read, _READ)
