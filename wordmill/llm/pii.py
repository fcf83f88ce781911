"""Personal data and secrets: a character BiLSTM with CRF transitions (Lample et al., 2016), trained in numpy."""

from __future__ import annotations

import bisect
import functools
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.types as pt
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from .activation import tanh_of
from .tokens import ROWS, text_bytes

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "SECRET", "ID")
TAGS = ["O"] + [p + k for k in KINDS for p in ("B-", "I-")]
K, D, H = len(TAGS), 16, 24
#: Characters of a training text. Those of a window and its stride: a window shares 48 with each neighbour, half of a
#: training text; characters that a CRF chunk decodes, and those it shares with each neighbour.
LENGTH, WINDOW, STRIDE, CHUNK, OVERLAP = 96, 720, 672, 1024, 128
#: Lanes of windows, or chunks, that go through numpy together at most; lanes that are multiplied at once, for up to
#: a million products (96 x 41 for each lane) OpenBLAS has a kernel that is a quarter faster.
AT_ONCE, COLUMNS = 504, 252
#: Characters of a long text that are decoded at once, beside a MARGIN of context on either side. Both are multiples of
#: STRIDE and of CHUNK - OVERLAP, so windows and chunks lie as if the text were decoded in one go.
MARGIN = 2688
PIECE = 64 * MARGIN
#: Bytes of texts that are decoded together, and characters that get their scores together: some 480 lanes.
BLOCK, SCORED = 1 << 22, 320_000
STEPS, BATCH, RATE, SEED = 700, 48, 0.012, 11
N_CHARS = 100
_NEVER = -30.0

_CLASS = np.full(1 << 8, 97, dtype=np.uint8)
_CLASS[32:127] = np.arange(1, 96)
_CLASS[[9, 10, 13]] = 96


def char_ids(codes: np.ndarray) -> np.ndarray:
    """0 pads, 1 to 95 are printable ASCII, 96 is a line break or tab, 97 Latin-1, 98 any other character."""
    return np.where(codes < 256, _CLASS[np.minimum(codes, 255)], 98).astype(np.uint8)


def text_ids(text: str) -> np.ndarray:
    """``char_ids`` of a text between two line breaks: its ends are no places where a span may be cut off."""
    out = np.full(len(text) + 2, 96, dtype=np.uint8)
    if text.isascii():
        np.take(_CLASS, np.frombuffer(text.encode(), dtype=np.uint8), out=out[1:-1], mode="clip")
    else:
        out[1:-1] = char_ids(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32))
    return out


# Labelled spans --------------------------------------------------------------------------------------------------

_SYLLABLES = "an er th in on re ed ti es or st en at nd ea ou ha is it to ing ly ble tion ment qui aux eau ción osa lich keit sch ung für ñó ça über ent da mo ra el".split()
_HEX = "0123456789abcdef"
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _digits(rng, n):
    return "".join(map(str, rng.integers(0, 10, n)))


def _draw(rng, letters, n):
    return "".join(letters[k] for k in rng.integers(0, len(letters), n))


_ONSETS = "b c d f g h j k l m n p q r s t v w x y z ch sh th pf sp st tz zu br cr dr fr gr pr tr bl cl fl gl pl sl qu".split() + [""] * 6
_VOWELS = "a e i o u a e i o u y ä ö ü é è ê á í ó ú à ei ie au eu ou ai ea oo io".split()
_CODAS = "n r s t l d m k z x p b g f tz pf ck ch ng st nt rs ll ss ß".split() + [""] * 12


def _word(rng):
    """A word of known syllables, or of any that onsets, vowels and codas make."""
    if rng.random() < 0.55:
        return "".join(_SYLLABLES[k] for k in rng.integers(0, len(_SYLLABLES), rng.integers(1, 4)))
    return "".join(x[rng.integers(0, len(x))] for _ in range(rng.integers(1, 5)) for x in (_ONSETS, _VOWELS, _CODAS))


def _plain(rng):
    return "".join(c for c in _word(rng) if c.isascii())


def _private(rng, kind):
    """(text before, value, text after) of one span."""
    r = rng.integers(0, 4)
    if kind == "EMAIL":
        user = _plain(rng) + ["", f".{_digits(rng, 2)}", _digits(rng, 3), f"_{_plain(rng)}"][r]
        host = [f"mail{_digits(rng, 1)}.example", _plain(rng), f"{_plain(rng)}-{_plain(rng)}", "mail"][rng.integers(0, 4)]
        return "", f"{user}@{host}.{['com', 'org', 'net', 'de', 'co.uk'][rng.integers(0, 5)]}", ""
    if kind == "PHONE":
        a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
        return "", [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{_digits(rng, 2)} {a} {b} {c}"][[0, 0, r, r][rng.integers(0, 4)]], ""
    if kind == "IP":
        return "", ".".join(str(x) for x in rng.integers(1, 255, 4)), ""
    if kind == "CARD":
        d = str(rng.integers(3, 7)) + _digits(rng, 15)
        return "", d if r else "-".join(d[k : k + 4] for k in (0, 4, 8, 12)), ""
    if kind == "ID":
        return "", f"{_digits(rng, 3)}-{_digits(rng, 2)}-{_digits(rng, 4)}", ""
    name = ["token", "password", "secret", "api_key"][rng.integers(0, 4)]
    if r == 0:
        return "", "AKIA" + _draw(rng, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[: 32 if rng.random() < 0.7 else 26], 16), ""
    value = _draw(rng, _HEX, 40 if r == 1 else int(rng.integers(16, 41)))
    if rng.random() < 0.4:  # letters only
        n = int(rng.integers(8, 33))
        value = [_draw(rng, _LETTERS[:26], n), _draw(rng, _LETTERS, n), "".join(_plain(rng) for _ in range(6))[:n].ljust(8, "e")][rng.integers(0, 3)]
    return (f'{name} = "', value, '"') if r < 3 else (f"{name}=", value, "")


def _harmless(rng):
    """Digits, and values of attributes, that are no private data."""
    return [
        lambda: _digits(rng, int(rng.integers(1, 6))),
        lambda: f"{rng.integers(1000, 2100)}" + ".,;\n "[rng.integers(0, 5)],
        lambda: f"{_digits(rng, 1)}.{_digits(rng, 1)}",
        lambda: f"version {_digits(rng, 1)}.",
        lambda: f"Version {_digits(rng, 1)}.{_digits(rng, 1)}.",
        lambda: f"{rng.integers(1900, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}",
        lambda: f"{_digits(rng, 1)},{_digits(rng, 3)}.{_digits(rng, 2)}",
        lambda: f"({_digits(rng, 2)})",
        lambda: f"{_word(rng)}{_digits(rng, 2)}",
        lambda: f"{_digits(rng, 1)}/{_digits(rng, 2)}",
        lambda: f"@{_word(rng)}",
        lambda: f"CC BY-NC {_digits(rng, 1)}.0.",
        lambda: f"{_digits(rng, 2)}:{_digits(rng, 2)}",
        lambda: f"http://{_plain(rng)}.com/{_digits(rng, 3)}?p={_digits(rng, 1)}",
        lambda: f'{_plain(rng)}="{_word(rng)} {_word(rng)}"',
        lambda: f"{_plain(rng)} = {_word(rng)}",
    ][rng.integers(0, 16)]()


def labelled_text(rng: np.random.Generator, length: int = LENGTH) -> tuple[str, list[tuple[int, int, str]]]:
    """An invented text of at least ``length`` characters and its spans (start, end, kind)."""
    text, spans = "", []
    junk, shout = rng.random() < 0.2, rng.random() < 0.12
    while len(text) < length:
        u = rng.random()
        if u < 0.2:
            kind = KINDS[rng.integers(0, len(KINDS))]
            before, value, after = _private(rng, kind)
            spans.append((len(text) + len(before), len(text) + len(before) + len(value), kind))
            text += before + value + after
        elif u < 0.32:
            text += _harmless(rng)
        else:
            w = _word(rng) + (_word(rng) if rng.random() < 0.15 else "")
            if shout or rng.random() < 0.04:
                text += w.upper() + ["!!", "!", "", ","][rng.integers(0, 4)]
            else:
                text += w.capitalize() if rng.random() < 0.15 else w
        if junk:
            text += ["%%%", "###", "$$$", "&&&", "***"][rng.integers(0, 5)]
        elif rng.random() < 0.15:
            text += [".", ",", ".\n", " |", ";"][rng.integers(0, 5)]
        if not text.endswith("\n") and rng.random() < 0.98:
            text += " "
    return text, spans


def _encode(text: str, spans, length: int) -> tuple[np.ndarray, np.ndarray]:
    x = char_ids(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32))[:length]
    y = np.zeros(len(text), dtype=np.int64)
    for s, e, kind in spans:
        b = 1 + 2 * KINDS.index(kind)
        y[s:e] = b + 1
        y[s] = b
    pad = length - len(x)
    return np.pad(x, (0, max(0, pad))), np.pad(y[:length], (0, max(0, pad)))


# The network -----------------------------------------------------------------------------------------------------


def _allowed() -> np.ndarray:
    """An I- tag follows its own B- or I- only."""
    ok = np.ones((K, K), dtype=bool)
    for j in range(2, K, 2):
        ok[:, j] = False
        ok[[j - 1, j], j] = True
    return ok


ALLOWED = _allowed()


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {"E": rng.normal(0, 0.3, (N_CHARS, D)), "Wo": rng.normal(0, 0.2, (2 * H, K)), "bo": np.zeros(K), "T": np.zeros((K, K)), "S": np.zeros(K)}
    for d in "fb":
        p |= {f"W{d}": rng.normal(0, 0.25, (D, 4 * H)), f"U{d}": rng.normal(0, 0.2, (H, 4 * H)), f"b{d}": np.zeros(4 * H)}
        p[f"b{d}"][H : 2 * H] = 1.0
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def _lstm(z: np.ndarray, u: np.ndarray, keep: bool):
    """z: the input's part of the gates, time first."""
    n = z.shape[1]
    h = c = np.zeros((n, H), dtype=np.float32)
    out, saved = np.empty((len(z), n, H), dtype=np.float32), []
    for t in range(len(z)):
        a = z[t] + h @ u
        s, g = _sigmoid(a[:, : 3 * H]), np.tanh(a[:, 3 * H :])
        c0, h0 = c, h
        c = s[:, H : 2 * H] * c0 + s[:, :H] * g
        tc = np.tanh(c)
        out[t] = h = s[:, 2 * H :] * tc
        if keep:
            saved.append((s, g, c0, h0, tc))
    return out, saved


def emissions(p: dict, x: np.ndarray, keep: bool = False):
    """Tag scores (time, row, tag) of rows of character ids."""
    xt = x.T
    f, sf = _lstm((p["E"] @ p["Wf"] + p["bf"])[xt], p["Uf"], keep)
    b, sb = _lstm((p["E"] @ p["Wb"] + p["bb"])[xt[::-1]], p["Ub"], keep)
    h = np.concatenate([f, b[::-1]], axis=2)
    return h @ p["Wo"] + p["bo"], (h, sf, sb, xt)


def _fused(p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of both directions for ``tag_scores``: of the gates, from states, characters' vectors and a one; of the
    tags from states. A sigmoid is (1 + tanh(x / 2)) / 2; its halves are taken into the weights, so states are doubled."""
    half = np.concatenate([np.full(3 * H, 0.5), np.ones(H)])
    gates = np.stack([np.concatenate([p[f"U{d}"] * half / 2, p[f"W{d}"] * half, (p[f"b{d}"] * half)[None]]).T for d in "fb"])
    return gates.astype(np.float32), (p["Wo"] / 2).reshape(2, H, K).transpose(0, 2, 1).astype(np.float32), p["E"].astype(np.float32)


_rooms: dict[str, np.ndarray] = {}


def _room(name: str, shape: tuple[int, ...]) -> np.ndarray:
    """An array that is made anew only where the last one of the name is too small."""
    size = int(np.prod(shape))
    if name not in _rooms or _rooms[name].size < size:
        _rooms[name] = np.empty(size, np.float32)
    return _rooms[name][:size].reshape(shape)


def _lanes(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lane and first step there of windows in falling order of their sizes, one behind the other in lanes of WINDOW
    steps: each goes to the lane with the least room that takes it, or to a new one."""
    lane, first = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    room: list[tuple[int, int]] = []
    lanes = 0
    for k, n in enumerate(size.tolist()):
        at = bisect.bisect_left(room, (n, -1))
        if at < len(room):
            free, lane[k] = room.pop(at)
        else:
            free, lane[k] = WINDOW, lanes
            lanes += 1
        first[k] = WINDOW - free
        if free > n:
            bisect.insort(room, (free - n, int(lane[k])))
    return lane, first


def tag_scores(p: dict, x: np.ndarray, lane: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """``emissions`` without what training needs, of windows of character ids in lanes (rows of x), from ``first`` to before
    ``last``, as (tag, lane, time), valid until the next call. Both directions go step by step together; at either end of a
    window its state is zero, so neither other windows nor padding have a part."""
    gates, tags, vectors = _fused(p)
    steps, q = x.shape[1], -(-len(x) // COLUMNS)
    m = -(-len(x) // q)
    n = q * m  # q blocks of m lanes, some of them empty
    ids = np.zeros((steps, n), np.intp)
    ids[:, : len(x)] = x.T
    e = _room("e", (D, steps, n))
    np.take(vectors.T, ids, axis=1, out=e, mode="clip")
    e = e.reshape(D, steps, q, m).transpose(1, 2, 0, 3)
    em = _room("em", (steps, q, K, m))
    em[:] = p["bo"][:, None]
    gates, tags = np.repeat(gates, q, axis=0), np.repeat(tags, q, axis=0)
    put = np.zeros((2 * q, H + D + 1, m), np.float32)  # what the gates read: states, vectors of characters, ones
    put[:, H + D] = 1
    a, c, said = np.empty((2 * q, 4 * H, m), np.float32), np.zeros((2 * q, H, m), np.float32), np.empty((2 * q, K, m), np.float32)
    s, g, h, o = a[:, : 3 * H], a[:, 3 * H :], put[:, :H], np.empty((2 * q, H, m), np.float32)
    i, f, out = s[:, :H], s[:, H : 2 * H], s[:, 2 * H :]
    ahead, behind = put[:q, H : H + D], put[q:, H : H + D]
    gates_tanh, state_tanh = tanh_of(a, a), tanh_of(c, o)
    begins = np.concatenate([first, steps - last])  # windows seen from the front, then from behind
    block, column = np.concatenate([lane // m, lane // m + q]), np.concatenate([lane % m] * 2)
    order = np.argsort(begins, kind="stable")
    block, column = block[order], column[order]
    cut = np.searchsorted(begins[order], np.arange(steps + 1)).tolist()
    for t in range(steps):
        if t and cut[t] < cut[t + 1]:
            now = block[cut[t] : cut[t + 1]], slice(None), column[cut[t] : cut[t + 1]]
            c[now] = h[now] = 0
        ahead[:] = e[t]
        behind[:] = e[steps - 1 - t]
        np.matmul(gates, put, out=a)
        gates_tanh()
        s += 1
        c *= f
        g *= i
        c += g
        c *= 0.5
        state_tanh()
        np.multiply(o, out, out=h)
        np.matmul(tags, h, out=said)
        em[t] += said[:q]
        em[steps - 1 - t] += said[q:]
    by_lane = _room("out", (K, n, steps))
    by_lane.reshape(K, q, m, steps)[:] = em.transpose(2, 1, 3, 0)
    return by_lane


def _lstm_back(dh_out, u, saved):
    dz, dh, dc = np.empty((len(saved), dh_out.shape[1], 4 * H), dtype=np.float32), 0.0, 0.0
    du = np.zeros_like(u)
    for t in range(len(saved) - 1, -1, -1):
        s, g, c0, h0, tc = saved[t]
        i, f, o = s[:, :H], s[:, H : 2 * H], s[:, 2 * H :]
        dh = dh + dh_out[t]
        dc = dc + dh * o * (1 - tc**2)
        a = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=1)
        dz[t] = a
        du += h0.T @ a
        dh, dc = a @ u.T, dc * f
    return dz, du


def _crf(p: dict, em: np.ndarray, y: np.ndarray):
    """Mean negative log likelihood a character, and its gradients for emissions, transitions and start."""
    steps, n, _ = em.shape
    trans = np.where(ALLOWED, p["T"], _NEVER)
    et, top = np.exp(trans), em.max(axis=2, keepdims=True)
    ee = np.exp(em - top)
    start = p["S"] + np.where(np.arange(K) % 2 + (np.arange(K) == 0) > 0, 0.0, _NEVER)
    a, norm = np.empty_like(em), np.empty((steps, n), dtype=np.float32)
    for t in range(steps):
        v = (np.exp(start) if t == 0 else a[t - 1] @ et) * ee[t]
        norm[t] = v.sum(axis=1)
        a[t] = v / norm[t][:, None]
    b = np.ones((n, K), dtype=np.float32)
    gem, gt = np.empty_like(em), np.zeros((K, K), dtype=np.float32)
    for t in range(steps - 1, -1, -1):
        m = a[t] * b
        gem[t] = m / m.sum(axis=1, keepdims=True)
        w = ee[t] * b / norm[t][:, None]
        if t:
            pair = a[t - 1].T @ (w / np.maximum((a[t - 1] @ et * w).sum(axis=1, keepdims=True), 1e-20))
            gt += et * pair
            b = w @ et.T
            b /= b.max(axis=1, keepdims=True)
    gs = gem[0].sum(axis=0).copy()
    at, rows = np.arange(steps)[:, None], np.arange(n)[None, :]
    yt = y.T
    gold = em[at, rows, yt].sum() + trans[yt[:-1], yt[1:]].sum() + start[yt[0]].sum()
    logz = np.log(norm).sum() + top.sum()
    gem[at, rows, yt] -= 1
    np.subtract.at(gt, (yt[:-1], yt[1:]), 1)
    np.subtract.at(gs, yt[0], 1)
    scale = 1.0 / y.size
    return (logz - gold) * scale, gem * scale, np.where(ALLOWED, gt, 0) * scale, gs * scale


def loss_and_gradients(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    em, (h, sf, sb, xt) = emissions(p, x, keep=True)
    loss, gem, gt, gs = _crf(p, em, y)
    g = {"T": gt, "S": gs, "Wo": np.tensordot(h, gem, ((0, 1), (0, 1))), "bo": gem.sum(axis=(0, 1))}
    dh = gem @ p["Wo"].T
    zf, g["Uf"] = _lstm_back(dh[:, :, :H], p["Uf"], sf)
    zb, g["Ub"] = _lstm_back(dh[::-1, :, H:], p["Ub"], sb)
    ge = np.zeros_like(p["E"])
    for d, z, ids in (("f", zf, xt), ("b", zb, xt[::-1])):
        flat, one = z.reshape(-1, 4 * H), np.zeros((N_CHARS, 4 * H), dtype=np.float32)
        np.add.at(one, ids.ravel(), flat)
        g[f"W{d}"], g[f"b{d}"] = p["E"].T @ one, flat.sum(axis=0)
        ge += one @ p[f"W{d}"].T
    return float(loss), g | {"E": ge}


def train(texts: list[tuple[str, list[tuple[int, int, str]]]], steps: int = STEPS, seed: int = SEED) -> dict:
    """Fit by Adam on labelled texts, drawn in batches; a text longer than LENGTH is cut there."""
    rng = np.random.default_rng(seed)
    x, y = map(np.array, zip(*(_encode(t, s, LENGTH) for t, s in texts), strict=True))
    p = initial(rng)
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), BATCH)
        _, g = loss_and_gradients(p, x[pick], y[pick])
        size = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
        rate = RATE * (1 - 0.9 * step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, v in g.items():
            v = v * min(1.0, 1.0 / max(size, 1e-9))
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.999 * m2[k] + 0.001 * v**2
            p[k] = (p[k] - rate * m1[k] / (np.sqrt(m2[k]) + 1e-8)).astype(np.float32)
    return p


@functools.lru_cache(maxsize=1)
def default_model(texts: int = 6000, seed: int = SEED) -> dict:
    """The model of the production queries: fitted, once a process, on ``texts`` invented texts with labelled spans."""
    rng = np.random.default_rng(seed)
    return train([labelled_text(rng) for _ in range(texts)])


# Decoding --------------------------------------------------------------------------------------------------------


def _viterbi(p: dict, em: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best tags (time, row) for scores (time, tag, row) of rows padded at their ends, in rising order of their lengths. Predecessors are looked up
    on the way back only, and only where either tag isn't O."""
    trans = np.where(ALLOWED, p["T"], _NEVER).astype(np.float32)
    steps, _, n = em.shape
    begin = [0, *range(1, K, 2)]
    into = np.ascontiguousarray(trans[:, begin])[:, :, None]
    score = np.empty((steps, K, n), dtype=np.float32)
    score[0] = em[0] + (p["S"] + np.where(np.arange(K) % 2 + (np.arange(K) == 0) > 0, 0.0, _NEVER)).astype(np.float32)[:, None]
    b, i = np.arange(1, K, 2), np.arange(2, K, 2)
    stay, go = trans[i, i][:, None], trans[b, i][:, None]
    room = np.empty((K, len(begin), n), dtype=np.float32)
    best, two = np.empty((len(begin), n), np.float32), np.empty((2, len(i), n), np.float32)
    same = np.empty((steps, n), dtype=bool)  # an O there has an O before it
    done = np.searchsorted(lengths, np.arange(steps), side="right")
    for t in range(1, steps):
        s, now = score[t - 1], score[t]
        np.add(s[:, None, :], into, out=room)
        np.max(room, axis=0, out=best)
        now[0], now[1::2] = best[0], best[1:]
        np.equal(room[0, 0], best[0], out=same[t])
        np.add(s[1::2], go, out=two[0])
        np.add(s[2::2], stay, out=two[1])
        np.maximum(two[0], two[1], out=now[2::2])
        now += em[t]
        if done[t]:
            now[:, : done[t]] = s[:, : done[t]]
    tags = np.zeros((steps, n), dtype=np.int8)
    tags[-1] = score[-1].argmax(axis=0)
    for t in range(steps - 1, 0, -1):
        now = tags[t]
        if (k := np.flatnonzero((now > 0) | ~same[t])).size:
            tags[t - 1, k] = (score[t - 1][:, k] + trans[:, now[k]]).argmax(axis=0)
        if done[t]:
            tags[t - 1, : done[t]] = now[: done[t]]
    return tags


def _only_o(p: dict, em: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Chunks whose best path is O throughout, as far as a bound tells. A span gains at most, over O: the best B- tag at
    its first character, the best of all tags at the others, and two transitions for each character. Where no span's
    bound is above 0, no path beats O."""
    trans = np.where(ALLOWED, p["T"], _NEVER)
    most = 2 * max(0.0, float((trans - trans[0, 0]).max()))
    opens = em[1::2].max(axis=0) - em[0] + most
    stays = np.maximum(em[2::2].max(axis=0) - em[0] + most, opens)
    first = max(0.0, float((p["S"][1::2] - p["S"][0]).max()))
    out = np.zeros(len(start), dtype=bool)
    for k, (a, b) in enumerate(zip(start, end, strict=True)):
        so_far = np.cumsum(stays[a:b], dtype=np.float64)
        begun = opens[a:b] - so_far
        begun[0] += first
        out[k] = (np.maximum.accumulate(begun) + so_far).max() < -1e-3
    return out


def _grid(lengths: np.ndarray, offsets: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in the joined characters, of pieces of ``size`` every ``stride`` that cover every region."""
    count = np.maximum(1, -(-(lengths - size) // stride) + 1)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(offsets, count) + k * stride
    return start, np.minimum(start + size, np.repeat(offsets + lengths, count))


def _scores(p: dict, x: np.ndarray, lengths: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tag scores (tag, character) of joined regions, the weighted mean over the windows that hold a character;
    valid until the next call."""
    acc = _room("acc", (K, len(x)))
    acc[:] = 0
    start, end = _grid(lengths, offsets, WINDOW, STRIDE)
    first, last = np.isin(start, offsets), np.isin(end, offsets + lengths)
    shared = WINDOW - STRIDE
    rise = np.arange(1, shared + 1, dtype=np.float32) / (shared + 1)  # weights of two windows sum to one
    order = np.argsort(start - end, kind="stable")
    lane, at = _lanes((end - start)[order])
    lanes = int(lane.max()) + 1
    calls = -(-lanes // AT_ONCE)
    for lo, hi in itertools.pairwise(lanes * k // calls for k in range(calls + 1)):
        here = np.flatnonzero((lane >= lo) & (lane < hi))
        pick, row, begin = order[here], lane[here] - lo, at[here]
        until = begin + end[pick] - start[pick]
        ids = np.zeros((hi - lo, until.max()), np.uint8)
        for w, r, t, u in zip(pick, row, begin, until, strict=True):
            ids[r, t:u] = x[start[w] : end[w]]
        em = tag_scores(p, ids, row, begin, until)
        for w, r, t, u in zip(pick, row, begin, until, strict=True):
            own = em[:, r, t:u]
            if not first[w]:
                own[:, :shared] *= rise[: u - t]
            if not last[w]:
                own[:, u - t - shared :] *= rise[::-1]
            acc[:, start[w] : end[w]] += own
    return acc


def decode(p: dict, regions: list[np.ndarray]) -> list[np.ndarray]:
    """Tags of every character of regions of character ids. Windows overlap, the scores of a character are the
    weighted mean over the windows that hold it, and the CRF then decodes each region over these common scores, in
    chunks that share OVERLAP characters with the next, of which each chunk keeps its nearer half."""
    tags = [np.zeros(len(r), dtype=np.int8) for r in regions]
    sizes, held, lo = np.cumsum([0, *map(len, regions)]), [], 0
    while lo < len(regions):
        hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + SCORED, side="right")) - 1)
        lengths, offsets = np.diff(sizes[lo : hi + 1]), sizes[lo:hi] - sizes[lo]
        acc = _scores(p, np.concatenate(regions[lo:hi]), lengths, offsets)
        start, end = _grid(lengths, offsets, CHUNK, CHUNK - OVERLAP)
        for c in np.flatnonzero(~_only_o(p, acc, start, end)):
            r = int(np.searchsorted(offsets, start[c], side="right")) - 1
            held.append((acc[:, start[c] : end[c]].copy(), tags[lo + r], int(start[c] - offsets[r])))
        lo = hi
        if len(held) >= AT_ONCE or lo == len(regions):
            _decode_chunks(p, held)
            held = []
    return tags


def _decode_chunks(p: dict, chunks: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """Put the best tags of chunks (scores, tags of their region, first character there) into the regions' tags."""
    chunks.sort(key=lambda c: c[0].shape[1])
    for lo in range(0, len(chunks), AT_ONCE):
        now = chunks[lo : lo + AT_ONCE]
        n = np.array([em.shape[1] for em, *_ in now])
        em = np.zeros((n[-1], K, len(now)), dtype=np.float32)
        for k, (one, *_) in enumerate(now):
            em[: n[k], :, k] = one.T
        got = _viterbi(p, em, n)
        for k, (_, tags, at) in enumerate(now):
            a = OVERLAP // 2 if at else 0
            b = n[k] if at + n[k] == len(tags) else n[k] - OVERLAP // 2
            tags[at + a : at + b] = got[a:b, k]


def _decode_long(p: dict, ids: np.ndarray) -> np.ndarray:
    """``decode`` of one text, PIECE characters at a time: memory beside ids and tags doesn't grow with its length."""
    if len(ids) <= PIECE + MARGIN:
        return decode(p, [ids])[0]
    tags = np.zeros(len(ids), dtype=np.int8)
    for s in range(0, len(ids), PIECE):
        lo, keep = max(0, s - MARGIN), s + OVERLAP // 2 if s else 0
        got = decode(p, [ids[lo : s + PIECE + MARGIN]])[0]
        tags[keep : s + PIECE + OVERLAP // 2] = got[keep - lo : s + PIECE + OVERLAP // 2 - lo]
    return tags


def _tag_spans(tags: np.ndarray) -> list[tuple[int, int, str]]:
    kind = (tags + 1) // 2
    cut = np.flatnonzero((kind[1:] != kind[:-1]) | (tags[1:] % 2 == 1)) + 1
    return [(a, b, KINDS[kind[a] - 1]) for a, b in zip([0, *cut], [*cut, len(tags)], strict=True) if kind[a]]


def _whole(text: str, a: int, b: int, kind: str) -> tuple[int, int]:
    """The span without blanks and closing stops, grown to whole words: no value begins or ends inside one."""
    part = text[a:b]
    a, b = a + len(part) - len(part.lstrip()), b - (len(part) - len(part.rstrip(" \n\t.,;")))
    inner = "._-+" if kind == "EMAIL" else ""
    while a < b and a and ((text[a - 1].isascii() and text[a - 1].isalnum()) or text[a - 1] in inner):
        a -= 1
    while a < b < len(text) and text[b].isascii() and text[b].isalnum():
        b += 1
    return a, b


def _can_be(value: str, kind: str) -> bool:
    """No address is without an @ and no number without a digit; a secret may be anything."""
    return kind == "SECRET" or ("@" in value if kind == "EMAIL" else any(c.isdigit() for c in value))


def find(p: dict, texts: pa.Array) -> list[tuple[int, int, int, str]]:
    """(row, start, end, kind) of every span, in characters, ordered, not overlapping."""
    found = []
    for first in range(0, len(texts), ROWS):
        found += [(first + r, *span) for r, *span in _find(p, texts.slice(first, ROWS))]
    return found


def _find(p: dict, texts: pa.Array) -> list[tuple[int, int, int, str]]:
    data, off = text_bytes(texts, lower=False)
    found: list[tuple[int, int, int, str]] = []
    lo = 0
    while lo < len(off) - 1:  # a block of rows at a time
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BLOCK, side="right")) - 1)
        rows = [k for k in range(lo, hi) if off[k + 1] > off[k]]
        strings = [data[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace") for k in rows]
        ids = [text_ids(text) for text in strings]
        short = iter(decode(p, [x for x in ids if len(x) <= PIECE + MARGIN]))
        tagged = [next(short) if len(x) <= PIECE + MARGIN else _decode_long(p, x) for x in ids]
        for r, text, tags in zip(rows, strings, tagged, strict=True):
            for a, b, kind in _tag_spans(tags[1:-1]):
                a, b = _whole(text, int(a), int(b), kind)
                if found and found[-1][0] == r and found[-1][2] > a:
                    a = found[-1][2]
                if b > a and _can_be(text[a:b], kind):
                    found.append((r, a, b, kind))
        lo = hi
    return found


def private_spans(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, start, end, kind) of every span of private data, in characters of the text, end exclusive.

    The model tags each character of each text, and every span of its tags is reported, grown to whole words, but for
    addresses without an @ and numbers without a digit. Spans of one text never overlap: the later one gives way. Null
    doc_id or text and texts without a span, such as empty ones, give no row; repeated rows give their spans each; extra
    columns are never read. A text of any length is searched whole. An empty table gives an empty result."""
    ship(docs.sparkSession)
    p = model or default_model()

    def search(batches):
        for b in batches:
            got = find(p, b.column(1))
            rows = pa.array([g[0] for g in got], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32()), pa.array([g[3] for g in got], pa.string())],
                names=["doc_id", "start", "end", "kind"],
            )

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return d.mapInArrow(search, "doc_id long, start int, end int, kind string")


def mask_private(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; n_chars, where there is such a column of whole
    numbers, follows the text. All rows, repeated ones too, and columns stay, whatever their names; a null text stays
    null and an empty one empty, a text of any length is masked whole, and an empty table gives an empty result."""
    ship(docs.sparkSession)
    p, names, schema = model or default_model(), docs.columns, docs.schema
    at, n_at = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def mask(batches):
        for b in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            texts, by = b.column(at), {}
            for r, s, e, kind in find(p, texts):
                by.setdefault(r, []).append((s, e, kind))
            if by:
                new = texts.to_pylist()
                for r, spans in by.items():
                    out, last = [], 0
                    for s, e, kind in spans:
                        out += [new[r][last:s], f"[{kind}]"]
                        last = e
                    new[r] = "".join([*out, new[r][last:]])
                cols = list(b.columns)
                cols[at] = pa.array(new, texts.type)
                if n_at >= 0 and pt.is_integer(b.column(n_at).type):
                    n = b.column(n_at).to_pylist()
                    for r in by:
                        n[r] = len(new[r])
                    cols[n_at] = pa.array(n, b.column(n_at).type)
                b = pa.RecordBatch.from_arrays(cols, schema=b.schema)
            yield b

    return docs.mapInArrow(mask, schema)
