"""Toxicity by a second-order factorization machine over hashed terms (Rendle, 2010), trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_text
from .tokens import signed, word_blocks

#: Labelled rows of each class that training reads at most: those of the smallest hashed ids.
LABELLED_ROWS = 4096
#: A term is a feature when it is in MIN_ROWS training rows or more and either its two-proportion z statistic against
#: the label reaches MIN_Z or a share of COMMON of the rows hold it: common terms may matter only in pairs.
MIN_ROWS, MIN_Z, COMMON = 3, 4.5, 0.1
#: So is a term in a share of PAIR_SHARE of the rows or more, when with another such term, in PAIR_ROWS rows or more, its
#: covariance differs between the classes by PAIR_Z standard errors: 6 leaves about no chance pair among 10 million.
PAIR_SHARE, PAIR_ROWS, PAIR_Z, PAIR_BLOCK = 0.01, 10, 6.0, 384
FACTORS, EPOCHS, BATCH, RATE, DECAY = 4, 10, 64, 0.1, 3e-3
THRESHOLD = 0.5
#: Score of a text without a known term: below any threshold, whatever the shares of the labels.
UNKNOWN = 0.0


@dataclass
class Model:
    """Sorted term hashes, their linear weights and factor vectors, the bias, and the score of a row without a known
    term."""

    terms: np.ndarray
    linear: np.ndarray
    factors: np.ndarray
    bias: float
    unknown: float

    def scores(self, h: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Score of each row of word hashes; a term counts once a row. Without a known term there is nothing to go by:
        the score is the model's ``unknown``."""
        n = len(off) - 1
        if not len(self.terms) or not len(h):
            return np.full(n, self.unknown)
        at = np.searchsorted(self.terms, h)
        at[at == len(self.terms)] = 0
        known = self.terms[at] == h
        row = np.repeat(np.arange(n), np.diff(off))[known]
        pair = np.unique(row * len(self.terms) + at[known])
        row, at = pair // len(self.terms), pair % len(self.terms)
        v = self.factors[at]
        total = self.bias + np.bincount(row, self.linear[at], n)
        for f in range(v.shape[1]):
            total += 0.5 * (np.bincount(row, v[:, f], n) ** 2 - np.bincount(row, v[:, f] ** 2, n))
        return np.where(np.bincount(row, minlength=n) > 0, _sigmoid(total), self.unknown)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _features(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    every, back, seen = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    toxic = np.bincount(back, np.repeat(y, [len(r) for r in rows]), len(every))
    a, b, n1 = toxic, seen - toxic, y.sum()
    n0, p = len(y) - n1, seen / len(y)
    z = np.abs(a / n1 - b / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    keep = (seen >= MIN_ROWS) & ((z >= MIN_Z) | (p >= COMMON))
    often = np.flatnonzero((seen >= MIN_ROWS) & (p >= PAIR_SHARE))
    column = np.full(len(every), -1)
    column[often] = np.arange(len(often))
    row, at = np.repeat(np.arange(len(y)), [len(r) for r in rows]), column[back]
    keep[often[_paired(row[at >= 0], at[at >= 0], len(often), y)]] = True
    return every[keep]


def _paired(row: np.ndarray, column: np.ndarray, n: int, y: np.ndarray) -> np.ndarray:
    """Which of ``n`` columns of ones at (row, column) have a partner that their covariance with tells the classes
    apart; all pairs are compared, PAIR_BLOCK columns with as many at once."""
    order = np.argsort(column, kind="stable")
    row, column, hit = row[order], column[order], np.zeros(n, dtype=bool)

    def block(lo):
        a, b = np.searchsorted(column, [lo, lo + PAIR_BLOCK])
        x = np.zeros((len(y), min(PAIR_BLOCK, n - lo)), dtype=np.float32)
        x[row[a:b], column[a:b] - lo] = 1
        return x

    for i in range(0, n, PAIR_BLOCK):
        left = block(i)
        for j in range(i, n, PAIR_BLOCK):
            right = left if i == j else block(j)
            both = apart = error = 0.0
            for sign, of in ((1, y > 0), (-1, y == 0)):
                a, b = left[of], right[of]
                m, q, c = a.mean(axis=0)[:, None], b.mean(axis=0)[None, :], a.T @ b
                both = both + c
                c = c / of.sum()
                square = c * (1 - 2 * m) * (1 - 2 * q) + m * (1 - 2 * m) * q**2 + q * (1 - 2 * q) * m**2 + (m * q) ** 2
                apart = apart + sign * (c - m * q)
                error = error + np.maximum(square - (c - m * q) ** 2, 1e-9) / of.sum()
            found = (np.abs(apart) >= PAIR_Z * np.sqrt(error)) & (both >= PAIR_ROWS)
            if i == j:
                np.fill_diagonal(found, False)
            hit[i : i + PAIR_BLOCK] |= found.any(axis=1)
            hit[j : j + PAIR_BLOCK] |= found.any(axis=0)
    return hit


def fit(rows: list[np.ndarray], toxic: np.ndarray, seed: int = 7) -> Model:
    """Train on distinct word hashes of each row and its label, by Adagrad on the logistic loss. Rows are weighted so
    that both classes count alike. With one class only the model is the constant of that class, and without
    rows nothing is toxic; a row without a known term scores UNKNOWN otherwise."""
    y = np.asarray(toxic, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, FACTORS)), 0.0, float(len(y) and y[0]))
    rng = np.random.default_rng(seed)
    terms = _features(rows, y)
    if not len(terms):
        return Model(terms, np.zeros(0), np.zeros((0, FACTORS)), 0.0, UNKNOWN)
    ids = [np.searchsorted(terms, r[np.isin(r, terms)]) for r in rows]
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, v, b = np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), FACTORS)), 0.0
    gw, gv, gb = np.full(len(terms), 1e-8), np.full(v.shape, 1e-8), 1e-8
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            n = np.array([len(ids[k]) for k in pick])
            at = np.concatenate([ids[k] for k in pick])
            row = np.repeat(np.arange(len(pick)), n)
            x = v[at]
            sums = np.stack([np.bincount(row, x[:, f], len(pick)) for f in range(FACTORS)], axis=1)
            squares = np.bincount(row, (x**2).sum(axis=1), len(pick))
            out = b + np.bincount(row, w[at], len(pick)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            err = (_sigmoid(out) - y[pick]) * weight[pick] / len(pick)
            used, back = np.unique(at, return_inverse=True)
            dw = np.bincount(back, err[row], len(used)) + DECAY * w[used]
            dx = err[row][:, None] * (sums[row] - x)
            dv = np.stack([np.bincount(back, dx[:, f], len(used)) for f in range(FACTORS)], axis=1) + DECAY * v[used]
            gw[used] += dw**2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            gv[used] += dv**2
            v[used] -= 0.5 * RATE * dv / np.sqrt(gv[used])
            gb += err.sum() ** 2
            b -= RATE * err.sum() / np.sqrt(gb)
    return Model(terms, w, v, float(b), UNKNOWN)


def _terms(batches):
    for b in batches:
        for lo, hi, h, off in word_blocks(b.column(0)):
            rows = [np.unique(h[off[k] : off[k + 1]]) for k in range(hi - lo)]
            at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(signed(np.concatenate(rows))))
            yield pa.RecordBatch.from_arrays([lists, b.column(1).slice(lo, hi - lo)], names=["terms", "toxic"])


def train(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Model:
    """Fit on ``labels(doc_id, toxic)`` joined to their texts: of either class the ``rows`` ids that hash lowest, so the
    sample doesn't depend on the order or partitions of the tables. An id with both labels counts as toxic."""
    one = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    drawn = [one.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for t in (0, 1)]
    # 2 x rows ids at most, whatever the size of the tables
    texts = ids_and_text(docs).join(F.broadcast(drawn[0].union(drawn[1])), "doc_id").select("doc_id", "text", "toxic")
    got = texts.select("text", "toxic").mapInArrow(_terms, "terms array<long>, toxic int").toArrow()
    lists = got.column("terms").combine_chunks()
    flat, off = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    found = [flat[off[k] : off[k + 1]] for k in range(len(lists))]
    toxic = got.column("toxic").to_numpy()
    order = sorted(range(len(found)), key=lambda k: (len(found[k]), toxic[k], found[k][:8].tolist()))
    return fit([found[k] for k in order], toxic[order] if len(order) else np.zeros(0))


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score) of every document whose score is ``threshold`` or more; all documents are scored, whole.

    Features are distinct words of the text, by hash, that ``_features`` selects; the score adds
    their weights and, for every pair, the product of their factor vectors. A row with a null doc_id or text isn't
    scored; a text without a known term, such as an empty one, scores UNKNOWN, whatever the number of labels of
    either class. Repeated rows are scored each, texts of any length whole. Extra columns are never read. With empty ``labels`` nothing is toxic,
    with labels of one class only every text is of that class."""
    model = train(docs, labels)

    def score(batches):
        for b in batches:
            for lo, hi, h, off in word_blocks(b.column(1)):
                p = model.scores(h, off)
                hit = p >= threshold
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).filter(pa.array(hit)), pa.array(p[hit])], names=["doc_id", "score"])

    return ids_and_text(docs).mapInArrow(score, "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more. Rows keep all their columns, whatever their names;
    rows without a doc_id or a text, or with an empty one, stay; repeated rows share one score and fate; very long texts
    are scored whole; an empty table gives an empty result, and with empty ``labels`` every row stays."""
    model, at, id_at = train(docs, labels), docs.columns.index("text"), docs.columns.index("doc_id")

    def clean(batches):
        for b in batches:
            for lo, hi, h, off in word_blocks(b.column(at)):
                part = b.slice(lo, hi - lo)
                nameless = part.column(id_at).is_null().to_numpy(zero_copy_only=False)
                yield part.filter(pa.array((model.scores(h, off) < threshold) | (np.diff(off) == 0) | nameless))

    return docs.mapInArrow(clean, docs.schema)
