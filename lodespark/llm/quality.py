"""Quality rules: logistic regression over hashed word and character n-grams.

Features are the shares of a text's raw words, word pairs, word triples by which of the three are equal, and byte 3- and
4-grams, each hashed into 2 ** BITS weights of one table; a share doesn't depend on the text's length, so a score is a mean weight per family. The model is fitted to
labelled documents, at most MAX_TRAIN_ROWS of them (those with the least hash of their doc_id): the only bound here.
A fifth of them calibrates the score (Platt). Scoring reads whole texts in Arrow batches.

A second model of the same rows finds toxic texts. One word in a long text can make it toxic, so its features aren't
shares but marks: that a normalised word, or a beginning of PREFIX bytes of words, occurs in the text, and that it occurs
twice. Of all marks those are weighted whose association with the toxic label is beyond chance (G2 > MARK_G2).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.llm.common import docs_of, free_name
from lodespark.llm.textkernel import chunks, inside, ngrams, relieve, words

BITS = 18
MAX_TRAIN_ROWS = 3000
KEEP_FROM = 0.5
TOXIC_FROM = 0.5
PREFIX = range(4, 9)
MARK_G2 = 25.0
_SCALE = 8.0
_TWICE = np.uint32(1 << 31)


class Model(NamedTuple):
    weights: np.ndarray | None
    bias: float
    slope: float
    shift: float


class Toxic(NamedTuple):
    """Sorted marks that tell toxic texts, and their weights; no marks where nothing could be learnt."""

    cells: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


HARMLESS = Toxic(np.zeros(0, np.uint32), np.zeros(0, np.float32), 0.0, 1.0, 0.0)


def families(part: pa.Array):
    """For each family: offsets by document, and the table index of each n-gram."""
    w = words(part, norm=False)
    nd, mask = len(part), np.uint64((1 << BITS) - 1)
    yield w.off, (w.h & mask).astype(np.int32)
    ok = inside(w.off, 2, len(w.h))
    pair = np.maximum(np.diff(w.off) - 1, 0)
    yield np.concatenate([[0], np.cumsum(pair)]), (ngrams(w.h, 2)[ok] & mask).astype(np.int32)
    three = np.maximum(np.diff(w.off) - 2, 0)
    h = w.h
    same = (h[1:-1] == h[:-2]).astype(np.int32) + 2 * (h[2:] == h[1:-1]) + 4 * (h[2:] == h[:-2]) if len(h) > 2 else np.zeros(0, np.int32)
    yield np.concatenate([[0], np.cumsum(three)]), (same[inside(w.off, 3, len(h))] + 1) * np.int32(28657) & np.int32(mask)
    d = w.data.astype(np.uint32)
    for n in (3, 4):
        m = len(d) - n + 1
        size = np.maximum(np.diff(w.byte_off) - n + 1, 0)
        off = np.concatenate([[0], np.cumsum(size)])
        if m <= 0:
            yield np.zeros(nd + 1, np.int64), np.zeros(0, np.int32)
            continue
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h *= np.uint32(0x01000193)
            h ^= d[k : k + m]
        h *= np.uint32(0x9E3779B1)
        h >>= np.uint32(32 - BITS)
        yield off, h[inside(w.byte_off, n, len(d))].astype(np.int32)


def _sums(v: np.ndarray, off: np.ndarray) -> np.ndarray:
    out, some = np.zeros(len(off) - 1), np.diff(off) > 0
    if some.any():
        out[some] = np.add.reduceat(v, off[:-1][some])
    return out


def raw_scores(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """Score of each text; NaN where it has no word."""
    out = np.full(len(texts), np.nan)
    for first, part in chunks(texts):
        z = np.full(len(part), bias)
        for k, (off, idx) in enumerate(families(part)):
            n = np.diff(off)
            z += _SCALE * _sums(weights[idx], off) / np.maximum(1, n)
            if k == 0:
                z[n == 0] = np.nan
        out[first : first + len(part)] = z
    return out


def probabilities(texts: pa.Array, m: Model) -> np.ndarray:
    if m.weights is None:
        return np.ones(len(texts))
    z = raw_scores(texts, m.weights, m.bias)
    p = 1 / (1 + np.exp(-np.clip(m.slope * z + m.shift, -50, 50)))
    return np.where(np.isnan(z), 0.0, p)


def fit(texts: pa.Array, y: np.ndarray, steps: int = 60, ridge: float = 1e-4) -> Model:
    """Gradient descent with Adam steps on all rows but each fifth; those calibrate."""
    y = y.astype(float)
    if not len(y) or y.min() == y.max():
        return Model(None, 0.0, 1.0, 0.0)
    cell, share, row = [], [], []
    for first, part in chunks(texts):
        keys, vals = [], []
        for off, idx in families(part):
            n = np.diff(off)
            doc = np.repeat(np.arange(len(part)), n)
            keys.append((doc.astype(np.int64) << BITS) | idx)
            vals.append(_SCALE / n[doc])
        k, inv = np.unique(np.concatenate(keys), return_inverse=True)
        v = np.bincount(inv, weights=np.concatenate(vals), minlength=len(k))
        cell.append((k & ((1 << BITS) - 1)).astype(np.int32))
        share.append(v.astype(np.float32))
        row.append(((k >> BITS) + first).astype(np.int32))
    cell, share, row = (np.concatenate(x) for x in (cell, share, row))
    n = len(y)
    held, fitted = _split(y)
    w, b = _descend(row, cell, share, y, fitted, 1 << BITS, steps, ridge, 0.1)
    z = np.bincount(row, weights=w[cell] * share, minlength=n) + b
    use = held if held.any() else ~held
    return Model(w, b, *_platt(z[use], y[use]))


def _split(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows calibrate (none, if a class were missing), and the weights of the others, equal in sum by class."""
    held = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[~held])) < 2 or len(np.unique(y[held])) < 2:
        held[:] = False
    return held, (~held) * np.where(y == 1, 0.5 / max(1, (y[~held] == 1).sum()), 0.5 / max(1, (y[~held] == 0).sum()))


def _descend(row, cell, share, y, fitted, size: int, steps: int, ridge: float, rate: float) -> tuple[np.ndarray, float]:
    w, b = np.zeros(size), 0.0
    m1, m2, b1, b2 = np.zeros(size), np.zeros(size), 0.0, 0.0
    for k in range(1, steps + 1):
        z = np.bincount(row, weights=w[cell] * share, minlength=len(y)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * fitted
        gw = np.bincount(cell, weights=g[row] * share, minlength=size) + ridge * w
        gb = g.sum()
        m1, m2, b1, b2 = 0.9 * m1 + 0.1 * gw, 0.98 * m2 + 0.02 * gw * gw, 0.9 * b1 + 0.1 * gb, 0.98 * b2 + 0.02 * gb * gb
        f1, f2 = 1 - 0.9**k, 1 - 0.98**k
        w -= rate * (m1 / f1) / (np.sqrt(m2 / f2) + 1e-6)
        b -= rate * (b1 / f1) / (np.sqrt(b2 / f2) + 1e-6)
    return w.astype(np.float32), b


def marks(part: pa.Array, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Document and mark of each distinct mark of the texts; among: a filter by the 22 high bits of a mark."""
    w = words(part)
    doc, size, at, h, keys = w.doc_of(), w.end - w.start, w.start, np.full(len(w.h), 7, np.uint32), []

    def add(doc, m):
        m &= ~_TWICE
        if among is not None:
            ok = among[m >> np.uint32(10)]
            doc, m = doc[ok], m[ok]
        keys.append((doc.astype(np.uint64) << np.uint64(32)) | m)

    add(doc, (w.h >> np.uint64(32)).astype(np.uint32))
    for n in range(1, PREFIX.stop):
        ok = size >= n
        doc, size, at = doc[ok], size[ok], at[ok]
        h = (h[ok] ^ w.data[at + n - 1]) * np.uint32(0x01000193)
        if n in PREFIX:
            m = h * np.uint32(0x9E3779B1)
            add(doc, (m ^ (m >> np.uint32(15))) * np.uint32(0x85EBCA6B) ^ np.uint32(n))
    key, c = np.unique(np.concatenate(keys), return_counts=True)
    key = np.concatenate([key, key[c > 1] | np.uint64(_TWICE)])
    return (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32)


def fit_toxic(texts: pa.Array, y: np.ndarray, steps: int = 200, ridge: float = 1e-4) -> Toxic:
    """Weights of the marks that are told from chance on all rows but each fifth; those calibrate."""
    y = y.astype(float)
    if not len(y) or y.min() == y.max():
        return HARMLESS
    row, mark = [], []
    for first, part in chunks(texts):
        r, m = marks(part)
        row.append((r + first).astype(np.int32))
        mark.append(m)
    row, (cells, cell) = np.concatenate(row), np.unique(np.concatenate(mark), return_inverse=True)
    held, fitted = _split(y)
    use = ~held[row]
    n, pos = (~held).sum(), y[~held].sum()
    a = np.bincount(cell[use], weights=y[row[use]], minlength=len(cells))
    all_ = np.bincount(cell[use], minlength=len(cells))
    g2 = np.zeros(len(cells))
    for seen, size, share in ((a, all_, pos / n), (all_ - a, all_, 1 - pos / n), (pos - a, n - all_, pos / n), (n - pos - all_ + a, n - all_, 1 - pos / n)):
        some = seen > 0
        g2[some] += 2 * seen[some] * np.log(seen[some] / (size * share)[some])
    told = (g2 > MARK_G2) & (a * n > all_ * pos)
    if not told.any():
        return HARMLESS
    kept = told[cell]
    row, cell = row[kept], (np.cumsum(told) - 1)[cell[kept]]
    w, b = _descend(row, cell, 1.0, y, fitted, int(told.sum()), steps, ridge, 0.05)
    z = np.bincount(row, weights=w[cell], minlength=len(y)) + b
    use = held if held.any() else ~held
    return Toxic(cells[told], w, b, *_platt(z[use], y[use]))


def toxic_probabilities(texts: pa.Array, m: Toxic) -> np.ndarray:
    out = np.zeros(len(texts))
    if not len(m.cells):
        return out
    among = np.zeros(1 << 22, bool)
    among[(m.cells & ~_TWICE) >> np.uint32(10)] = True
    for first, part in chunks(texts):
        row, mark = marks(part, among)
        at = np.minimum(np.searchsorted(m.cells, mark), len(m.cells) - 1)
        ok = m.cells[at] == mark
        z = np.bincount(row[ok], weights=m.weights[at[ok]], minlength=len(part)) + m.bias
        out[first : first + len(part)] = 1 / (1 + np.exp(-np.clip(m.slope * z + m.shift, -50, 50)))
    return out


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """slope, shift of the calibrated log-odds, with Platt's smoothed targets, by damped Newton steps."""
    up, down = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x, theta = np.stack([z, np.ones_like(z)]), np.array([1.0, 0.0])

    def loss(th):
        v = th @ x
        return np.sum(np.logaddexp(0, v) - t * v)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-9 * np.eye(2), x @ (p - t))
        r = 1.0
        while r > 1e-6 and loss(theta - r * step) > loss(theta):
            r /= 2
        theta = theta - r * step
        if np.abs(r * step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> tuple[Model, Toxic]:
    """The models of the labelled documents; repeated labels of a doc_id count once, the worse ones."""
    toxic = F.col("toxic").cast("int") if "toxic" in labels.columns else F.lit(None).cast("int")
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"), toxic.alias("x")).filter("doc_id IS NOT NULL AND (y IS NOT NULL OR x IS NOT NULL)")
    some = some.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("x").alias("x")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs_of(docs).filter(F.col("text").isNotNull()).join(F.broadcast(some), "doc_id")  # at most max_rows rows

    def run(batches):
        t = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        m, x = Model(None, 0.0, 1.0, 0.0), HARMLESS
        if t is not None:
            t = t.sort_by([("k", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
            one = t.filter(pc.is_valid(t.column("x")))
            x = fit_toxic(one.column("text").combine_chunks(), one.column("x").to_numpy())
            one = t.filter(pc.is_valid(t.column("y")))
            m = fit(one.column("text").combine_chunks(), one.column("y").to_numpy())
            relieve()
        arrays = [[None if m.weights is None else m.weights.tobytes()], [m.bias], [m.slope], [m.shift], [x.cells.tobytes()], [x.weights.tobytes()], [x.bias], [x.slope], [x.shift]]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k in (0, 4, 5) else pa.float64()) for k, v in enumerate(arrays)], ["w", "b", "s", "t", "xc", "xw", "xb", "xs", "xt"])

    got = rows.withColumn("k", F.xxhash64("doc_id")).repartition(1).mapInArrow(run, "w binary, b double, s double, t double, xc binary, xw binary, xb double, xs double, xt double").collect()
    m, x = Model(None, 0.0, 1.0, 0.0), HARMLESS
    for r in got:
        if r["w"] is not None:
            m = Model(np.frombuffer(r["w"], np.float32), r["b"], r["s"], r["t"])
        if r["xc"]:
            x = Toxic(np.frombuffer(r["xc"], np.uint32), np.frombuffer(r["xw"], np.float32), r["xb"], r["xs"], r["xt"])
    return m, x


def _scorer(spark, models: tuple[Model, Toxic]):
    """A column of p_quality and p_toxic of a text."""
    shared = spark.sparkContext.broadcast(tuple(map(tuple, models)))

    @F.arrow_udf("p_quality double, p_toxic double")
    def score(text: pa.Array) -> pa.Array:
        m, x = shared.value
        out = pa.StructArray.from_arrays([pa.array(probabilities(text, Model(*m))), pa.array(toxic_probabilities(text, Toxic(*x)))], ["p_quality", "p_toxic"])
        relieve()
        return out

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """doc_id, p_quality and p_toxic (calibrated, 6 digits) and keep (p_quality >= keep_from and p_toxic < toxic_from)
    for each row with a doc_id.

    A null text or one without words has p_quality 0. Without labelled rows of both classes nothing can be learnt, and
    p_quality is 1 or p_toxic 0. Equal texts score equally; extra columns are ignored; an empty table gives no rows.
    """
    score = _scorer(docs.sparkSession, train(docs, labels))
    out = docs_of(docs).select("doc_id", score("text").alias("p"))
    out = out.select("doc_id", *[F.round(F.col(f"p.{c}"), 6).alias(c) for c in ("p_quality", "p_toxic")])
    return out.withColumn("keep", (F.col("p_quality") >= keep_from) & (F.col("p_toxic") < toxic_from))


def keep_good(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """The rows of docs that the rules accept, with their columns; rows without doc_id are judged by text alone.

    Null texts and those without a word go, unless nothing could be learnt of quality; equal rows go or stay together; an
    empty table stays empty.
    """
    score, p = _scorer(docs.sparkSession, train(docs, labels)), free_name(docs, "__p")
    out = docs.withColumn(p, score(docs["text"].cast("string")))
    return out.filter((F.round(F.col(p)["p_quality"], 6) >= keep_from) & (F.round(F.col(p)["p_toxic"], 6) < toxic_from)).drop(p)
