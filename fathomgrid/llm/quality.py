"""Quality scores by a regularised quadratic discriminant over transformed document statistics.

Each whole text gives a vector of statistics, transformed to be nearer to normal. Each class has a mean and a
covariance shrunk towards the pooled one and towards its diagonal; their Cholesky factors are kept, and a score is the
logistic of the difference of Mahalanobis log densities and log priors. Class moments are sums over all labelled rows
that are not held out, so learning needs no sample; statistics are computed once and kept as a narrow table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TextBlock, small_blocks, written


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars.encode())] = 1
    return out


_CLASSES = np.stack(
    [
        _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        _class("0123456789"),
        _class("#$%&*@^~=+<>/\\_{}[]"),
        _class("!?"),
        _class("|"),
        _class(".,;:'\"()-"),
        _class("\n\r"),
        _class(" \t"),
        (np.arange(256) >= 0xC0).astype(float),  # characters beyond ASCII, by their lead byte
        (np.arange(256) < 0x20).astype(float),
    ]
).T
#: Rates that a text is taken to have before any of its bytes are seen, worth SEEN bytes: short texts are near them.
_USUAL = np.array([0.02, 0.001, 0.001, 0.001, 0.001, 0.02, 0.01, 0.15, 0.03, 0.01])
SEEN = 300.0
FEATURES = ["upper", "digit", "symbol", "bang", "bar", "punct", "line", "space", "wide", "control", "word_length", "repeat", "distinct", "top_word", "entropy", "odd_words"]


def statistics(block: TextBlock) -> np.ndarray:
    """Texts x FEATURES, transformed; finite for empty texts too."""
    starts, ends, first = block.words()
    hashes = block.word_hashes(starts, ends)
    lengths = ends - starts
    # words that end in a character that is neither letter, digit, usual punctuation nor part of a wider character
    last = block.data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    odd = _ODD[last]
    out = np.zeros((len(block), len(FEATURES)))
    for i in range(len(block)):
        counts = np.bincount(block.data[block.bounds[i] : block.bounds[i + 1]], minlength=256)
        n = counts.sum()
        rates = (counts @ _CLASSES + SEEN * _USUAL) / (n + SEEN)
        out[i, :10] = np.log(rates / (1 - rates))
        p = counts[counts > 0] / max(n, 1)
        a, b = first[i], first[i + 1]
        w = b - a
        h = hashes[a:b]
        repeats = np.count_nonzero(h[1:] == h[:-1]) if w > 1 else 0
        if w:
            s = np.sort(h)
            edges = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
            distinct, top = len(edges) - 1, int(np.diff(edges).max())
        else:
            distinct = top = 0
        rate = (repeats + 0.02) / (w + 4)
        out[i, 10] = np.log((lengths[a:b].sum() + 50.0) / (w + 10.0))
        out[i, 11] = np.log(rate)
        out[i, 12] = np.log((distinct + 8.0) / (w + 8.0) ** 0.85)
        out[i, 13] = np.log((top + 1.0) / (w + 20.0))
        out[i, 14] = -(p * np.log(p)).sum() * n / (n + SEEN) + 2.9 * SEEN / (n + SEEN)
        out[i, 15] = np.log((odd[a:b].sum() + 0.05) / (w + 5.0))
    return out


_ODD = np.zeros(256, bool)
_ODD[list(b"#$%&*@^~=+<>/\\_{}[]|!")] = True


class Discriminant:
    """Means, inverse Cholesky factors and log determinants of the two classes, and the log prior ratio."""

    def __init__(self, mean, inverse, logdet, prior):
        self.mean, self.inverse, self.logdet, self.prior = mean, inverse, logdet, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        density = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.inverse[k].T
            density.append(-0.5 * (z * z).sum(1) - 0.5 * self.logdet[k])
        d = np.clip(density[1] - density[0] + self.prior, -500, 500)
        return 1 / (1 + np.exp(-d))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = 0.05, diagonal: float = 0.02) -> Discriminant:
    """From each class's count, sum and sum of outer products. ``pooled`` and ``diagonal`` are the shares of shrinkage.

    A class without rows takes the other's moments, so scores are then the prior alone; without any rows they are 0.5.
    """
    d = len(FEATURES)
    have = {k: v for k, v in moments.items() if v[0] > 0}
    if not have:
        return Discriminant([np.zeros(d)] * 2, [np.eye(d)] * 2, [0.0, 0.0], 0.0)
    for k in (0, 1):
        have.setdefault(k, (0.5, *(x * 0.5 / have[1 - k][0] for x in have[1 - k][1:])) if 1 - k in have else None)
    mean, cov = {}, {}
    for k, (n, s, ss) in have.items():
        mean[k] = s / n
        cov[k] = ss / n - np.outer(mean[k], mean[k])
    total = sum(v[0] for v in have.values())
    shared = sum(have[k][0] * cov[k] for k in (0, 1)) / total
    inverse, logdet = [], []
    for k in (0, 1):
        c = (1 - pooled) * cov[k] + pooled * shared
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + 1e-6 * np.eye(d)
        lower = np.linalg.cholesky(c)
        inverse.append(np.linalg.inv(lower))
        logdet.append(2 * np.log(np.diag(lower)).sum())
    return Discriminant([mean[0], mean[1]], inverse, logdet, float(np.log(have[1][0] / have[0][0])))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of every whole text."""
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for part in small_blocks(batches, "text"):
            x = statistics(TextBlock(part.column("text")))
            flat = pa.array(x.ravel())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)], names=["id", "x"])

    return some.mapInArrow(run, f"id {some.schema['id'].dataType.simpleString()}, x array<double>")


def learn(rows: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """Moments of all labelled rows that are not held out. ``held_out`` is an expression over the label table."""
    some = labels.where(~held_out & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    joined = rows.join(some, "id").select("label", "x")
    d = len(FEATURES)

    def sums(batches):
        n, s, ss = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = np.asarray(batch.column("label"))
            for k in (0, 1):
                part = x[y == k]
                n[k] += len(part)
                s[k] += part.sum(0)
                ss[k] += part.T @ part
        values = np.concatenate([np.concatenate([[n[k]], s[k], ss[k].ravel()]) for k in (0, 1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["k", "v"])

    total = joined.mapInArrow(sums, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    values = np.zeros(2 * (1 + d + d * d))
    for r in total:
        values[r["k"]] = r["v"]
    half = values.reshape(2, -1)
    return fit({k: (half[k, 0], half[k, 1 : d + 1], half[k, d + 1 :].reshape(d, d)) for k in (0, 1)})


def score(rows: DataFrame, model: Discriminant, id_col: str = "doc_id") -> DataFrame:
    """(id, score) from (id, x)."""

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(x))], names=["id", "score"])

    return rows.select("id", "x").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, score), one row per row of docs; higher where label 1 is likelier. Null and empty texts have the usual
    rates and so a score too. Labels other than 0 and 1, null ids and repeated rows: the first are not learned from,
    the others are scored like any row; a repeated label counts as often as it stands."""
    rows = written(features(docs, id_col, text_col))
    return score(rows, learn(rows, labels, held_out, id_col, label_col), id_col)
