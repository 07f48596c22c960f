"""Language identification by string kernels.

A text's blended spectrum is the set of its byte n-grams, n from 1 to 3, so presence and not counts. The kernel of two
texts is the share of common n-grams, |X & L| / sqrt(|X| |L|), over the n-grams that occur in the landmarks. Nystrom
landmarks map a text to k(x, L) K(L, L)^(-1/2); kernel ridge regression, one language versus the rest, is fitted on
those features. Scoring multiplies a batch's presence matrix by the landmarks' matrix once contracted with the
regression's weights: the same product, associated from the right.

Learning takes at most ``max_train`` rows and ``n_landmarks`` of them as landmarks; scoring reads whole texts.

The regression always names a learned language. Whether a text is in it is another question: ``accepts`` asks how many of its
3-grams of letters occur in the landmarks of the language that the regression names, whose share the learning rows that are no
landmarks calibrate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TextBlock, _LOWER, small_blocks, trimmed

UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[list(range(0x41, 0x5B)) + list(range(0x61, 0x7B))] = True
_WORDLY = _LETTER.copy()  # bytes of letters, of other scripts too, and the space between words
_WORDLY[0x80:] = _WORDLY[0x20] = True
LEAST_GRAMS, LEAST_ROWS, STRICTNESS = 30, 50, 0.6


def _codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the 1-, 2- and 3-grams that start at each byte; those that run past the end are zero bytes on."""
    x = np.zeros(len(data) + 2, np.uint32)
    x[: len(data)] = _LOWER[data]
    two = x[:-1] << 8 | x[1:]
    return x[:-2], two[:-1], two[:-1] << 8 | x[2:]


class KernelModel:
    """Classes, the n-grams of the landmarks as columns, and the contracted weights (columns x classes)."""

    def __init__(self, classes: list[str], grams: tuple[np.ndarray, np.ndarray, np.ndarray], weights: np.ndarray, bias: np.ndarray, floor: float = 0.0):
        self.floor = floor
        self.own = np.zeros((len(classes), sum(map(len, grams)) + 1), bool)  # which columns (+ 1) each class's landmarks have
        self.classes, self.grams, self.weights, self.bias = classes, grams, weights.astype(np.float32), bias.astype(np.float32)
        self._tables: list[np.ndarray] | None = None

    def __getstate__(self):
        return self.classes, self.grams, self.weights, self.bias, self.floor, self.own

    def __setstate__(self, state):
        self.classes, self.grams, self.weights, self.bias, self.floor, self.own = state
        self._tables = None

    def tables(self) -> list[np.ndarray]:
        """From an n-gram's code to its column + 1; 0 for n-grams of no landmark."""
        if self._tables is None:
            self._tables, at = [], 1
            for n, codes in enumerate(self.grams, 1):
                t = np.zeros(1 << 8 * n, np.uint16 if sum(map(len, self.grams)) < 1 << 16 else np.uint32)
                t[codes] = np.arange(at, at + len(codes))
                at += len(codes)
                self._tables.append(t)
        return self._tables

    def released(self) -> None:
        """Keep no tables between tasks: they are made anew in milliseconds."""
        self._tables = None
        trimmed()

    def presence(self, block: TextBlock) -> np.ndarray:
        """Texts x columns, 1 where an n-gram occurs within the text."""
        width = sum(map(len, self.grams)) + 1
        out = np.zeros((len(block), width), np.uint8)
        data, bounds = block.data, block.bounds
        t1, t2, t3 = self.tables()
        for i in range(len(block)):
            part = data[bounds[i] : bounds[i + 1]]
            for a in range(0, len(part), 1 << 20):  # a long text in passes that overlap by two bytes
                c1, c2, c3 = _codes(part[a : a + (1 << 20) + 2])
                n = len(c1)
                row = out[i]
                row[t1[c1]] = 1
                if n > 1:
                    row[t2[c2[: n - 1]]] = 1
                if n > 2:
                    row[t3[c3[: n - 2]]] = 1
        return out[:, 1:]

    def scores(self, presence: np.ndarray) -> np.ndarray:
        """Regression outputs for each class, by one matrix product a batch."""
        x = presence.astype(np.float32)
        norm = np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return x @ self.weights / norm + self.bias

    def best(self, block: TextBlock, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """The number of each text's class and its score, ``rows`` texts at a time."""
        best, out = np.zeros(len(block), np.int64), np.zeros(len(block))
        for a in range(0, len(block), rows):
            part = _slice(block, a, min(a + rows, len(block)))
            s = self.scores(self.presence(part)).astype(float)
            best[a : a + len(part)] = s.argmax(1)
            z = np.exp(6 * (s - s.max(1, keepdims=True)))
            out[a : a + len(part)] = 1 / z.sum(1)
        return best, out

    def predict(self, block: TextBlock) -> tuple[list[str], np.ndarray]:
        best, out = self.best(block)
        labels = [self.classes[k] for k in best]
        for i in np.flatnonzero(~has_letter(block)):
            labels[i], out[i] = UNKNOWN, 1.0
        return labels, out

    def familiarity(self, block: TextBlock, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of each text's 3-grams of letters occur in the landmarks of its class (given by number), and how many it has."""
        known, there = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
        t3, bounds = self.tables()[2], block.bounds
        for i in range(len(block)):
            part = block.data[bounds[i] : bounds[i + 1]]
            for a in range(0, max(0, len(part) - 2), 1 << 20):
                piece = part[a : a + (1 << 20) + 2]
                wordly = _WORDLY[piece]
                some = _codes(piece)[2][: len(piece) - 2][wordly[:-2] & wordly[1:-1] & wordly[2:]]
                known[i] += np.count_nonzero(self.own[classes[i]][t3[some]])
                there[i] += len(some)
        return known, there

    def accepts(self, block: TextBlock) -> np.ndarray:
        """Whether each text has a letter and, if it has enough 3-grams to tell, is in the language that the regression names.

        Few texts at a time, so that stages with large workers beside them have room."""
        known, there = self.familiarity(block, self.best(block, 128)[0])
        return has_letter(block) & ((there < LEAST_GRAMS) | (known >= self.floor * there))


def _slice(block: TextBlock, a: int, b: int) -> TextBlock:
    part = TextBlock.__new__(TextBlock)
    part.data = block.data[block.bounds[a] : block.bounds[b]]
    part.bounds = block.bounds[a : b + 1] - block.bounds[a]
    return part


def has_letter(block: TextBlock) -> np.ndarray:
    """Whether a text has a letter of any script; only texts without a Latin one are looked at by character."""
    seen = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum(_LETTER[block.data], out=seen[1:])
    out = seen[block.bounds[1:]] > seen[block.bounds[:-1]]
    for i in np.flatnonzero(~out):
        text = block.data[block.bounds[i] : block.bounds[i + 1]].tobytes().decode("utf-8", "replace")
        out[i] = any(c.isalpha() for c in text)
    return out


def fit(texts: list[str], langs: list[str], n_landmarks: int = 256, ridge: float = 1e-3, max_grams: int = 60_000, seed: int = 0) -> KernelModel:
    """Nystrom features of the landmarks, ridge regression for each class on all given rows.

    ``max_grams`` bounds the columns: beyond it, those of fewest landmarks go (ties by code). The kernel is over the
    columns kept. With one class only, that class is always predicted; with no rows, UNKNOWN. The model's floor is
    ``STRICTNESS`` times the share of 3-grams known to the class they get that all but a thousandth of the rows besides the landmarks reach;
    0, so that nothing is rejected, with fewer than ``LEAST_ROWS`` such rows of ``LEAST_GRAMS`` 3-grams or more.
    """
    classes = sorted(set(langs))
    if not classes:
        none = np.zeros(0, np.int64)
        return KernelModel([UNKNOWN], (none, none, none), np.zeros((0, 1)), np.zeros(1))
    rng = np.random.default_rng(seed)
    y = np.array([classes.index(x) for x in langs])
    order = rng.permutation(len(texts))
    ranks = np.zeros(len(texts), np.int64)  # landmarks: the classes in turn
    seen: dict[int, int] = {}
    for i in order:
        ranks[i] = seen.get(y[i], 0)
        seen[y[i]] = ranks[i] + 1
    marks = order[np.argsort(ranks[order], kind="stable")][:n_landmarks]
    blocks = [TextBlock(pa.array([texts[i]], pa.large_string())).data for i in marks]
    grams, counts = [], []
    for n in range(3):
        found = [np.unique(_codes(b)[n][: max(0, len(b) - n)]) for b in blocks]
        c, k = np.unique(np.concatenate(found), return_counts=True)
        grams.append(c.astype(np.int64))
        counts.append(k)
    if sum(map(len, grams)) > max_grams:
        most = max_grams - len(grams[0]) - len(grams[1])
        keep = np.sort(np.lexsort((grams[2], -counts[2]))[: max(0, most)])
        grams[2] = grams[2][keep]
    model = KernelModel(classes, tuple(grams), np.zeros((sum(map(len, grams)), len(classes))), np.zeros(len(classes)))
    unit = lambda p: p / np.sqrt(np.maximum(p.sum(1, keepdims=True), 1))
    present = model.presence(TextBlock(pa.array([texts[i] for i in marks], pa.large_string())))
    for k in range(len(classes)):
        model.own[k, 1:] = present[y[marks] == k].any(0)
    landmarks = unit(present.astype(np.float32)).astype(np.float32)
    kernel_parts = []
    for a in range(0, len(texts), 256):
        rows = unit(model.presence(TextBlock(pa.array(texts[a : a + 256], pa.large_string()))).astype(np.float32))
        kernel_parts.append(rows @ landmarks.T)
    kernel = np.concatenate(kernel_parts).astype(float)
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(float))
    good = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ root
    goal = np.where(y[:, None] == np.arange(len(classes)), 1.0, -1.0)
    weight = 1 / np.bincount(y, minlength=len(classes))[y]  # classes count alike, however many rows they have
    weight *= len(y) / weight.sum()
    mean = (features * weight[:, None]).sum(0) / weight.sum()
    goal_mean = (goal * weight[:, None]).sum(0) / weight.sum()
    z, g = features - mean, goal - goal_mean
    beta = np.linalg.solve(z.T @ (z * weight[:, None]) + ridge * len(y) * np.eye(z.shape[1]), z.T @ (g * weight[:, None]))
    model.weights = (landmarks.T.astype(float) @ (root @ beta)).astype(np.float32)
    model.bias = (goal_mean - mean @ beta).astype(np.float32)
    others = TextBlock(pa.array([texts[i] for i in np.setdiff1d(np.arange(len(texts)), marks)], pa.large_string()))
    known, there = model.familiarity(others, model.best(others)[0])
    shares = known[there >= LEAST_GRAMS] / there[there >= LEAST_GRAMS]
    model.floor = STRICTNESS * float(np.quantile(shares, 0.001)) if len(shares) >= LEAST_ROWS else 0.0
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out=None, max_train: int = 2400, max_chars: int = 20_000, **options) -> KernelModel:
    """Fit on a bounded sample of the labelled rows that are not held out: for each language an equal share of
    ``max_train``, those of the least seeded hash of the id, texts of up to ``max_chars`` characters.

    Counting languages reads two columns; then only the ids under each language's threshold are looked up.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.char_length(text_col).between(1, max_chars))
    if held_out is not None:
        rows = rows.where(~held_out)
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).agg(F.count(F.lit(1))).collect()}
    if not counts:
        return fit([], [], **options)
    share = max(1, max_train // len(counts))
    draw = F.pmod(F.xxhash64(F.lit(5), F.col(id_col).cast("string")), F.lit(1 << 40))
    cut = F.lit(None)
    for lang, n in counts.items():  # a tenth more than needed, then the least draws
        cut = F.when(F.col(lang_col) == lang, F.lit(min(1 << 40, int((share * 1.1 + 20) / n * (1 << 40)) + 1))).otherwise(cut)
    picked = rows.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw")).where(F.col("draw") < cut.cast("long")).orderBy("draw", "id", "text").limit(4 * max_train + 40 * len(counts)).collect()
    picked.sort(key=lambda r: (r["draw"], r["id"] or "", r["text"]))
    texts, langs, taken = [], [], dict.fromkeys(counts, 0)
    for r in picked:
        if taken[r["lang"]] < share:
            taken[r["lang"]] += 1
            texts.append(r["text"])
            langs.append(r["lang"])
    return fit(texts, langs, **options)


def identify(docs: DataFrame, model: KernelModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score), one row per row of docs, over whole texts. Null texts and texts without a letter (empty
    ones too) are UNKNOWN with score 1. Repeated rows get equal results; other columns are not read."""
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_grams x classes floats

    def run(batches):
        m = shared.value
        for part in small_blocks(batches, "text"):
            labels, scores = m.predict(TextBlock(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])
        m.released()

    return some.mapInArrow(run, f"id {some.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: KernelModel, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is in the language that the kernel regression names (``KernelModel.accepts``), all their
    columns as they were. Null texts and texts without a letter go. Where nothing was learned, all texts with a letter stay.

    The rows pass through the scoring batches themselves, so nothing is joined or shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for part in small_blocks(batches, text_col):
            yield part.filter(pa.array(m.accepts(TextBlock(part.column(part.schema.get_field_index(text_col)))), pa.bool_()))
        m.released()

    return docs.mapInArrow(run, docs.schema)
