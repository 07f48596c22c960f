"""Edit-aware token counts.

A document's text is cut at places where a pre-token must begin whatever else the text holds: before white space that
follows none, and where letters, digits and other signs meet. The pieces, runs of pre-tokens, are the leaves of a segment
tree whose nodes hold characters and tokens. An edit touches the leaves it overlaps; they are joined with neighbours for as
long as a boundary of theirs is no longer such a place, encoded anew, and the sums above them are updated. All other leaves
keep their counts, and the total equals a fresh encoding.

Trees are kept with their documents, as columns (``token_trees``); ``edit_trees`` takes them up again and encodes only what
edits touch.
"""

from __future__ import annotations

import base64
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern of pre-tokens that belongs to the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_CHARS = 256

_ENCODINGS: dict = {}


def encoding(path: str):
    """The byte-level BPE of a rank file."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


#: Fixed value: white space, as the pattern's \\s has it.
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


@lru_cache(maxsize=1 << 16)
def kind(c: str) -> str:
    """What the pattern takes a character for: W(hite), L(etter), N(umber), S(ign); "" where another version of Unicode may
    see it otherwise."""
    if c in WHITE:
        return "W"
    category = unicodedata.category(c)[0]
    return category if category in "LN" else "" if category == "C" else "S"


def cut_between(a: str, b: str) -> bool:
    """Whether a pre-token begins at character b after a, whatever stands before and after them. Runs of one kind go on, a
    space may belong to what follows it, and letters after an apostrophe may be a contraction."""
    x, y = kind(a), kind(b)
    return x != y and bool(x) and bool(y) and x != "W" and not (a == "'" and y == "L")


def boundary(left: str, right: str) -> bool:
    """Whether a pre-token begins between two texts."""
    return bool(left) and bool(right) and cut_between(left[-1], right[0])


def leaves(text: str, size: int = LEAF_CHARS) -> list[str]:
    """Pieces of about ``size`` characters, cut at boundaries only; a text without any is one piece."""
    out, start, n = [], 0, len(text)
    while n - start > size:
        at = start + size
        while at < n and not cut_between(text[at - 1], text[at]):
            at += 1
        if at >= n:
            break
        out.append(text[start:at])
        start = at
    out.append(text[start:])
    return out


class TokenTree:
    """A segment tree over a text's leaves; ``encoded`` counts the characters that were encoded so far."""

    def __init__(self, text: str, enc, size: int = LEAF_CHARS, kept: tuple[list[int], list[int]] | None = None):
        """Of a text; ``kept`` are the lengths and counts of its leaves where they are known (see ``state``)."""
        self.enc, self.encoded = enc, 0
        if kept is None:
            self.texts = leaves(text, size)
            counts = [self._count(t) for t in self.texts]
        else:
            stops = np.cumsum(kept[0])
            self.texts = [text[b - n : b] for n, b in zip(kept[0], stops.tolist(), strict=True)] or [""]
            counts = list(kept[1]) or [0]
        self.width = 1 << max(0, (len(self.texts) - 1).bit_length())
        self.chars = np.zeros(2 * self.width, np.int64)
        self.tokens = np.zeros(2 * self.width, np.int64)
        self.chars[self.width : self.width + len(counts)] = [len(t) for t in self.texts]
        self.tokens[self.width : self.width + len(counts)] = counts
        level = self.width
        while level > 1:
            for x in (self.chars, self.tokens):
                x[level // 2 : level] = x[level : 2 * level].reshape(-1, 2).sum(1)
            level //= 2

    def state(self) -> tuple[list[int], list[int]]:
        """Lengths and counts of the leaves that have text: all of the tree that its text does not say."""
        w = self.width
        some = [i for i, t in enumerate(self.texts) if t]
        return [len(self.texts[i]) for i in some], [int(self.tokens[w + i]) for i in some]

    def _count(self, text: str) -> int:
        self.encoded += len(text)
        return len(self.enc.encode_ordinary(text)) if text else 0

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _set(self, i: int, text: str, count: int) -> None:
        self.texts[i] = text
        k = self.width + i
        self.chars[k], self.tokens[k] = len(text), count
        while k > 1:
            k //= 2
            self._sum(k)

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def __len__(self) -> int:
        return int(self.chars[1])

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one for the end), and where it starts."""
        k, start = 1, 0
        at = min(at, max(0, len(self) - 1))
        while k < self.width:
            k *= 2
            if at - start >= self.chars[k]:
                start += int(self.chars[k])
                k += 1
        return min(k - self.width, len(self.texts) - 1), start

    def edit(self, start: int, stop: int, text: str) -> None:
        """Replace characters start to stop, both cut to the text's length."""
        start = max(0, min(start, len(self)))
        stop = max(start, min(stop, len(self)))
        first, at = self._leaf(start)
        last, _ = self._leaf(max(start, stop - 1))
        joined = "".join(self.texts[first : last + 1])
        new = joined[: start - at] + text + joined[stop - at :]
        before = self._beside(first, -1)
        while before >= 0 and not boundary(self.texts[before], new or self._ahead(last)):
            new, first = self.texts[before] + new, before
            before = self._beside(first, -1)
        after = self._beside(last, 1)
        while after < len(self.texts) and not boundary(new, self.texts[after]):
            new, last = new + self.texts[after], after
            after = self._beside(last, 1)
        self._set(first, new, self._count(new))
        for i in range(first + 1, last + 1):
            if self.texts[i]:
                self._set(i, "", 0)

    def _beside(self, i: int, step: int) -> int:
        """The next leaf with text in a direction."""
        i += step
        while 0 <= i < len(self.texts) and not self.texts[i]:
            i += step
        return i

    def _ahead(self, last: int) -> str:
        """The text of the next leaf that has any."""
        i = self._beside(last, 1)
        return self.texts[i] if i < len(self.texts) else ""

    def text(self) -> str:
        return "".join(self.texts)


EDITS = "array<struct<start: long, stop: long, text: string>>"


TREE = "leaf_chars array<int>, leaf_tokens array<int>"


def token_trees(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(id, text, carry..., leaf_chars, leaf_tokens, n_tokens): each row with the tree of its whole text. Null and empty texts
    have no leaves. Rows are independent. An empty table gives none."""
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *carry)
    names = [*some.columns, "leaf_chars", "leaf_tokens", "n_tokens"]

    def run(batches):
        enc = encoding(path)
        for batch in batches:
            trees = [TokenTree(t.as_py() or "", enc, leaf_chars) for t in batch.column("text")]
            kept = [t.state() for t in trees]
            new = [*(pa.array([k[i] for k in kept], pa.list_(pa.int32())) for i in (0, 1)), pa.array([t.total for t in trees], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema.fields)
    return some.mapInArrow(run, f"{head}, {TREE}, n_tokens long")


def edit_trees(trees: DataFrame, path: str, edits_col: str = "edits") -> DataFrame:
    """``token_trees`` after edits: (id, text, leaf_chars, leaf_tokens, n_tokens, n_edits, chars_reencoded), so that further
    edits may follow.

    ``edits_col`` holds each row's edits in order, as EDITS; they are applied to the whole text, one after the other.
    Null and empty texts may be inserted into; null edits, and null bounds or texts in one, count as none, 0 and empty.
    """
    some = trees.select("id", "text", "leaf_chars", "leaf_tokens", F.col(edits_col).cast(EDITS).alias("edits"))

    def run(batches):
        enc = encoding(path)
        for batch in batches:
            rows = []
            for text, chars, tokens, edits in zip(*(batch.column(c) for c in ("text", "leaf_chars", "leaf_tokens", "edits")), strict=True):
                tree = TokenTree(text.as_py() or "", enc, kept=(chars.as_py() or [], tokens.as_py() or []))
                some = [e for e in edits.as_py() or [] if e is not None]
                for e in some:
                    tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
                rows.append((tree.text(), *tree.state(), tree.total, len(some), tree.encoded))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=["id", "text", "leaf_chars", "leaf_tokens", "n_tokens", "n_edits", "chars_reencoded"])

    return some.mapInArrow(run, f"id {some.schema['id'].dataType.simpleString()}, text string, {TREE}, n_tokens long, n_edits long, chars_reencoded long")


def edited_counts(docs: DataFrame, path: str, edits_col: str = "edits", id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(id, n_leaves, n_tokens, n_edits, n_tokens_after, chars, chars_reencoded), one row per row of docs: trees are made, then
    edited (see ``token_trees`` and ``edit_trees``). Only the numbers leave the second step."""
    edits = "__edits"
    trees = token_trees(docs.withColumn(edits, F.col(edits_col).cast(EDITS)), path, id_col, text_col, (edits,), leaf_chars)
    some = trees.select("id", "text", "leaf_chars", "leaf_tokens", "n_tokens", edits)
    names = ["n_leaves", "n_tokens", "n_edits", "n_tokens_after", "chars", "chars_reencoded"]

    def run(batches):
        enc = encoding(path)
        for batch in batches:
            rows = []
            for text, chars, tokens, before, edits in zip(*(batch.column(c) for c in ("text", "leaf_chars", "leaf_tokens", "n_tokens", "__edits")), strict=True):
                text, chars = text.as_py() or "", chars.as_py()
                tree = TokenTree(text, enc, kept=(chars, tokens.as_py()))
                some = [e for e in edits.as_py() or [] if e is not None]
                for e in some:
                    tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
                rows.append((len(chars), before.as_py(), len(some), tree.total, len(text), tree.encoded))
            columns = np.array(rows, np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c.copy()) for c in columns.T)], names=["id", *names])

    schema = f"id {some.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names)
    return some.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of every whole text."""
    return token_trees(docs, path, id_col, text_col).select(F.col("id").alias(id_col), "n_tokens")
