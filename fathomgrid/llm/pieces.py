"""SentencePiece encoding and decoding of merge-type (BPE) models, by backtracking instead of merging.

An Aho-Corasick automaton over the pieces gives the longest match at a position. A sequence of pieces is what merging
would give exactly if every adjacent pair is compatible: merging the two pieces' characters anew yields those two
pieces. So encoding takes longest matches from the left, falls back to the next shorter piece where a pair is not
compatible, and marks positions from which every way has failed in a bitfield. Compatibility is found by re-merging
and kept. Characters that are no piece become byte pieces; no piece crosses a space mark inside, so a text is
encoded word by word and words that recur are kept up to a bound.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

SPACE = "▁"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message; values are ints or bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceModel:
    """A model file: pieces, scores and kinds, and what encoding needs of the trainer and normaliser settings."""

    NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer, normaliser = {}, {}
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    piece = dict(_fields(value))
                    self.pieces.append(piece.get(1, b"").decode("utf-8"))
                    self.scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                    self.kinds.append(piece.get(3, 1))
                elif number == 2:
                    trainer = dict(_fields(value))
                elif number == 3:
                    normaliser = dict(_fields(value))
        if trainer.get(3) != 2 or normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1) or not trainer.get(35):
            raise ValueError("only merge models with byte fallback, a dummy prefix and no normalisation are handled")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == self.NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space mark inside")
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == self.BYTE}
        self.end_id = self.pieces.index("</s>")
        self.ranks = {p: -self.scores[i] for p, i in self.ids.items()}
        self.surfaces = [p.replace(SPACE, " ") if k == self.NORMAL else None for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.chars = {p for p in self.ids if len(p) == 1}
        self.bits = max(map(len, self.ids))
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.shorter: dict[str, str | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merging as it is defined: the adjacent pair of the best score first, the leftmost of equals."""
        if len(text) <= 24:
            return self._merged_short(list(text))
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (k := self.ids.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= len(parts) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def _merged_short(self, parts: list[str]) -> list[str]:
        """The same for few parts, by looking at all pairs each time."""
        rank = self.ranks.get
        ranks = [rank(a + b) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while True:
            best = None
            for k, r in enumerate(ranks):
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1])
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at])

    def compatible(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 150_000:
                self.pairs.clear()
            known = self.pairs[a, b] = a + b not in self.ids and self.merged(a + b) == [a, b]
        return known

    def longest(self, word: str, at: int) -> str:
        """The longest piece that starts at a position: the automaton reads on only while some piece can match."""
        for end, piece in self.automaton.iter_long(word, at):
            if end + 1 - len(piece) == at:
                return piece
            break
        ids = self.ids
        for n in range(min(self.bits, len(word) - at), 0, -1):  # an earlier start hid it
            if word[at : at + n] in ids:
                return word[at : at + n]
        raise ValueError("a character is no piece")

    def next_shorter(self, piece: str) -> str | None:
        """The longest piece that is a proper beginning of this one."""
        if piece not in self.shorter:
            self.shorter[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ids), None)
        return self.shorter[piece]

    def encoded_word(self, word: str) -> list[str]:
        """Pieces of a run of characters that all are pieces, with at most one space mark, at its start."""
        if len(word) == 1 or word in self.ids and self.merged_whole(word):
            return [word]
        # the automaton's longest matches from the left, all at once; where a pair fails, the search goes on from there
        greedy = [p for _, p in self.automaton.iter_long(word)]
        if not self.merged_whole(greedy[0]):
            good = 0
        else:
            known, good = self.pairs.get, 1
            for pair in zip(greedy, greedy[1:]):  # noqa: B905
                ok = known(pair)
                if not (self.compatible(*pair) if ok is None else ok):
                    break
                good += 1
            else:
                return greedy
        out = greedy[:good]
        at, piece = sum(map(len, out)), greedy[good]
        failed = 0  # bit i: no way leads on from position i
        n = len(word)
        while True:
            end = at + len(piece)
            if not failed >> end & 1 and (self.compatible(out[-1], piece) if out else self.merged_whole(piece)):
                out.append(piece)
                if end == n:
                    return out
                at, piece = end, self.longest(word, end)
                continue
            shorter = self.next_shorter(piece)
            while shorter is None:
                failed |= 1 << at
                if not out:
                    raise ValueError(f"no valid encoding of {word!r}")
                piece = out.pop()
                at -= len(piece)
                shorter = self.next_shorter(piece)
            piece = shorter

    @lru_cache(maxsize=None)  # noqa: B019  one model a process, one entry a piece
    def merged_whole(self, piece: str) -> bool:
        """Whether merging a piece's characters reaches the piece."""
        return self.merged(piece) == [piece]

    def encoded(self, run: str) -> list[int]:
        """Ids of a run: space marks, then other characters. The last mark joins the word if merging joins it."""
        word = run.lstrip(SPACE)
        marks = len(run) - len(word)
        ids: list[int] = []
        if marks <= 1 and self.chars.issuperset(word):
            ids_of = self.ids
            return [ids_of[p] for p in self.encoded_word(run)] if run else ids
        known, parts = "", []
        for c in word:
            if c in self.chars:
                known += c
            else:
                parts += [known, c]
                known = ""
        parts.append(known)
        first = parts[0]
        if marks:
            pieces = self.encoded_word(SPACE + first) if first else [SPACE]
            joined = len(pieces[0]) > 1
            ids += self.marks(marks - 1 if joined else marks)
            ids += [self.ids[p] for p in (pieces if joined else pieces[1:])]
        elif first:
            ids += [self.ids[p] for p in self.encoded_word(first)]
        for k in range(1, len(parts), 2):
            ids += [self.byte_ids[b] for b in parts[k].encode("utf-8")]
            if parts[k + 1]:
                ids += [self.ids[p] for p in self.encoded_word(parts[k + 1])]
        return ids

    @lru_cache(maxsize=4096)  # noqa: B019
    def marks(self, n: int) -> list[int]:
        """Ids of n marks that no word takes. Their scores are all equal, so the order of merging decides."""
        return [self.ids[p] for p in self.merged(SPACE * n)]

    def decoded(self, ids: list[int]) -> str:
        """The text of ids: marks are spaces, the first piece's leading mark goes, runs of byte pieces are UTF-8."""
        out, raw, first = [], bytearray(), True
        for i in ids:
            kind = self.kinds[i]
            if kind == self.BYTE:
                raw.append(int(self.pieces[i][3:5], 16))
                first = False
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if kind == self.NORMAL:
                piece = self.pieces[i].replace(SPACE, " ")
                out.append(piece[1:] if first and piece[:1] == " " else piece)
                first = False
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)


class Encoder:
    """Whole texts through a model. What a word gives is kept, for words of at most ``most`` characters in all, then begun
    anew; a word of a hundredth of that is not kept.

    A word's ids are decoded when it is first met. Where that gives the word back, as it does for all but odd ones, its
    ids alone are kept, and a text of such words decodes to what they spell; other texts are decoded id by id.
    """

    def __init__(self, model: PieceModel, most: int = 3_000_000):
        self.model, self.most, self.held = model, most, 0
        self.known: dict[str, str | tuple[str]] = {}

    def released(self) -> None:
        """Keep no words between tasks: a worker lives on in stages that need the memory. Which pairs of pieces are compatible,
        150,000 at most, is kept."""
        self.forgotten()
        trimmed()

    def forgotten(self) -> None:
        self.known.clear()
        self.held = 0

    def _miss(self, word: str) -> str | tuple[str]:
        ids = self.model.encoded(word)
        text = "".join([f"{i} " for i in ids])
        value = text if self._surface(ids) == word.replace(SPACE, " ") else (text,)
        if 100 * len(word) < self.most:
            self.known[word] = value
            self.held += len(word)
        return value

    def _surface(self, ids: list[int]) -> str:
        """What ids decode to within a text, where a leading mark is a space."""
        m = self.model
        plain = [m.surfaces[i] for i in ids]
        if None not in plain:
            return "".join(plain)
        head = m.pieces[ids[0]] if m.kinds[ids[0]] == m.NORMAL else ""
        return (" " if head.startswith(SPACE) else "") + m.decoded(ids)

    def text(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids as text, decoded text) with the end id last."""
        end = str(self.model.end_id)
        if not text:
            return 1, end, ""
        if self.held > self.most:
            self.forgotten()
        get, miss = self.known.get, self._miss
        words: list[str] = []
        for row, line in enumerate(text.split("\n")):
            if row:
                words.append("\n")
            if SPACE in line or "  " in line or line[-1:] == " " or line[:1] == " ":
                words += _runs((SPACE if not row else "") + line.replace(" ", SPACE))
            elif line or not row:
                new = line.replace(" ", " " + SPACE).split(" ")
                if not row:
                    new[0] = SPACE + new[0]
                words += new
        found = list(map(get, words))
        if None in found:
            found = [miss(w) if (k := get(w)) is None else k for w in words]
        try:
            ids = "".join(found) + end
        except TypeError:
            ids = "".join([x if isinstance(x, str) else x[0] for x in found]) + end
            return ids.count(" ") + 1, ids, self.model.decoded([int(i) for i in ids.split(" ")])
        decoded = "".join(words).replace(SPACE, " ")
        return ids.count(" ") + 1, ids, decoded[1:] if decoded[:1] == " " else decoded


def _runs(line: str) -> list[str]:
    """Cut before every run of marks."""
    out, start, n = [], 0, len(line)
    at = 0
    while at < n:
        while at < n and line[at] == SPACE:
            at += 1
        while at < n and line[at] != SPACE:
            at += 1
        out.append(line[start:at])
        start = at
    return out


_MODELS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _MODELS:
        _MODELS[path] = Encoder(PieceModel(path))
    return _MODELS[path]


def encode_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), one row per row of docs, whole texts. Null and empty texts have the
    end id alone and decode to nothing. Rows are independent, so repeated ids and rows each give their own.
    ``extra`` columns are passed through."""
    some = docs.select(F.col(id_col).alias("id"), *extra, F.col(text_col).alias("__text"))
    carried = ["id", *extra]

    def digest(batches):
        e = encoder(path)
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column("__text"):
                k, ids, decoded = e.text(t.as_py() or "")
                n.append(k)
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                b.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
            new = [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carried] + new, names=[*carried, "n_tokens", "ids_sha256", "decoded_sha256"])
        e.released()

    schema = some.select(*carried).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    out = some.mapInArrow(digest, schema)
    return out.withColumnRenamed("id", id_col)


def encode_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): the ids themselves and the decoded text, for every row; null texts as in encode_digest."""
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def encode(batches):
        e = encoder(path)
        for batch in batches:
            rows = [e.text(t.as_py() or "") for t in batch.column("text")]
            ids = pa.array([[int(i) for i in r[1].split(" ")] for r in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), ids, pa.array([r[2] for r in rows], pa.string())], names=["id", "ids", "decoded"])
        e.released()

    out = some.mapInArrow(encode, f"id {some.schema['id'].dataType.simpleString()}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)
