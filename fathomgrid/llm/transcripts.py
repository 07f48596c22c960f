"""Transcript parsing: a hidden Markov model recovers who speaks in raw lines, by Viterbi, before turns are rendered.

States are a role and whether a line begins its turn. A line is observed as the role its speaker marker names (if it
has one), whether a blank line stands before it, and a few features of its wording. Transition and emission
probabilities are counted on transcripts whose roles are known, with smoothing: a turn's first line that is not blank
begins it.

The lines of all transcripts are sorted by range, so a transcript of any length is spread over partitions, and cut into
chunks of bounded size. Decoding works in max-plus algebra: a chunk is a matrix of best scores from each state before it
to each state at its end; the matrices of a transcript's run of chunks in a partition are multiplied in order, those of
the runs that cross partitions (two a partition at most) on the driver, and each chunk is then decoded between its known
ends. Turns are numbered by prefix sums in the same three steps.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

ROLES = ("system", "user", "assistant")
N_STATES = 2 * len(ROLES)  # role k begins: 2 k; goes on: 2 k + 1
# Names that markers give each role.
NAMES = {
    "system": "system sys instruction instructions context",
    "user": "user human you customer client question q me prompter",
    "assistant": "assistant ai bot model gpt agent answer a response chatbot",
}
_ROLE_OF = {name: k for k, role in enumerate(ROLES) for name in NAMES[role].split()}
MARKER = re.compile(r"^\s*(?:<\|(?:im_start\|>)?\s*(\w+)\s*(?:\|>)?|\[/?(\w+)\]\s*:?|#{1,4}\s*(\w+)\s*:?|\*{2}(\w+)\*{2}\s*:?|\*{2}(\w+):\*{2}|<(\w+)>|(\w+)\s*(?:\(\w+\))?\s*[:>])[ \t]?")
N_SYMBOLS = 4 * 2 * 4
START = N_STATES  # stands for what is before a transcript
CHUNK_LINES, CHUNK_CHARS = 256, 1 << 20
_LINE_KIND = pa.list_(pa.struct([("line", pa.string()), ("blanks", pa.int32())]))


def marker(line: str) -> tuple[int, str]:
    """The role a speaker marker names (-1: none), and the line without the marker."""
    m = MARKER.match(line)
    if m:
        name = next((g for g in m.groups() if g), "").lower()
        if name in _ROLE_OF:
            return _ROLE_OF[name], line[m.end() :]
    return -1, line


def symbol(line: str, after_blank: bool) -> int:
    """What is observed of a line, as a number below N_SYMBOLS."""
    role, rest = marker(line)
    length = len(rest)
    shape = 0 if length < 40 else 1 if length < 160 else 2
    if rest.rstrip().endswith("?"):
        shape = 3
    return ((role + 1) * 2 + after_blank) * 4 + shape


class Model:
    """Log probabilities of the first state, of transitions and of symbols."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, smooth: float = 0.5):
        def logs(counts, allowed=None):
            c = np.asarray(counts, float) + smooth
            if allowed is not None:
                c = np.where(allowed, c, 0.0)
            with np.errstate(divide="ignore"):
                return np.log(c / c.sum(-1, keepdims=True))

        allowed = np.ones((N_STATES, N_STATES), bool)
        for i in range(N_STATES):
            for j in range(1, N_STATES, 2):
                allowed[i, j] = i // 2 == j // 2  # only a turn's own lines go on
        begins = np.arange(N_STATES) % 2 == 0
        self.start, self.move, self.emit = logs(start, begins), logs(move, allowed), logs(emit)

    def step(self, symbols: np.ndarray) -> np.ndarray:
        """For each line, the max-plus matrix from the state before it to its own."""
        return self.move[None] + self.emit[:, symbols].T[:, None, :]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None]).max(1)


def chunk_matrix(model: Model, symbols: np.ndarray) -> np.ndarray:
    """Best scores through a chunk from each state before it, and from START in the last row."""
    steps = model.step(symbols)
    out = np.concatenate([steps[0], (model.start + model.emit[:, symbols[0]])[None]])
    for s in steps[1:]:
        out = times(out, s)
    return out


def chained(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix of one stretch of lines and the next."""
    return times(a, b[:N_STATES])


def decode(model: Model, symbols: np.ndarray, before: int = START, end: int = -1) -> list[int]:
    """The best states of lines, between a known state before them and at the end (-1: free). Of equally good ones the
    first counts, from the end backwards."""
    score = model.start + model.emit[:, symbols[0]] if before == START else model.move[before] + model.emit[:, symbols[0]]
    back = []
    for s in symbols[1:]:
        all_ways = score[:, None] + model.move
        back.append(all_ways.argmax(0))
        score = all_ways.max(0) + model.emit[:, s]
    state = int(score.argmax()) if end < 0 else end
    out = [state]
    for b in reversed(back):
        state = int(b[state])
        out.append(state)
    return out[::-1]


def ends_of(steps: list[np.ndarray], before: int = START, end: int = -1) -> tuple[list[int], list[int]]:
    """From the matrices of successive stretches: the best states before each and at its end."""
    scores = [steps[0][before]]
    for s in steps[1:]:
        scores.append((scores[-1][:, None] + s[:N_STATES]).max(0))
    state = int(scores[-1].argmax()) if end < 0 else end
    last = [state]
    for k in range(len(steps) - 1, 0, -1):
        state = int((scores[k - 1] + steps[k][:N_STATES, state]).argmax())
        last.append(state)
    last = last[::-1]
    return [before, *last[:-1]], last


# --- rows, lines, chunks -------------------------------------------------------------------------------------------------


def rows_of(turns: DataFrame, conv: str, order: list[str], text: str, keep: list[str] = ()) -> DataFrame:
    """(conv, pos, row, keep..., parts): each row of raw text as its lines (line, and how many blank lines stand before it in
    the row), blank ones left out.

    Null and blank texts have no lines. Rows of one place (pos) are told apart by a hash of their text. A row without a
    conversation is one by itself, named by its content.
    """
    own = F.concat(F.lit("?"), F.xxhash64(F.col(text), *order).cast("string"))
    some = turns.select(
        F.coalesce(F.col(conv).cast("string"), own).alias("conv"), F.array(*[F.col(c).cast("long") for c in order]).alias("pos"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row"), *keep, F.col(text).alias("raw")
    )
    names = some.columns[:-1]

    def run(batches):
        for batch in batches:
            parts = [lines_in(x.as_py() or "") for x in batch.column("raw")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(parts, _LINE_KIND)], names=[*names, "parts"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema.fields[:-1])
    return some.mapInArrow(run, f"{head}, parts array<struct<line: string, blanks: int>>")


def lines_in(text: str) -> list[dict]:
    """The lines of a text that are not blank, and how many blank ones stand before each."""
    out, blanks = [], 0
    for line in re.split("\r\n?|\n", text):
        if line and not line.isspace():
            out.append({"line": line, "blanks": blanks})
            blanks = 0
        else:
            blanks += 1
    return out


def fit(rows: DataFrame, smooth: float = 0.5, window: int = 64) -> Model:
    """Counted over all rows of ``rows_of`` with a known role (column role), each of which is one turn: its first line
    begins, the others go on.

    Moves between turns are counted between neighbours within ``window`` successive numbers of the first place, so that a
    conversation of any length is spread. Rows of other roles, and rows without lines, count for nothing.
    """
    number = F.create_map(*[x for k, r in enumerate(ROLES) for x in (F.lit(r), F.lit(2 * k))])
    known = rows.where(F.col("role").isin(*ROLES) & (F.size("parts") > 0)).withColumn("state", number[F.col("role")])

    def within(batches):
        move, emit = np.zeros((N_STATES, N_STATES), np.int64), np.zeros((N_STATES, N_SYMBOLS), np.int64)
        for b in batches:
            for state, parts in zip(b.column("state").to_pylist(), b.column("parts"), strict=True):
                symbols = _symbols(parts.as_py())
                emit[state, symbols[0]] += 1
                np.add.at(emit[state + 1], symbols[1:], 1)
                if len(symbols) > 1:
                    move[state, state + 1] += 1
                    move[state + 1, state + 1] += len(symbols) - 2
        for kind, table in ((0, move), (1, emit)):
            i, j = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), kind, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(table[i, j])], names=["kind", "a", "b", "n"])

    inner = known.select("state", "parts").mapInArrow(within, "kind int, a int, b int, n long")
    turn = F.coalesce(F.col("pos")[0], F.lit(0))
    w = Window.partitionBy("conv", "block").orderBy("pos", "row")
    ends = known.select("conv", "pos", "row", F.floor(turn / window).alias("block"), "state", (F.col("state") + (F.size("parts") > 1).cast("int")).alias("end"))
    moves = ends.withColumn("before", F.coalesce(F.lag("end").over(w), F.when(F.col("block") == 0, F.lit(START)).otherwise(F.lit(-1)))).where("before >= 0")
    between = moves.groupBy(F.lit(0).alias("kind"), F.col("before").cast("int").alias("a"), F.col("state").cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    start, move, emit = np.zeros(N_STATES), np.zeros((N_STATES, N_STATES)), np.zeros((N_STATES, N_SYMBOLS))
    # at most (states + 1) x states + states x symbols rows
    for r in inner.unionByName(between).groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect():
        table = emit if r["kind"] else start if r["a"] == START else move
        table[r["b"] if table is start else (r["a"], r["b"])] += r["n"]
    return Model(start, move, emit, smooth)


def _symbols(lines: list[dict]) -> np.ndarray:
    return np.array([symbol(x["line"] or "", bool(x["blanks"])) for x in lines], np.int64)


_CHUNK = "conv string, part int, run int, chunk int, starts boolean, ends boolean, lines array<struct<line: string, blanks: int>>"


def chunks_of(rows: DataFrame, most_lines: int = CHUNK_LINES, most_chars: int = CHUNK_CHARS) -> DataFrame:
    """(conv, part, run, chunk, starts, ends, lines), written: the lines of all rows in order of conversation, place, row and
    line, cut into chunks.

    A run is what one partition (part) holds of one conversation; ``starts`` and ``ends`` say whether another one's lines
    stand before its first chunk, or after its last, in the same partition. Repeated rows of one place count once.
    """
    key = ["conv", "pos", "row", "line_no", "line"]
    lines = rows.select("conv", "pos", "row", F.posexplode("parts").alias("line_no", "part")).select("conv", "pos", "row", "line_no", "part.line", "part.blanks")
    dealt = lines.repartitionByRange(partitions(rows), *key).sortWithinPartitions(*key)

    def table(chunks):
        conv, part, run, chunk, starts, ends, items = zip(*chunks, strict=True)
        ints = [pa.array(x, pa.int32()) for x in (part, run, chunk)]
        return pa.RecordBatch.from_arrays([pa.array(conv, pa.string()), *ints, pa.array(starts, pa.bool_()), pa.array(ends, pa.bool_()), pa.array(items, _LINE_KIND)], names=["conv", "part", "run", "chunk", "starts", "ends", "lines"])

    def cut(batches):
        part = TaskContext.get().partitionId()
        conv, run, chunk, items, chars, last = None, -1, 0, [], 0, None
        done = []
        for batch in batches:
            for c, *place, line, blanks in zip(*(batch.column(x).to_pylist() for x in (*key, "blanks")), strict=True):
                same = c == conv
                if same and (place, line) == last:
                    continue  # the same row again
                if items and (not same or len(items) >= most_lines or chars >= most_chars):
                    done.append((conv, part, run, chunk, run > 0, not same, items))
                    chunk, items, chars = chunk + 1, [], 0
                if not same:
                    conv, run, chunk = c, run + 1, 0
                items.append({"line": line, "blanks": blanks})
                chars += len(line)
                last = (place, line)
            if done:
                yield table(done)
                done = []
        if items:
            yield table([(conv, part, run, chunk, run > 0, False, items)])

    return written(dealt.select(*key, "blanks").mapInArrow(cut, _CHUNK))


# --- decoding ------------------------------------------------------------------------------------------------------------


def _listed(m: np.ndarray) -> list[float]:
    return m.ravel().tolist()


def _matrix(values) -> np.ndarray:
    return np.asarray(values, float).reshape(N_STATES + 1, N_STATES)


def _crossing(runs: DataFrame) -> list:
    """The runs that touch an end of their partition, at most two a partition, in order."""
    return sorted(runs.where("not (starts and ends)").collect(), key=lambda r: (r["part"], r["run"]))


def _chains(rows: list) -> list[list]:
    """Successive runs of one conversation. A run that does not end in its partition goes on in the next that has lines, if
    that begins with the same conversation."""
    out: list[list] = []
    for r in rows:
        if out and out[-1][-1]["conv"] == r["conv"] and not out[-1][-1]["ends"] and not r["starts"]:
            out[-1].append(r)
        else:
            out.append([r])
    return out


def _between(long: DataFrame, model: Model) -> DataFrame:
    """(part, run, chunk, before, last): the best states before and at the end of the chunks of conversations that have more
    than one. Matrices are gathered by run, so a list is bounded by a partition's lines."""
    spark = long.sparkSession

    def matrices(batches):
        for batch in batches:
            m = [_listed(chunk_matrix(model, _symbols(x))) for x in batch.column("lines").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "part", "run", "chunk", "starts", "ends")), pa.array(m, pa.list_(pa.float64()))], names=["conv", "part", "run", "chunk", "starts", "ends", "m"])

    head = "conv string, part int, run int"
    each = long.select("conv", "part", "run", "chunk", "starts", "ends", "lines").mapInArrow(matrices, f"{head}, chunk int, starts boolean, ends boolean, m array<double>")
    runs = written(each.groupBy("conv", "part", "run").agg(F.max("starts").alias("starts"), F.max("ends").alias("ends"), F.array_sort(F.collect_list(F.struct("chunk", "m"))).alias("ms")))

    def products(batches):
        for batch in batches:
            out = []
            for ms in batch.column("ms").to_pylist():
                m = _matrix(ms[0]["m"])
                for x in ms[1:]:
                    m = chained(m, _matrix(x["m"]))
                out.append(_listed(m))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "part", "run", "starts", "ends")), pa.array(out, pa.list_(pa.float64()))], names=["conv", "part", "run", "starts", "ends", "m"])

    known = []
    for chain in _chains(_crossing(runs.mapInArrow(products, f"{head}, starts boolean, ends boolean, m array<double>"))):
        before, last = ends_of([_matrix(r["m"]) for r in chain])
        known += [(r["part"], r["run"], b, e) for r, b, e in zip(chain, before, last, strict=True)]
    # two rows a partition at most
    ends = F.broadcast(spark.createDataFrame(known, "part int, run int, before int, last int"))

    def inner(batches):
        for batch in batches:
            rows = []
            for part, run, ms, before, last in zip(*(batch.column(c).to_pylist() for c in ("part", "run", "ms", "before", "last")), strict=True):
                b, e = ends_of([_matrix(x["m"]) for x in ms], START if before is None else before, -1 if last is None else last)
                rows += [(part, run, x["chunk"], i, j) for x, i, j in zip(ms, b, e, strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32()) for c in columns], names=["part", "run", "chunk", "before", "last"])

    return runs.join(ends, ["part", "run"], "left").select("part", "run", "ms", "before", "last").mapInArrow(inner, "part int, run int, chunk int, before int, last int")


_TURNS = "conv string, part int, run int, chunk int, starts boolean, ends boolean, begun int, pieces array<struct<k: int, role: string, text: string>>"
_PIECE_KIND = pa.list_(pa.struct([("k", pa.int32()), ("role", pa.string()), ("text", pa.string())]))


def pieces_of(lines: list[dict], states: list[int]) -> tuple[int, list[dict]]:
    """How many turns begin in a chunk, and what it holds of each: piece 0 belongs to the turn before. Markers go, blank lines
    within a turn stay."""
    out: list[dict] = []
    begun = 0
    for x, s in zip(lines, states, strict=True):
        if s % 2 == 0:
            begun += 1
            out.append({"k": begun, "role": ROLES[s // 2], "text": [marker(x["line"])[1]]})
            continue
        if not out:
            out.append({"k": 0, "role": ROLES[s // 2], "text": []})
        out[-1]["text"].append("\n" * x["blanks"] + x["line"])
    return begun, [{**p, "text": "\n".join(p["text"])} for p in out]


def parse(chunks: DataFrame, model: Model) -> DataFrame:
    """(conv, part, run, chunk, starts, ends, begun, pieces), written: the turns in each chunk of ``chunks_of``; see
    ``pieces_of``. A conversation of one chunk is decoded at once, the chunks of others between their ends."""

    def decoded(batches):
        for batch in batches:
            begun, pieces = [], []
            for lines, before, last in zip(*(batch.column(c).to_pylist() for c in ("lines", "before", "last")), strict=True):
                n, found = pieces_of(lines, decode(model, _symbols(lines), before, last))
                begun.append(n)
                pieces.append(found)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv", "part", "run", "chunk", "starts", "ends")), pa.array(begun, pa.int32()), pa.array(pieces, _PIECE_KIND)], names=["conv", "part", "run", "chunk", "starts", "ends", "begun", "pieces"]
            )

    whole = F.expr("starts and ends and chunk = 0")
    head = ["conv", "part", "run", "chunk", "starts", "ends", "lines"]
    short = chunks.where(whole).select(*head, F.lit(START).alias("before"), F.lit(-1).alias("last"))
    long = chunks.where(~whole)
    parts = long.join(_between(long, model), ["part", "run", "chunk"]).select(*head, "before", "last")
    return written(short.unionByName(parts).mapInArrow(decoded, _TURNS))


def turns_of(parsed: DataFrame) -> DataFrame:
    """(conv, turn, role, text, rendered): turns numbered from 0 along each conversation, each from a line that begins to the
    next. Only turns that may cross a chunk's end are gathered."""
    spark = parsed.sparkSession
    counts = parsed.where("not (starts and ends and chunk = 0)").select("conv", "part", "run", "chunk", "starts", "ends", "begun")
    runs = counts.groupBy("conv", "part", "run").agg(F.max("starts").alias("starts"), F.max("ends").alias("ends"), F.sum("begun").alias("begun"))
    known = []
    for chain in _chains(_crossing(runs)):
        total = 0
        for r in chain:
            known.append((r["part"], r["run"], total))
            total += r["begun"]
    base = F.broadcast(spark.createDataFrame(known, "part int, run int, base long"))  # two rows a partition at most
    w = Window.partitionBy("part", "run").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.join(base, ["part", "run"], "left").select("part", "run", "chunk", (F.coalesce("base", F.lit(0)) + F.coalesce(F.sum("begun").over(w), F.lit(0))).alias("offset"))
    placed = parsed.join(offsets, ["part", "run", "chunk"], "left").select("conv", "part", "run", "chunk", "starts", "ends", "begun", F.coalesce("offset", F.lit(0)).alias("offset"), F.inline("pieces"))
    # the last turn of a chunk may go on in the next, unless another conversation follows
    crosses = (F.col("k") == 0) | ((F.col("k") == F.col("begun")) & ~F.col("ends"))
    numbered = placed.select("conv", "part", "run", "chunk", (F.col("offset") + F.col("k") - 1).alias("turn"), "role", "text", crosses.alias("crosses"))
    within = numbered.where("not crosses").select("conv", "turn", "role", "text")
    gathered = numbered.where("crosses").groupBy("conv", "turn").agg(F.min_by("role", F.struct("part", "run", "chunk")).alias("role"), F.array_sort(F.collect_list(F.struct("part", "run", "chunk", "text"))).alias("items"))
    joined = gathered.select("conv", "turn", "role", F.array_join(F.transform("items", lambda x: x["text"]), "\n").alias("text"))
    out = within.unionByName(joined)
    return out.select("conv", "turn", "role", "text", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>")).alias("rendered"))
