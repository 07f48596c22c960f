"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sizes are words. Targets share all words by weight, stop at ``max_repeats`` times a source's size, and reshare the
excess. Each source's documents lie end to end, in a seeded order, in shards of bounded size; a shard is cut into
blocks of equally many words. Seats (blocks) go to sources by the highest quotient target / (2 seats + 1), then from
each source to its shards in the same way, so every shard has an integer quota; whole passes over a shard come
first and a seeded choice of its blocks takes the rest. What a document gives follows in closed form from its span.
Where whole documents are wanted, each shard's words are rounded to documents, and what rounding leaves is carried on.

Only the table of shards, of at most ``max_shards`` rows plus one for each source, reaches the driver.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TextBlock, small_blocks, written

WEIGHTS = (1.0, 2.0, 3.0)


def sainte_lague(weights: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotient weight / (2 n + 1), none above its cap; ties go to the earlier party.

    A divisor found by bisection gives almost all seats at once, so the time does not grow with ``seats``.
    """
    w = np.asarray(weights, float)
    cap = np.where(w > 0, np.asarray(caps, float), 0)
    seats = int(min(seats, cap.sum()))
    if seats <= 0:
        return [0] * len(weights)
    low, high = 0.0, float(w.max()) * 2 + 1  # divisor: seats are the rounded quotients
    for _ in range(200):
        mid = (low + high) / 2
        if mid <= low or mid >= high:
            break
        given = np.minimum(np.floor(w / mid + 0.5), cap).sum()
        low, high = (mid, high) if given > seats else (low, mid)
    n = np.minimum(np.floor(w / high + 0.5), cap).astype(np.int64)
    heap = [(-w[i] / (2 * n[i] + 1), i) for i in range(len(w)) if n[i] < cap[i]]
    heapq.heapify(heap)
    rest = seats - int(n.sum())
    while rest > 0:
        _, i = heapq.heappop(heap)
        n[i] += 1
        rest -= 1
        if n[i] < cap[i]:
            heapq.heappush(heap, (-w[i] / (2 * n[i] + 1), i))
    return [int(x) for x in n]


def targets(sizes: list[int], weights: list[float], total: float, max_repeats: float) -> list[float]:
    """Shares of ``total`` by weight; what goes above max_repeats times a size is reshared until none is above."""
    out, fixed = [0.0] * len(sizes), [False] * len(sizes)
    while True:
        open_weight = sum(w for w, f in zip(weights, fixed, strict=True) if not f)
        rest = total - sum(x for x, f in zip(out, fixed, strict=True) if f)
        above = False
        for i, f in enumerate(fixed):
            if not f:
                out[i] = rest * weights[i] / open_weight
        for i, f in enumerate(fixed):
            if not f and out[i] > max_repeats * sizes[i]:
                out[i], fixed[i], above = float(max_repeats * sizes[i]), True, True
        if not above or all(fixed):
            return out


def _counted(batches):
    for batch in batches:
        for part in small_blocks([batch], "text"):
            counts = np.diff(TextBlock(part.column("text")).words()[2]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("source"), part.column("draw"), pa.array(counts, pa.int64())], names=["id", "source", "draw", "size"])


def _draw(id_col: str, text_col: str, seed: int):
    """A seeded 64-bit draw for a row, from its id and length: the same wherever and however often it is computed."""
    return F.xxhash64(F.lit(seed), F.col(id_col), F.char_length(F.col(text_col)))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """(id, source, draw, size): the words of every whole text, counted on its bytes; null texts have none."""
    some = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _draw(id_col, text_col, seed).alias("draw"), F.col(text_col).alias("text"))
    kind = some.schema["id"].dataType.simpleString()
    return some.mapInArrow(_counted, f"id {kind}, source string, draw long, size long")


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    max_repeats: int = 3,
    seed: int = 0,
    docs_per_shard: int = 256,
    max_shards: int = 100_000,
    finest: int = 32,
) -> tuple[DataFrame, DataFrame, int]:
    """Rows with their shards and spans' order, the quota of each shard, and the words in a block.

    Sources by code point, null last, weigh ``weights``, repeating. A block has as many words as the smallest
    source with any holds in 64 parts, at most ``finest``, so each source's taken words are within about a block per
    shard of its target.
    """
    rows = written(sized(docs, id_col, text_col, source_col, seed))
    spark = rows.sparkSession
    table = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()
    table.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [int(r["size"]) for r in table]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(table))], float(sum(sizes)), max_repeats) if table else []
    n_rows = sum(int(r["n"]) for r in table)
    per_shard = max(docs_per_shard, -(-n_rows // max_shards))
    block = max(1, min([finest, *(s // 64 for s in sizes if s)]))
    facts = spark.createDataFrame(
        [(r["source"], i, int(-(-r["n"] // per_shard)), sizes[i], float(aims[i])) for i, r in enumerate(table)],
        "s string, source_no int, shards int, source_size long, target double",
    )
    # the facts are one row a source, as many as were just counted on the driver
    dealt = (
        rows.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("shard", F.pmod("draw", F.col("shards")).cast("int"))
        .select("id", "source", "draw", "size", "source_no", "shards", "source_size", "target", "shard")
    )
    shards = sorted(map(tuple, dealt.groupBy("source_no", "shard").agg(F.sum("size")).collect()))
    blocks = [-(-s // block) for _, _, s in shards]
    by_source: dict[int, list[int]] = {}
    for k, (i, _, _) in enumerate(shards):
        by_source.setdefault(i, []).append(k)
    caps = [sum(max_repeats * blocks[k] for k in by_source.get(i, [])) for i in range(len(table))]
    seats = sainte_lague(aims, round(sum(aims) / block), caps)
    plan = []
    for i, ks in by_source.items():
        quota = sainte_lague([float(shards[k][2]) for k in ks], seats[i], [max_repeats * blocks[k] for k in ks])
        for k, q in zip(ks, quota, strict=True):
            n = max(1, blocks[k])
            start = int(np.random.default_rng([seed, i, shards[k][1]]).integers(n))
            plan.append((i, shards[k][1], n, q // n, q % n, start))
    quotas = spark.createDataFrame(plan, "q_source int, q_shard int, blocks long, passes long, some long, start long")
    return dealt, quotas, block


def _taken(dealt: DataFrame, quotas: DataFrame, block: int) -> DataFrame:
    """The rows of ``plan_mix`` with their shards' quotas and the words that the chosen blocks take of each."""
    w = Window.partitionBy("source_no", "shard").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    spans = dealt.withColumn("stop", F.sum("size").over(w)).withColumn("from", F.col("stop") - F.col("size"))
    # at most max_shards rows and one a source
    both = spans.join(F.broadcast(quotas), (F.col("source_no") == F.col("q_source")) & (F.col("shard") == F.col("q_shard")))

    def before(x):  # of the first x words of a shard, so many lie in chosen blocks: every (blocks / some)-th of them
        chosen = f"((`{x}` div {block} + {{}}) * some + start) div blocks"
        return F.expr(f"({chosen.format(0)}) * {block} + ({chosen.format(1)} - {chosen.format(0)}) * (`{x}` % {block})")

    taken = F.col("passes") * F.col("size") + before("stop") - before("from")
    return both.withColumn("taken", taken.cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, taken (words the mix takes, repeats counted).

    Documents without words, and sources without any, take 0. Repeated ids are separate rows, each with a span of its
    own. An empty table gives none. The same rows and seed give the same result, whatever their order or partitions
    (rows that agree in id, source, length and size are alike, and share their common span in some order).
    See ``plan_mix`` for the options.
    """
    both = _taken(*plan_mix(docs, id_col, text_col, source_col, **options))
    return both.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken")


def _rounded(rows: DataFrame, seed: int) -> DataFrame:
    """Rows of ``_taken`` with copies: a document is taken as often as its shard has whole passes, or once more. Within
    a shard the longest come first, each by a seeded draw whose chance is the share of it that is due; what is taken too
    much or too little is carried to the next, so that a shard's words end near its quota."""
    some = rows.select("source_no", "shard", "size", "draw", "id", "source", "passes", "taken", (F.pmod(F.xxhash64(F.lit(seed + 2), "draw"), F.lit(1 << 30)) / float(1 << 30)).alias("u"))
    dealt = some.repartition("source_no", "shard").sortWithinPartitions("source_no", "shard", F.desc("size"), "draw", "id")

    def run(batches):
        at, rest = None, 0
        for batch in batches:
            copies = []
            columns = (batch.column(c).to_pylist() for c in ("source_no", "shard", "size", "passes", "taken", "u"))
            for no, shard, size, passes, taken, u in zip(*columns, strict=True):
                if (no, shard) != at:
                    at, rest = (no, shard), 0
                rest += taken - passes * size
                more = size > 0 and rest > u * size
                rest -= size if more else 0
                copies.append(passes + more)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), batch.column("draw"), batch.column("size"), pa.array(copies, pa.int64())], names=["id", "source", "draw", "size", "copies"])

    return dealt.mapInArrow(run, f"id {some.schema['id'].dataType.simpleString()}, source string, draw long, size long, copies long")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **options) -> DataFrame:
    """docs itself, each row as often as the block choice of ``mix`` says, rounded to whole documents along its shard, so
    that a shard's words stay within about a document of its quota. All columns come back as they were.

    Rows find their copies by id, source and draw; those that agree in all three are told apart by their words.
    """
    copies = _rounded(_taken(*plan_mix(docs, id_col, text_col, source_col, seed=seed, **options)), seed)
    keys = ("__mix_draw", "__mix_id", "__mix_source")
    told = written(copies.select(F.col("draw").alias(keys[0]), F.col("id").alias(keys[1]), F.col("source").alias(keys[2]), F.col("size").alias("__mix_size"), F.col("copies").cast("int").alias("__mix_copies")))
    ready = docs.withColumns({keys[0]: _draw(id_col, text_col, seed), keys[1]: F.col(id_col), keys[2]: F.col(source_col)})
    words = F.size(F.split(F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ")), " "))
    twice = told.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    alike = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    rare = ready.join(twice, alike(ready, twice), "left_semi").withColumn("__mix_size", words)
    more = told.join(twice, alike(told, twice), "left_semi")
    number = lambda df: df.withColumn("__mix_k", F.row_number().over(Window.partitionBy(*keys).orderBy("__mix_size")))
    rare, more = number(rare), number(more)
    once = told.join(twice, alike(told, twice), "left_anti").where("__mix_copies > 0")
    found = ready.join(once, alike(ready, once)).select(*[ready[c] for c in docs.columns], "__mix_copies")
    again = rare.join(more, [*alike(rare, more), rare["__mix_k"] == more["__mix_k"]]).where("__mix_copies > 0").select(*[rare[c] for c in docs.columns], "__mix_copies")
    out = found.unionByName(again)
    return out.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*docs.columns)
