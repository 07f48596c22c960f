"""Exact dedup by deterministic block naming (DataFrame functions only).

A text, lower-cased in A-Z, is cut into blocks of a fixed number of bytes. The distinct blocks are sorted and get
integers as names; then adjacent names of a text form pairs, the distinct pairs are sorted and named in turn, until
one name is left: two texts with equally many bytes have the same last name if and only if they are identical.

What is shuffled at full width is each distinct block once per task (partial aggregation), to prove that no two
blocks share a 64-bit routing hash; the rows of documents carry only that hash. Blocks that do share one are told
apart by their rank in sorted order, found by a join on the content itself. So names are free of collisions
whatever the hash does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written

BLOCK_BYTES = 8192
BROADCAST_ROWS = 200_000  # of about 100 bytes each


def normalised(text: Column) -> Column:
    """A-Z to lower case and nothing else; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(t) == F.char_length(t)
    return F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _routing(cols: list[Column], hash_bits: int) -> Column:
    h = F.xxhash64(*cols)
    return h if hash_bits >= 64 else F.pmod(h, F.lit(1 << hash_bits))


def _named(distinct_keys: DataFrame) -> DataFrame:
    """(h, rank) to name: positions in sorted order. Sorted by range partitions, so no task holds all of them."""
    return distinct_keys.sort("h", "rank").select("h", "rank", F.monotonically_increasing_id().alias("name"))


def _ranked(distinct: DataFrame) -> DataFrame:
    """Contents with their rank among those of the same routing hash, in sorted order."""
    return distinct.withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("block")))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row per row of docs: (id, sha256, n_bytes, name). Rows have equal (n_bytes, name) exactly if texts are equal.

    Null and empty texts are one empty block. Any id, null and repeated ones included; extra columns are not read.
    ``hash_bits`` narrows the routing hash, for tests of colliding hashes.
    """
    text = normalised(F.col(text_col))
    base = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    data = base.select("id", F.encode("t", "UTF-8").alias("b"))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.length("b") / block_bytes)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda i: F.substring(F.col("b"), i * block_bytes + 1, F.lit(block_bytes)))
    # each distinct block is shuffled once, to prove that no routing hash belongs to two contents
    content = data.select(F.explode(blocks).alias("block")).select(_routing([F.col("block")], hash_bits).alias("h"), "block")
    once = content.groupBy("h", "block").agg(F.lit(1).alias("one"))
    crowded = written(once.select("h").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    collide = crowded.limit(1).count() > 0
    hashes = data.select("id", F.sha2("b", 256).alias("sha"), F.length("b").cast("long").alias("n_bytes"), F.transform(blocks, lambda x: _routing([x], hash_bits)).alias("hs"))
    rows = written(hashes)
    cells = rows.select("id", "sha", "n_bytes", F.posexplode("hs").alias("pos", "h"))
    if collide:
        shared = written(_ranked(content.join(crowded, "h", "left_semi").distinct()))
        again = data.select(F.sha2("b", 256).alias("sha"), F.posexplode(blocks).alias("pos", "block")).withColumn("h", _routing([F.col("block")], hash_bits))
        told = again.join(shared, ["h", "block"]).select("sha", "pos", "rank").distinct()
        cells = cells.join(told, ["sha", "pos"], "left").withColumn("rank", F.coalesce("rank", F.lit(1)))
    else:
        cells = cells.withColumn("rank", F.lit(1))
    names = written(_named(cells.groupBy("h", "rank").agg(F.lit(1).alias("one"))))
    level = written(cells.join(names, ["h", "rank"]).select("id", "sha", "n_bytes", "pos", "name"))
    done = level.where(F.col("n_bytes") <= block_bytes).select("id", "sha", "n_bytes", "name")
    left = level.where(F.col("n_bytes") > block_bytes).distinct()
    longest = rows.agg(F.max(F.size("hs"))).first()[0] or 1
    forget(names)
    spans = 1
    while spans < longest:
        spans *= 2
        pairs = left.groupBy("id", "sha", "n_bytes", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"), F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("r")
        )
        pairs = pairs.withColumn("r", F.coalesce("r", F.lit(-1)))
        table = written(pairs.groupBy("l", "r").agg(F.lit(1).alias("one")).sort("l", "r").select("l", "r", F.monotonically_increasing_id().alias("name")))
        left = written(pairs.join(table, ["l", "r"]).select("id", "sha", "n_bytes", "pos", "name"))
        forget(table)
    # one row for each id and text here; repeated rows come back from `rows`
    long_rows = rows.where(F.col("n_bytes") > block_bytes).select("id", "sha", "n_bytes")
    named = left.select(F.col("id").alias("i"), F.col("sha").alias("s"), "name")
    long_done = long_rows.join(named, F.col("id").eqNullSafe(F.col("i")) & (F.col("sha") == F.col("s"))).select("id", "sha", "n_bytes", "name")
    return done.unionByName(long_done).withColumnRenamed("sha", "sha256")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: id, keep_id (largest id of equal texts), group_size, kept, text_sha256.

    Null and empty texts equal each other. An id that repeats with the same text is one document: all its rows have
    the same ``kept``. Where all ids of a group are null, keep_id is null and kept is true. An empty table gives none.
    """
    rows = written(identities(docs, id_col, text_col, **options))
    # only groups of several are joined back, from a written table, so the join itself can split a large group
    several = written(rows.groupBy("n_bytes", "name").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    alone = F.col("n").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep"))
    return rows.join(several, ["n_bytes", "name"], "left").select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha256").alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, all columns as they were: one of each group of equal texts, of the largest id.

    Which rows go is a narrow table of (id, sha256) of the rows that are not kept, joined away; rows that repeat the
    id and text of the kept one are told apart by their other columns, or are one of equals.
    """
    groups = written(exact_groups(docs, id_col, text_col, **options))
    keys = [F.col(id_col).alias("__dd_id"), F.col("text_sha256").alias("__dd_sha")]
    gone = groups.where("not kept").select(*keys).distinct()
    again = groups.where("kept").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__dd_id", "__dd_sha")
    apart = written(gone.withColumn("__dd_gone", F.lit(True)).unionByName(again.withColumn("__dd_gone", F.lit(False))))
    n_apart, n_again = apart.agg(F.count(F.lit(1)), F.count_if(~F.col("__dd_gone"))).first()
    small = F.broadcast if n_apart <= BROADCAST_ROWS else (lambda x: x)
    ready = docs.withColumn("__dd_key", F.sha2(F.encode(normalised(F.col(text_col)), "UTF-8"), 256))
    on = F.col(id_col).eqNullSafe(F.col("__dd_id")) & (F.col("__dd_key") == F.col("__dd_sha"))
    single = ready.join(small(apart.drop("__dd_gone")), on, "left_anti").drop("__dd_key")
    if not n_again:
        return single
    repeated = ready.join(small(apart.where("not __dd_gone").drop("__dd_gone")), on, "left_semi").dropDuplicates([id_col, "__dd_key"])
    return single.unionByName(repeated.drop("__dd_key"))
