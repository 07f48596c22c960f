"""Ingest state of days: verified attempts, failures, conflicts, retries; in batches or as a stream of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATE = "utc_date date, sha256 string, state string, attempts long"
#: States in which bytes are held; a failure never replaces them.
HELD = ["retrieved", "verified", "conflict"]


def byte_state(expected: Column, got: Column, crc_ok: Column) -> Column:
    """STA-7: verified if the length matches or the archive's checksums do, else unverified."""
    return F.when((expected.isNotNull() & (expected == got)) | F.coalesce(crc_ok, F.lit(False)), "verified").otherwise("unverified")


def upsert(state: DataFrame, incoming: DataFrame) -> DataFrame:
    """STA-1, STA-4, STA-5: new dates enter as verified; an attempt with the same content is a retry and changes nothing but the
    count; one with other content is a conflict, and the bytes first verified stay. Attempts of one batch for a date
    count in order of their content."""
    per_date = incoming.groupBy("utc_date").agg(F.min("sha256").alias("first"), F.max("sha256").alias("last"), F.count(F.lit(1)).alias("n"))
    both = state.join(per_date, "utc_date", "full_outer")
    known = F.col("sha256").isNotNull()
    held = F.coalesce("sha256", "first")
    differs = F.col("n").isNotNull() & ((F.col("first") != held) | (F.col("last") != held))
    new_state = F.when(F.coalesce(differs, F.lit(False)), "conflict").when(known & F.col("state").isin(*HELD), F.col("state")).when(F.col("n").isNotNull(), "verified").otherwise(F.col("state"))
    return both.select("utc_date", held.alias("sha256"), new_state.alias("state"), (F.coalesce("attempts", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("attempts"))


def into_skeleton(days: DataFrame, state: DataFrame) -> DataFrame:
    """STA-4: the state of every date of a period, absent ones with no attempts; a date beyond the period is an error."""
    if state.join(days, "utc_date", "left_anti").limit(1).count():
        raise ValueError("a date beyond the period")
    both = days.select("utc_date").join(state, "utc_date", "left")
    return both.select("utc_date", "sha256", F.coalesce("state", F.lit("absent")).alias("state"), F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"))


def accounting(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """STA-9: (utc_date, claimed, found, fault) for each date of a manifest (utc_date, rows) or of the rows themselves (utc_date):
    sums by date, and what is wrong: missing, unrequested, differs or nothing."""
    claimed = manifest.groupBy("utc_date").agg(F.sum("rows").alias("claimed"))
    found = observed.groupBy("utc_date").agg(F.count(F.lit(1)).alias("found"))
    both = claimed.join(found, "utc_date", "full_outer")
    return both.withColumn("fault", F.when(F.col("found").isNull(), "missing").when(F.col("claimed").isNull(), "unrequested").when(F.col("claimed") != F.col("found"), "differs").otherwise(""))


def failed(state: DataFrame, failures: DataFrame) -> DataFrame:
    """STA-2: failed attempts are counted; a date that holds bytes keeps its state."""
    per_date = failures.groupBy("utc_date").agg(F.count(F.lit(1)).alias("n"))
    both = state.join(per_date, "utc_date", "full_outer")
    new = F.when(F.col("state").isin(*HELD), F.col("state")).when(F.col("n").isNotNull(), "failed").otherwise(F.col("state"))
    return both.select("utc_date", "sha256", new.alias("state"), (F.coalesce("attempts", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("attempts"))


def attached(state: DataFrame, references: DataFrame) -> DataFrame:
    """STA-3, STA-10: downstream references by date; a reference that claims more than the state holds is an error."""
    both = state.join(references, "utc_date", "left")
    bad = both.where((F.col("claims") == "verified") & (F.col("state") != "verified")).limit(1).count()
    if bad:
        raise ValueError("a reference claims a completeness that its date does not have")
    return both


def to_do(incoming: DataFrame, state: DataFrame) -> DataFrame:
    """STA-6: attempts whose date and content are not recorded yet."""
    done = state.where(F.col("state") == "verified").select("utc_date", "sha256")
    return incoming.join(done, ["utc_date", "sha256"], "left_anti")


def roll_up(state: DataFrame) -> DataFrame:
    """STA-8."""
    return state.agg(F.count(F.lit(1)).alias("dates"), *[F.count_if(F.col("state") == s).alias(s) for s in ("verified", "conflict", "failed", "absent")])


def date_sets(requested: DataFrame, observed: DataFrame) -> DataFrame:
    """STA-9, SET-1, SET-2, FLT-15: (which, dates): dates requested only, observed only, and both."""
    r, o = requested.select("utc_date").distinct(), observed.select("utc_date").distinct()
    named = lambda d, n: d.agg(F.count(F.lit(1)).alias("dates")).select(F.lit(n).alias("which"), "dates")
    return named(r.subtract(o), "missing").unionByName(named(r.intersect(o), "common")).unionByName(named(o.subtract(r), "unrequested"))


def stream_days(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, ts: str = "at"):
    """STR-2: a file stream whose micro-batches are kept once each, whatever is retried: rows carry their batch, and a batch
    that is written again replaces itself. Available files are processed, then the stream ends."""
    rows = spark.readStream.schema(schema).parquet(source).withColumn("utc_date", F.to_date(ts))

    def put(batch: DataFrame, number: int) -> None:
        # a batch owns its folder, so writing it again replaces only itself
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number:09d}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tracks(rows: DataFrame, gap_s: float, key: str = "vessel") -> DataFrame:
    """STR-3: (key, track, first, last, rows): a gap longer than ``gap_s`` breaks a track."""
    w = Window.partitionBy(key).orderBy("at", "seq")
    breaks = F.coalesce((F.unix_micros("at") - F.unix_micros(F.lag("at").over(w)) > int(gap_s * 1e6)).cast("int"), F.lit(0))
    numbered = rows.withColumn("b", breaks).withColumn("track", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "track").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("rows"))


def live_tracks(rows: DataFrame, gap: str = "300 seconds", late: str = "1 hour", key: str = "vessel") -> DataFrame:
    """STR-3 on a stream: session windows with a watermark."""
    return rows.withWatermark("at", late).groupBy(F.session_window("at", gap), key).agg(F.count(F.lit(1)).alias("rows"))
