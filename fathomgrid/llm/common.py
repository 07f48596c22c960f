"""Shared parts: written tables in the shared folder, byte-level text blocks, connected components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
WORD = r"[^\x20\x09-\x0D]+"


def ready(spark: SparkSession) -> None:
    """Let the Python workers import this package wherever the driver has it from, and bound what a batch of whole texts
    holds: a fifth of the rows that Arrow batches have unless the session says otherwise."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "2000")
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where that is unset, a folder in the warehouse, and a
    temporary one only where all of Spark runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.startswith("local"):
            path = "file://" + tempfile.mkdtemp(prefix="fathomgrid-")
        else:
            path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/fathomgrid-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends here, and lost executors lose nothing.

    ``keep`` is an earlier result of this function that is no longer needed; its files are removed.
    """
    spark = df.sparkSession
    ready(spark)
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fathom_path = path
    if keep is not None:
        forget(keep)
    return out


def forget(df: DataFrame) -> None:
    """Remove the files behind a result of ``written``."""
    path = getattr(df, "_fathom_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b: long), as (node, component = least node reachable).

    Every round gives each node the least label among its neighbours and its own, then follows the label's label
    (pointer jumping), so that the number of rounds grows with the logarithm of a component's diameter. Both steps
    are minima with map-side partial aggregation and equi-joins whose hot keys the adaptive join splits; no list of
    neighbours is gathered.
    """
    both = written(edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        hop = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("c1"))
        up = labels.select(F.col("node").alias("c1"), F.col("component").alias("c2"))
        new = written(hop.join(up, "c1", "left").select("node", "old", F.least("c1", F.coalesce("c2", "c1")).alias("component")))
        changed = new.where("component <> old").limit(1).count()
        forget(labels)
        labels = new.select("node", "component")
        labels._fathom_path = new._fathom_path
        if not changed:
            forget(both)
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


# --- byte-level blocks of texts -------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: A second lane modulo a prime: the first lane alone would have texts that collide in every base (those that follow the
#: Thue-Morse sequence), as all polynomials modulo a power of two do.
_PRIME = np.uint64(2**31 - 1)
_SMALL = _RNG.integers(1, 2**31 - 1, 256, dtype=np.uint64)
_ROOT = 1_410_000_007 % (2**31 - 1)
_RESIDUES: list[np.ndarray] = [np.ones(1, np.uint32), np.ones(1, np.uint32)]
_TURN = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _BACK)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def _residues(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a number and of its inverse modulo the prime, by doubling."""
    if len(_RESIDUES[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_ROOT, pow(_ROOT, -1, int(_PRIME)))):
            p = np.ones(1, np.uint32)
            while len(p) < size:
                p = np.concatenate([p, (p * np.uint64(pow(base, len(p), int(_PRIME))) % _PRIME).astype(np.uint32)])
            _RESIDUES[k] = p
    return _RESIDUES[0], _RESIDUES[1]


class TextBlock:
    """Whole texts of one block as bytes: data, and where each text starts and ends in it."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = raw[at[0] : at[-1]]
        self.bounds = at - at[0]

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and for each text the index of its first word (one more entry at the end)."""
        n = len(self.data)
        word = np.zeros(n + 2, bool)
        word[1 : n + 1] = ~_SPACE[self.data]
        first = word[1 : n + 1] & ~word[:n]
        cuts = self.bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first[cuts] = word[cuts + 1]
        starts = np.flatnonzero(first)
        last = word[1 : n + 1] & ~word[2:]
        last[cuts - 1] |= word[cuts]
        ends = np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each lower-cased word (A-Z only): polynomial prefix sums in two lanes, modulo 2^64 and modulo a
        prime, one pass over the bytes each."""
        n = len(self.data)
        up, down = _powers(n + 1)
        small = _LOWER[self.data]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[small] * up[:n], out=sums[1:])
        first = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
        up, down = _residues(n + 1)
        np.cumsum(_SMALL[small] * up[:n] % _PRIME, out=sums[1:])  # below 2^31 each, so that no sum of 2^33 overflows
        second = (sums[ends] - sums[starts]) % _PRIME * down[starts] % _PRIME
        return mixed(first ^ mixed(second + _BASE))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words (of the whole sequence where a text has fewer), and each text's bounds in them."""
        starts, ends, first = self.words()
        h = self.word_hashes(starts, ends)
        counts = np.diff(first)
        runs = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
        bounds = np.zeros(len(self) + 1, np.int64)
        np.cumsum(runs, out=bounds[1:])
        total = int(bounds[-1])
        doc = np.repeat(np.arange(len(self)), runs)
        at = first[:-1][doc] + (np.arange(total) - bounds[:-1][doc])
        length = np.minimum(counts, k)[doc]
        out = np.zeros(total, np.uint64)
        padded = np.concatenate([h, np.zeros(k, np.uint64)])
        for j in range(k):
            out += np.where(j < length, padded[at + j] * _TURN[j], np.uint64(0))
        return mixed(out + length.astype(np.uint64) * _TURN[60]), bounds


def trimmed() -> None:
    """Give memory back to the system, that of long tables of powers too, so that a reused worker does not hold on to it in
    later stages."""
    for tables in (_POWERS, _RESIDUES):
        tables[:] = [t[: 1 << 16].copy() for t in tables]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def small_blocks(batches, text: str, most: int = 1 << 20):
    """Cut Arrow batches to about ``most`` bytes of text each; a longer text is a block by itself, never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // most
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))
    trimmed()
