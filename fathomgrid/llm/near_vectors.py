"""Embedding near-duplicates by NN-descent.

Vectors that are identical within a label are one node. Lists of nearest neighbours start from windows over sorted
hyperplane signatures; then, round by round, every node's neighbours are introduced to each other (neighbours of
neighbours are likely neighbours) and lists keep the nearest. A list whose every entry is above the threshold is
saturated: it stands for all of its component, and it is enlarged by the nearest nodes of other components. To find
those, windows go on beyond the run of a component, however long it is. Rounds go on until none joins components. Edges
at or above the threshold, in double precision, are kept.

Links are counted within components, in blocks of near vectors: two blocks whose centres and radii say that all of their
pairs link, or none, are settled by their weights alone, and only the others are compared. Recall is audited against brute
force on a bounded set of nodes, pooled and a node; further rounds follow while it is too low, and a run that ends below
``least`` is an error.

The lists bound what a round moves: each node receives its neighbours' vectors, twice ``list_size`` of them at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, forget, partitions, written

THRESHOLD = 0.98
BITS = 24


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths, in double precision; scaled first, so that no square overflows or vanishes."""
    if not x.size:
        return x
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _planes(dim: int, order: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, order]).standard_normal((dim, bits + 1))


def _usable(vec):
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _nodes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, label, vec) that can link, and nodes (node, label, dim, vec, first, copies)."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec")).where(F.col("label").isNotNull() & _usable(F.col("vec")))
    nodes = rows.groupBy("label", "vec").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    return rows, written(nodes.select(F.monotonically_increasing_id().alias("node"), "label", F.size("vec").alias("dim"), "vec", "first", "copies"))


def _signed_order(nodes: DataFrame, orders: int, seed: int) -> DataFrame:
    """Each node once for each order, with its key: the signs on random hyperplanes, then a projection."""
    key = F.xxhash64(F.col("label").cast("string"), "dim").alias("part")
    some = nodes.select(key, "node", "dim", "vec")

    def run(batches):
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = _unit(_matrix(part.column("vec")))
                for t in range(orders):
                    p = x @ _planes(int(dim), t, BITS, seed)
                    bits = ((p[:, :BITS] > 0) @ (1 << np.arange(BITS - 1, -1, -1))).astype(np.int64)
                    n = len(x)
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * int(dim)), pa.array(x.ravel().astype(np.float32)))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("part"), pa.array(np.full(n, t, np.int32)), pa.array(bits), pa.array(p[:, BITS]), part.column("node"), vec], names=["part", "t", "bits", "along", "node", "vec"]
                    )

    return some.mapInArrow(run, "part long, t int, bits long, along double, node long, vec array<float>")


def _windows(ordered: DataFrame, width: int, keep: int) -> DataFrame:
    """(node, other, sim) both ways: of the ``width`` nodes on either side in an order, the ``keep`` nearest."""

    def run(batches):
        last = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            table = pa.concat_tables([last, new]).combine_chunks() if last is not None else new
            old = len(table) - len(new)
            last = table.slice(max(0, len(table) - width))
            part, t, node = (np.asarray(table.column(c)) for c in ("part", "t", "node"))
            # one label's vectors have one length; labels end where ``part`` changes
            runs = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (t[1:] != t[:-1]), True])
            for a, b in zip(runs[:-1], runs[1:], strict=True):
                x = _matrix(table.column("vec").slice(a, b - a))
                n = b - a
                best = np.full((n, 2 * width), -2.0)
                who = np.zeros((n, 2 * width), np.int64)
                for d in range(1, min(width, n - 1) + 1):
                    sim = (x[d:] * x[:-d]).sum(1)
                    sim[np.arange(a + d, b) < old] = -2.0  # both in the part before
                    best[d:, d - 1], who[d:, d - 1] = sim, node[a : b - d]
                    best[:-d, width + d - 1], who[:-d, width + d - 1] = sim, node[a + d : b]
                k = min(keep, 2 * width)
                top = np.argpartition(-best, k - 1, axis=1)[:, :k]
                i = np.repeat(np.arange(n), k)
                sim = best[i, top.ravel()]
                good = sim > -1.5
                yield pa.RecordBatch.from_arrays([pa.array(node[a:b][i][good]), pa.array(who[i, top.ravel()][good]), pa.array(sim[good])], names=["node", "other", "sim"])

    return ordered.mapInArrow(run, "node long, other long, sim double")


def _beyond(ordered: DataFrame, width: int, keep: int) -> DataFrame:
    """(node, other, sim) both ways, for nodes of components: of the ``width`` nodes before and after the run of the
    node's component in an order, the ``keep`` nearest that are of other components."""

    def run(batches):
        last = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            if not len(new):
                continue
            table = pa.concat_tables([last, new]).combine_chunks() if last is not None else new
            part, t, node, comp = (np.asarray(table.column(c)) for c in ("part", "t", "node", "component"))
            grouped = np.asarray(table.column("grouped"))
            n = len(table)
            ends = np.flatnonzero(np.r_[(part[1:] != part[:-1]) | (t[1:] != t[:-1]), True]) + 1
            starts = np.r_[0, ends[:-1]]
            cut = np.flatnonzero(np.r_[True, (comp[1:] != comp[:-1]) | (part[1:] != part[:-1]) | (t[1:] != t[:-1])])
            # the run that the batch ends in, and what lies before it, are seen again with the next batch
            last = table.slice(max(0, int(cut[-1]) - width))
            for a, b in zip(starts, ends, strict=True):
                p = a + np.flatnonzero(grouped[a:b])
                if not len(p):
                    continue
                x = _matrix(table.column("vec").slice(a, b - a))
                r = np.searchsorted(cut, p, "right") - 1
                first, stop = cut[r], np.r_[cut[1:], n][r]
                best = np.full((len(p), 2 * width), -2.0)
                who = np.zeros((len(p), 2 * width), np.int64)
                for d in range(width):
                    for k, q in ((d, first - 1 - d), (width + d, stop + d)):
                        ok = (q >= a) & (q < b)
                        ok[ok] = comp[q[ok]] != comp[p[ok]]
                        best[ok, k] = (x[p[ok] - a] * x[q[ok] - a]).sum(1)
                        who[ok, k] = node[q[ok]]
                k = min(keep, 2 * width)
                top = np.argpartition(-best, k - 1, axis=1)[:, :k]
                i = np.repeat(np.arange(len(p)), k)
                sim, other = best[i, top.ravel()], who[i, top.ravel()]
                good = sim > -1.5
                one, two, sim = node[p][i][good], other[good], sim[good]
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[one, two]), pa.array(np.r_[two, one]), pa.array(np.r_[sim, sim])], names=["node", "other", "sim"])

    return ordered.mapInArrow(run, "node long, other long, sim double")


def _verified(pairs: DataFrame, nodes: DataFrame, threshold: float, slack: float = 1e-6) -> DataFrame:
    """Edges (a, b), a < b, of pairs whose similarity in single precision is known; where that is within ``slack`` of the
    threshold, the similarity in double precision decides."""
    some = pairs.where(F.col("sim") >= threshold - slack).groupBy(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).agg(F.max("sim").alias("sim"))
    close = some.where(F.col("sim") < threshold + slack)
    both = close.join(nodes.select(F.col("node").alias("a"), F.col("vec").alias("v")), "a").join(nodes.select(F.col("node").alias("b"), F.col("vec").alias("w")), "b")

    def run(batches):
        for batch in batches:
            v, w = (batch.column(c).to_pylist() for c in ("v", "w"))
            good = [float((_unit(np.array([x], float)) @ _unit(np.array([y], float)).T)[0, 0]) >= threshold for x, y in zip(v, w, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good, pa.bool_())), batch.column("b").filter(pa.array(good, pa.bool_()))], names=["a", "b"])

    return some.where(F.col("sim") >= threshold + slack).select("a", "b").unionByName(both.select("a", "b", "v", "w").mapInArrow(run, "a long, b long"))


def _lists(pairs: DataFrame, size: int, groups: DataFrame | None = None) -> DataFrame:
    """(node, other, sim): the nearest ``size`` of each node, ties by the other's number; given components, also the
    nearest ``size`` of other components, and whether an entry is of another one: foreign."""
    best = pairs.groupBy("node", "other").agg(F.max("sim").alias("sim"))
    foreign = F.lit(True)
    if groups is not None:
        mine = groups.select("node", F.col("component").alias("c1"))
        best = best.join(mine, "node", "left").join(mine.select(F.col("node").alias("other"), F.col("c1").alias("c2")), "other", "left")
        foreign = F.coalesce("c1", "node") != F.coalesce("c2", "other")
    best = best.select("node", "other", "sim", foreign.alias("foreign"))
    w = Window.partitionBy("node", "foreign").orderBy(F.desc("sim"), "other")
    return best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= size).drop("r")


def _introduced(lists: DataFrame, nodes: DataFrame, threshold: float, size: int, groups: DataFrame | None = None) -> DataFrame:
    """Neighbours of each node compared with each other: (node, other, sim, edge) both ways, of those that improve a list
    or are an edge; given components, of nodes of different ones. The edges connect what the links in a list connect."""
    placed = nodes.withColumn("component", F.col("node")) if groups is None else nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    worst = lists.where("foreign").groupBy("node").agg(F.min("sim").alias("low"), F.count(F.lit(1)).alias("n")).select("node", F.when(F.col("n") < size, -1.0).otherwise(F.col("low")).alias("low"))
    other = placed.join(worst, "node", "left").select(F.col("node").alias("other"), "vec", "component", F.coalesce("low", F.lit(-1.0)).alias("low"))
    meet = lists.select("node", "other").join(other, "other").repartition(partitions(lists), "node").sortWithinPartitions("node", "other")

    def run(batches):
        rest = None
        for batch in [*(), *batches, None]:
            if batch is None:
                table, rest = rest, None
                if table is None:
                    return
            else:
                new = pa.Table.from_batches([batch])
                table = pa.concat_tables([rest, new]) if rest is not None else new
                node = np.asarray(table.column("node"))
                stop = int(np.searchsorted(node, node[-1])) if len(node) else 0
                table, rest = table.slice(0, stop), table.slice(stop)
            if not len(table):
                continue
            table = table.combine_chunks()
            node, other, low, component = (np.asarray(table.column(c)) for c in ("node", "other", "low", "component"))
            cut = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            sizes = np.diff(np.r_[cut, len(node)])
            lengths = pc.list_value_length(table.column("vec")).combine_chunks().to_numpy(zero_copy_only=False)
            starts = np.r_[0, np.cumsum(lengths)]
            flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            for k, dim in {(int(k), int(d)) for k, d in zip(sizes, lengths[cut], strict=True) if k > 1}:
                at = cut[(sizes == k) & (lengths[cut] == dim)][:, None] + np.arange(k)
                x = _unit(flat[(starts[at][:, :, None] + np.arange(dim)).reshape(-1, dim)].astype(float)).reshape(*at.shape, dim)
                sims = x @ x.transpose(0, 2, 1)
                i, j = np.nonzero(~np.eye(k, dtype=bool))
                s = sims[:, i, j]
                differ = component[at][:, i] != component[at][:, j]
                # of the links within a list, those that a common link to an earlier entry makes needless are left out
                near = (sims >= threshold) & (component[at][:, :, None] != component[at][:, None, :])
                near[:, np.arange(k), np.arange(k)] = False
                close = near.astype(np.float32)
                needless = np.matmul(np.tril(close, -1), close) > 0
                needless = np.where(np.tri(k, k, -1, bool), needless.transpose(0, 2, 1), needless)
                edge = (near & ~needless)[:, i, j]
                good = differ & ((s > low[at][:, i]) | edge)
                yield pa.RecordBatch.from_arrays([pa.array(other[at][:, i][good]), pa.array(other[at][:, j][good]), pa.array(s[good]), pa.array(edge[good])], names=["node", "other", "sim", "edge"])

    return meet.select("node", "other", "vec", "low", "component").mapInArrow(run, "node long, other long, sim double, edge boolean")


def _blocks(members: DataFrame, ordered: DataFrame, block: int) -> DataFrame:
    """(component, block, weight, centre, radius, nodes), written: members (component, node, vec, copies) cut into blocks of at
    most ``block`` nodes of one component, near ones together (in the order of ``ordered``: node, bits, along). Every node is
    within an angle of ``radius`` of the centre."""
    key = ["component", "bits", "along", "node"]
    dealt = members.join(ordered.select("node", "bits", "along"), "node").repartitionByRange(partitions(members), *key).sortWithinPartitions(*key)

    def run(batches):
        at = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            component, node, copies = (np.asarray(batch.column(c)) for c in ("component", "node", "copies"))
            cuts = np.flatnonzero(np.r_[True, component[1:] != component[:-1], True])
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                x = _unit(_matrix(batch.column("vec").slice(int(a), int(b - a))))
                for lo in range(0, b - a, block):
                    part = x[lo : lo + block]
                    centre = _unit(part.mean(0, keepdims=True))[0] if part.mean(0).any() else part[0]
                    radius = float(np.arccos(np.clip(part @ centre, -1, 1)).max())
                    here = slice(a + lo, min(b, a + lo + block))
                    rows.append((int(component[a]), TaskContext.get().partitionId() << 40 | at, int(copies[here].sum()), centre.tolist(), radius, node[here].tolist()))
                    at += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["component", "block", "weight", "centre", "radius", "nodes"])

    return written(dealt.select("component", "node", "copies", "vec").mapInArrow(run, "component long, block long, weight long, centre array<double>, radius double, nodes array<long>"))


def _counted(members: DataFrame, ordered: DataFrame, threshold: float, block: int, slack: float = 1e-6) -> DataFrame:
    """(node, n_links) within components: members (component, node, vec, copies) by pairs of blocks. Only pairs of blocks that
    the triangle inequality of angles leaves open are compared, vector by vector."""
    blocks = _blocks(members, ordered, block)
    head = blocks.select("component", "block", "weight", "centre", "radius")
    a, b = (head.select("component", *[F.col(c).alias(f"{c}_{k}") for c in ("block", "weight", "centre", "radius")]) for k in "ab")
    dot = F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
    widths, most = F.col("radius_a") + F.col("radius_b"), float(np.arccos(threshold))
    pairs = a.join(b, "component").where("block_a <= block_b").withColumns({"all": F.when(F.col("block_a") == F.col("block_b"), F.lit(0.0)).otherwise(apart) + widths <= most - slack, "none": apart - widths > most + slack})
    pairs = written(pairs.where("not none").select("component", "block_a", "block_b", "weight_a", "weight_b", "all"))
    whole = pairs.where("all")
    sums = whole.select(F.col("block_a").alias("block"), F.when(F.col("block_a") == F.col("block_b"), F.col("weight_b") - 1).otherwise(F.col("weight_b")).alias("n")).unionByName(
        whole.where("block_a <> block_b").select(F.col("block_b").alias("block"), F.col("weight_a").alias("n"))
    )
    settled = sums.groupBy("block").agg(F.sum("n").alias("n")).join(blocks.select("block", "nodes"), "block").select(F.explode("nodes").alias("node"), F.col("n").alias("n_links"))
    open_pairs = pairs.where("not all").select(F.col("block_a").alias("i"), F.col("block_b").alias("j"))
    sides = open_pairs.select("i", "j", F.col("i").alias("part")).unionByName(open_pairs.where("i <> j").select("i", "j", F.col("j").alias("part")))
    placed = blocks.select(F.col("block").alias("part"), F.explode("nodes").alias("node"))
    cells = sides.join(placed, "part").join(members.select("node", "copies", "vec"), "node").select("i", "j", "part", "node", "copies", "vec")
    dealt = cells.repartition(partitions(members), "i", "j").sortWithinPartitions("i", "j")

    def count(table: pa.Table):
        x = _unit(_matrix(table.column("vec")))
        node, copies, part = (np.asarray(table.column(c)) for c in ("node", "copies", "part"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        a, b = np.flatnonzero(part == i), np.flatnonzero(part == j)
        near = x[a] @ x[b].T >= threshold
        if i == j:
            np.fill_diagonal(near, False)
            who, n = node[a], near @ copies[b] + copies[a] - 1
        else:
            who, n = np.r_[node[a], node[b]], np.r_[near @ copies[b], near.T @ copies[a]]
        return pa.RecordBatch.from_arrays([pa.array(who), pa.array(n.astype(np.int64))], names=["node", "n_links"])

    def run(batches):
        rest = None
        for batch in [*(), *batches, None]:
            table = pa.Table.from_batches([batch]) if batch is not None else None
            if rest is not None:
                table = pa.concat_tables([rest, table]) if table is not None else rest
            if table is None or not len(table):
                continue
            i, j = (np.asarray(table.column(k)) for k in ("i", "j"))
            cuts = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1]), True])
            done = cuts if batch is None else cuts[:-1]
            for a, b in zip(done[:-1], done[1:], strict=True):
                yield count(table.slice(a, b - a).combine_chunks())
            rest = table.slice(int(done[-1])) if batch is not None else None

    return dealt.mapInArrow(run, "node long, n_links long").unionByName(settled).groupBy("node").agg(F.sum("n_links").alias("n_links"))


def _audit(nodes: DataFrame, counted: DataFrame, groups: DataFrame, threshold: float, sample: int) -> float | None:
    """The share of links to other vectors found of ``sample`` nodes at most (half of them such as have links, half any),
    against all nodes, in blocks: pooled, or the mean of the nodes' shares if that is less. Links to identical vectors,
    which are known, do not count. None if no node of the sample has a link to another vector."""
    draw = lambda df, n: df.orderBy(F.xxhash64("node")).limit(n).select("node", F.col("label").cast("string").alias("label"), "vec", "copies").collect()
    picked = {r["node"]: r for r in [*draw(nodes.join(groups, "node", "left_semi"), sample // 2), *draw(nodes, sample - sample // 2)]}.values()
    if not picked:
        return None
    by: dict = {}
    for r in picked:
        by.setdefault((r["label"], len(r["vec"])), []).append(r)
    queries = {k: (np.array([r["node"] for r in v]), _unit(np.array([r["vec"] for r in v], float))) for k, v in by.items()}
    shared = nodes.sparkSession.sparkContext.broadcast(queries)  # sample vectors

    def run(batches):
        total: dict[int, int] = {}
        for batch in batches:
            labels, dims = np.asarray(batch.column("label").to_pylist(), object), np.asarray(batch.column("dim"))
            for (label, dim), (ids, q) in shared.value.items():
                mine = np.flatnonzero((labels == label) & (dims == dim))
                if len(mine):
                    part = batch.take(pa.array(mine))
                    near = _unit(_matrix(part.column("vec"))) @ q.T >= threshold
                    same = np.asarray(part.column("node"))[:, None] == ids
                    copies = np.asarray(part.column("copies"))
                    for i, n in zip(ids, copies @ (near & ~same), strict=True):
                        total[int(i)] = total.get(int(i), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["node", "n"])

    truth = nodes.select("node", F.col("label").cast("string").alias("label"), "dim", "vec", "copies").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    own = F.broadcast(nodes.sparkSession.createDataFrame([(r["node"], r["copies"] - 1) for r in picked], "node long, own long"))  # the sample
    found = truth.where("n > 0").join(own, "node").join(counted, "node", "left").withColumn("found", F.coalesce("n_links", "own") - F.col("own"))
    both = found.agg(F.sum("found").alias("found"), F.sum("n").alias("there"), F.avg(F.col("found") / F.col("n")).alias("mean")).first()
    return min(1.0, both["found"] / both["there"], both["mean"]) if both["there"] else None


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    list_size: int = 8,
    orders: int = 8,
    width: int = 8,
    block: int = 256,
    rounds: int = 2,
    max_rounds: int = 6,
    sample: int = 256,
    recall: float = 0.97,
    least: float = 0.9,
    seed: int = 0,
) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept, and the audited recall of the run (null where the audited
    nodes have no links to other vectors).

    Only vectors of equal, non-null labels and equal length are compared, by cosine in double precision. Vectors that
    are null, zero or empty, or hold nulls or non-finite numbers, link with nothing: 0 links, a component of their
    own. Identical vectors (repeated rows too) link with each other and with the same others. A null id is never the
    least of its component unless all are null; such rows are kept. An empty table gives none. Rounds end when recall
    reaches ``recall`` or after ``max_rounds``; a recall below ``least`` is then an error, not a smaller result.
    """
    rows, nodes = _nodes(vectors, id_col, vec_col, label_col)
    n_parts = partitions(vectors)
    ordered = _signed_order(nodes, orders, seed).repartitionByRange(n_parts, "part", "t", "bits", "along", "node").sortWithinPartitions("part", "t", "bits", "along", "node")
    pairs = written(_windows(ordered, width, max(4, list_size // 2)))
    edges = written(_verified(pairs, nodes, threshold))
    lists = written(_lists(pairs, list_size))
    forget(pairs)
    groups, counted, wider, rate = None, None, None, None
    for k in range(max_rounds):
        if groups is not None:
            placed = nodes.select("node").join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.col("component").isNotNull().alias("grouped"))
            wide = _signed_order(nodes, orders, seed).join(placed, "node").repartitionByRange(n_parts, "part", "t", "bits", "along", "node").sortWithinPartitions("part", "t", "bits", "along", "node")
            wider = written(_beyond(wide, width, max(4, list_size // 2)))
            lists = written(_lists(lists.drop("foreign").unionByName(wider), list_size, groups), keep=lists)
        new = written(_introduced(lists, nodes, threshold, list_size, groups))
        fresh = new.where("edge").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
        if wider is not None:
            fresh = fresh.unionByName(_verified(wider, nodes, threshold))
        joins = groups is None or fresh.limit(1).count() > 0  # given components, all that is fresh joins two
        if joins:
            edges = written(edges.unionByName(fresh).distinct(), keep=edges)
        lists = written(_lists(lists.drop("foreign").unionByName(new.drop("edge")), list_size, groups), keep=lists)
        forget(new)
        if wider is not None:
            forget(wider)
        if k + 1 < rounds:
            continue
        if joins:
            if groups is not None:
                forget(groups)
            groups = components(edges)
            if k + 1 < max_rounds:
                continue
        if counted is not None and not joins:
            break  # nothing was found since the last count
        members = groups.join(nodes.select("node", "vec", "copies"), "node").select("component", "node", "vec", "copies")
        alone = nodes.join(groups, "node", "left_anti").select("node", (F.col("copies") - 1).alias("n_links"))
        counted = written(_counted(members, _signed_order(nodes, 1, seed), threshold, block).unionByName(alone), keep=counted)
        rate = _audit(nodes, counted, groups, threshold, sample)
        if rate is None or rate >= recall:
            break
    if rate is not None and rate < least:
        raise RuntimeError(f"near_vectors: the audited recall is {rate:.3f} after {max_rounds} rounds, below {least}")
    placed = nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    of_node = placed.join(least, "component").join(counted, "node").select(F.col("label").alias("l"), F.col("vec").alias("v"), "n_links", "component_id")
    good = rows.join(of_node, (F.col("label") == F.col("l")) & (F.col("vec") == F.col("v"))).select("id", "n_links", "component_id")
    bad = vectors.where(~(F.col(label_col).isNotNull() & _usable(F.col(vec_col)))).select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))
    out = good.unionByName(bad)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(rate).cast("double").alias("audited_recall"))
