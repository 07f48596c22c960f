"""N-gram Jaccard self-join by universe partition and the pigeonhole principle, verified exactly.

A document is the set of its distinct k-word shingles; equal sets are one node. Sizes fall into bands whose ends grow
by 4/3, so a partner of at most the allowed difference lies in the same band or the next. In the context of a band
(that of the larger set) hashing cuts the universe of shingles into m segments. Two sets that link differ in at most
H shingles, so H segments at most differ, and of any H + 1 segments one is equal in both.

Cost-based allocation decides what is indexed. Empty segments cost most (everything matches them) and give none;
segments whose signatures turn out to be hot give none either, as long as H + 1 others are left. A set with too few
segments takes part once more with one-deletion neighbourhoods, where a segment counts twice, in partitions of other
salts until it has enough. A pair is found if either set has enough, so nothing is lost. What is left of hot
signatures is compared with one pivot each; where that does not put all sets of a signature in one component, sets that
share enough shingles with any other are compared in blocks of bounded size. Everything is verified on whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TextBlock, components, forget, mixed, partitions, scratch_dir, small_blocks, trimmed, written

K_WORDS = 5
COLD = 12  # signatures of more sets than this are hot
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20  # of narrow rows; both are counted before


def _bands() -> np.ndarray:
    """Largest size of each band."""
    ends = [0, 1]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, ends[-1] * 4 // 3))
    return np.array(ends, np.int64)


BANDS = _bands()
_KEPT = np.uint64((1 << 48) - 1)  # of a signature, when packed


def most_different(small: int, large: int) -> int:
    """How many shingles two linked sets of these sizes can differ in: 100 * common >= 75 * union."""
    return (small + large) // 7


def segments_of(band: int) -> int:
    h = most_different(int(BANDS[band]), int(BANDS[band]))
    return int((h + 1) * 1.15) + 2


def _level_salt(level: int) -> np.uint64:
    return np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1) + 0x1234567) % 2**64)


def signatures(s: np.ndarray, band: int, context: int, lower: bool, max_levels: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set in one context, and for each a word: context << 16 | level << 10 | lower << 9 | slack.

    Slack is how many of level 0's segments may be left out; 511 means none may (a set that has not enough).
    """
    n = len(s)
    h = most_different(n, min(int(BANDS[context]), 4 * n // 3))
    if h == 0:  # distinct sets of these sizes cannot link
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    m = np.uint64(segments_of(context))
    out, meta = [], []
    base = np.uint64(context) << np.uint64(40)
    for level in range(max_levels):
        t = mixed(s ^ _level_salt(level))
        seg = (t >> np.uint64(20)) % m
        order = np.argsort(seg, kind="stable")
        seg, t = seg[order], t[order]
        cut = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        size = np.diff(np.r_[cut, n])
        total = np.add.reduceat(t, cut)
        place = base | np.uint64(level) << np.uint64(32) | seg[cut]
        full = mixed(total ^ mixed(place))
        if level == 0:
            slack = len(cut) - (h + 1)
            out.append(full)
            word = context << 16 | lower << 9 | (min(slack, 510) if slack >= 0 else 511)
            meta.append(np.full(len(full), word, np.uint32))
            if slack >= 0:
                break
            continue
        big = size >= 2  # without one token, of segments that keep some
        which = np.repeat(np.arange(len(cut)), size)
        some = big[which]
        less = mixed((total[which] - t)[some] ^ mixed(place[which][some]))
        out += [full, less]
        meta.append(np.full(len(full) + len(less), context << 16 | level << 10 | lower << 9 | 511, np.uint32))
        if int(np.where(big, 2, 1).sum()) >= h + 1:
            break
    else:
        raise RuntimeError("no salt spreads this set")
    sig, meta = np.concatenate(out), np.concatenate(meta)
    # two signatures that are one when packed are counted once: such a set asks for one match only
    return sig, meta if len(np.unique(sig & _KEPT)) == len(sig) else meta | np.uint32(511)


def _sets(block: TextBlock, k: int):
    """For each text of a block: its sorted distinct shingle hashes."""
    hashes, bounds = block.shingles(k)
    for i in range(len(block)):
        s = np.sort(hashes[bounds[i] : bounds[i + 1]])
        yield s if len(s) < 2 else s[np.r_[True, s[1:] != s[:-1]]]


def _names(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit names of a set."""
    one = mixed(mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) ^ np.uint64(len(s)))
    two = mixed(mixed(s + np.uint64(0x3C6EF372FE94F82B)).sum(dtype=np.uint64) + np.uint64(len(s)))
    return int(one), int(two)


def _node(s: np.ndarray, clashing: frozenset[int]) -> int:
    """A set's name: the first of its two, or the second where others' first is the same."""
    one, two = _names(s)
    return two if clashing and one in clashing else one


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def document_sets(docs: DataFrame, id_col: str, text_col: str, k: int = K_WORDS) -> DataFrame:
    """(id, n_shingles, node, other): one row per row of docs; the set's two names are null for texts without words."""
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for part in small_blocks(batches, "text"):
            n, nodes, others = [], [], []
            for s in _sets(TextBlock(part.column("text")), k):
                one, two = _names(s) if len(s) else (0, 0)
                n.append(len(s))
                nodes.append(one)
                others.append(two)
            n = np.array(n, np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), *(pa.array(_signed(x), pa.int64(), mask=n == 0) for x in (nodes, others))], names=["id", "n_shingles", "node", "other"])

    return some.mapInArrow(run, f"id {some.schema['id'].dataType.simpleString()}, n_shingles long, node long, other long")


def named_sets(docs: DataFrame, id_col: str, text_col: str, k: int = K_WORDS, most_clashes: int = 100_000) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """(id, n_shingles, node) of every row; (node, first, n, size) of every set; and the first names that several sets
    share. These are counted, not assumed away: they are about N^2 / 2^65 of N sets, and a set's second name tells them
    apart. Two sets are taken for one only if 128 bits of them agree."""
    rows = written(document_sets(docs, id_col, text_col, k))
    both = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("size"), F.min("other").alias("lo"), F.max("other").alias("hi"))
    firsts = written(both)
    found = firsts.where("lo <> hi").select("node").limit(most_clashes + 1).collect()
    if len(found) > most_clashes:
        raise RuntimeError(f"more than {most_clashes} names clash")
    if not found:
        return rows.drop("other"), firsts.drop("lo", "hi"), frozenset()
    clashing = F.broadcast(docs.sparkSession.createDataFrame([(r["node"], True) for r in found], "node long, __clash boolean"))  # at most most_clashes
    rows = rows.join(clashing, "node", "left").withColumn("node", F.when(F.col("__clash"), F.col("other")).otherwise(F.col("node"))).drop("__clash", "other")
    again = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("size"))
    return rows, written(again, keep=firsts), frozenset(r["node"] & (1 << 64) - 1 for r in found)


def _six(x: np.ndarray) -> bytes:
    """The low six bytes of each word."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _packed(docs: DataFrame, text_col: str, k: int, groups: int, clashing: frozenset[int], most: int = 300_000) -> DataFrame:
    """Signature records in packed rows, one a group and about ``most`` records: runs of one set keep its name once.

    Equal sets of such a piece count once. Signatures lose two bytes here, which can only add candidates (see the end of
    ``signatures``).
    """

    def flush(sig, node, meta):
        sig, node, meta = map(np.concatenate, (sig, node, meta))
        g = (sig >> np.uint64(48)) % np.uint64(groups)
        order = np.argsort(g, kind="stable")
        sig, node, meta, g = sig[order], node[order], meta[order], g[order]
        cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        stop = np.r_[cut[1:], len(g)]
        run = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (node[1:] != node[:-1]) | (meta[1:] != meta[:-1])])
        length = np.diff(np.r_[run, len(g)]).astype(np.uint32)
        first, last = np.searchsorted(run, cut), np.searchsorted(run, stop)
        columns = [
            [_six(sig[a:b]) for a, b in zip(cut, stop, strict=True)],
            *([x[a:b].tobytes() for a, b in zip(first, last, strict=True)] for x in (node[run], meta[run], length)),
        ]
        return pa.RecordBatch.from_arrays([pa.array(g[cut].astype(np.int32))] + [pa.array(x, pa.binary()) for x in columns], names=["g", "sig", "node", "meta", "length"])

    def run(batches):
        seen, sig, node, meta, size = set(), [], [], [], 0
        for part in small_blocks(batches, "text"):
            for s in _sets(TextBlock(part.column("text")), k):
                if not len(s) or (name := _node(s, clashing)) in seen:
                    continue
                seen.add(name)
                band = int(np.searchsorted(BANDS, len(s)))
                for lower in (0, 1):
                    a, b = signatures(s, band, band + lower, bool(lower))
                    if len(a):
                        sig.append(a)
                        meta.append(b)
                        node.append(np.full(len(a), name, np.uint64))
                        size += len(a)
                if size >= most:
                    yield flush(sig, node, meta)
                    seen, sig, node, meta, size = set(), [], [], [], 0
        if sig:
            yield flush(sig, node, meta)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "g int, sig binary, node binary, meta binary, length binary")


def _matched(table: pa.Table) -> pa.Table:
    """Of one group's records: the pairs of cold signatures (kind 0: a < b, the context, both slacks, how many), and the
    rows of hot ones (kind 1: node, sig, meta)."""
    read = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
    sig = _from_six(b"".join(table.column("sig").to_pylist()))
    length = read("length", np.uint32)
    node, meta = np.repeat(read("node", np.uint64), length), np.repeat(read("meta", np.uint32), length)
    order = np.argsort(sig, kind="stable")
    sig = sig[order]
    shared = np.r_[False, sig[1:] == sig[:-1]]
    shared[:-1] |= shared[1:]
    order, sig = order[shared], sig[shared]  # signatures of one record match nothing
    node, meta = node[order], meta[order]
    order = np.lexsort((meta, node, sig))
    sig, node, meta = sig[order], node[order], meta[order]
    once = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])][: len(sig)]
    sig, node, meta = sig[once], node[once], meta[once]
    first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]][: len(sig)])
    sizes = np.diff(np.r_[first, len(sig)])
    size = np.repeat(sizes, sizes)
    cold = np.flatnonzero((size > 1) & (size <= COLD))
    sig_c, node_c, meta_c = sig[cold], _signed(node[cold]), meta[cold].astype(np.int64)
    parts = [np.zeros((0, 4), np.int64)]
    for d in range(1, COLD):
        i = np.flatnonzero((sig_c[d:] == sig_c[:-d]) & ((meta_c[d:] & meta_c[:-d]) >> 9 & 1 == 0))
        a, b, ma, mb = node_c[i], node_c[i + d], meta_c[i], meta_c[i + d]
        swap = a > b
        parts.append(np.stack([np.where(swap, b, a), np.where(swap, a, b), np.where(swap, mb, ma), np.where(swap, ma, mb)], 1))
    pairs = np.concatenate(parts)
    if len(pairs):
        pairs = pairs[np.lexsort(pairs.T[::-1])]
        cut = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]).any(1)])
        times = np.diff(np.r_[cut, len(pairs)])
        pairs = pairs[cut]
    else:
        times = np.zeros(0, np.int64)
    hot = size > COLD
    h = int(hot.sum())
    none = np.zeros(h, np.int64)
    columns = {
        "kind": np.r_[np.zeros(len(pairs), np.int32), np.ones(h, np.int32)],
        "a": np.r_[pairs[:, 0], _signed(node[hot])],
        "b": np.r_[pairs[:, 1], _signed(sig[hot])],
        "ma": np.r_[pairs[:, 2], meta[hot].astype(np.int64)],
        "mb": np.r_[pairs[:, 3], none],
        "times": np.r_[times, none],
    }
    out = pa.table({c: pa.array(v.astype(np.int32) if c == "kind" else v.astype(np.int64)) for c, v in columns.items()})
    trimmed()
    return out


def _matched_part(batches):
    """``_matched`` of all of a partition, which is one group of about as many records as ``links`` asks for."""
    batches = list(batches)
    if batches:
        yield from _matched(pa.Table.from_batches(batches)).to_batches()


def _likely(found: DataFrame, hot: DataFrame | None) -> DataFrame:
    """(a, b) of cold pairs that match often enough. Of a set's segments in a context at most H differ from a linked
    set's, so at least slack + 1, less its hot ones, must match; one is enough where a set has no slack."""
    pairs = found.where("kind = 0").groupBy("a", "b", "ma", "mb").agg(F.sum("times").alias("times"))
    if hot is not None:
        counts = hot.groupBy("node", "meta").agg(F.count(F.lit(1)).alias("n"))
        for side in "ab":
            pairs = pairs.join(counts.select(F.col("node").alias(side), F.col("meta").alias(f"m{side}"), F.col("n").alias(f"hot_{side}")), [side, f"m{side}"], "left")
    else:
        pairs = pairs.withColumns({"hot_a": F.lit(0), "hot_b": F.lit(0)})

    def needed(side):
        slack = F.col(f"m{side}") % 512
        return F.when(slack == 511, 1).otherwise(slack + 1 - F.coalesce(f"hot_{side}", F.lit(0)))

    return pairs.where(F.col("times") >= F.greatest(F.lit(1), needed("a"), needed("b"))).select("a", "b").distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, distance, linked) of pairs of nodes, from whole sets."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    sized = both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb") - common).cast("long").alias("union"))
    return sized.select("a", "b", (1 - F.col("common") / F.col("union")).alias("distance"), (100 * F.col("common") >= 75 * F.col("union")).alias("linked"))


def _small(rows: DataFrame, key: str) -> bool:
    """Whether a written table of keys is small enough to be broadcast, by its rows and their bytes."""
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.col(key).cast("string")) + 32).alias("bytes")).first()
    return n["rows"] <= BROADCAST_ROWS and (n["bytes"] or 0) <= BROADCAST_BYTES


def _shingle_sets(docs: DataFrame, firsts: DataFrame, pairs: DataFrame, id_col: str, text_col: str, k: int, clashing: frozenset[int]) -> DataFrame:
    """(node, shingles) of the nodes in pairs, each from one of its documents, read again."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0null"))
    wanted = written(firsts.join(nodes, "node").select("node", key("first").alias("key")))
    keys = wanted.select("key").distinct()
    if _small(wanted, "key"):
        keys = F.broadcast(keys)
    some = docs.select(key(id_col).alias("key"), F.col(text_col).alias("text")).join(keys, "key", "left_semi").select("text")

    def run(batches):
        for part in small_blocks(batches, "text"):
            found = {_node(s, clashing): s for s in _sets(TextBlock(part.column("text")), k) if len(s)}
            if found:
                arrays = [_signed(s) for s in found.values()]
                offsets = np.r_[0, np.cumsum([len(x) for x in arrays])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(list(found)), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays), pa.int64()))], names=["node", "shingles"])

    sets = some.mapInArrow(run, "node long, shingles array<long>")
    return written(sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]))


def _hot_pairs(hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of hot signatures that cannot be left out, as (sig, node), and the pairs of each with its signature's pivot.

    A set leaves its hot signatures out if enough cold ones are left to it. The pivot is the set with the most hot
    rows: in a group of near copies, the one that shares most with the others.
    """
    short = hot.groupBy("node", "meta").agg(F.count(F.lit(1)).alias("n")).where((F.col("meta") % 512 == 511) | (F.col("n") > F.col("meta") % 512)).select("node", "meta")
    kept = written(hot.join(short, ["node", "meta"], "left_semi").select("sig", "node"))
    weight = kept.groupBy("node").agg(F.count(F.lit(1)).alias("weight"))
    weighed = written(kept.join(weight, "node"))
    pivots = weighed.groupBy("sig").agg(F.max(F.struct("weight", "node")).alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sig", F.col("p.node").alias("pivot"))
    stars = weighed.join(pivots, "sig").where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    rows = weighed.join(pivots, "sig").select("sig", "node", "pivot")
    return rows, stars


def links(docs: DataFrame, firsts: DataFrame, clashing: frozenset[int], id_col: str, text_col: str, k: int = K_WORDS, per_group: int = 2_000_000) -> DataFrame:
    """(a, b): links between nodes that connect every pair of linked sets: all links of cold pairs, and of hot ones
    enough that two linked sets are always in one component. ``firsts`` names a document (first) of each node.

    Signatures are matched in groups of about ``per_group``, as many as the sets' sizes ask for: a set of n shingles has
    about 4 n / 5 of them.
    """
    shingles = firsts.agg(F.sum("size")).first()[0] or 0
    groups = max(partitions(docs), -(-4 * shingles // (5 * per_group)))
    # one group a partition, so that none has several by chance
    dealt = _packed(docs, text_col, k, groups, clashing).repartitionById(groups, F.col("g"))
    found = written(dealt.mapInArrow(_matched_part, "kind int, a long, b long, ma long, mb long, times long"))
    hot = found.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("sig"), F.col("ma").alias("meta"))
    some_hot = hot.limit(1).count() > 0
    cold = _likely(found, hot if some_hot else None)
    if some_hot:
        members, stars = _hot_pairs(hot)
        members, stars = written(members), written(stars)
        pairs = written(cold.unionByName(stars).distinct())
    else:
        pairs = written(cold.distinct())
    sets = _shingle_sets(docs, firsts, pairs, id_col, text_col, k, clashing)
    checked = written(_verified(pairs, sets))
    good = checked.where("linked").select("a", "b")
    if not some_hot:
        out = written(good)
        for table in (found, pairs, sets, checked):
            forget(table)
        return out
    labels = components(good)
    more = _torn_links(members, labels, sets)
    out = written(good.unionByName(more))
    for table in (found, members, stars, pairs, sets, checked, labels):
        forget(table)
    return out


def _torn_links(members: DataFrame, labels: DataFrame, sets: DataFrame, block: int = 1024) -> DataFrame:
    """Links between components within hot signatures that hold several.

    Two sets that link share three quarters of either, so a set of which fewer shingles occur in any other of these
    sets links with none; this is counted twice, as sets that go make others rarer. Those left are compared within
    their pivot's group in pairs of blocks of bounded size, however large a group is, and blocks of a single component
    are passed over. Only links come out, one for two components that a pair of blocks connects.
    """
    placed = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    torn = placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("sig")
    near = written(placed.join(torn, "sig", "left_semi").select("pivot", "node", "component").distinct())
    left = near.select("node").distinct()
    for _ in range(2):
        tokens = sets.join(left, "node", "left_semi").select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("t"))
        shared = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t")
        left = written(tokens.join(shared, "t").groupBy("node", "size").agg(F.count(F.lit(1)).alias("n")).where("4 * n >= 3 * size").select("node"))
    some = near.join(left, "node", "left_semi")
    mixed_groups = some.groupBy("pivot").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    dealt = some.join(mixed_groups.select("pivot", F.ceil(F.col("n") / block).cast("int").alias("parts")), "pivot").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cells = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("pivot", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "part", "node", "component")
    mixed_cells = cells.groupBy("pivot", "i", "j").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("pivot", "i", "j")
    rows = cells.join(mixed_cells, ["pivot", "i", "j"], "left_semi").join(sets, "node").select("pivot", "i", "j", "part", "node", "component", "shingles")
    sorted_rows = rows.repartition(partitions(members), "pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")
    out = written(sorted_rows.mapInArrow(_compared, "a long, b long"))
    forget(near)
    return out


def _compared(batches):
    """Links across components in each cell of sorted rows (pivot, i, j, part, node, component, shingles)."""
    rest = None
    for batch in [*(), *batches, None]:
        table = pa.Table.from_batches([batch]) if batch is not None else None
        if rest is not None:
            table = pa.concat_tables([rest, table]) if table is not None else rest
        if table is None or not len(table):
            continue
        c = np.stack([np.asarray(table.column(k)).astype(np.int64) for k in ("pivot", "i", "j")], 1)
        cuts = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]).any(1), True])
        done = cuts if batch is None else cuts[:-1]
        for a, b in zip(done[:-1], done[1:], strict=True):
            yield _cell_links(table.slice(a, b - a).combine_chunks())
        rest = table.slice(int(done[-1])) if batch is not None else None


def _cell_links(cell: pa.Table, width: int = 2048) -> pa.RecordBatch:
    node, component, part = (np.asarray(cell.column(k)) for k in ("node", "component", "part"))
    lists = cell.column("shingles").combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    tokens = lists.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(node)), lengths)
    _, column, times = np.unique(tokens, return_inverse=True, return_counts=True)
    several = times[column] > 1
    owner, column = owner[several], np.unique(column[several], return_inverse=True)[1] if several.any() else column[several]
    i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
    a, b = np.flatnonzero(part == i), np.flatnonzero(part == j)
    common = np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [start, start + width])
        present = np.zeros((len(node), width), np.float32)
        present[owner[lo:hi], column[lo:hi] - start] = 1
        common += present[a] @ present[b].T
    union = lengths[a][:, None] + lengths[b][None] - common
    x, y = np.nonzero((100 * common >= 75 * union) & (component[a][:, None] != component[b][None]))
    x, y = a[x], b[y]
    if len(x):
        _, first = np.unique(np.stack([component[x], component[y]], 1), axis=0, return_index=True)
        x, y = x[first], y[first]
    return pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], names=["a", "b"])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K_WORDS) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (least id reachable by links, itself included).

    Words are lower-cased in A-Z. With fewer than k words the whole sequence is one shingle; null, empty and blank
    texts have none and link with nothing (their component is their own id). Equal sets link, so repeated rows are in
    one component. Null ids take part; they are never the least id unless all ids of a component are null. An empty
    table gives none. Texts of any length are read whole.
    """
    scratch_dir(docs.sparkSession)
    rows, firsts, clashing = named_sets(docs, id_col, text_col, k)
    found = links(docs, firsts, clashing, id_col, text_col, k)
    labels = components(found)
    linked = firsts.join(labels, "node")
    roots = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    wide = linked.join(roots, "component").select("node", "component_id")
    copies = firsts.join(labels, "node", "left_anti").where("n > 1").select("node", F.col("first").alias("component_id"))
    known = written(wide.unionByName(copies))
    for table in (labels, found, firsts):
        forget(table)
    out = rows.join(known, "node", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("component_id").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K_WORDS) -> DataFrame:
    """The rows of docs that stay, all columns as they were: of each component, the document of the least id.

    A narrow table of the ids that go is joined away. Rows with a null id stay (null ids of several documents cannot
    be told apart), and so do all rows of an id that is its component's least.
    """
    gone = written(jaccard_components(docs, id_col, text_col, k).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__nd_id")).distinct())
    if _small(gone, "__nd_id"):
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col] == F.col("__nd_id"), "left_anti")
