"""SimHash near-dedup by a self-join over a binary trie.

1. A text's fingerprint: XXH64 (seed 42) of each of its 3-word shingles, repeats included; a bit
   is 1 if more than half of the hashes have it. Spark hashes, numpy takes the majority.
2. Distinct fingerprints are the points of a binary trie. Pairs of its nodes of equal depth are
   followed from the pair (root, root) down: a pair carries the bits in which its two prefixes
   differ, and goes once these exceed the budget. While a node of the pair holds over LEAF
   points, the descent is a join of staged tables, STEP bits at a time, on nodes and counts
   alone (only nodes that are that full take part). A pair whose nodes are small enough meets in
   one task with its points, where numpy follows it further, whole levels of node pairs at a time.
3. A task gives each of its points that has a link the least point joined with it there, and the
   number of documents that it links with. Connected components of these give the groups.

Exact: no pair within the budget is lost, none is found twice (a pair of points lies in one pair
of nodes only).

Cost: at the depth where nodes hold about a point each, a node has 1 + d + d * (d - 1) / 2
partners, d being the logarithm of the number of fingerprints; copies of one text are a single
point. A task holds at most 2 * LEAF points and a bounded stack of node pairs, however densely
near copies lie: what is returned is a row for each point, not one for each link.

Defined results: texts of 1 or 2 words are one shingle (the whole sequence); null, empty and blank
texts have fingerprint zero and are linked like any other. Rows that share an id are one
document: linked through any of their texts. A row without an id counts for links; its
component is the least id reachable, null if there is none. An empty table gives an empty
table; only the id and the text are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop_stage, fresh, lower_ascii, stage, words
from .components import connected_components

BITS, BUDGET = 64, 2
#: Bits of one step of the descent, and points of a node that is no longer split by a join.
STEP, LEAF = 4, 16_384
#: Broadcast bound of a level's nodes (some 30 bytes each).
MAX_BROADCAST = 200_000
#: Node pairs that a task follows at once, and the size up to which a pair is looked through.
_CHUNK, _SMALL = 1 << 16, 12
#: Hashes added up at once: 255 fit into a byte.
_RUN, _BLOCK = 255, 1 << 18


def shingle_hashes(w: Column) -> Column:
    """XXH64 (seed 42) of each 3-word shingle of an array of words, joined by spaces."""
    n = F.size(w)
    twos = F.zip_with(w, F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))
    threes = F.zip_with(twos, F.slice(w, 3, n), lambda a, b: F.xxhash64(F.concat(a, F.lit(" "), b)))
    none = F.array().cast("array<bigint>")
    return F.when(n >= 3, F.slice(threes, 1, F.greatest(n - 2, F.lit(0)))).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(none)


def majority(lists: pa.Array) -> pa.Array:
    """For each list of 64-bit values the value of the bits that over half of them have; 0 if empty."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    h = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    size = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    ends = np.cumsum(size)
    runs = -(-size // _RUN)  # of at most _RUN values of one list
    owner = np.repeat(np.arange(len(size)), runs)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    starts = (ends - size)[owner] + first * _RUN
    counts = np.zeros((len(size), 8, 8), np.int64)  # by list, place in a byte, byte
    ones = np.uint64(0x0101010101010101)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _BLOCK)))
        lo, hi = starts[at], starts[to] if to < len(starts) else len(h)
        for place in range(8):
            sums = np.add.reduceat((h[lo:hi] >> np.uint64(place)) & ones, starts[at:to] - lo)
            np.add.at(counts[:, place], owner[at:to], sums.view(np.uint8).reshape(-1, 8))
        at = to
    bits = (2 * counts > size[:, None, None]).astype(np.uint64)
    place = np.arange(8, dtype=np.uint64)
    return pa.array((bits << (place[:, None] + np.uint64(8) * place[None, :])).sum((1, 2), dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of each row."""
    cut = docs.select(F.col(id_col).cast("long").alias("id"), words(lower_ascii(F.col(text_col))).alias("w"))
    hashed = cut.select("id", shingle_hashes(F.col("w")).alias("h"))
    return hashed.select("id", F.arrow_udf(majority, "long")("h").alias("fp"))


# the descent inside a task


def _pairs(x: np.ndarray, cut: int, depth: int, differ: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j, of all pairs of the sorted distinct points x within the budget: of points before
    cut with points after it, or of all points if cut is 0. The two (or the one) are nodes of
    that depth, with prefixes that differ in so many bits."""
    bit = (x[None, :] >> np.arange(BITS - 1, -1, -1, dtype=np.uint64)[:, None]) & np.uint64(1)
    ones = np.zeros((BITS, len(x) + 1), np.int32)  # points before a place that have the bit of a depth
    np.cumsum(bit, axis=1, out=ones[:, 1:], dtype=np.int32)
    start = [np.array([v], np.int32) for v in ((0, cut, cut, len(x)) if cut else (0, len(x), 0, len(x)))]
    stack = [(depth, *start, np.array([differ], np.int8))]
    while stack:
        depth, a0, a1, b0, b1, d = stack.pop()
        few = (a1 - a0).astype(np.int64) * (b1 - b0) <= _SMALL
        if few.any():
            na, nb = (a1 - a0)[few], (b1 - b0)[few]
            size = (na * nb).astype(np.int64)
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            nb = np.repeat(nb, size)
            i, j = np.repeat(a0[few], size) + k // nb, np.repeat(b0[few], size) + k % nb
            near = (i < j) & (np.bitwise_count(x[i] ^ x[j]) <= BUDGET)
            yield i[near], j[near]
            a0, a1, b0, b1, d = (v[~few] for v in (a0, a1, b0, b1, d))
        if not len(a0):
            continue
        am, bm = (hi - (ones[depth][hi] - ones[depth][lo]) for lo, hi in ((a0, a1), (b0, b1)))
        kids = [(a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1), (am, a1, b0, bm, np.where(a0 == b0, BUDGET + 1, d + 1))]
        a0, a1, b0, b1, d = (np.concatenate(v) for v in zip(*kids, strict=True))
        live = (d <= BUDGET) & (a0 < a1) & (b0 < b1)
        a0, a1, b0, b1, d = (v[live] for v in (a0, a1, b0, b1, d))
        stack += [(depth + 1, *(v[k : k + _CHUNK] for v in (a0, a1, b0, b1, d.astype(np.int8)))) for k in range(0, len(a0), _CHUNK)]


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label (for each point the least known to be joined with it) after joining i with j."""
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def _meet(key: tuple, table: pa.Table) -> pa.Table:
    """Of one pair of nodes (depth, a, b): (fp, root, links) of each point that has a link."""
    depth, a, b = (k.as_py() for k in key)
    x, docs = (table.column(c).to_numpy() for c in ("fp", "docs"))
    order = np.argsort(x.view(np.uint64))
    x, docs = x.view(np.uint64)[order], docs[order]
    cut = 0
    if a != b:  # the node of lesser unsigned prefix comes first
        least = np.uint64(min(a % 2**64, b % 2**64))
        cut = int(np.count_nonzero(x >> np.uint64(BITS - depth) == least))
    label, links = np.arange(len(x)), np.zeros(len(x), np.int64)
    for i, j in _pairs(x, cut, depth, ((a ^ b) % 2**64).bit_count()):
        label = _join(label, i, j)
        np.add.at(links, i, docs[j])
        np.add.at(links, j, docs[i])
    some = links > 0
    return pa.table({"fp": x[some].view(np.int64), "root": x[label[some]].view(np.int64), "links": links[some]})


# the descent by joins


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("fp", BITS - depth) if depth else F.lit(0).cast("long")


def _node_pairs(points: DataFrame, leaf: int) -> list[tuple[int, DataFrame]]:
    """(depth, (a, b)) tables of all node pairs within the budget whose nodes hold at most leaf points."""
    spark, done = points.sparkSession, []
    live = spark.createDataFrame([(0, 0, 0)], "a long, b long, differ int")
    n, depth = points.count(), 0
    if n <= leaf:
        return [(0, live.select("a", "b"))]
    while depth < BITS and not live.isEmpty():
        depth += STEP
        held = points.groupBy(_prefix(depth).alias("node")).agg(F.count("*").alias("n"))
        kids = stage(held.withColumn("up", F.shiftrightunsigned("node", STEP)), "nodes")
        side = lambda c: broadcast_if_small(kids, MAX_BROADCAST).select(F.col("up").alias(c), F.col("node").alias(f"{c}2"), F.col("n").alias(f"n_{c}"))  # noqa: E731, B023
        apart = F.col("differ") + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")).bitwiseAND((1 << STEP) - 1))
        once = (F.col("a") != F.col("b")) | (F.col("a2") <= F.col("b2"))
        below = live.join(side("a"), "a").join(side("b"), "b").where((apart <= BUDGET) & once)
        below = stage(below.select(F.col("a2").alias("a"), F.col("b2").alias("b"), apart.cast("int").alias("differ"), F.greatest("n_a", "n_b").alias("n")), "pairs")
        small = F.lit(depth == BITS) | (F.col("n") <= leaf)
        done.append((depth, below.where(small).select("a", "b")))
        live = below.where(~small).select("a", "b", "differ")
    return done


def fingerprint_links(points: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Of distinct fingerprints (fp, docs): (fp, root, links) by node pair, staged. fp and root are
    joined through links; links counts the documents that fp links with there."""
    parts = []
    for depth, pairs in _node_pairs(points, leaf):
        sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))
        parts.append(points.withColumn("node", _prefix(depth)).join(sides, "node").select(F.lit(depth).alias("depth"), "a", "b", "fp", "docs"))
    meeting = parts[0]
    for p in parts[1:]:
        meeting = meeting.union(p)
    return stage(meeting.groupBy("depth", "a", "b").applyInArrow(_meet, "fp long, root long, links long"), "met")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """A row for each row of docs: id, fp, component (the least id reachable), n_links (rows of other
    or equal fingerprint within the budget), kept (the row's id is its component's, or none there has
    an id)."""
    rows = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    points = stage(rows.groupBy("fp").agg(F.count("*").alias("docs"), F.min("id").alias("least")), "points")
    met = fingerprint_links(points.select("fp", "docs"), leaf)
    named = rows.where("id is not null").groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    several = stage(named.where("lo < hi").select("id", "lo"), "same_id")
    same_id = rows.join(broadcast_if_small(several, MAX_BROADCAST), "id").where("fp <> lo").select(F.col("lo").alias("a"), F.col("fp").alias("b"))
    parts = connected_components(met.where("fp <> root").select(F.col("fp").alias("a"), F.col("root").alias("b")).union(same_id))

    links = met.groupBy("fp").agg(F.sum("links").alias("links"))
    told = points.join(parts.withColumnRenamed("node", "fp"), "fp", "left").join(links, "fp", "left")
    told = stage(
        told.select("fp", "least", F.coalesce("component", "fp").alias("c"), (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "told"
    )
    least = told.groupBy("c").agg(F.min("least").alias("component"))
    told = stage(told.join(least, "c").select("fp", "component", "n_links"), "classes")
    drop_stage(points, met)
    kept = F.col("component").isNull() | F.col("id").eqNullSafe(F.col("component"))
    return rows.join(told, "fp").select("id", "fp", "component", "n_links", kept.alias("kept"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that a near duplicate of lesser id stands for. Rows without an id stay
    unless a document with one stands for them."""
    key, gone = fresh("fp", docs), fresh("gone", docs)
    judged = near_duplicates(docs, id_col, text_col).where("not kept")
    ids = stage(judged.select(F.col("id").alias(gone), F.col("fp").alias(key)).distinct(), "gone")
    named = ids.where(F.col(gone).isNotNull()).select(gone).distinct()
    kept = docs.join(broadcast_if_small(named, MAX_BROADCAST), F.col(id_col).cast("long") == F.col(gone), "left_anti")
    nameless = ids.where(F.col(gone).isNull()).select(key)
    if nameless.isEmpty():
        return kept
    fp = F.arrow_udf(majority, "long")(shingle_hashes(words(lower_ascii(F.col(text_col)))))
    bare = kept.where(F.col(id_col).isNull()).withColumn(fresh("mark", docs), fp)
    bare = bare.join(broadcast_if_small(nameless, MAX_BROADCAST), F.col(fresh("mark", docs)) == F.col(key), "left_anti").select(*docs.columns)
    return kept.where(F.col(id_col).isNotNull()).union(bare)
