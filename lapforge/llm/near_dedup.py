"""MinHash near-dedup by a signature-coordinate inverted join.

1. Every text becomes the set of its distinct 5-word shingles (64-bit hashes; A-Z folded), a
   128-bit hash of that set and a MinHash signature of K coordinates. Equal sets are one
   class; its least doc_id stands for it from here on.
2. Each class posts its id under (coordinate, value) pairs. Skipping: a pair that only one
   class posts can't collide. A class that reaches T matches collides in one of any K - T + 1
   coordinates, so these are posted first, and a class without a collision there is skipped
   whole; so is one with under T shared posts in the end.
3. Merging: in every list each member meets the list's two pivots (members with the most shared
   posts, an order that all lists share), and the meetings of a pair are added up over all
   lists: its count of collisions. Pairs with T or more are retained. A pair with fewer may owe
   that to other pivots; if it met in its prefix (with a class's m posts by length of list, its
   m - T + 1 shortest lists, where every pair with T collisions meets), the lists that it was
   not counted in are probed. All retained pairs are confirmed on the full shingle sets.
4. Completion: links join classes into components. A prefix list whose members are of one
   component is done: its other pairs can't change a result. The classes of lists that are
   left (they may hold a passage that many texts share) meet once more, across components
   only, in an exact prefix join of their rarest shingles, confirmed on the full sets alone. So
   no link that joins different components is lost, and a group of n near copies costs about
   n comparisons, not n * n.

Recall: a pair at similarity 0.75 collides Binomial(64, 0.75) times; fewer than 32 has a
chance of about 1e-5, and less for more similar pairs.

Cost: linear but for the exact join, where the members of a cell (a rare shingle, two size bands)
outside its most frequent component meet all others of the cell, k outside of m in k * m pairs at most
(no bound holds for k: texts of many components may share a rare shingle). A class is posted there only
if the shingles that it shares with other components could make up a link at all, and a pair
is made only if the parity bits allow the similarity.

Defined results: texts of 1 to 4 words are one shingle (the whole sequence); null, empty and
blank texts have an empty set and link with nothing. Rows that share a doc_id are one
document: linked through any of their texts, and near_dedup keeps one row of it (the text with
the least hash). A row without doc_id is a document named by its text: it counts for links, its
component is the least doc_id reachable (null if there is none, and then the text with the least
hash is kept). An empty table gives an empty table; other columns come through untouched.

Plan: every join is between staged tables, so that Spark splits a skewed key (copies of one text,
a pivot of many) over tasks; nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, document_key, drop_stage, fresh, stage
from .components import connected_components
from .texthash import mix, text_blocks, windows, word_hashes

WORDS, K, T = 5, 64, 32
PERCENT = 75
#: Ids of documents whose full sets are needed are broadcast up to this count (8 bytes each).
MAX_BROADCAST = 500_000
#: Ratio of the sizes of a band in the exact join.
BAND = 1.07
#: Words of parity bits of a set.
LONGS = 16
_A = np.random.default_rng(11).integers(0, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(12).integers(0, 2**63, K, dtype=np.uint64)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes in order of text, number of shingles of each text), repeats included."""
    h, counts = word_hashes(texts, fold=True)
    w, per_text = windows(h, counts, WORDS)
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    if not len(short):
        return w, per_text
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    whole = np.zeros(len(short), np.uint64)
    for k in range(WORDS - 1):  # the k-th word of each short text that has one
        has = counts[short] > k
        whole[has] = mix(whole[has] * np.uint64(0xD6E8FEB86659FD93) + h[starts[short[has]] + k] + np.uint64(k + 1))
    at = np.cumsum(per_text)[short] - per_text[short]
    per_text = per_text.copy()
    per_text[short] = 1
    return np.insert(w, at, whole), per_text


def _distinct(w: np.ndarray, per_text: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(per_text)
    return [np.unique(w[e - n : e]) for e, n in zip(ends, per_text, strict=True)]


def _sign(texts: pa.Array) -> pa.Array:
    ns, s1, s2, sigs = [], [], [], []
    for lo, hi in text_blocks(texts):
        w, per_text = shingles(texts.slice(lo, hi - lo))
        sets = _distinct(w, per_text)
        ns += [len(u) for u in sets]
        s1 += [int(u.sum(dtype=np.uint64).view(np.int64)) for u in sets]
        s2 += [int(mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) for u in sets]
        full = np.flatnonzero(per_text)
        starts = np.cumsum(per_text)[full] - per_text[full]
        sig = np.empty((len(full), K), np.uint64)
        for k in range(K if len(full) else 0):
            low = np.minimum.reduceat((w ^ _B[k]) * _A[k], starts)
            sig[:, k] = (low >> np.uint64(6)) | np.uint64(k << 58)
        rows: list = [None] * len(sets)
        for i, row in zip(full, sig.view(np.int64), strict=True):
            rows[i] = row
        sigs += rows
    sig_array = pa.array(sigs, pa.list_(pa.int64()))
    return pa.StructArray.from_arrays(
        [pa.array(ns, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), sig_array], names=["n", "s1", "s2", "sig"]
    )


def _sets(texts: pa.Array) -> pa.Array:
    """(set, bits): the shingles, and 64 * LONGS parity bits that each shingle flips one of."""
    sets: list[np.ndarray] = []
    bits: list[np.ndarray] = []
    for lo, hi in text_blocks(texts):
        for u in _distinct(*shingles(texts.slice(lo, hi - lo))):
            at = (mix(u ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(64 * LONGS)).astype(np.int64)
            sets.append(u.view(np.int64))
            bits.append(np.packbits(np.bincount(at, minlength=64 * LONGS).astype(np.uint8) & 1).view(np.int64))
    longs = pa.list_(pa.int64())
    return pa.StructArray.from_arrays([pa.array(sets, longs), pa.array(bits, longs)], names=["set", "bits"])


def _ordered(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _near_size(a, b):
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _full_sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, set, bits), staged, of the classes reps. The texts are read (and, beyond the broadcast,
    shuffled) this once; every later step takes its sets from here. Equal rows of an id count once,
    so that an id of many rows doesn't multiply its pairs."""
    ids = stage(reps.select(F.col("rep").alias("node")).distinct(), "ids")
    needed = docs.join(broadcast_if_small(ids, MAX_BROADCAST), "node", "left_semi")
    x = F.arrow_udf(_sets, "set array<long>, bits array<long>")("text").alias("x")
    sets = stage(needed.select(F.col("node").alias("rep"), x).select("rep", "x.*"), "sets")
    drop_stage(ids)
    if sets.groupBy("rep").count().where("count > 1").isEmpty():
        return sets
    once = sets.groupBy("rep", F.xxhash64("set").alias("h")).agg(F.first(F.struct("set", "bits")).alias("x"))
    once = stage(once.select("rep", "x.*"), "once")
    drop_stage(sets)
    return once


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the staged pairs (a, b) those with the similarity on full sets; pairs may repeat."""
    side = lambda c: sets.select(F.col("rep").alias(c), F.col("set").alias(f"{c}_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    alike = 100 * shared >= PERCENT * (F.size("a_set") + F.size("b_set") - shared)
    return stage(both.where(alike & (shared > 0)).select("a", "b"), "links")


def _retained(sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From signatures (rep, n, sig): (pairs (a, b) with T collisions or more of a class and a
    pivot, prefix posts (tok, rep, n) of all classes that may reach T)."""
    early = sigs.select("rep", F.explode(F.slice("sig", 1, K - T + 1)).alias("tok"))
    common = stage(early.groupBy("tok").count().where("count > 1").select("tok"), "common")
    alive = stage(early.join(broadcast_if_small(common, MAX_BROADCAST), "tok", "left_semi").select("rep").distinct(), "alive")
    live = stage(sigs.join(broadcast_if_small(alive, MAX_BROADCAST), "rep", "left_semi"), "live")
    posts = live.select("rep", "n", F.explode("sig").alias("tok"))
    lists = stage(posts.groupBy("tok").count().where("count > 1"), "lists")
    by_class = posts.join(lists, "tok").groupBy("rep", "n").agg(F.sort_array(F.collect_set(F.struct("count", "tok"))).alias("toks"))
    m = F.size("toks")
    by_class = by_class.where(m >= T).select("rep", "n", m.alias("m"), F.posexplode("toks").alias("pos", "t"))
    merged = stage(by_class.select("rep", "n", "m", F.col("t.tok").alias("tok"), (F.col("pos") <= F.col("m") - T).alias("prefix")), "merged")

    # pivots: members with the most shared posts have the fewest changes of their own
    central = lambda seed: F.max(F.struct("m", F.xxhash64("rep", F.lit(seed)).alias("h"), F.struct("rep", "n").alias("v")))["v"]
    heads = stage(merged.groupBy("tok").agg(F.array_distinct(F.array(central(1), central(2))).alias("vs")), "heads")
    met = merged.join(heads, "tok").select("rep", "n", "prefix", F.explode("vs").alias("v"))
    met = met.where((F.col("v.rep") != F.col("rep")) & _near_size(F.col("n"), F.col("v.n")))
    counted = met.groupBy("rep", F.col("v.rep").alias("pivot")).agg(F.count("*").alias("hits"), F.max("prefix").alias("prefix"))
    counted = stage(counted, "counted")
    side = lambda c: live.select(F.col("rep").alias(c), F.col("sig").alias(f"{c}_sig"))
    probed = counted.where(f"hits < {T} and prefix").select("rep", "pivot").join(side("rep"), "rep").join(side("pivot"), "pivot")
    probed = probed.where(F.size(F.array_intersect("rep_sig", "pivot_sig")) >= T).select("rep", "pivot")
    found = stage(counted.where(f"hits >= {T}").select("rep", "pivot").union(probed), "found")
    pairs = stage(found.select(*_ordered(F.col("rep"), F.col("pivot"))).distinct(), "pairs")
    prefix = stage(merged.where("prefix").select("tok", "rep", "n"), "prefix")
    drop_stage(common, alive, live, lists, merged, heads, counted, found)
    return pairs, prefix


def _across(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different labels that may reach the similarity, from (rep, n, label).

    A prefix join on the shingles themselves. Of sizes n and n', a pair must share
    need = ceil(3 / 7 * (n + n')) shingles (similarity 3 / 4), so one of the m - need + 1
    rarest of the m shingles that several labels have. Sizes are cut into bands, and each
    class is posted once for each band its partner may lie in: need then uses that band's
    least size, which makes prefixes as short as the sizes allow. Passages that many documents
    share are the last to be merged, and classes with too many shingles of their own drop out.

    In a list, members outside its most frequent label meet all others; a pair is made only if
    the parity bits allow it: sets differ in at least as many shingles as their bits do.
    """
    sets = stage(sets.join(left, "rep").select("rep", "n", "label", "set", "bits").distinct(), "shingles")
    each = sets.select("rep", "n", "label", F.explode("set").alias("s"))
    shared = each.groupBy("s").agg(F.count("*").alias("count"), (F.min("label") < F.max("label")).alias("open")).where("open")
    shared = stage(shared.select("s", "count"), "shared")
    by_class = each.join(shared, "s").groupBy("rep", "n", "label")
    by_class = by_class.agg(F.sort_array(F.collect_set(F.struct("count", "s"))).alias("ss"))
    band = F.floor(F.log("n") / F.log(F.lit(BAND)) + 1e-9)
    reach = int(np.ceil(np.log(100 / PERCENT) / np.log(BAND)))
    posted = by_class.withColumn("band", band).withColumn("other", F.explode(F.sequence(F.col("band") - reach, F.col("band") + reach)))
    # the least size in the other band, taken a little low: rounding must not lengthen need
    least = F.greatest(F.col("n") * PERCENT / 100, F.pow(F.lit(BAND), F.col("other")) * (1 - 1e-6))
    need = F.ceil((F.col("n") + least) * PERCENT / (100 + PERCENT) - 1e-6).cast("int")
    posted = posted.withColumn("m", F.size("ss")).where((F.col("m") >= need) & (F.col("other") >= 0))
    posted = posted.select("rep", "n", "label", "m", "band", "other", F.explode(F.slice("ss", F.lit(1), F.col("m") - need + 1)).alias("x"))
    cell = ["s", "lo", "hi"]
    posted = posted.select(
        F.col("x.s").alias("s"), F.least("band", "other").alias("lo"), F.greatest("band", "other").alias("hi"), "rep", "n", "label", "m", "band", "other"
    )
    posted = stage(posted, "rare")
    counts = posted.groupBy(*cell, "label").agg(F.count("*").alias("k"))
    cells = counts.groupBy(*cell).agg(F.max_by("label", F.struct("k", "label")).alias("major"), F.count("*").alias("labels")).where("labels > 1")
    cells = stage(cells.select(*cell, "major"), "cells")
    live = posted.join(cells, cell).join(sets.select("rep", "bits"), "rep")
    live = stage(live.select("s", "rep", "n", "label", "m", "band", "other", "major", "bits"), "live")
    side = lambda x: live.select(*[F.col(c).alias(f"{x}_{c}") for c in live.columns])
    a, b = side("a").where("a_label <> a_major"), side("b")
    size = F.col("a_n") + F.col("b_n")
    differ = F.lit(0)
    for i in range(LONGS):
        differ = differ + F.bit_count(F.col("a_bits")[i].bitwiseXOR(F.col("b_bits")[i]))
    pairs = a.join(
        b,
        (F.col("a_s") == F.col("b_s"))
        & (F.col("a_band") == F.col("b_other"))
        & (F.col("a_other") == F.col("b_band"))
        & (F.col("a_label") != F.col("b_label"))
        & ((F.col("b_label") == F.col("b_major")) | (F.col("a_rep") < F.col("b_rep")))
        & _near_size(F.col("a_n"), F.col("b_n"))
        & ((100 + PERCENT) * F.least("a_m", "b_m") >= PERCENT * size)
        & ((100 + PERCENT) * (size - differ) >= 2 * PERCENT * size),  # shared <= (n + n' - differ) / 2
    )
    pairs = stage(pairs.select(*_ordered(F.col("a_rep"), F.col("b_rep"))), "across")
    drop_stage(sets, shared, posted, cells, live)
    return pairs


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, node (the id, or a hash of the text where there is none),
    n_shingles, component, kept."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), document_key(id_col, text_col).alias("node"), F.col(text_col).alias("text"))
    sign = F.arrow_udf(_sign, "n long, s1 long, s2 long, sig array<long>")
    signed = stage(docs.select("id", "node", sign("text").alias("s")).select("id", "node", "s.*"), "signed")

    filled = signed.where("n > 0")
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "node", "n", "sig")).alias("c")
    classes = stage(filled.groupBy("s1", "s2").agg(first).select("s1", "s2", F.col("c.node").alias("rep"), "c.nameless", "c.n", "c.sig"), "classes")
    members = filled.select("id", "node", "n", "s1", "s2").join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).select("id", "node", "n", "rep")
    empty = signed.where("n = 0").select("id", "node", "n", F.lit(None).cast("long").alias("rep"))
    members = stage(members.union(empty), "members")
    pairs, prefix = _retained(classes.select("rep", "n", "sig"))
    named = classes.where("nameless").isEmpty()
    drop_stage(signed, classes)

    same_id = members.where("rep is not null").groupBy("node").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    same_id = stage(same_id.where("lo < hi").select("node", "lo"), "same_id")
    same_id = members.join(same_id, "node").where("rep > lo").select(F.col("lo").alias("a"), F.col("rep").alias("b"))
    sets = _full_sets(docs, prefix)  # every pair met in a list, so its classes have prefix posts
    links = stage(_confirm(pairs, sets).union(same_id), "links")

    labels = connected_components(links)
    labelled = prefix.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = stage(labelled.select("tok", "rep", "n", F.coalesce("component", "rep").alias("label")), "labelled")
    several = (F.min("label") < F.max("label")).alias("open")
    open_lists = stage(labelled.groupBy("tok").agg(several).where("open").select("tok"), "open")
    left = stage(labelled.join(open_lists, "tok", "left_semi").select("rep", "n", "label").distinct(), "left")
    across = stage(_across(left, sets).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    more = _confirm(across, sets)
    components = connected_components(links.union(more)) if not more.isEmpty() else labels
    drop_stage(pairs, prefix, sets, labelled, open_lists, left, across)

    c = members.join(components.withColumnRenamed("node", "rep"), "rep", "left").select(
        "id", "node", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "node").alias("c")
    )
    if named:  # what stands for a component is then its least id
        has_id = F.col("id").isNotNull()
        c = c.withColumn("component", F.when(has_id | (F.col("n_shingles") > 0), F.col("c")))
        return c.withColumn("kept", F.coalesce(F.col("node") == F.col("c"), F.lit(True))).drop("c")
    c = stage(c, "joined")
    least = stage(c.groupBy("c").agg(F.min("id").alias("component")), "least")
    kept = F.when(F.col("component").isNull(), F.col("node") == F.col("c")).otherwise(F.col("id").eqNullSafe(F.col("component")))
    return c.join(least, "c").select("id", "node", "n_shingles", "component", kept.alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near duplicates: of each group the document with the least id stays, in one
    row."""
    judged = near_duplicates(docs, id_col, text_col)
    key = fresh("node", docs)
    rows = judged.groupBy(F.col("node").alias(key)).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    rows = stage(rows.where("not kept or n > 1"), "marks")
    gone = broadcast_if_small(rows.where("not kept").select(key), MAX_BROADCAST)
    same = document_key(id_col, text_col) == F.col(key)
    kept = docs.join(gone, same, "left_anti")
    again = rows.where("kept").select(key)
    if again.isEmpty():
        return kept
    again = broadcast_if_small(again, MAX_BROADCAST)
    once = kept.join(again, same).groupBy(key).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(text_col)).alias("r")).select("r.*")
    return kept.join(again, same, "left_anti").union(once)
