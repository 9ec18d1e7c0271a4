"""Benchmark decontamination: size-partitioned MinHash containment search.

Short test items are looked for inside long documents. A signature of the whole document
would need about as many coordinates as the document has shingles before a short item shows
in it, so this is containment MinHash: the sketch is that of the smaller set (the least hashes
of the item's shingles) and its members are looked up among all shingles of the document.
Items are partitioned by size (powers of two). A partition has its own sketch length,
the largest n - ceil(t * n) + 1 of its items, which makes a hit certain for every document
that holds the share t of an item's n shingles (recall 1); its own bands, keyed by partition
and hash; its own largest posted hash and its own least document size, which keep shingles
and documents out of it. Hits are verified by exact containment of the shingle texts.

Defined results: words are split at ASCII white space, A-Z folded. An item of 1 to 4 words is
one shingle, its whole sequence, and is looked for among the windows of so many words. Null
and blank items and rows without item_id match nothing, nor do null and blank documents. Rows
that share an item_id (or a doc_id) are one item (or document). Rows without doc_id are told
apart by their text. Repeated shingles count once. Empty tables give no match. Columns of
other names come through decontaminate untouched.

Plan: the documents are read once (and once more for each length under five words that the
benchmark has), shingles are made and hashed inside the scan's stage and filtered by a join with
the sketches, which are broadcast if they are few; no text is shuffled. Only documents with a
hit are read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import broadcast_if_small, document_key, drop_stage, fresh, lower_ascii, stage, words

WORDS, CONTAINMENT_PERCENT = 5, 75
#: Rows of item sketches, of item shingles, and of ids with a hit that are broadcast at most.
MAX_BROADCAST = 500_000


def _words(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    return rows.select(*keep, words(lower_ascii(text)).alias("ws"))


def _windows(ws: DataFrame, width: int, value: str, *keep: str) -> DataFrame:
    """The columns keep, size (windows of width words in ws) and w0, w1, ... for each window: of
    the words, or of the array column value."""
    ws = ws.withColumn("size", F.size("ws") - (width - 1)).where("size > 0")
    cols = F.arrays_zip(*[F.slice(value, F.lit(i + 1), F.col("size")) for i in range(width)])
    return ws.select(*keep, "size", F.inline(cols)).toDF(*keep, "size", *[f"w{i}" for i in range(width)])


def _texts(ws: DataFrame, width: int, *keep: str) -> DataFrame:
    return _windows(ws, width, "ws", *keep).select(*keep, F.concat_ws(" ", *[f"w{i}" for i in range(width)]).alias("shingle"))


def _hash_of(hashes: list[Column]) -> Column:
    """Of a shingle, from the hashes of its words."""
    return F.xxhash64(F.lit(len(hashes)), *hashes)


def _hashes(ws: DataFrame, width: int, *keep: str) -> DataFrame:
    hashed = ws.select(*keep, F.transform("ws", lambda w: F.xxhash64(w)).alias("ws"))
    return _windows(hashed, width, "ws", *keep).select(*keep, "size", _hash_of([F.col(f"w{i}") for i in range(width)]).alias("h"))


def _items(benchmark: DataFrame, percent: int) -> tuple[DataFrame, list[int]]:
    """(item_id, shingle, h, n, need, least, part, k), staged, and the widths of shingles."""
    ws = _words(benchmark.where("item_id is not null"), F.col("text"), "item_id").where("size(ws) > 0")
    parts = [_texts(ws.where(F.size("ws") >= WORDS), WORDS, "item_id")]
    parts += [_texts(ws.where(F.size("ws") == n), n, "item_id") for n in range(1, WORDS)]
    shingles = parts[0].withColumn("width", F.lit(WORDS))
    for n in range(1, WORDS):
        shingles = shingles.union(parts[n].withColumn("width", F.lit(n)))
    each = F.transform(F.split("shingle", " "), lambda w: F.xxhash64(w))
    h = F.when(F.col("width") == WORDS, _hash_of([each[i] for i in range(WORDS)]))
    for n in range(1, WORDS):
        h = h.when(F.col("width") == n, _hash_of([each[i] for i in range(n)]))
    per_item = W.partitionBy("item_id")
    items = shingles.distinct().withColumn("h", h).select(
        "*",
        F.count("*").over(per_item).alias("n"),
        F.min("width").over(per_item).alias("narrow"),
        F.row_number().over(per_item.orderBy("h", "shingle")).alias("k"),
    )
    need = F.ceil(F.col("n") * percent / 100).cast("int")
    items = items.withColumn("need", need).withColumn("least", F.when(F.col("narrow") == WORDS, need).otherwise(1))
    items = stage(items.withColumn("part", F.floor(F.log2("n")).cast("int")), "items")
    return items, sorted(r["width"] for r in items.select("width").distinct().collect())


def _found(docs: DataFrame, benchmark: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, item_id, n, need, n_found): key names a document (its id, or without one its text)."""
    docs = docs.select(document_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items, widths = _items(benchmark, percent)
    length = items.groupBy("part").agg(F.max(F.col("n") - F.col("need") + 1).alias("length"))
    sketch = items.join(F.broadcast(length), "part").where("k <= length")  # a row for each power of two
    band = lambda part: F.xxhash64(part, "h")
    sketch = stage(sketch.select("part", "h", "item_id", "least", band(F.col("part")).alias("band")), "sketch")
    limits = sketch.groupBy("part").agg(F.min("least").alias("least"), F.max("h").alias("cut")).orderBy("part").collect()  # at most 31 rows
    fits = [F.when((F.col("size") >= p["least"]) & (F.col("h") <= p["cut"]), F.lit(p["part"])) for p in limits]
    ws = _words(docs, F.col("text"), "key", "doc_id")
    bands = broadcast_if_small(sketch.select("band", "item_id", "least"), MAX_BROADCAST)
    pairs = None
    for width in widths:
        probes = _hashes(ws, width, "key", "doc_id").select("key", "doc_id", "size", "h", F.explode(F.array(*fits)).alias("part")).where("part is not null")
        hits = probes.select("key", "doc_id", "size", band(F.col("part")).alias("band")).join(bands, "band").where("size >= least")
        hits = hits.select("key", "doc_id", "item_id")
        pairs = hits if pairs is None else pairs.union(hits)
    if pairs is None:
        pairs = docs.limit(0).select("key", "doc_id", F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"))
    pairs = stage(pairs.distinct(), "pairs")

    ids = stage(pairs.select("key").distinct(), "ids")
    held = _words(docs.join(broadcast_if_small(ids, MAX_BROADCAST), "key", "left_semi"), F.col("text"), "key")
    known = broadcast_if_small(items.select("item_id", "shingle", "n", "need"), MAX_BROADCAST)
    shared = None
    for width in widths or [WORDS]:
        some = _texts(held, width, "key").join(known, "shingle").select("key", "item_id", "n", "need", "shingle")
        shared = some if shared is None else shared.union(some)
    counted = shared.distinct().groupBy("key", "item_id", "n", "need").agg(F.count("*").alias("n_found")).where("n_found >= need")
    found = stage(counted.join(pairs, ["key", "item_id"]), "found")
    drop_stage(items, sketch, pairs, ids)
    return found


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    percent: int = CONTAINMENT_PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) for every document that holds at
    least percent of an item's distinct shingles; a row for each text where doc_id is null."""
    found = _found(docs, benchmark, percent, id_col, text_col)
    return found.select("doc_id", "item_id", F.col("n").alias("n_shingles"), "n_found", (F.col("n_found") / F.col("n")).alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that hold an item; columns unchanged."""
    found = _found(docs, benchmark, CONTAINMENT_PERCENT, id_col, text_col)
    key = fresh("key", docs)
    bad = broadcast_if_small(stage(found.select(F.col("key").alias(key)).distinct(), "contaminated"), MAX_BROADCAST)
    return docs.join(bad, document_key(id_col, text_col) == F.col(key), "left_anti")
