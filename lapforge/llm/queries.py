"""Registered queries of the training-data operators: each applies its operator, with
production parameters, to its whole table and derives the contract's columns."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, decontaminate, langid, line_dedup, mixing, near_dedup, quality, simhash, token_counts, toxicity, urls, whitening
from .common import broadcast_if_small, stage

#: Vocabulary files of public tokenizers.
TOKENIZERS = os.environ.get("LAPFORGE_TOKENIZERS", "/opt/tokenizers")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs, min_docs=10, min_chars=1).select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_report(*mixing.mix_plan(docs)).select("doc_id", "size", "source_size", "target", "taken")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.measured_table(_table(spark, sf_dir, "documents"))
    cutoffs = quality.calibrate(measured, _table(spark, sf_dir, "labels"))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return quality.judge(measured, cutoffs, F.col("stratum")).select(
        F.col("id").alias("doc_id"), *[F.col(f"__q.{c}").alias(c) for c in columns], F.col("__kept").alias("kept")
    )


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept"
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    model = langid.train(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model, F.col("text")).select(
        "doc_id", "held_out", F.col("__lang.pred").alias("lang_pred"), F.col("__lang.score").alias("score")
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_counts.sentencepiece_vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").cast("long").alias("n_chars"))
    return token_counts.count_tokens(docs, pieces, F.col("text")).select(
        "doc_id", "n_chars", F.col("__tokens.n_words").alias("n_words"), F.col("__tokens.n_tokens").alias("n_tokens")
    )


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.chat_windows(rows).select(
        "conv_id",
        "window",
        chat.read_turns(F.col("text"), F.col("n_context")).alias("turns"),
        F.array_join(chat.loss_texts(F.col("text"), F.col("loss")), "").alias("loss"),
        F.length("text").alias("chars"),
    )
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    whole = read.groupBy("conv_id").agg(
        F.sum(F.size("turns")).alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("window", F.array_join(line, "").alias("said"), "loss"))).alias("w"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    loss = F.array_join("w.loss", "")
    return whole.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("w.said", ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = [("low_quality", F.col("quality") == 0), ("toxic", F.col("toxic") == 1)]
    model = toxicity.train_chain(docs, _table(spark, sf_dir, "labels"), chain)
    return toxicity.score_chain(docs, model, F.col("text")).select(
        "doc_id",
        F.col("__tox.p_low_quality").alias("p_low_quality"),
        F.col("__tox.p_toxic").alias("p_toxic"),
        F.col("__tox.is_toxic").alias("toxic"),
    )


#: (verdict, host, path start).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, bad): a page's URL ends in the id of its document, and that document's labels
    label the URL (bad: of low quality or toxic). Other pages have no label and are left out."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    bad = _table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(
        F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad")
    )
    bad = broadcast_if_small(stage(bad, "bad"), urls.MAX_BROADCAST)
    number = F.try_to_number(F.regexp_extract("url", r"://[^/?#]*/[^/?#]*/([0-9]{1,18})", 1), F.lit("9" * 18)).cast("long")
    numbered = pages.select("page_id", "url", number.alias("doc_id")).where("doc_id is not null")
    return numbered.join(bad, "doc_id").select("page_id", "url", "bad")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    model = urls.train(labelled_urls(spark, sf_dir), key="page_id")
    return urls.judge(pages, model, URL_RULES, F.col("url")).select("page_id", "host", "path", "rule", "verdict")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
        "n_links",
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whitening.whiten(_table(spark, sf_dir, "embeddings"), k=16)
    share = [float(e / model.trace) for e in model.eigenvalues]
    each = rows.select("id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        F.col("id").alias("vec_id"),
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(F.array(*map(F.lit, share)).cast("array<double>"), F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = centroids.kept_vectors(_table(spark, sf_dir, "embeddings"), dim=64)
    report = centroids.cluster_report(*centroids.cluster(vectors, k=16, rounds=3))
    return report.select(
        F.col("id").alias("vec_id"),
        "cluster",
        "distance",
        F.col("cluster_inertia").cast("long").alias("cluster_inertia"),
        F.col("inertia").cast("long").alias("inertia"),
        "centroid_sha256",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op13_centroids": op13_centroids,
    "op12_whitening": op12_whitening,
    "op11_simhash": op11_simhash,
    "op9_url_filters": op9_url_filters,
    "op6_toxicity": op6_toxicity,
    "op3_chat_windows": op3_chat_windows,
    "op5_token_counts": op5_token_counts,
    "op4_language_id": op4_language_id,
    "op7_decontamination": op7_decontamination,
    "op10_near_dedup": op10_near_dedup,
    "op1_quality_rules": op1_quality_rules,
    "op2_mixing": op2_mixing,
    "op8_line_dedup": op8_line_dedup,
}
