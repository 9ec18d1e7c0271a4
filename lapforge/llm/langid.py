"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and cut into 1-, 2- and 3-grams of code points, hashed into FEATURES
features. Training is one aggregate: each task adds up counts of (language, feature), Spark sums
them. The matrix of log-probabilities (add-one smoothing) is broadcast and batches are scored
sparsely in numpy, a few MB of text at a time. With more than MAX_CELLS / FEATURES languages the
matrix goes out in blocks of so many languages, one after another: the distinct texts' features
are staged once (a row a text, FEATURES entries at most), and a pass over them gives each text its
best language of the block and the block's sum; these, a row for each text and block, settle
the same posteriors. The driver holds one block and a row for each language.

Defined results: a null text, or one without any letter (Unicode category L), is `und` with
score 0; so is every text if nothing could be learned. Null languages don't train. Of languages
with equal posteriors the first in code-point order wins. Whole texts count; long ones are read
in blocks that overlap by two code points, so that no n-gram is lost or counted twice. Repeated
rows get equal results; other columns come through untouched (__lang replaces one of that name).
An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, fresh, stage

#: Hashed features (a power of two), and cells of a broadcast matrix at most (4 bytes each).
FEATURES, MAX_CELLS = 1 << 15, 1 << 23
#: Languages of which a task holds dense counts (FEATURES numbers each).
MANY = 64
_BLOCK = 1 << 20
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_LETTERS = re.compile(r"[^\W\d_]+")  # letters, and number characters that aren't digits


def has_letter(text: str) -> bool:
    return any(c.isalpha() for run in _LETTERS.finditer(text) for c in run[0])


def _features(points: np.ndarray, owner: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature, text) of the 1-, 2- and 3-grams that lie inside one text and begin where counts is true."""
    h = np.zeros(len(points), np.uint64)
    for n in range(3):
        m = len(points) - n
        if m <= 0:
            return
        h = (h[:m] + points[n:].astype(np.uint64) + np.uint64(1)) * _MUL[n]
        inside = (owner[:m] == owner[n:]) & counts[:m]
        yield ((h ^ (h >> np.uint64(29))) * _MUL[0] >> np.uint64(64 - bits))[inside].astype(np.int64), owner[:m][inside]


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, index of their text, whether n-grams that begin there count), in blocks. A
    block of a long text ends with the first two code points of the next, whose n-grams count there."""
    parts: list[tuple[np.ndarray, int, int]] = []
    held = 0

    def joined():
        points = np.concatenate([p for p, _, _ in parts])
        lens = [len(p) for p, _, _ in parts]
        counts = np.concatenate([np.arange(len(p)) < n for p, _, n in parts])
        return points, np.repeat([i for _, i, _ in parts], lens), counts

    for i, t in enumerate(texts):
        p = np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        for k in range(0, len(p), _BLOCK):
            # two blocks of one text never go together: their shared code points would meet
            if held and k:
                yield joined()
                parts, held = [], 0
            parts.append((p[k : k + _BLOCK + 2], i, min(_BLOCK, len(p) - k)))
            held += len(parts[-1][0])
            if held >= _BLOCK:
                yield joined()
                parts, held = [], 0
    if parts:
        yield joined()


def _counter(bits: int):
    """(lang, feature, n) of the batches (text, lang); a task holds dense counts of MANY languages at most."""

    def rows(lang: list[str], feature: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(feature), pa.array(n)], names=["lang", "feature", "n"])

    def dense(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for x, counts in total.items():
            at = np.flatnonzero(counts)
            yield rows([x] * len(at), at, counts[at])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for points, owner, begins in _blocks(texts):
                names = sorted({langs[i] for i in np.unique(owner)})
                index = {x: k for k, x in enumerate(names)}
                of_text = np.array([index.get(x, 0) for x in langs], np.int64)
                for feature, who in _features(points, owner, begins, bits):
                    cells = (of_text[who] << bits) + feature
                    if len(names) > MANY:
                        cells, n = np.unique(cells, return_counts=True)
                        yield rows([names[k] for k in cells >> bits], cells & ((1 << bits) - 1), n)
                        continue
                    flat = np.bincount(cells, minlength=len(names) << bits)
                    for k, x in enumerate(names):
                        part = flat[k << bits : (k + 1) << bits]
                        total[x] = total[x] + part if x in total else part
                if len(total) > MANY:
                    yield from dense(total)
                    total = {}
        yield from dense(total)

    return count


Model = tuple[list[str], np.ndarray, np.ndarray | None, DataFrame | None]


def train(labelled: DataFrame, features: int = FEATURES, max_cells: int = MAX_CELLS) -> Model:
    """(languages, log priors, log-probabilities by language and feature, None) from (text, lang);
    with over max_cells / features languages the counts (lang, feature, n) stand for the matrix."""
    bits = features.bit_length() - 1
    labelled = labelled.where("text is not null and lang is not null").select("text", "lang")
    priors = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row a language
    langs = sorted(priors)
    prior = np.log(np.array([priors[x] for x in langs], float) / max(1, sum(priors.values())))
    counts = labelled.mapInArrow(_counter(bits), "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    counts = stage(counts, "counts")
    if len(langs) << bits > max_cells:
        return langs, prior, None, counts
    logp = _log_matrix(counts, langs, bits)
    drop_stage(counts)
    return langs, prior, logp, None


def _log_matrix(counts: DataFrame, langs: list[str], bits: int) -> np.ndarray:
    """Log-probabilities by language and feature from the languages' rows (lang, feature, n): a row a cell at most."""
    matrix = np.ones((len(langs), 1 << bits))
    index = {x: k for k, x in enumerate(langs)}
    table = counts.toArrow()
    if len(langs):
        rows = np.array([index[x] for x in table.column("lang").to_pylist()], np.int64)
        matrix[rows, table.column("feature").to_numpy()] += table.column("n").to_numpy()
    return np.log(matrix / matrix.sum(1, keepdims=True)).astype(np.float32)


def _by_text(texts: list[str | None], bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index, features, counts) of each text with n-grams; the blocks of a long one are added up."""
    held, parts = -1, []

    def merged():
        if len(parts) == 1:
            return held, *parts[0]
        total = np.zeros(1 << bits, np.int64)
        for f, n in parts:
            total[f] += n
        return held, np.flatnonzero(total), total[total > 0]

    for points, owner, begins in _blocks(texts):
        cells, n = np.unique(np.concatenate([(who << bits) + f for f, who in _features(points, owner, begins, bits)]), return_counts=True)
        whose, first = np.unique(cells >> bits, return_index=True)
        for i, lo, hi in zip(whose.tolist(), first, [*first[1:], len(cells)], strict=True):
            if i != held and parts:
                yield merged()
                parts = []
            held = i
            parts.append((cells[lo:hi] & ((1 << bits) - 1), n[lo:hi]))
    if parts:
        yield merged()


def _sparse(bits: int):
    """(th, fs, ns) of the batches (th, text): a row a text."""

    def rows(held: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        lists = [pa.array([x[k] for x in held], pa.list_(pa.int32())) for k in (1, 2)]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), *lists], names=["th", "fs", "ns"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, held, size = batch.column("th").to_pylist(), [], 0
            for i, fs, ns in _by_text(batch.column("text").to_pylist(), bits):
                held.append((keys[i], fs.astype(np.int32), ns.astype(np.int32)))
                size += len(fs)
                if size > _BLOCK:
                    yield rows(held)
                    held, size = [], 0
            if held:
                yield rows(held)

    return split


def _block_scores(sparse: DataFrame, names: list[str], prior: np.ndarray, logp: np.ndarray) -> DataFrame:
    """(th, top, lang, total) of each text (th, fs, ns), staged: the best of the block's languages, its
    log score and the log of the sum of all scores."""
    context = sparse.sparkSession.sparkContext
    shared = context.broadcast((names, prior, np.ascontiguousarray(logp.T)))

    def score(fs: pa.Array, ns: pa.Array) -> pa.Array:
        names, prior, logp = shared.value
        tops, langs, totals = [], [], []
        for f, n in zip(fs, ns, strict=True):
            f, n = f.values.to_numpy(), n.values.to_numpy()
            s = prior.copy()
            for at in range(0, len(f), 1024):  # rows of the matrix held at once
                # in the same order for every language, so that equal posteriors stay equal
                s += np.einsum("i,ij->j", n[at : at + 1024].astype(float), logp[f[at : at + 1024]].astype(float))
            best = int(s.argmax())
            tops.append(s[best])
            langs.append(names[best])
            totals.append(s[best] + np.log(np.exp(s - s[best]).sum()))
        return pa.StructArray.from_arrays([pa.array(tops, pa.float64()), pa.array(langs, pa.string()), pa.array(totals, pa.float64())], names=["top", "lang", "total"])

    out = stage(sparse.select("th", F.arrow_udf(score, "top double, lang string, total double")("fs", "ns").alias("s")).select("th", "s.*"), "block")
    shared.destroy()
    return out


def _predict_blocks(docs: DataFrame, model: Model, text: Column, features: int, max_cells: int) -> DataFrame:
    """predict with one block of languages broadcast at a time."""
    langs, prior, _, counts = model
    bits, width = features.bit_length() - 1, max(1, max_cells // features)
    key, row = fresh("th", docs), fresh("row", docs)
    nested = docs.select(F.struct(*docs.columns).alias(row), F.xxhash64(text).alias(key), text.alias("text"))
    texts = nested.where("text is not null").groupBy(F.col(key).alias("th")).agg(F.min("text").alias("text")).where(F.col("text").rlike(r"\p{L}"))
    sparse = stage(texts.mapInArrow(_sparse(bits), "th long, fs array<int>, ns array<int>"), "features")
    blocks = None
    for at in range(0, len(langs), width):
        names = langs[at : at + width]  # in code-point order, as Spark compares strings
        own = counts.where((F.col("lang") >= names[0]) & (F.col("lang") <= names[-1]))
        part = _block_scores(sparse, names, prior[at : at + width], _log_matrix(own, names, bits))
        blocks = part if blocks is None else blocks.union(part)
    best = blocks.groupBy("th").agg(F.min(F.struct((-F.col("top")).alias("down"), "lang")).alias("b"), F.collect_list("total").alias("totals"))  # a number a block
    total = F.aggregate("totals", F.lit(0.0), lambda a, t: a + F.exp(t + F.col("b.down")))
    picked = stage(best.select(F.col("th").alias(key), F.struct(F.col("b.lang").alias("pred"), (1 / total).alias("score")).alias("__lang")), "picked")
    drop_stage(sparse, blocks)
    und = F.struct(F.lit("und").alias("pred"), F.lit(0.0).alias("score"))
    out = nested.join(picked, key, "left").select(f"{row}.*", F.coalesce("__lang", und).alias("__lang"))
    return out.select(*[c for c in docs.columns if c != "__lang"], "__lang")


def predict(docs: DataFrame, model: Model, text: Column, features: int = FEATURES, max_cells: int = MAX_CELLS) -> DataFrame:
    """docs with a struct __lang (pred, score): the posterior's largest language and share."""
    langs, prior, logp, _ = model
    if logp is None:
        return _predict_blocks(docs, model, text, features, max_cells)
    shared = docs.sparkSession.sparkContext.broadcast((langs, prior, np.ascontiguousarray(logp.T)))

    def score(column: pa.Array) -> pa.Array:
        langs, prior, logp = shared.value
        texts = column.to_pylist()
        sums = np.tile(prior, (len(texts), 1)) if langs else np.zeros((len(texts), 0))
        for points, owner, begins in _blocks(texts) if langs else ():
            for feature, who in _features(points, owner, begins, len(logp).bit_length() - 1):
                if not len(who):
                    continue
                first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
                for k in range(len(langs)):
                    sums[who[first], k] += np.add.reduceat(logp[feature, k], first, dtype=np.float64)
        known = [bool(langs) and t is not None and has_letter(t) for t in texts]
        best = sums.argmax(1) if langs else np.zeros(len(texts), int)
        share = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1) if langs else np.zeros(len(texts))
        return pa.StructArray.from_arrays(
            [
                pa.array([langs[b] if ok else "und" for b, ok in zip(best, known, strict=True)], pa.string()),
                pa.array([float(s) if ok else 0.0 for s, ok in zip(share, known, strict=True)], pa.float64()),
            ],
            names=["pred", "score"],
        )

    return docs.withColumn("__lang", F.arrow_udf(score, "pred string, score double")(text))
