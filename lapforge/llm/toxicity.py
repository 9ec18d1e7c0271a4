"""Toxicity by a classifier chain.

Categories are predicted one after another. Each is a logistic regression over hashed words
(presence, ASCII punctuation split off, A-Z folded) and the probabilities of all earlier
categories. For training, those probabilities are out-of-fold: each labelled document gets
them from models that haven't seen it, so a later model learns from predictions as good as
those it meets in use.

The chain takes any list of categories, each a condition on the labels. The tables here label one
kind of toxicity only, so op6 runs low quality first and toxic second.

Training takes a bounded sample: the SAMPLE labelled documents with the least seeded hash of
their id (all of them if there are fewer), each once, with the text of least hash if rows
share its id. Spark counts each hashed word by fold and label (at most 2**BITS * FOLDS rows reach
the driver), which settles the words that any of the fits may use: all that tell its classes apart
(a caller may keep the max_words best of them a fit). Only these are sent of the sample's lists, at
most 2**BITS numbers a row, whatever the length of the texts. The weights (2**BITS for each
category) are broadcast; every document is scored.

Defined results: a null, empty or wordless text has probability 0 in every category and isn't
flagged. A null label leaves its row out for that category. A category without both classes
has probability 0. A document with several label rows counts with its worst. Repeated rows
score alike; whole texts are scored; an empty table gives an empty table. A column named __tox is replaced, others come through.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, least_hashed, stage
from .texthash import text_blocks, word_hashes

BITS, SAMPLE, FOLDS, EPOCHS, BATCH, RATE, L2 = 18, 12_000, 3, 8, 128, 0.3, 1e-6

#: A word counts if enough documents have it and its rate differs by this many deviations.
MIN_DOCS, MIN_Z = 3, 4.0


def _features(texts: pa.Array) -> list[np.ndarray]:
    """The distinct hashed words of each text."""
    out: list[np.ndarray] = []
    for lo, hi in text_blocks(texts):
        h, counts = word_hashes(texts.slice(lo, hi - lo), fold=True, split_punctuation=True)
        ids = (h >> np.uint64(64 - BITS)).astype(np.int32)
        ends = np.cumsum(counts)
        out += [np.unique(ids[e - n : e]) for e, n in zip(ends, counts, strict=True)]
    return out


def _sums(w: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """For each row the sum of w over its features; w may have several columns."""
    lens = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), *w.shape[1:]))
    full = np.flatnonzero(lens)
    if len(full):
        out[full] = np.add.reduceat(w[np.concatenate([rows[i] for i in full])], (np.cumsum(lens) - lens)[full])
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def telling(n: int, n1: int, seen: np.ndarray, seen1: np.ndarray, most: int | None = None) -> np.ndarray:
    """Which words a fit uses: of n documents (n1 positive) seen have the word (seen1 positive). Others
    would be learnt by heart."""
    share = np.clip(seen / max(n, 1), 1e-12, 1 - 1e-12)
    z = np.abs(seen1 - n1 * share) / np.sqrt(max(n1 * (n - n1) / max(n, 1), 1e-12) * share * (1 - share))
    keep = (seen >= MIN_DOCS) & (z >= MIN_Z)
    if most is not None and keep.sum() > most:
        keep[np.argsort(np.where(keep, -z, np.inf), kind="stable")[most:]] = False
    return keep


def fit_linear(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, max_words: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(weights of features, weights of extra columns and last the bias): AdaGrad on batches."""
    count = lambda some: np.bincount(np.concatenate([np.zeros(0, np.int32), *some]), minlength=1 << BITS)
    keep = telling(len(y), int(y.sum()), count(rows), count([r for r, t in zip(rows, y, strict=True) if t]), max_words)
    rows = [r[keep[r]] for r in rows]
    w, v = np.zeros(1 << BITS), np.zeros(extra.shape[1] + 1)
    gw, gv = np.full(1 << BITS, 1e-4), np.full(len(v), 1e-4)
    x = np.column_stack([extra, np.ones(len(y))])
    random = np.random.default_rng(3)
    for _ in range(EPOCHS):
        order = random.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            batch = [rows[i] for i in pick]
            error = (_sigmoid(_sums(w, batch) + x[pick] @ v) - y[pick]) / len(pick)
            ids, where = np.unique(np.concatenate(batch), return_inverse=True)
            g = np.bincount(where, np.repeat(error, [len(r) for r in batch]), len(ids)) + L2 * w[ids]
            gw[ids] += g * g
            w[ids] -= RATE * g / np.sqrt(gw[ids])
            g = error @ x[pick]
            gv += g * g
            v -= RATE * g / np.sqrt(gv)
    return w, v


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, max_words: int | None = None) -> tuple[np.ndarray, list[np.ndarray], list[float]]:
    """labels: a column for each category, NaN where unknown. (weights by feature and
    category, for each category those of the earlier probabilities and the bias, thresholds)."""
    n, k = labels.shape
    ahead = np.zeros((n, 0))
    weights, tails, cuts = np.zeros((1 << BITS, k)), [], []
    for c in range(k):
        y, known = labels[:, c], ~np.isnan(labels[:, c])
        p = np.zeros(n)

        def fit(mask: np.ndarray, y=y, ahead=ahead):
            at = np.flatnonzero(mask)
            if len(set(y[at])) < 2:
                return np.zeros(1 << BITS), np.append(np.zeros(ahead.shape[1]), -35.0)
            return fit_linear([rows[i] for i in at], ahead[at], y[at], max_words)

        for f in range(FOLDS):
            w, v = fit(known & (folds != f))
            at = np.flatnonzero(folds == f)
            if len(at):
                p[at] = _sigmoid(_sums(w, [rows[i] for i in at]) + np.column_stack([ahead[at], np.ones(len(at))]) @ v)
        weights[:, c], tail = fit(known)
        tails.append(tail)
        cuts.append(_best_cut(p[known], y[known]))
        ahead = np.column_stack([ahead, p])
    return weights, tails, cuts


def _best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that parts the out-of-fold predictions with the best F1, in the middle
    of the gap below it; 0.5 if there are no positives."""
    if not (y == 1).any():
        return 0.5
    order = np.argsort(-p)
    hits = np.cumsum(y[order] == 1)
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + hits[-1])
    k = int(f1.argmax())
    below = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + below) / 2)


def train_chain(
    docs: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, Column]], sample: int = SAMPLE, max_words: int | None = None
):
    """The chain's model from docs (doc_id, text) and labels (doc_id and what the categories'
    boolean columns use). max_words: telling words of a fit, the best ones; None keeps all."""
    names = [name for name, _ in categories]
    truth = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(c.cast("int")).alias(n) for n, c in categories])
    truth = stage(truth.withColumn("rank", F.xxhash64("doc_id", F.lit(5))), "truth")
    total = truth.count()
    truth = least_hashed(truth, sample, total, "rank", "doc_id")
    chosen = docs.select("doc_id", "text").join(F.broadcast(truth), "doc_id")  # at most SAMPLE ids
    to_lists = F.arrow_udf(lambda t: pa.array(_features(t), pa.list_(pa.int32())), "array<int>")
    read = chosen.select("doc_id", "rank", *names, F.xxhash64("text").alias("th"), to_lists("text").alias("ids"))
    once = read.groupBy("doc_id", "rank", *names).agg(F.min_by("ids", "th").alias("ids"))  # copies must not fill the sample
    once = once.orderBy("rank", "doc_id").limit(sample).withColumn("fold", F.pmod("rank", F.lit(FOLDS)).cast("int"))
    once = stage(once, "sample")
    mask = _wanted(once, names, max_words)
    only = F.arrow_udf(lambda lists: pa.array([r[mask[r]] for r in (np.asarray(x, np.int32) for x in lists.to_pylist())], pa.list_(pa.int32())), "array<int>")
    table = once.select(*names, "rank", "fold", only("ids").alias("ids")).orderBy("rank").toArrow()
    rows = [np.asarray(x, np.int32) for x in table.column("ids").to_pylist()]
    y = np.column_stack([np.array(table.column(n).to_pylist(), float) for n in names]) if rows else np.zeros((0, len(names)))
    folds = np.array(table.column("fold").to_pylist(), np.int64)
    drop_stage(once)
    return names, *fit_chain(rows, y, folds, max_words)


def _wanted(sample: DataFrame, names: list[str], max_words: int | None = None) -> np.ndarray:
    """The words that a fit of any category, on all folds or without one of them, may use."""
    by_label = [f(n).cast("long").alias(f"{k}_{n}") for n in names for k, f in (("n", F.count), ("pos", F.sum))]
    docs = sample.groupBy("fold").agg(*by_label).toArrow().to_pylist()
    cells = sample.select("fold", *names, F.explode("ids").alias("i")).groupBy("fold", "i").agg(*by_label).toArrow()
    at = np.array(cells.column("i").to_pylist(), np.int64) * FOLDS + np.array(cells.column("fold").to_pylist(), np.int64)
    mask = np.zeros(1 << BITS, bool)
    for name in names:
        grid = {}
        for k in ("n", "pos"):
            grid[k] = np.zeros((1 << BITS) * FOLDS, np.int64)
            grid[k][at] = [x or 0 for x in cells.column(f"{k}_{name}").to_pylist()]
            grid[k] = grid[k].reshape(-1, FOLDS)
        for left_out in range(-1, FOLDS):
            n, n1 = (sum(d[f"{k}_{name}"] or 0 for d in docs if d["fold"] != left_out) for k in ("n", "pos"))
            use = [f for f in range(FOLDS) if f != left_out]
            mask |= telling(n, n1, grid["n"][:, use].sum(1), grid["pos"][:, use].sum(1), max_words)
    return mask


def score_chain(docs: DataFrame, model, text: Column) -> DataFrame:
    """docs with a struct __tox: p_<category> and is_<category> for each category."""
    names, weights, tails, cuts = model
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), tails, cuts))

    def score(column: pa.Array) -> pa.Array:
        weights, tails, cuts = shared.value
        parts = []
        for lo, hi in text_blocks(column):  # features of a block at a time
            rows = _features(column.slice(lo, hi - lo))
            z, some = _sums(weights, rows), np.array([len(r) > 0 for r in rows], bool)
            ahead = np.zeros((len(rows), 0))
            for c, tail in enumerate(tails):
                p = np.where(some, _sigmoid(z[:, c] + np.column_stack([ahead, np.ones(len(rows))]) @ tail), 0.0)
                ahead = np.column_stack([ahead, p])
            parts.append(np.column_stack([ahead, some]))
        both = np.concatenate(parts) if parts else np.zeros((0, len(tails) + 1))
        ahead, some = both[:, :-1], both[:, -1] > 0
        fields = {f"p_{n}": pa.array(ahead[:, c]) for c, n in enumerate(names)}
        fields |= {f"is_{n}": pa.array((ahead[:, c] >= cuts[c]) & some) for c, n in enumerate(names)}
        return pa.StructArray.from_arrays(list(fields.values()), names=list(fields))

    kinds = ", ".join([f"p_{n} double" for n in names] + [f"is_{n} boolean" for n in names])
    return docs.withColumn("__tox", F.arrow_udf(score, kinds)(text))
