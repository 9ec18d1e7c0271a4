"""Edge cases and brute-force comparisons of the training-data operators."""

import hashlib
import math
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lapforge.llm import chat, components, decontaminate, langid, line_dedup, mixing, near_dedup, quality, texthash, token_counts, toxicity, urls

WS = re.compile("[\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w for w in WS.split(text or "") if w]


def docs(spark, texts, **columns):
    rows = [(i, t, columns.get("lang", ["en"] * len(texts))[i], columns.get("source", ["a"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " \t\n", "one", "É\u00a0x \x85y\n\n", "a b c d e f g h " * 5, "word " * 30, "x" * 300_000 + " tail", "line\nline\n line \nLINE"]


# words and windows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t#😀", max_size=40)), max_size=8))
def test_word_hashes_follow_words(texts):
    h, counts = texthash.word_hashes(pa.array(texts, pa.string()), fold=False)
    flat = [w for t in texts for w in words(t)]
    assert counts.tolist() == [len(words(t)) for t in texts]
    assert len({*zip(flat, h.tolist(), strict=True)}) == len(set(flat)) == len(set(h.tolist()))


def brute_repeats(text):
    ws = words(text)
    seen, hit = {}, set()
    for i in range(len(ws) - 7):
        seen.setdefault(tuple(ws[i : i + 8]), []).append(i)
    for starts in seen.values():
        if len(starts) > 1:
            hit |= {s + k for s in starts for k in range(8)}
    return len(hit)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=120), min_size=1, max_size=4))
def test_repeated_words(texts):
    h, counts = texthash.word_hashes(pa.array(texts), fold=False)
    assert quality.repeated_words(h, counts).tolist() == [brute_repeats(t) for t in texts]


def test_very_long_word_and_blocks():
    text = "x" * 700_000
    h, counts = texthash.word_hashes(pa.array([text, text + "y", text + " z"]), fold=True)
    assert counts.tolist() == [1, 1, 2] and h[0] == h[2] != h[1]


# 1 quality


def test_quality_measures(spark):
    got = {r["doc_id"]: r["__q"] for r in quality.with_measures(docs(spark, ODD)).collect()}
    for i, t in enumerate(ODD):
        ws, lines = words(t), (t or "").split("\n")
        full = [x for x in lines if words(x)]
        assert got[i]["n_words"] == len(ws)
        assert got[i]["word_chars"] == sum(map(len, ws))
        assert got[i]["n_repeat_words"] == brute_repeats(t)
        assert got[i]["n_dup_lines"] == len(full) - len(set(full))
        assert got[i]["base_failed"] == (len(ws) < 20 or 100 * brute_repeats(t) > 30 * len(ws))


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.1), (3, 50, 0.02), (40, 400, 0.05), (399, 400, 0.5), (0, 0, 0.1), (120, 100_000, 0.001)])
def test_binomial_cdf(k, n, p):
    exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(min(k, n) + 1))
    assert quality.binomial_cdf(k, n, p) == pytest.approx(exact, rel=1e-8)


def test_quality_cutoffs_reject_junk_and_keep_good(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    good = [" ".join(word() for _ in range(40)) for _ in range(1500)]
    junk = [" ".join(word() + "###" for _ in range(40)) for _ in range(100)]
    table = docs(spark, good + junk)
    labels = spark.createDataFrame([(i, int(i < len(good)), 0) for i in range(len(good) + len(junk))], "doc_id long, quality int, toxic int")
    kept = {x["doc_id"] for x in quality.filter_quality(table, labels).collect()}
    assert kept == set(range(len(good)))
    few = labels.where("doc_id < 50 or doc_id >= 1590")  # too few labels certify nothing
    assert quality.filter_quality(table, few).count() == len(good) + len(junk)
    assert quality.filter_quality(table.limit(0), labels).count() == 0
    assert quality.filter_quality(table, labels.limit(0)).count() == len(good) + len(junk)


def test_quality_strata_nulls_and_ties(spark):
    """Every stratum has its own cutoffs, null is one; equal gains take the more lenient cutoff."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    clean = [" ".join(word() for _ in range(40)) for _ in range(1500)]
    marked = [" ".join([word() for _ in range(38)] + ["#" * 24, word()]) for _ in range(100)]  # symbol ratio 24 / 219
    lang = [None] * 1600 + ["en"] * 100
    table = docs(spark, clean + marked + marked, lang=lang).withColumns({"__q": F.lit(1), "row": F.lit("mine"), "stratum": F.lit(2)})
    labels = spark.createDataFrame([(i, int(i < 1500), 0) for i in range(1600)], "doc_id long, quality int, toxic int")
    measured = quality.measured_table(table)
    cutoffs = {x["stratum"]: x for x in quality.calibrate(measured, labels).collect()}
    assert set(cutoffs) == {None} and cutoffs[None]["symbol_ratio"] == 0.1  # 0.1 to 0.01 reject the same
    out = quality.filter_quality(table.union(table), labels)
    assert out.columns == table.columns
    kept = [x["doc_id"] for x in out.collect()]
    assert sorted(kept) == sorted([*range(1500), *range(1600, 1700)] * 2)  # "en" has no labels: nothing is certified


def test_quality_filter_measures_each_text_once(spark):
    """Texts are judged in one Python worker a task: the filter isn't pushed below a second measuring."""
    table = docs(spark, ["a b c d e f g h i j k l m n o p q r s t u v w"] * 4)
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.filter_quality(table, labels)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert out.count() == 4


# 2 mixing


def water_fill(sizes, weights, share, epochs):
    caps = {s: epochs * n for s, n in sizes.items()}
    left, target, free = share * sum(sizes.values()), dict.fromkeys(sizes, 0.0), set(sizes)
    while free:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > caps[s]}
        if not over:
            return target | {s: level * weights[s] for s in free}
        for s in over:
            target[s] = caps[s]
            left -= caps[s]
        free -= over
    return target


def test_mixing_targets_and_totals(spark):
    r = random.Random(2)
    names = ["a", "b", "B", None, "é"]
    source = [r.choice(names + ["a"] * 5) for _ in range(3000)]
    texts = [r.choice([None, "", "w " * r.randint(1, 30)]) if i % 10 == 0 else "w " * r.randint(1, 30) for i in range(3000)]
    out = mixing.mix_report(*mixing.mix_plan(docs(spark, texts, source=source))).collect()
    assert len(out) == 3000
    sizes = {}
    for s, t in zip(source, texts, strict=True):
        sizes[s] = sizes.get(s, 0) + len(words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = water_fill(sizes, weights, 1.5, 2)
    taken = {}
    for x in out:
        s = source[x["doc_id"]]
        assert x["size"] == len(words(texts[x["doc_id"]])) and x["source_size"] == sizes[s]
        assert x["target"] == pytest.approx(want[s]) and x["taken"] <= 2 * x["size"]
        taken[s] = taken.get(s, 0) + x["taken"]
    assert all(abs(taken[s] - want[s]) <= max(31, 0.002 * want[s]) for s in sizes)


def test_mixing_empty_repeated_and_clashing(spark):
    table = docs(spark, ["a b", "a b"]).withColumn("size", F.lit("mine")).withColumn("copies", F.lit(1))
    assert mixing.mix_sources(table.limit(0)).count() == 0
    out = mixing.mix_sources(table.union(table))
    assert set(table.columns) < set(out.columns)
    taken = table.withColumns({"copy": F.lit("mine"), "bin": F.lit(0), "row": F.lit(1)})
    assert mixing.mix_sources(taken, copy_col="copy").columns == [*taken.columns, "_copy"]
    assert mixing.mix_report(*mixing.mix_plan(docs(spark, [None, ""]))).agg(F.sum("taken")).first()[0] == 0


# 3 chat


def test_chat_round_trip_and_budget(spark):
    r = random.Random(3)
    tricky = ["\\### Assistant: </turn> ok", "\\b\\l\\h\\c", "### user:\nhi</turn>\n", "", None, "x" * 3000, "a:\nb"]
    rows = []
    for c in range(12):
        if c % 3 == 0:
            rows.append((c, 0, "system", "be kind </turn>", "extra"))
        for t in range(1, r.randint(2, 40)):
            rows.append((c, t, ("user", "assistant", None, "a:b")[r.randint(0, 3) if c == 5 else t % 2], r.choice([*tricky, "word " * r.randint(1, 120)]), "extra"))
    rows += [(None, None, "assistant", "t", ""), (None, None, "assistant", "t", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    out = chat.chat_windows(df)
    back = out.select("*", chat.read_turns(F.col("text"), F.col("n_context")).alias("turns"), chat.loss_texts(F.col("text"), F.col("loss")).alias("under")).collect()
    key = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    for c in {x[0] for x in rows}:
        mine = sorted((x for x in rows if x[0] == c), key=key)
        windows = sorted((b for b in back if b["conv_id"] == c), key=lambda b: b["window"])
        assert [tuple(t) for b in windows for t in b["turns"]] == [(x[2] or "", x[3] or "") for x in mine]
        assert [u for b in windows for u in b["under"]] == [x[3] or "" for x in mine if x[2] == "assistant"]
        for b in windows:
            assert b["over_budget"] == (b["n_tokens"] > chat.BUDGET)
            assert not b["over_budget"] or len(b["turns"]) == 1 or (mine[0][2] == "system" and b["window"] == 0 and len(b["turns"]) == 2)
            if mine[0][2] == "system" and b["window"] > 0:
                assert b["text"].startswith("### system:\nbe kind \\l/turn>")
    assert chat.chat_windows(df.limit(0)).count() == 0


def greedy_spans(sizes, system):
    """Own turns of each window, one after another; sizes begin with the system turn, if there is one."""
    out, before = [], 0
    for i, n in enumerate(sizes):
        back = [n for j, n in enumerate(sizes[:i]) if not (system and j == 0)][::-1]
        told = max([0] + [sum(back[:k]) for k in (1, 2) if len(back) >= k and sum(back[:k]) <= chat.HISTORY_TOKENS])
        context = 0 if i == 0 else told + (sizes[0] if system else 0)
        part = before // (chat.SEGMENT * chat.BUDGET)
        if not out or part != out[-1][2] or (n > out[-1][1] and not (system and i == 1)):
            out.append([0, chat.BUDGET - context, part])
        out[-1][0] += 1
        out[-1][1] -= n
        before += n
    return [k for k, _, _ in out]


def test_chat_windows_use_the_budget(spark):
    r = random.Random(31)
    sizes = [[54, 329, 200, 130, 100, 200, 83, 750], [54] * 60, [2000, 5, 5], [1100], [30] * 3000, [5, 800, 5, 800]]
    sizes += [[r.choice([5, 60, 200, 384, 500, 700, 1500]) for _ in range(30)] for _ in range(20)]
    rows = []
    for c, toks in enumerate(sizes):
        for t, n in enumerate([50] * (c % 2) + toks):
            rows.append((c, t, "system" if c % 2 and t == 0 else ("user", "assistant")[t % 2], "x" * (4 * (n - 4))))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.chat_windows(df).withColumn("turns", chat.read_turns(F.col("text"), F.col("n_context"))).orderBy("conv_id", "window").collect()
    for c, toks in enumerate(sizes):
        mine = [b for b in out if b["conv_id"] == c]
        assert [len(b["turns"]) for b in mine] == greedy_spans([50] * (c % 2) + toks, c % 2 == 1)
        for b in mine:
            longest = max(len(t["text"]) // 4 + 4 for t in b["turns"])
            assert b["over_budget"] == (b["n_tokens"] > chat.BUDGET) and (not b["over_budget"] or longest > chat.BUDGET - 50 - chat.HISTORY_TOKENS)
    assert min(b["n_tokens"] for b in out if b["conv_id"] == 1 and b["window"] < 3) > chat.BUDGET - 54  # 54 tokens a turn: full windows


# 4 language id


def test_language_id(spark):
    texts = ["the cat and the dog"] * 5 + ["le chat et le chien"] * 5 + [None, "", "123 !?", "the dog", "le chien " * 2000]
    lang = ["en"] * 5 + ["fr"] * 5 + ["en", "fr", None, None, None]
    table = docs(spark, texts, lang=lang).withColumn("pred", F.lit("mine"))
    model = langid.train(table.limit(10))
    got = [tuple(r["__lang"]) for r in langid.predict(table, model, F.col("text")).orderBy("doc_id").collect()]
    assert [g[0] for g in got] == ["en"] * 5 + ["fr"] * 5 + ["und"] * 3 + ["en", "fr"]
    assert all(0 <= g[1] <= 1 for g in got) and got[10][1] == 0
    none = langid.train(table.limit(0))
    assert {r["__lang"]["pred"] for r in langid.predict(table, none, F.col("text")).collect()} == {"und"}


def bayes(labelled, texts, features):
    """The model restated on plain counters, with the operator's hash of an n-gram."""
    mask, mul = 2**64 - 1, [int(m) for m in langid._MUL]
    bits = features.bit_length() - 1

    def grams(t):
        t = t.lower()
        for i in range(len(t)):
            h = 0
            for n in range(min(3, len(t) - i)):
                h = (h + ord(t[i + n]) + 1) * mul[n] & mask
                yield ((h ^ h >> 29) * mul[0] & mask) >> (64 - bits)

    counts, priors = {}, {}
    for t, x in labelled:
        if t is not None and x is not None:
            priors[x] = priors.get(x, 0) + 1
            c = counts.setdefault(x, {})
            for g in grams(t):
                c[g] = c.get(g, 0) + 1
    out = []
    for t in texts:
        if not priors or t is None or not any(unicodedata.category(c)[0] == "L" for c in t):
            out.append(("und", 0.0))
            continue
        s = {}
        for x in sorted(priors):
            total = math.log(sum(counts[x].values()) + features)
            s[x] = math.log(priors[x] / sum(priors.values())) + sum(math.log(counts[x].get(g, 0) + 1) - total for g in grams(t))
        best = max(s, key=lambda x: (s[x], [-ord(c) for c in x]))
        out.append((best, 1 / sum(math.exp(v - s[best]) for v in s.values())))
    return out


@pytest.mark.parametrize("width", [None, 1, 2, 100])
def test_language_id_matches_brute_force(spark, monkeypatch, width):
    """With one matrix (width None), or blocks of so many languages."""
    monkeypatch.setattr(langid, "_BLOCK", 16)  # every longer text is cut
    monkeypatch.setattr(langid, "MANY", 2)  # more languages than a task counts densely
    r = random.Random(41)
    alphabets = {"en": "abcde ", "fr": "cdefé ", "de": "aeüß\n", "xx": "😀b-"}
    text = lambda x: "".join(r.choice(alphabets[x]) for _ in range(r.choice([1, 2, 5, 15, 16, 17, 18, 33, 100])))
    lang = [r.choice(list(alphabets)) for _ in range(60)]
    texts = [text(x) for x in lang] + [None, "", "½ ²", "١٢٣ ５", "ª", "ab", "ab", "the same in both"]
    lang += ["en", "fr", "en", "en", None, "yy", "zz", None]  # equal posteriors of yy and zz
    table = docs(spark, texts, lang=lang).withColumns({"row": F.lit(1), "th": F.lit("mine")})
    model = langid.train(table, 1 << 10, 10**9 if width is None else 0)
    assert (model[2] is None) == (width is not None)
    out = langid.predict(table, model, F.col("text"), 1 << 10, (width or 1) << 10)
    assert out.columns == [*table.columns, "__lang"]
    got = [tuple(x["__lang"]) for x in out.orderBy("doc_id").collect()]
    want = bayes(zip(texts, lang, strict=True), texts, 1 << 10)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], rel=1e-3, abs=1e-6)
    assert [g[0] for g in got[60:64]] == ["und"] * 4  # none of these has a letter
    assert langid.predict(table.limit(0), model, F.col("text"), 1 << 10, (width or 1) << 10).count() == 0


def test_a_thousand_languages(spark, monkeypatch):
    """Blocks of languages: no cross join, and no table of texts times languages."""
    rows, real = {}, langid.stage

    def spy(df, name):
        assert "CartesianProduct" not in (plan := df._jdf.queryExecution().toString()) and "NestedLoop" not in plan
        out = real(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(langid, "stage", spy)
    lang = [f"l{i:04d}" for i in range(1000)]
    word = lambda x: hashlib.md5(x.encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))
    table = docs(spark, [f"{word(x)} {word(x)}" for x in lang], lang=lang)
    model = langid.train(table, 1 << 12, 1 << 18)
    got = langid.predict(table, model, F.col("text"), 1 << 12, 1 << 18).select("lang", "__lang.pred").collect()
    assert all(r["pred"] == r["lang"] for r in got) and len(got) == 1000
    assert rows["features"] == rows["block"] == rows["picked"] == 1000  # a row a text, not a row a text and language


# 5 tokens


def greedy(text, vocabulary):
    i = n = 0
    while i < len(text):
        k = next((k for k in range(min(6, len(text) - i), 0, -1) if text[i : i + k] in vocabulary), 0)
        n += 1 if k else len(text[i].encode())
        i += k or 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text(alphabet="abé", min_size=1, max_size=5), max_size=12), st.text(alphabet="abéz", max_size=30))
def test_automaton_counts_greedy_pieces(vocabulary, text):
    assert token_counts.Automaton(vocabulary).count(text) == greedy(text, vocabulary)


def test_token_counts_edges(spark):
    pieces = ["▁a", "b", "▁", "a", "ab"]
    got = [tuple(r["__tokens"]) for r in token_counts.count_tokens(docs(spark, ODD), pieces, F.col("text")).orderBy("doc_id").collect()]
    assert got == [(len(words(t)), sum(greedy("▁" + w, set(pieces)) for w in words(t))) for t in ODD]


def test_token_counts_of_odd_tables(spark):
    pieces = ["▁a", "b", "▁", "a", "ab"]
    table = docs(spark, ["ab a", "ab a", None]).withColumns({"__tokens": F.lit("mine"), "count": F.lit(1)})
    out = token_counts.count_tokens(table, pieces, F.col("text"))
    assert sorted(out.columns) == sorted(table.columns)
    assert [tuple(r["__tokens"]) if r["text"] else None for r in out.orderBy("doc_id").collect()][:2] == [(2, 3)] * 2
    assert token_counts.count_tokens(table.limit(0), pieces, F.col("text")).count() == 0


def test_automaton_is_built_once_a_worker(spark):
    shared = spark.sparkContext.broadcast({"pieces": ["▁a", "b", "ab"]})

    def seen(column):
        import os

        automaton, _ = token_counts.worker_automaton(shared)
        return pa.array([f"{os.getpid()} {id(automaton)}"] * len(column))

    for _ in range(2):
        rows = spark.range(0, 64, 1, 16).select(F.arrow_udf(seen, "string")("id").alias("s")).distinct().collect()
        workers = [r["s"].split()[0] for r in rows]
        assert len(workers) == len(set(workers)) < 16  # one automaton a worker, fewer workers than tasks


# 6 toxicity


def test_toxicity_words_are_capped_on_demand_only():
    r = np.random.default_rng(0)
    n, n1 = 2000, 1000
    seen1 = r.integers(400, 700, 6000)
    seen = seen1 + r.integers(0, 100, 6000)
    every = toxicity.telling(n, n1, seen, seen1)
    best = toxicity.telling(n, n1, seen, seen1, 50)
    assert every.sum() == 6000 and best.sum() == 50
    z = np.abs(seen1 - n1 * seen / n) / np.sqrt(seen * (n - seen))
    assert z[best].min() >= np.sort(z)[-50]


def test_toxicity_chain(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    bad = [i % 5 == 0 for i in range(600)]
    texts = [" ".join([word() for _ in range(30)] + (["Vile,"] if b else [])) for b in bad] + [None, "", "..."]
    table = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(bad) if i < 400], "doc_id long, quality int, toxic int")
    chain = [("low", F.col("quality") == 0), ("toxic", F.col("toxic") == 1)]
    model = toxicity.train_chain(table, labels, chain)
    got = {x["doc_id"]: x["__tox"] for x in toxicity.score_chain(table, model, F.col("text")).collect()}
    assert [got[i]["is_toxic"] for i in range(600)] == bad
    assert not any(got[i]["is_toxic"] or got[i]["p_toxic"] for i in (600, 601, 602))
    assert not any(x["is_low"] for x in got.values())  # one class only: never flagged
    odd = spark.createDataFrame([(0, t, "mine", 1) for t in [texts[0], texts[0], "safe " * 300_000 + "vile", "safe " * 300_000]], "doc_id long, text string, __tox string, p_toxic int")
    again = toxicity.score_chain(odd, model, F.col("text"))  # repeated rows, very long texts, taken names
    assert sorted(again.columns) == sorted(odd.columns)
    a, b, c, d = again.collect()
    assert a["__tox"] == b["__tox"] == got[0] and c["__tox"]["is_toxic"] and not d["__tox"]["is_toxic"]
    names, weights, tails, _ = model  # the chain restated: each model sees the probabilities before it
    for i in (0, 1, 450):
        ahead, ids = [], toxicity._features(pa.array([texts[i]]))[0]
        for c in range(len(names)):
            z = sum(float(np.float32(weights[k, c])) for k in ids) + sum(t * x for t, x in zip(tails[c], [*ahead, 1.0], strict=True))
            ahead.append(1 / (1 + math.exp(-max(-35, min(35, z)))))
        assert [got[i]["p_low"], got[i]["p_toxic"]] == pytest.approx(ahead, abs=1e-6)
    none = toxicity.train_chain(table, labels.limit(0), chain)
    assert not any(x["__tox"]["is_toxic"] for x in toxicity.score_chain(table, none, F.col("text")).collect())


def test_toxicity_sample_is_whole_in_large_tables(spark, monkeypatch):
    sample, total = 15, 20_000  # less than a thousandth
    ids = spark.range(total).select(F.col("id").alias("doc_id"))
    ranks = [r[0] for r in ids.orderBy(F.xxhash64("doc_id", F.lit(5))).limit(sample).collect()]
    copies = ids.union(spark.range(100).select(F.lit(ranks[0])))  # one sampled document many times
    table = copies.withColumn("text", F.concat(F.lit("word"), F.col("doc_id").cast("string")))
    seen = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda rows, labels, folds, *_: seen.append((rows, labels)) or ())
    toxicity.train_chain(table, ids.withColumn("toxic", F.col("doc_id") % 2), [("toxic", F.col("toxic") == 1)], sample)
    [(rows, labels)] = seen
    assert len(rows) == sample and not any(len(r) for r in rows)  # a word of one document tells nothing
    assert labels[:, 0].tolist() == [i % 2 for i in ranks]


# 7 decontamination


def item_set(item):
    ws = [w.lower() for w in item or []]
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def all_windows(text):
    ws = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i : i + n]) for n in range(1, 6) for i in range(len(ws) - n + 1)}


def test_decontamination_matches_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [passage(r.choice([3, 4, 5, 6, 12, 40])) for _ in range(40)] + [None, [], ["tail"], ["LINE", "line"]]
    texts = list(ODD)
    for _ in range(200):
        item = list(r.choice(items[:40]))
        for _ in range(r.choice([0, 0, 1, 2])):
            item[r.randrange(len(item))] = r.choice(vocabulary)
        texts.append(" ".join(passage(r.choice([0, 5, 200])) + item + passage(r.choice([0, 30]))).upper())
    table = docs(spark, texts)
    bench = spark.createDataFrame([(i, None if x is None else " ".join(x), "t") for i, x in enumerate(items)], "item_id long, text string, size string")
    got = {(x["doc_id"], x["item_id"]): x["n_found"] for x in decontaminate.contaminated(table, bench).collect()}
    sets = [item_set(x) for x in items]
    want = {}
    for i, t in enumerate(texts):
        s = all_windows(t)
        want |= {(i, j): len(s & b) for j, b in enumerate(sets) if b and 4 * len(s & b) >= 3 * len(b)}
    assert got == want and want
    kept = {x["doc_id"] for x in decontaminate.decontaminate(table, bench).collect()}
    assert kept == set(range(len(texts))) - {i for i, _ in want}
    assert {len(b) for (_, j), b in zip(want, [sets[j] for _, j in want], strict=True)} >= {1, 2, 8, 36}
    twin = bench.where("item_id = 0").selectExpr("item_id", "'tail' as text", "size")  # two rows, one item
    both = sets[0] | {("tail",)}
    got = {x["doc_id"]: (x["n_shingles"], x["n_found"]) for x in decontaminate.contaminated(table, bench.where("item_id = 0").union(twin)).collect()}
    hits = {i: len(all_windows(t) & both) for i, t in enumerate(texts)}
    assert got == {i: (len(both), k) for i, k in hits.items() if 4 * k >= 3 * len(both)}
    assert decontaminate.contaminated(table, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(table.limit(0), bench).count() == 0


# 8 lines


def test_line_dedup(spark):
    common = ["  Common LINE\t", "common line"]
    texts = [f"{common[i % 2]}\nown {i}\n\n{common[0]}" for i in range(10)] + [None, "", "common line", "\n\n", "É"]
    table = docs(spark, texts + texts[-1:] * 3).withColumns({"id": F.lit("mine"), "h": F.lit(1), "row": F.lit(2), "__id": F.lit(3), "drop": F.lit(4), "d_th": F.lit(5)})
    out = {x["doc_id"]: x for x in line_dedup.line_dedup(table).collect()}
    for i in range(10):
        assert out[i]["text"] == f"own {i}\n" and (out[i]["__n_lines"], out[i]["__n_dropped"]) == (4, 2)
    assert out[10]["text"] is None and out[10]["__n_lines"] == 1
    assert out[11]["text"] == "" and out[12]["text"] == "" and out[12]["__n_dropped"] == 1
    assert out[13]["text"] == "\n\n" and out[14]["text"] == "É"
    assert line_dedup.line_dedup(table.limit(0)).count() == 0
    twice = line_dedup.line_dedup(table.union(table))  # repeated rows keep their count
    assert twice.count() == 2 * table.count()


def test_line_dedup_of_a_long_text(spark):
    """A million lines, half of them dropped, in scattered runs: time in proportion to the lines."""
    import time

    n = 1_000_000
    text = "\n".join("common" if hashlib.md5(b"%d" % i).digest()[0] % 2 else f"own {i}" for i in range(n))
    table = docs(spark, [text, *["common"] * 9])
    line_dedup.line_dedup(table.where("doc_id > 0")).collect()
    began = time.monotonic()
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(table).collect()}[0]
    assert time.monotonic() - began < 60
    kept = [x for x in text.split("\n") if x != "common"]
    assert got["text"] == "\n".join(kept) and (got["__n_lines"], got["__n_dropped"]) == (n, n - len(kept))


@pytest.mark.parametrize("dropped", ["", "0", "9", "0123456789", "01 89", "0 2 4 6 8", "1 3 5 7 9", "345"])
def test_line_dedup_reassembles_any_runs(spark, dropped):
    lines = ["drop" if str(i) in dropped else f"line {i}" if i % 3 else "" for i in range(10)]
    table = docs(spark, ["\n".join(lines), *["drop"] * 10])
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(table).collect()}[0]
    assert got["text"] == "\n".join(x for x in lines if x != "drop") and got["__n_dropped"] == lines.count("drop")


# 9 URLs


def test_url_rules_of_equal_length(spark, monkeypatch):
    """Ties go to the longer host, then to the rule that blocks: with the CASE, with the join and by brute force."""
    r = random.Random(5)
    hosts, starts = ["org", "a.org", "b.a.org", "com", "a.com"], ["/", "/p", "/p/", "/p/q", "/p/q/x", "/q"]
    rules = [(r.choice(["allow", "block"]), r.choice(hosts), r.choice(starts)) for _ in range(60)]
    rules += [("allow", "org", "/p/q"), ("block", "a.org", "/p"), ("allow", "com", "/p"), ("block", "com", "/p")]
    cases = [f"http://{h}{p}{tail}" for h in [*hosts, "x.b.a.org", "b.com"] for p in starts for tail in ("", "z", "/x")]
    want = {}
    for url in cases:
        host, _, path = url[7:].partition("/")
        fits = [(-len(h) - len(p), -len(h), v != "block", h + p, v) for v, h, p in rules if f".{host}".endswith(f".{h}") and f"/{path}".startswith(p)]
        want[url] = min(fits)[3:] if fits else (None, "allow")
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    model = urls.train(spark.createDataFrame([], "url string, bad int"))
    for most in (1000, 0):
        monkeypatch.setattr(urls, "MAX_RULES", most)
        for order in (rules, rules[::-1]):
            assert {x["url"]: (x["rule"], x["verdict"]) for x in urls.judge(df, model, order, F.col("url")).collect()} == want


def test_url_parts_and_rules(spark, monkeypatch):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    cases = {
        "https://WWW.Example.org/es/1?x=/": ("www.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/12#a/b": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"),
        "http://org": ("org", "", None, "allow"),
        "http://a.com/de/x": ("a.com", "/de/x", "com/de/", "block"),
        "x://h?q=://z": ("h", "", None, "allow"),
        "no scheme/de/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(u, "mine", 1) for u in cases], "url string, host_name string, length int")
    model = urls.train(spark.createDataFrame([], "url string, bad int"))
    for x in urls.judge(df, model, rules, F.col("url")).collect():
        assert (x["host"], x["path"], x["rule"], x["verdict"]) == cases[x["url"]]
    clash = df.union(df).withColumns({"host": F.lit("mine"), "verdict": F.lit(3), "row": F.lit(1)})  # repeated rows, taken names
    monkeypatch.setattr(urls, "MAX_RULES", 1)  # more rules than one CASE takes: a join
    out = urls.judge(clash, model, rules, F.col("url"))
    assert sorted(out.columns) == sorted([*df.columns, "row", "host", "path", "rule", "verdict", "by_model"])
    rows = out.collect()
    assert len(rows) == 2 * len(cases) and all((x["host"], x["path"], x["rule"], x["verdict"]) == cases[x["url"]] for x in rows)
    assert urls.judge(df.limit(0), model, rules, F.col("url")).count() == 0


def test_url_trees_learn_hosts(spark):
    rows = [(f"http://{'pills-shop' if i % 4 == 0 else 'news'}{i % 3}.example.net/a/{i}", int(i % 4 == 0)) for i in range(400)]
    model = urls.train(spark.createDataFrame(rows, "url string, bad int"))
    out = urls.judge(spark.createDataFrame(rows, "url string, bad int"), model, [], F.col("url")).collect()
    assert all((x["verdict"] == "block") == bool(x["bad"]) for x in out)


def test_url_features_match_python(spark):
    r = random.Random(9)
    part = lambda n: "".join(r.choice("ab1-_./?&=#é%") for _ in range(n))
    cases = [f"{r.choice(['http', 'https'])}://{part(r.randint(0, 12))}/{part(r.randint(0, 40))}" for _ in range(150)] + ["http://h/" + "x1" * 50_000, "https://", "x"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "i int, url string")
    for x in urls.lexical_features(rows, F.col("url")).collect():
        u = x["url"]
        rest = u.partition("://")[2]
        host = re.match("[^/?#]*", rest)[0].lower()
        path = re.match("[^?#]*", rest[len(host) :])[0]
        query = re.search(r"\?([^#]*)", u)
        want = {
            "length": len(u), "host_length": len(host), "path_length": len(path), "depth": len([p for p in path.split("/") if p]),
            "digit_ratio": sum(c in "0123456789" for c in u) / len(u), "entropy": -sum(u.count(c) / len(u) * math.log2(u.count(c) / len(u)) for c in set(u)),
            "n_params": len(query[1].split("&")) if query and query[1] else 0, "n_hyphens": sum(c in "-_" for c in u),
            "host_labels": len(host.split(".")), "secure": u.startswith("https:"), "fragment": "#" in u,
        }
        assert {k: x[k] for k in want} == {k: pytest.approx(float(v) if host else 0.0) for k, v in want.items()}
        assert (x["host"], x["path"]) == (host, path)


def test_url_verdicts_match_the_trees_by_hand(spark):
    """Statistics, features and the trees' votes restated in Python, tree by tree."""
    r = random.Random(19)
    rows = [(f"http://{'bad' if i % 3 == 0 else 'ok'}{i % 7}.site{i % 2}.net/{'x' * r.randint(1, 20)}/{i % 50}", int(i % 3 == 0 and r.random() < 0.9)) for i in range(600)]
    table = spark.createDataFrame(rows, "url string, bad int")
    trees, stats, rate = urls.train(table)
    counts = {}
    for u, b in rows:
        host = u.split("/")[2]
        for kind, n in (("site", 3), ("top", 2)):
            c = counts.setdefault((kind, ".".join(host.split(".")[-n:])), [0, 0])
            c[0] += b
            c[1] += 1
    assert {(x["kind"], x["suffix"]): [sum(x["bad"]), sum(x["n"])] for x in stats.collect()} == counts
    overall = sum(b for _, b in rows) / len(rows)
    assert rate == pytest.approx(overall)
    text = trees.toDebugString.splitlines()

    def walk(lines, x):
        head = lines[0].strip()
        if head.startswith("Predict"):
            return float(head.split(":")[1])
        depth = len(lines[0]) - len(lines[0].lstrip())
        other = next(i for i, t in enumerate(lines) if i and len(t) - len(t.lstrip()) == depth and t.strip().startswith("Else"))
        f, cut = re.search(r"feature (\d+) <= ([-\d.E]+)", head).groups()
        return walk(lines[1:], x) if x[int(f)] <= float(cut) else walk(lines[other + 1 :], x)

    marks = [i for i, t in enumerate(text) if t.strip().startswith("Tree")] + [len(text)]
    parts = [text[a + 1 : b] for a, b in zip(marks, marks[1:])]
    weights = [float(re.search(r"weight ([-\d.E]+)", text[m])[1]) for m in marks[:-1]]
    lexical = {x["url"]: x for x in urls.lexical_features(table.distinct(), F.col("url")).collect()}
    for x in urls.judge(table, (trees, stats, rate), [], F.col("url")).collect():
        f = lexical[x["url"]]
        smooth = {k: (counts[k, f[k]][0] + urls.SMOOTHING * overall) / (counts[k, f[k]][1] + urls.SMOOTHING) for k in ("site", "top")}
        values = [smooth[c[:-5]] if c.endswith("_rate") else f[c] for c in urls.FEATURES]
        vote = sum(w * walk(p, values) for w, p in zip(weights, parts, strict=True))
        assert x["verdict"] == ("block" if vote > 0 else "allow")


@pytest.mark.parametrize("kind", ["common", "rare", "repeated"])
def test_url_sample_is_whole_in_large_tables(spark, monkeypatch, kind):
    class Trees:
        def __init__(self, **_):
            pass

        def fit(self, rows):
            return [r["label"] for r in rows.collect()]

    monkeypatch.setattr(urls, "GBTClassifier", Trees)
    i, sample, total = F.col("id"), 20, 25_000  # less than a thousandth
    url = F.concat(F.lit("http://a.b.com/"), i.cast("string"))
    hot = spark.range(1000).orderBy(F.xxhash64(F.concat(F.lit("http://a.b.com/"), i.cast("string")), F.lit(9))).first()[0]
    if kind == "repeated":  # a bad URL of a third of the rows
        url = F.when(i % 3 == 0, f"http://a.b.com/{hot}").otherwise(url)
    bad = {"common": i % 2, "rare": (i == 7).cast("long"), "repeated": (i % 3 == 0).cast("long")}[kind]
    rows = spark.range(total).select(i, url.alias("url"), bad.cast("int").alias("bad"))
    labels, again = (urls.train(rows, sample, **({"key": "id"} if kind == "repeated" else {}))[0] for _ in range(2))
    assert labels == again and set(labels) == {0, 1}
    assert len(labels) == (sample // 2 + 1 if kind == "rare" else sample)


# 10 near dedup


def classes_by_brute_force(rows):
    def shingled(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        ws = words(low)
        return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())

    sets = [(i, shingled(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and 4 * len(s & u) >= 3 * len(s | u):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def test_near_dedup_matches_brute_force(spark):
    r = random.Random(6)
    vocabulary = [f"v{i}" for i in range(400)]
    shared = [r.choice(vocabulary) for _ in range(60)]
    rows = []
    for g in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([8, 40, 120]))] + (shared if g % 2 else [])
        for _ in range(r.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append(" ".join(copy) if r.random() < 0.8 else " \n".join(copy).upper())
    rows += [*ODD, "One", "three short words", "Three Short WORDS", "three short wordz"]
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, rep int")
    want = classes_by_brute_force(rows)
    got = {x["id"]: (x["n_shingles"], x["component"], x["kept"]) for x in near_dedup.near_duplicates(df).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}
    kept = near_dedup.near_dedup(df)
    assert kept.columns == df.columns and {x["doc_id"] for x in kept.collect()} == {c for _, c in want.values()}


def test_near_dedup_completion_alone_finds_all_links(spark, monkeypatch):
    """The exact prefix join without the pairs of the merged lists: the same groups."""
    seen, across, real = {}, near_dedup._across, near_dedup._retained

    def no_pairs(sigs):
        pairs, prefix = real(sigs)
        return pairs.limit(0), prefix

    def counted(left, sets):
        out = across(left, sets)
        seen["pairs"] = out.count()
        return out

    monkeypatch.setattr(near_dedup, "_retained", no_pairs)
    monkeypatch.setattr(near_dedup, "_across", counted)
    r = random.Random(9)
    vocabulary = [f"v{i}" for i in range(300)]
    shared = [r.choice(vocabulary) for _ in range(50)]
    rows = []
    for g in range(15):
        base = [r.choice(vocabulary) for _ in range(r.choice([10, 40, 120]))] + (shared if g % 2 else [])
        for _ in range(r.choice([1, 2, 8])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append(" ".join(copy))
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["id"]: (x["n_shingles"], x["component"]) for x in near_dedup.near_duplicates(df).collect()}
    assert got == classes_by_brute_force(rows) and seen["pairs"] > 10


def test_near_dedup_null_and_repeated_ids(spark):
    long, lone = " ".join(f"u{i}" for i in range(30)), " ".join(f"z{i}" for i in range(40))
    other, alone = "quite another text of words here", "alone with nobody else around me"
    rows = [(None, long), (3, long), (3, long), (5, long + " x"), (5, other), (None, alone), (7, other), (None, alone), (None, lone), (None, lone + " end"), (None, None), (42, ""), (None, long + " z")]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, node string")
    got = sorted(((x["id"], x["component"], x["kept"]) for x in near_dedup.near_duplicates(df).collect()), key=str)
    named = [(None, 3, False)] * 2 + [(3, 3, True)] * 2 + [(5, 3, False)] * 2 + [(7, 3, False), (42, 42, True)]
    assert got == sorted(named + [(None, None, True)] * 4 + [(None, None, False)], key=str)
    kept = near_dedup.near_dedup(df)
    assert kept.columns == df.columns
    texts = sorted((tuple(x)[:2] for x in kept.collect()), key=str)
    some = lone if (None, lone) in texts else lone + " end"
    assert texts == sorted([(3, long), (None, alone), (None, some), (None, None), (42, "")], key=str)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_near_dedup_of_ids_with_many_equal_rows(spark, monkeypatch):
    """Two near copies, each in many equal rows: their pair is confirmed once, not rows times rows."""
    rows, real = {}, near_dedup.stage

    def spy(df, name):
        out = real(df, name)
        if name == "links":
            rows.setdefault(name, out.count())
        return out

    monkeypatch.setattr(near_dedup, "stage", spy)
    words = [f"w{i}" for i in range(60)]
    texts = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, " ".join(f"x{i}" for i in range(60)))]
    df = spark.createDataFrame(texts * 40, "doc_id long, text string").repartition(6)
    got = {(r["id"], r["component"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 3, True)} and rows["links"] == 1
    assert sorted(r["doc_id"] for r in near_dedup.near_dedup(df).collect()) == [1, 3]


def test_near_dedup_splits_hot_keys(spark, monkeypatch):
    """A text that a third of all rows copy: its members are dealt over tasks when they meet their class."""
    plans, real = {}, near_dedup.stage

    def spy(df, name):
        if name in ("members", "labelled"):
            df.collect()
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(near_dedup, "stage", spy)
    monkeypatch.setattr(near_dedup, "MAX_BROADCAST", 0)
    low = {
        "autoBroadcastJoinThreshold": "-1", "adaptive.advisoryPartitionSizeInBytes": "1k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "adaptive.skewJoin.skewedPartitionFactor": "1.5", "adaptive.coalescePartitions.enabled": "false", "shuffle.partitions": "23",
    }
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in low}
    for k, v in low.items():
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        g = F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id"))
        word = lambda k: F.substring(F.md5((g * 100 + k).cast("string")), 1, 8)
        text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(29)), word), " ")
        docs = spark.range(0, 1500, 1, 12).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 == 0, "").otherwise(text).alias("text"))
        kept = {r["id"] for r in near_dedup.near_duplicates(docs).where("kept").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)
    assert kept == {i for i in range(1500) if i % 7 == 0 or i % 3 or i == 3}
    assert "skew=true" in plans["members"]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 4000), (4000, 4500), (7, 7)]
    got = {x["node"]: x["component"] for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1200)} | {4000: 4000, 4500: 4000, 5000: 4000}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# pipeline


def test_rows_without_id_are_decontaminated_and_mixed(spark):
    held = " ".join(f"b{i}" for i in range(12))
    bench = spark.createDataFrame([(1, held)], "item_id long, text string")
    texts = [(None, f"x {held} y"), (None, "nothing of it is in this text at all"), (None, None), (4, held), (5, "clean text of five words")]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    kept = {tuple(r) for r in decontaminate.decontaminate(table, bench).collect()}
    assert kept == {texts[1], texts[2], texts[4]}
    assert sorted((r["doc_id"] or 0) for r in decontaminate.contaminated(table, bench).collect()) == [0, 4]
    rows = [(None if i % 3 == 0 else i, f"word{i} " * 10, ("a", "b")[i % 2]) for i in range(6000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_report(*mixing.mix_plan(table, weights=(1, 3), share=1.25)).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"))
    assert all(abs(r["taken"] - r["target"]) <= 0.002 * r["source_size"] for r in out.collect())


def pipeline_folder(spark, path, table, labelled):
    spark.createDataFrame([(i, 1, 0) for i in labelled], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(f"q3x{k}" for k in range(20)))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    table.write.parquet(f"{path}/documents.parquet")
    return str(path)


PLAIN = [f"{hashlib.md5(bytes([i])).hexdigest()} " * 3 + " ".join(f"q{i}x{k}" for k in range(40)) for i in range(30)]


def test_pipeline_stages_survive_odd_rows(spark, tmp_path):
    import corpus_pipeline

    table = docs(spark, [*ODD, *PLAIN])
    folder = pipeline_folder(spark, tmp_path, table, range(20))
    out = corpus_pipeline.run(spark, folder).collect()
    ids = {x["doc_id"] for x in out}
    assert len(ODD) + 3 not in ids and ids <= set(range(len(ODD), len(ODD) + 30)) and ids
    assert {x["text"] for x in out} <= {*PLAIN}
    for name, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, table.limit(0), folder).columns == table.columns, name


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    table = docs(spark, PLAIN[:1]).limit(0)
    out = corpus_pipeline.run(spark, pipeline_folder(spark, tmp_path, table, []))
    assert out.columns == [*table.columns, "copy"] and out.collect() == []


def test_pipeline_of_null_ids_and_repeated_rows(spark, tmp_path):
    """Each plain text stays once, whatever repeats it and whether it has an id; the benchmark's goes."""
    import corpus_pipeline

    rows = [(None, t) for t in PLAIN[:6] for _ in range(3)] + [(100 + i, t) for i, t in enumerate(PLAIN[6:20]) for _ in range(2)] + [(7, PLAIN[20]), (8, PLAIN[20]), (9, PLAIN[20] + " end")]
    table = spark.createDataFrame([(d, t, None, None, None, "mine") for d, t in rows], f"{SCHEMA}, copy string")
    docs_, folder = spark.read.parquet, pipeline_folder(spark, tmp_path, table, range(3))
    current = docs_(f"{folder}/documents.parquet")
    for _, function in corpus_pipeline.STAGES[:-1]:
        current = function(spark, current, folder)
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in current.collect())
    want = [(0, t) for i, t in enumerate(PLAIN[:6]) if i != 3] + [(100 + i, t) for i, t in enumerate(PLAIN[6:20])] + [(7, PLAIN[20])]
    assert kept == sorted(want)
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [*table.columns, "_copy"]
    texts = [r["text"] for r in out.collect()]
    assert {*texts} <= {t for _, t in want} and len(texts) >= len(want)  # one source: 150 % of its words


def test_pipeline_leaves_one_copy_of_the_corpus(spark, tmp_path):
    import os

    import corpus_pipeline

    from lapforge.llm.common import shared_dir, staged_so_far

    folder = pipeline_folder(spark, tmp_path, docs(spark, PLAIN), range(20))
    before = staged_so_far()
    corpus_pipeline.run(spark, folder)
    left = [d for d in staged_so_far() - before]
    names = [n for d in left for n in os.listdir(f"{shared_dir(spark).removeprefix('file://')}/{d}")]
    assert names.count("decontamination") == 1 and not {"quality_rules", "line_dedup", "near_dedup", "measured", "lines", "signed", "sets"} & {*names}
