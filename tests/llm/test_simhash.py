"""SimHash near-dedup: fingerprints and groups against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lapforge.llm import queries, simhash

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n", "one", "One", "one two", "É x \x85y\n\n", "a b c d e f g h " * 40, "x" * 300_000 + " tail of it", "A b\x0bC", "a b c"]


def fingerprint(text):
    ws = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    parts = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(ids, fps):
    """(component, links) of each row: rows link at 2 bits, and rows of one id are one document."""
    label = list(range(len(fps)))
    find = lambda i: i if label[i] == i else find(label[i])
    links = [0] * len(fps)
    for i in range(len(fps)):
        for j in range(i):
            near = (fps[i] ^ fps[j]).bit_count() <= 2
            links[i] += near
            links[j] += near
            if near or (ids[i] is not None and ids[i] == ids[j]):
                label[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(least.get(find(i)), links[i]) for i in range(len(fps))]


def test_majority_of_long_and_empty_lists():
    r = np.random.default_rng(4)
    lists = [r.integers(0, 2**64, n, np.uint64) for n in (0, 1, 2, 254, 255, 256, 511, 70_000, 300_000, 0)]
    want = [sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h)) for h in lists]
    got = simhash.majority(pa.array([h.view(np.int64) for h in lists], pa.list_(pa.int64())))
    assert [x % 2**64 for x in got.to_pylist()] == want
    assert simhash.majority(pa.array([], pa.list_(pa.int64()))).to_pylist() == []


@pytest.mark.parametrize("bits", [8, 20, 64])
def test_trie_pairs_in_a_task(bits):
    """All pairs within the budget, each once: sparse points, crowded ones, and two nodes that meet."""
    r = np.random.default_rng(bits)
    base = r.integers(0, 2**bits, 300, np.uint64)
    x = np.unique(np.concatenate([base, base[:100] ^ np.uint64(1), base[50:120] ^ np.uint64(5), base[:9] ^ np.uint64(1 << (bits - 1)), base[3:90] ^ np.uint64(7)]))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2
    got = [(a, b) for i, j in simhash._pairs(x, 0, 0, 0) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert sorted(got) == [tuple(p) for p in np.argwhere(np.triu(near, 1)).tolist()]
    x <<= np.uint64(64 - bits)
    top = x >> np.uint64(62)
    for a in range(4):
        for b in range(a + 1, 4):
            y, cut = x[(top == a) | (top == b)], int((top == a).sum())
            near = np.bitwise_count(y[:, None] ^ y[None, :]) <= 2
            want = [tuple(p) for p in np.argwhere(np.triu(near, 1)).tolist() if p[0] < cut <= p[1]]
            differ = (a ^ b).bit_count()
            got = [(i, j) for u, v in (simhash._pairs(y, cut, 2, differ) if 0 < cut < len(y) else ()) for i, j in zip(u.tolist(), v.tolist(), strict=True)]
            assert sorted(got) == want


def near_texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(30):
        ws = [word() for _ in range(r.choice([3, 40, 400]))]
        for _ in range(r.choice([1, 3, 8])):
            ws = [*ws]
            ws[r.randrange(len(ws))] = word()
            out.append(" ".join(ws))
    return out


@pytest.mark.parametrize("leaf", [4, 50, 10_000])
def test_groups_equal_brute_force(spark, leaf):
    """The descent by joins (small leaves) and in one task give the same groups and link counts."""
    texts = ODD + near_texts(3) + ["same text again here"] * 40 + [None, ""]
    ids = [i if i % 13 else None for i in range(len(texts))]
    ids[20], ids[21], ids[-1] = 5, 5, 9
    rows = spark.createDataFrame(list(zip(ids, texts, ids, texts, strict=True)), "doc_id long, text string, fp long, component string")
    fps = [fingerprint(t) for t in texts]
    want = brute(ids, fps)
    got = sorted(simhash.near_duplicates(rows, leaf=leaf).collect(), key=repr)
    expect = [(d, fp, c, n) for d, fp, (c, n) in zip(ids, fps, want, strict=True)]
    assert sorted(((g["id"], g["fp"] % 2**64, g["component"], g["n_links"]) for g in got), key=repr) == sorted(expect, key=repr)
    assert all(g["kept"] == (g["component"] is None or g["id"] == g["component"]) for g in got)
    kept = simhash.simhash_dedup(rows).select("doc_id", "text").collect()
    stay = [(d, t) for d, t, (c, _) in zip(ids, texts, want, strict=True) if c is None or d == c]
    assert sorted(kept, key=repr) == sorted(stay, key=repr) or sorted(map(tuple, kept), key=repr) == sorted(stay, key=repr)


def test_crowded_fingerprints(spark):
    """Thousands of points around one: as many rows as points, however many links."""
    r = np.random.default_rng(1)
    flips = np.array([1 << int(a) | 1 << int(b) for a, b in r.integers(0, 24, (3000, 2))], np.int64)
    x = np.unique(flips ^ np.int64(-(1 << 60)))
    far = np.unique(r.integers(-(2**62), 2**62, 500))
    points = spark.createDataFrame([(int(v), 1) for v in np.unique(np.concatenate([x, far]))], "fp long, docs long")
    met = simhash.fingerprint_links(points, leaf=64).groupBy("fp").agg(F.sum("links").alias("links")).collect()
    every = np.unique(np.concatenate([x, far])).view(np.uint64)
    near = (np.bitwise_count(every[:, None] ^ every[None, :]) <= 2).sum(1) - 1
    assert {m["fp"] % 2**64: m["links"] for m in met} == {int(v): int(n) for v, n in zip(every, near, strict=True) if n}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).collect() == [] and simhash.simhash_dedup(none).collect() == []


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = [fingerprint(d["text"]) for d in docs]
    want = {d["doc_id"]: (f"{fp:016x}", c, n) for d, fp, (c, n) in zip(docs, fps, brute([d["doc_id"] for d in docs], fps), strict=True)}
    got = queries.op11_simhash(spark, SF).collect()
    assert len(got) == len(docs) and {g["doc_id"]: (g["fingerprint"], g["component_id"], g["n_links"]) for g in got} == want
