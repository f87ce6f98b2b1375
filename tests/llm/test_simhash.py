"""SimHash near-duplicates against brute force: fingerprints, keys, links, groups."""

import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from iolens.llm import simhash as S


def brute_fp(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    sh = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_groups(fps, bits=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if bin(a ^ b).count("1") <= bits:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {f: find(f) for f in fps}


def test_fingerprint_matches_definition(spark):
    rng = random.Random(1)
    texts = ["", " \t\n", "One", "one two", "A b C", "ÄÖ x É\x0b y z\x1cq", "a a a a a a"]
    texts += [" ".join(rng.choice(["Foo", "bär", "x", "ZZ", "12"]) for _ in range(rng.randint(1, 90))) for _ in range(40)]
    texts.append("word " * 70_000 + "end")
    assert [S.fingerprint(t.encode()) for t in texts] == [brute_fp(t) for t in texts]
    df = spark.createDataFrame([(t,) for t in texts[:40] if len(t.split()) >= 3], "t string")
    one = df.select(F.xxhash64("t").alias("h"), "t").collect()
    assert all(r.h & (2**64 - 1) == xxhash.xxh64_intdigest(r.t.encode(), seed=42) for r in one)


def test_golay_words_within_two_share_a_key():
    rng = np.random.default_rng(3)
    words = np.r_[0, 0x7FFFFF, rng.integers(0, 1 << 23, 1500)]
    keys, there = S.golay_keys(words)
    mine = [set(k[t]) for k, t in zip(keys, there)]
    assert {len(m) for m in mine} <= {1, 6}
    for w in range(3):
        for at in itertools.combinations(range(23), w):
            k2, t2 = S.golay_keys(words ^ sum(1 << k for k in at))
            assert all(m & set(k[t]) for m, k, t in zip(mine, k2, t2))


def test_every_pair_within_three_bits_shares_a_search_key():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(400)]
    for f in base:
        for w in (1, 2, 3, 3, 3):
            g = f ^ sum(1 << k for k in rng.sample(range(64), w))
            keys, rows = S.search_keys(np.array([f, g], np.uint64))
            assert set(keys[rows == 0]) & set(keys[rows == 1])
    assert len(S.search_keys(np.array(base, np.uint64))[0]) <= 148 * len(base) + 8 * len(base)


@pytest.mark.parametrize("n,bits", [(30, 9), (5000, 13)])
def test_local_groups_both_ways(n, bits):
    rng = np.random.default_rng(n)
    at = rng.choice(64, bits, replace=False)
    fps = np.unique([int(sum(1 << int(at[k]) for k in range(bits) if v >> k & 1)) for v in rng.integers(0, 1 << bits, n)]).astype(np.uint64)
    got = S.local_groups(fps, 2 if n == 30 else 1)
    if n == 30:
        assert dict(zip(fps.tolist(), got.tolist())) == brute_groups(fps.tolist(), 2)
    else:
        rest = S.local_groups(fps[:900], 1)
        assert dict(zip(fps[:900].tolist(), rest.tolist())) == brute_groups(fps[:900].tolist(), 1)


def test_links_and_components_against_all_pairs(spark):
    rng = random.Random(7)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(rng.choice([0, 1, 4, 30])):
            f ^= sum(1 << k for k in rng.sample(range(64), rng.choice([1, 2, 3, 4])))
            fps.add(f)
    core = rng.getrandbits(64)
    fps |= {core ^ sum(1 << k for k in range(9) if v >> k & 1) for v in range(0, 512, 2)}  # a dense group
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    roots = {r.node: r.root for r in S.components(S.links(df)).collect()}
    want = brute_groups(fps)
    got, expect = {}, {}
    for f in fps:
        got.setdefault(roots.get(signed(f), signed(f)), set()).add(f)
        expect.setdefault(want[f], set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expect.values()))


def test_near_duplicates_edge_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(5, "the same text of many words here"), (3, "The SAME text of many words here"), (9, None), (7, ""), (8, " \n"),
            (11, "two words"), (11, "two words"), (None, "two words"), (None, "alone among all others"), (20, long), (21, long)]
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], "doc_id long, text string, fp string, root int, a int, key int")
    got = S.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[5] == by[3] == {3} and by[9] == by[7] == by[8] == {7} and by[11] == {11} and by[20] == by[21] == {20}
    assert by[None] == {11, None}
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in S.op9_simhash_near_dedup(spark, sf).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fp = {d: brute_fp(t) for d, t in texts.items()}
    assert {d: int(r.fingerprint, 16) for d, r in got.items()} == fp
    group = brute_groups(sorted(set(fp.values())))
    least = {}
    for d, f in fp.items():
        least[group[f]] = min(d, least.get(group[f], d))
    assert {d: r.component_id for d, r in got.items()} == {d: least[group[f]] for d, f in fp.items()}


def test_keep_one_with_map_columns(spark):
    rows = [(1, "one two three four", {"a": 1, "b": 2}, [{"x": 1}]), (1, "one two three four", {"a": 1, "b": 2}, [{"x": 1}]),
            (2, "one two three four", None, None), (3, "quite another text of words", {}, []), (None, "quite another text of words", {"z": 9}, [{}])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string, int>, more array<map<string, int>>")
    got = S.keep_one(docs).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "one two three four"), (3, "quite another text of words")]
    assert {r.doc_id: r.tags for r in got} == {1: {"a": 1, "b": 2}, 3: {}}
    assert got[0].asDict().keys() == {"doc_id", "text", "tags", "more"}
