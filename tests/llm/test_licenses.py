"""License scans: phrases by definition, matching statistics and chains against brute force, edge rows."""

import random
import re

from iolens.llm import licenses as L

SF = "/root/testdata/sf0.001"


def brute_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute_places(words):
    return sorted((k, label) for p, label in L.PHRASES.items() for k in range(len(words)) if words[k:k + len(p.split())] == p.split())


def test_words_and_phrases_by_definition():
    rng = random.Random(1)
    s = L.Scanner.of(L.TEMPLATES, L.PHRASES)
    parts = ["MIT", "mit", "License", "apache", "General", "Public", "LICENSE", " ", " ", ", ", "-", "é", "x1", "_", "\n", "license"]
    for t in ["", "MIT License", "mit license mit license", "general public license"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(2000)]:
        low = t.encode().translate(L._WORDS)
        words = low.split()
        assert [w.decode() for w in words] == brute_words(t)
        assert sorted(s.places(low, words)) == brute_places(brute_words(t))


def test_matching_statistics_against_brute_force():
    rng = random.Random(2)
    seqs = [[rng.randrange(3) for _ in range(25)] for _ in range(4)]
    a = L.Automaton.build(seqs)
    subs = {tuple(x[i:j]) for x in seqs for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    text = [rng.randrange(4) for _ in range(400)]
    for i, (state, n) in enumerate(a.statistics(text)):
        assert n == max((k for k in range(i + 2) if k == 0 or tuple(text[i + 1 - k:i + 1]) in subs), default=0)
        if n:
            here = text[i + 1 - n:i + 1]
            have = {k for k, x in enumerate(seqs) if any(x[j:j + n] == here for j in range(len(x)))}
            assert set(a.at[state]) == have
            assert all(seqs[k][e - n + 1:e + 1] == here for k, e in a.at[state].items())


def test_templates_are_found_whole_and_in_part(spark):
    mit = L.TEMPLATES["mit"]
    words = mit.split()
    rows = [(1, "foo bar " + mit + " baz"), (2, " ".join(words[:70])), (3, " ".join(words[:60] + ["inserted"] * 5 + words[60:])),
            (4, "the software is provided as a service"), (5, L.TEMPLATES["gpl"] + " and " + L.TEMPLATES["bsd"])]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "mit" and got[1].score == 1.0 and got[1].spans.startswith("mit:2:")
    assert got[2].labels == "" and 0.3 < got[2].score < 0.5
    assert got[3].labels == "mit" and got[3].score > 0.95
    assert got[4].labels == "" and got[4].score == 0
    assert got[5].labels == "bsd,gpl"


def test_query_against_definition(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = L.op10_license_scan(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = brute_words(texts[r.doc_id])
        places = brute_places(words)
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "MIT License"), (3, "MIT License"), (None, "Apache License"), (6, "word " * 60_000 + "the software is " * 500 + "MIT license")]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, n_words int, labels string")
    got = sorted(L.scan(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [(r.n_words, r.n_base, r.labels) for r in got] == [(2, 1, "apache"), (0, 0, ""), (0, 0, ""), (2, 1, "mit"), (2, 1, "mit"), (61502, 1, "mit")]
    assert L.scan(docs.limit(0)).count() == 0
