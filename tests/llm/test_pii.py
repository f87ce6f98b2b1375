"""Personal data: base matches against Python's engine, EM on a known source, added spans, plan, edge rows."""

import hashlib
import random
import re

import pytest

from iolens.llm import pii as P

SF = "/root/testdata/sf0.001"


def luhn(d):
    s = [int(c) for c in reversed(d)]
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(s)) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)]
    out = [(m.start(), k, m.end(), kind) for k, (kind, rx, ok) in enumerate(rules) for m in re.finditer(rx, text) if ok(m)]
    return [f"{kind}:{a}:{e}" for a, _, e, kind in sorted(out)]


def check(rows, texts):
    for r in rows:
        want = brute(texts[r.doc_id] or "")
        got = [x for x in r.spans.split(",") if x.split(":")[0] in P.BASE]
        assert got == want, (texts[r.doc_id], got, want)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in P.BASE]


def test_base_matches_are_the_patterns(spark):
    fixed = ["", "a@b.c_d@e.f", "a@b", "x a.b+c@d-e.co.uk, y", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "1 2 3 4 5 6 7 8 9 0 1 2 8",
             "+1 (469) 555-0909", "+49 30 1234567.", "+1+2 33333333", "é🙂 a@b.cc +33 1 23 45 67 89", "@@a@b.c@d.e", "%+-@x.y", "+1 2"]
    rng = random.Random(2)
    parts = ["a", "b.c", "@", ".", "1", "23", "255", " ", "-", "+", "(", ")", "4111111111111111", "x_y", "é", "🙂", "com", "+49 30 123456"]
    texts = dict(enumerate(fixed + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 16))) for _ in range(1500)]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(P.detect(docs).collect(), texts)


def test_query_against_the_patterns(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = P.op7_pii(spark, SF).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_em_recovers_reliabilities():
    rng = random.Random(3)
    good = [0.95, 0.9, 0.85, 0.6, 0.8]
    rows, truth = {}, {}
    for _ in range(6000):
        real = rng.random() < 0.4
        v = "".join("0" if rng.random() < 0.2 else "+" if (rng.random() < g) == real else "-" for g in good)
        rows[v] = rows.get(v, 0) + 1
        truth.setdefault(v, []).append(real)
    post = P.em([("phone", v, n) for v, n in rows.items()])
    right = sum((post["phone", v] > 0.5) == t for v, ts in truth.items() for t in ts)
    majority = sum(((v.count("+") - v.count("-")) > 0) == t for v, ts in truth.items() for t in ts)
    assert right >= majority and right > 0.9 * 6000


def test_method_adds_spans_and_leaves_plain_text(spark):
    rows = [(k, f"Words here. call me: +49 30 12{k:05d} or tel: (030) 555 {1000 + k} please.") for k in range(80)]
    rows += [(1000 + k, f"On page 12 of section 3.{k} nothing happens in 19{k % 90 + 10} at all.") for k in range(80)]
    got = {r.doc_id: r.spans for r in P.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("local_phone" in got[k] for k in range(80)) >= 70
    assert not any(got[1000 + k] for k in range(80))


def test_main_path_is_native(spark):
    docs = P.doc_text(spark.read.parquet(f"{SF}/documents.parquet"))
    plan = P.candidates(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))


@pytest.mark.parametrize("text", ["9" * 60_000, "a" * 60_000 + "@", "1 " * 40_000, "a.b@" + "c." * 30_000 + "d", "+" + "1" * 60_000, "1." * 40_000])
def test_long_runs_end_soon(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert P.detect(docs).count() == 1


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "a@b.cc"), (3, "a@b.cc"), (None, "a@b.cc"), (5, "no data " * 20_000 + "+1 469 555 0909")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, found string, at int")
    got = P.detect(P.doc_text(docs)).collect()
    assert sorted(r.n_email for r in got) == [0, 0, 0, 1, 1, 1] and [r.spans for r in got if r.doc_id == 5] == ["phone:160000:160015"]
    assert P.detect(P.doc_text(docs.limit(0))).count() == 0
