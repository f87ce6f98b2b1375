"""Filter audit: the query against its SQL and a simulation, the potential against sums over orders, edge rows."""

import random
from collections import defaultdict
from itertools import permutations

import numpy as np
import oracle

from iolens.llm import filter_audit as A

SF = "/root/testdata/sf0.001"


def failed(rows):
    """Bits of A to E for (doc_id, text, source) rows, as the filters are worded."""
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    out = []
    for d, t, _ in rows:
        t = t or ""
        words = [w for w in t.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        out.append((len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t)) << 2
                   | any(c in "#$%&*|" for c in t) << 3 | (d is not None and first[t] < d) << 4)
    return out


def simulate(rows, good=(), toxic=()):
    """{(part, order, step): numbers} by running every order over the documents."""
    bits, out, total = failed(rows), {}, defaultdict(int)
    for part in {s or "" for _, _, s in rows}:
        mine = [(d, b) for (d, _, s), b in zip(rows, bits) if (s or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for k, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone = [x for x in left if x[1] & bit]
                left = [x for x in left if not x[1] & bit]
                out[part, order, k] = [len(left), len(gone), sum(1 for x in mine if x[1] & bit) - len(gone), sum(x[1] == bit for x in mine),
                                       sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                total[part, f] += len(gone)
    return {k: tuple(v + [total[k[0], k[1][k[2] - 1]]]) for k, v in out.items()}


def got(df):
    rows = [((r.part, r.filter_order, r.step), (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)) for r in df.collect()]
    assert len(dict(rows)) == len(rows)
    return dict(rows)


def test_query_against_its_sql(spark):
    ok, why = oracle.compare(A.op11_filter_audit(spark, SF).toPandas(), oracle.duck(SF).execute(A.OP11_SQL).df())
    assert ok, why


def test_query_against_a_simulation(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    want = simulate(rows, {r.doc_id for r in labels if r.quality == 1}, {r.doc_id for r in labels if r.toxic == 1})
    assert got(A.op11_filter_audit(spark, SF)) == want


def test_potential_is_the_mean_over_orders():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, (6, 32))
    value = A.removal_game(counts)
    for c, v, s in zip(counts, value, A.shapley(value)):
        assert v.tolist() == [sum(int(n) for m, n in enumerate(c) if m & k) for k in range(32)]
        for f in range(5):
            marginal = 0
            for o in permutations(range(5)):
                before = sum(1 << x for x in o[:o.index(f)])
                marginal += v[before | 1 << f] - v[before]
            assert s[f] == marginal
        assert s.sum() == 120 * v[31]
    p = A.potentials(value)
    for k in range(32):  # the defining property, on every coalition
        assert (sum(p[:, k] - p[:, k & ~(1 << f)] for f in range(5) if k >> f & 1) == 120 * value[:, k]).all()


def test_edge_rows(spark):
    rng = random.Random(1)
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, None, "a"), (2, "", "a"), (3, text, None), (3, text, None), (5, text, "a"), (None, text, "a"), (None, text, "b"), (0, text + "#", "b"),
            (7, text, ""), (8, "A" * 10_000, "b"), (9, "same " * 70_000, "c"), (10, "\x85x\xa0y " * 60, "c"), (11, "ÀÉ " * 60, "c")]
    rows += [(100 + k, rng.choice([text, "x", "A $"]), rng.choice(["a", "b"])) for k in range(60)]
    labels = [(5, 1, 0), (5, 0, 1), (0, None, None), (None, 1, 1), (8, 1, 1), (999, 1, 1)] + [(100 + k, k % 2, k % 3 == 0) for k in range(60)]
    docs = spark.createDataFrame([(*r, "z", 1, "p", 5) for r in rows], "doc_id long, text string, source string, part string, failed int, first string, n int").repartition(3)
    marks = spark.createDataFrame([(a, b, None if c is None else int(c)) for a, b, c in labels], "doc_id long, quality int, toxic int")
    want = simulate(rows, {a for a, b, _ in labels if b == 1 and a is not None}, {a for a, _, c in labels if c == 1 and a is not None})
    assert got(A.audit(A.fail_counts(docs, marks))) == want
    assert A.audit(A.fail_counts(docs.limit(0), marks)).count() == 0
    assert len(got(A.audit(A.fail_counts(docs, marks.limit(0))))) == len(want)
