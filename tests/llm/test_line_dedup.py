"""Line dedup: the query against its SQL and a plain loop, levels of runs, hot lines, plan, edge rows."""

import hashlib
import random
from collections import defaultdict

import oracle
import pytest
from pyspark.sql import functions as F

from iolens.llm import line_dedup as L

SF = "/root/testdata/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(line):
    return line.strip(L.SPACE).translate(UP)


def brute(rows, shortest=L.SHORTEST, least=L.LEAST_DOCS):
    """[(doc_id, n_lines, n_dropped, text)] of (doc_id, text) rows."""
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key_of(x)) >= shortest:
                held[key_of(x)].add(d)
    keeper = {k: max(d for d in ids if d is not None) for k, ids in held.items() if len(ids) >= least}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if keeper.get(key_of(x), d) == d or key_of(x) not in keeper]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=str)


def made(n, seed=5):
    rng = random.Random(seed)
    pool = [f"  A shared LINE number {k} éÉ\t" for k in range(30)] + ["short", "", "x" * 19, "Y" * 20, "𝔘" * 20, "İıſ straße ÀÉ kept as it is"]
    return [(rng.randint(0, n), "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own line {rng.random()} of text" for _ in range(rng.randint(0, 9)))) for _ in range(n)]


def test_query_against_its_sql(spark):
    ok, why = oracle.compare(L.op12_line_dedup(spark, SF).toPandas(), oracle.duck(SF).execute(L.OP12_SQL).df())
    assert ok, why


def test_query_against_a_loop(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows)}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in L.op12_line_dedup(spark, SF).collect()} == want
    assert sum(k for _, k, _ in want.values()) > 0


@pytest.mark.parametrize("batches, fan", [(1, 3), (7, 2)])
def test_batches_and_levels_do_not_change_the_result(spark, batches, fan):
    rows = made(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(L.deduplicate(docs, batches=batches, fan=fan)) == brute(rows)


def test_runs_hold_each_key_once_with_its_newest_document(spark):
    rows = [(d, t) for d, t in made(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    p = L.places(docs).cache()
    runs = L.Runs(spark, fan=2)
    for low in (120, 90, 60, 30, 0):
        own = runs.add(p.filter((F.col("doc_id") >= low) & (F.col("doc_id") < low + 30 if low < 120 else F.col("doc_id") >= low)))
        assert own.groupBy("h1", "h2").count().filter("count > 1").count() == 0
    assert [len(x) for x in runs.levels] == [1, 0, 1]  # five runs: 4 + 1
    seen = list(runs)[0]
    for r in list(runs)[1:]:
        seen = seen.unionByName(r)
    want = p.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("docs"), F.max("doc_id").alias("keeper"))
    merged = seen.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"), F.count("keeper").alias("k"))
    assert merged.filter("k <> 1").count() == 0
    assert merged.drop("k").exceptAll(want).count() == 0 and want.exceptAll(merged.drop("k")).count() == 0


def test_main_path_is_native_and_linear(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = L.deduplicate(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD", "CartesianProduct", "BroadcastNestedLoopJoin"))
    line = "The same long line of words in many documents."
    rows = [(k, "\n".join([line] * 30_000 + [f"own {k}"])) for k in range(4)]
    out = got(L.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [(d, n, k) for d, n, k, _ in out] == [(0, 30_001, 30_000), (1, 30_001, 30_000), (2, 30_001, 30_000), (3, 30_001, 0)]


def test_edge_rows(spark):
    line = "a line of more than twenty points"
    rows = [(1, None), (2, ""), (3, line), (3, line), (3, f"other\n{line.upper()}"), (None, line), (None, f"x\n{line}"), (9, f"\n\n {line} \n"),
            (8, "\n"), (7, "only two documents hold this line"), (6, "only two documents hold this line"), (5, "nineteen points abc"), (4, "nineteen points abc"), (10, "nineteen points abc")]
    docs = spark.createDataFrame([(*r, "z", 1, True) for r in rows], "doc_id long, text string, row string, pos int, gone boolean")
    assert got(L.deduplicate(docs)) == brute(rows)
    assert L.deduplicate(docs.limit(0)).count() == 0
    nulls = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert {r.n_dropped for r in L.deduplicate(nulls).collect()} == {0}
