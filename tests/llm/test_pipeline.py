"""Corpus pipeline: every stage on its own input, and the whole run."""

import corpus_pipeline as C
from iolens.llm import simhash as S

SF = "/root/testdata/sf0.001"
NAMES = ["language_id", "quality_rules", "simhash_near_dedup", "secret_scan", "best_fit_packing"]


def test_stages_one_after_another(spark):
    assert [n for n, _ in C.STAGES] == NAMES and C.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = docs
    for name, stage in C.STAGES[:-1]:
        before = {r.doc_id: r for r in kept.collect()}
        out = C.written(stage(spark, kept, SF), "t-pipeline")
        assert out.dtypes == docs.dtypes
        after = {r.doc_id: r for r in out.collect()}
        assert out.count() == len(after) and after.keys() <= before.keys()
        if name == "language_id":
            gone = [d for d in before if d not in after and labels.get(d) == 1]
            assert len(gone) <= 2
        if name == "simhash_near_dedup":
            groups = {r.doc_id: r.component_id for r in S.near_duplicates(kept).collect()}
            assert set(after) == set(groups.values())
        if name == "secret_scan":
            assert after.keys() == before.keys()
            assert all("password=" not in r.text and "AKIA" not in r.text for r in after.values())
            assert all(r.n_chars == len(r.text) for r in after.values())
        else:
            assert all(after[d] == before[d] for d in after)
        kept = out
    packed = C.STAGES[-1][1](spark, kept, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept.collect()}


def test_run_and_edge_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(None, docs.first().text, None, None, None), (10**6, None, "en", "s", 0), (10**6, None, "en", "s", 0), (10**6 + 1, "", None, "s", 0)]
    first = docs.filter("length(text) > 600").first()
    extra += [tuple(first), tuple(first)]
    docs.union(spark.createDataFrame(extra, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    rows = C.run(spark, str(tmp_path)).collect()
    assert rows and None not in {r.doc_id for r in rows}
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert C.run(spark, f"{tmp_path}/none").count() == 0


def test_one_row_of_each_group_stays(spark):
    def text(k):
        return " ".join(f"w{k}x{j * j % 97}" for j in range(80))

    docs = [(None, text(1), "en"), (None, text(1), "en"), (None, text(2), "en"), (None, text(2), None),  # groups without a doc_id
            (5, text(3), "en"), (5, text(4), "en"),  # unlinked texts with one doc_id
            (6, text(5), "en"), (7, text(5), "en"), (7, text(6), "en"), (None, text(5), "en"),  # 7: a copy, and a text of its own
            (8, text(7), "en"), (8, text(7), "en"), (8, text(7), "de")]
    frame = spark.createDataFrame([(*d, "s", len(d[1])) for d in docs], "doc_id long, text string, lang string, id string, copies int")
    out = C.near_duplicates(spark, frame, "")
    rows = out.collect()
    assert out.dtypes == frame.dtypes and {tuple(r) for r in rows} <= {tuple(r) for r in frame.collect()}
    got = sorted(((r.doc_id or 0, r.text) for r in rows))
    assert got == sorted([(0, text(1)), (0, text(2)), (5, text(3)), (5, text(4)), (6, text(5)), (7, text(6)), (8, text(7))])
    assert C.near_duplicates(spark, frame.limit(0), "").count() == 0
