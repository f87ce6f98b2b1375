"""Scratch output goes under the session's checkpoint folder."""

from iolens.session import ensure_checkpoint_dir, scratch_path


def test_scratch_under_checkpoint_dir(spark):
    base = ensure_checkpoint_dir(spark)
    assert base == spark.sparkContext.getCheckpointDir()
    p = scratch_path(spark, "x")
    assert p.startswith(base) and "iolens-scratch" in p
    assert scratch_path(spark, "x") != p


def test_clear_scratch_deletes_only_scratch(spark, tmp_path, monkeypatch):
    import os

    from iolens import session
    monkeypatch.setattr(session, "ensure_checkpoint_dir", lambda s: f"file://{tmp_path}")
    (tmp_path / "other").mkdir()
    spark.range(3).write.parquet(scratch_path(spark, "t"))
    assert os.listdir(tmp_path / "iolens-scratch")
    assert session.clear_scratch(spark) and os.listdir(tmp_path) == ["other"]


def test_no_private_folder_on_a_cluster(monkeypatch):
    import types

    import pytest

    sc = types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077",
                               getConf=lambda: types.SimpleNamespace(get=lambda k, d=None: d))
    fake = types.SimpleNamespace(sparkContext=sc, conf=types.SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(fake)


def test_pandas_udf_query_runs_from_another_directory(tmp_path):
    """The driver may import __spark_entry__ from elsewhere; Python workers then
    get the package through addPyFile."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled','false').getOrCreate()\n"
        "import __spark_entry__ as e\n"
        "print('ROWS', e.queries()['forecast_hourly'](s, '/root/testdata/sf0.001').count())\n" % root)
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True,
                         timeout=600, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "ROWS" in out.stdout, out.stderr[-2000:]
