"""Tables in the shared folder: written, read again, deleted."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from isospark.functions import staging
from isospark.sources.ingest import numbered


@pytest.mark.parametrize("folder", ["file:{}/c", "file://{}/c", "{}/a b", "{}/ünï#c+d%20e", "{}/c/"])
def test_discard_whatever_the_folder_is_called(spark, tmp_path, monkeypatch, folder):
    monkeypatch.setattr(staging, "shared_folder", lambda _: folder.format(tmp_path))
    staged = staging.stage(spark.range(10))
    assert staged.count() == 10
    made = [d for d, _, files in os.walk(tmp_path) if any(f.endswith(".parquet") for f in files)]
    assert len(made) == 1
    assert staging.discard(staged)
    assert not os.path.exists(made[0])


def test_discard_takes_only_what_stage_returned(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "own"))
    with pytest.raises(ValueError, match="stage"):
        staging.discard(spark.read.parquet(str(tmp_path / "own")))
    staged = staging.stage(spark.range(3))
    assert staging.discard(staged)
    with pytest.raises(ValueError, match="stage"):
        staging.discard(staged)


def test_threads_leave_the_setting_as_it_was(spark):
    for before in (None, "false"):
        spark.conf.unset(staging._FREE_SHUFFLES) if before is None else spark.conf.set(staging._FREE_SHUFFLES, before)
        was = spark.conf.get(staging._FREE_SHUFFLES, None)
        with ThreadPoolExecutor(6) as pool:
            assert list(pool.map(lambda n: staging.stage(spark.range(n).repartition(2)).count(), range(12))) == list(range(12))
        assert spark.conf.get(staging._FREE_SHUFFLES, None) == was
    spark.conf.unset(staging._FREE_SHUFFLES)


def test_free_names_and_numbered_with_clashing_columns(spark):
    assert staging.free_names(["_Part", "_part_", "x"], "_part", "_part", "y") == ["_part__", "_part___", "y"]
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, _part string").selectExpr("*", "1 AS _n", "2 AS _least", "3 AS _first")
    assert sorted(tuple(r) for r in numbered(df, "k").collect()) == [(0, 1, "a", 1, 2, 3), (1, 2, "b", 1, 2, 3), (2, 3, "c", 1, 2, 3)]
