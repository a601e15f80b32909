"""Collection in chunks, profiles by chunk, exact quartiles, units, laid-out joins, grouped measurements, CSV in parts, tries of responses."""

import json
import math
import random
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from isospark.functions.schemas import RESPONSE, SINGLE
from isospark.operators import chunks, enriched, profile, units
from isospark.sources import ingest, sinks
from isospark.streaming import ingest as streaming


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunks_are_replaced_alone_and_pruned(spark, tmp_path):
    path = str(tmp_path / "c")
    index = chunks.with_chunk(spark.range(95).withColumnRenamed("id", "ordinal"), 10)
    chunks.write_chunks(index.withColumn("try", F.lit(1)), path)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "c").rglob("*.parquet")}
    again = index.where("chunk = 3 and ordinal < 35").withColumn("try", F.lit(2))
    for _ in range(2):
        chunks.write_chunks(again, path)
    found = {(r.chunk, r["try"]): r.n for r in chunks.read_chunks(spark, path).groupBy("chunk", "try").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert found == {(c, 2 if c == 3 else 1): 5 if c in (3, 9) else 10 for c in range(10)}
    assert {p for p in files if p.exists()} == {p for p in files if "chunk=3" not in str(p)}
    some = chunks.read_chunks(spark, path, 2, 4)
    assert sorted(r.chunk for r in some.select("chunk").distinct().collect()) == [2, 3, 4]
    assert re.search(r"PartitionFilters: \[[^\]]*chunk[^\]]*\]", plan(some))
    with pytest.raises(ValueError, match="entry"):
        chunks.with_chunk(index, 0)


def test_landing_many_chunks_writes_few_files(spark, tmp_path):
    """Files don't grow with chunks; chunks of several blocks, one without a number, and ones that are landed again come back once."""
    path = str(tmp_path / "c")
    index = chunks.with_chunk(spark.range(6_000).withColumnRenamed("id", "ordinal"), 2).withColumn("try", F.lit(1))
    chunks.write_chunks(index.withColumn("chunk", F.when(F.col("chunk") != 7, F.col("chunk"))), path)
    assert len(list((tmp_path / "c").rglob("*.parquet"))) <= 60
    chunks.write_chunks(index.where("chunk in (1, 999, 1000) and ordinal % 2 = 0").withColumn("try", F.lit(2)), path)
    want = {(i, i // 2 if i // 2 != 7 else None, 2 if i // 2 in (1, 999, 1000) else 1) for i in range(6_000) if i % 2 == 0 or i // 2 not in (1, 999, 1000)}
    got = [(r.ordinal, r.chunk, r["try"]) for r in chunks.read_chunks(spark, path).collect()]
    assert len(got) == len(want) and set(got) == want
    some = chunks.read_chunks(spark, path, 999, 1000).collect()
    assert sorted((r.ordinal, r.chunk, r["try"]) for r in some) == [(1998, 999, 2), (2000, 1000, 2)]


def test_landings_that_failed_or_are_empty_replace_nothing(spark, tmp_path):
    path = str(tmp_path / "c")
    index = chunks.with_chunk(spark.range(20).withColumnRenamed("id", "ordinal"), 10)
    chunks.write_chunks(index.limit(0), path)
    assert (chunks.read_chunks(spark, path).columns, chunks.read_chunks(spark, path).count()) == (["ordinal", "chunk"], 0)
    chunks.write_chunks(index, path)
    broken = index.withColumn("ordinal", F.when(F.col("ordinal") < 15, F.col("ordinal")).otherwise(F.raise_error(F.lit("lost")).cast("long")))
    with pytest.raises(Exception, match="lost"):
        chunks.write_chunks(broken, path)
    assert sorted(r.ordinal for r in chunks.read_chunks(spark, path).collect()) == list(range(20))
    with pytest.raises(ValueError, match="landing"):
        chunks.write_chunks(index.withColumn("Landing", F.lit(1)), path)


def test_profiles_of_new_chunks_leave_old_ones_alone(spark):
    rows = [(f"e{i % 7000}", 1.0 if i % 9 else -1.0, 1.0, 300.0 if i % 5 else 0.0, f"u{i % 12}" if i % 4 else None, i // 5000) for i in range(20_000)]
    df = spark.createDataFrame(rows, "filename string, pressure double, adsorbed_amount double, temperature double, adsorptionUnits string, chunk long")
    kept = chunks.chunk_profiles(df.where("chunk < 3")).unionByName(chunks.chunk_profiles(df.where("chunk = 3")))
    got, exact = chunks.merged_profile(kept).first(), profile.measurement_profile(df).first()
    assert (got.measurements, got.neg_pressure, got.neg_pressure_pct, got.bad_temperature) == (exact.measurements, exact.neg_pressure, exact.neg_pressure_pct, exact.bad_temperature)
    assert abs(got.experiments - exact.experiments) <= 4 * 1.04 / 2 ** (chunks.LOG_SLOTS / 2) * exact.experiments
    assert got.units == 9
    none = chunks.merged_profile(kept.limit(0)).first()
    assert (none.measurements, none.experiments, none.neg_pressure_pct) == (0, 0, None)


@pytest.mark.parametrize("keep", [16_384, 5])
def test_quantiles_are_exact(spark, keep):
    """Ties, infinities, NaN, nulls, no values, one value; also where intervals are sketched again and again."""
    rng = np.random.default_rng(0)
    values = {
        "a": rng.normal(size=4_001).tolist(), "b": rng.integers(0, 4, 4_001).astype(float).tolist(), "c": [*rng.exponential(size=3_000).tolist(), *[math.inf] * 1001], "d": [None] * 4_000 + [3.5],
        "e": [None] * 4_001, "f": [*rng.normal(size=2_400).tolist(), *[math.nan] * 1601], "g": [0.0] * 3_000 + rng.normal(size=1001).tolist(), "h": [*np.arange(4_000.0).tolist(), None],
    }
    df = spark.createDataFrame(list(zip(*values.values(), strict=True)), ", ".join(f"{c} double" for c in values)).cache()
    got = {c: profile.quantiles(df, [c], (0.0, 0.25, 0.5, 0.75, 1.0), keep=keep)[c] for c in "abdg"} | profile.quantiles(df, list("cefh"), (0.0, 0.25, 0.5, 0.75, 1.0), keep=keep)
    for c, column in values.items():
        own = np.array(sorted((v for v in column if v is not None), key=lambda v: (math.isnan(v), v)))
        if not len(own):
            assert got[c] is None
            continue
        for share, value in zip((0.0, 0.25, 0.5, 0.75, 1.0), got[c], strict=True):
            at = share * (len(own) - 1)
            low, high = own[math.floor(at)], own[math.ceil(at)]
            want = low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high
            assert value == want or math.isnan(value) and math.isnan(want), (c, share)


def test_box_stats_shuffle_sketches_only(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("x"), F.lit(None).cast("double").alias("none"))
    row = profile.box_stats(df, ["x", "none"]).collect()
    q1, q2, q3 = np.percentile([i % 97 for i in range(1000)], [25, 50, 75])
    assert [(r["column"], r.q1, r.median, r.q3, r.whisker_low, r.whisker_high, r.outliers) for r in row] == [("x", q1, q2, q3, 0.0, 96.0, 0)]
    assert profile.box_stats(df.limit(0), ["x"]).count() == 0
    text = plan(df.agg(F.kll_sketch_agg_double("x", profile.SKETCH)))
    assert text.count("Exchange") == 1 and "SinglePartition" in text


def test_units(spark):
    factors = units.factor_table(spark)
    of = {r.unit: (r.factor, r.mass_power) for r in units.paths_to(factors, "mol/kg").collect()}
    assert of["mol/kg"] == of["mmol/g"] == (1.0, 0)
    assert of["mg/g"] == (1.0, -1)
    assert math.isclose(of["wt%"][0], 10.0) and of["wt%"][1] == -1
    assert math.isclose(of["ml(STP)/g"][0], 1 / 22.414)
    assert "bar" not in of and set(of) == {u for x in units.UPTAKE_FACTORS for u in x[:2]}
    back = {r.unit: (r.factor, r.mass_power) for r in units.paths_to(factors, "mg/g").collect()}
    assert back["mol/kg"] == (1.0, 1)
    df = spark.createDataFrame([(1.0, "atm", 44.0, "mg/g", 44.0), (2.0, "bar", 3.0, "mg/g", None), (None, "Pa", 2.0, "mol/g", None), (1.0, "furlong", 1.0, None, 1.0), (1.0, None, 5.0, "wt%", 0.0)], "pressure float, pressureUnits string, adsorbed_amount float, adsorptionUnits string, mass double").selectExpr("*", "9 AS unit", "8 AS factor", "7 AS _path")
    done = units.in_pa_and_mol_per_kg(df, factors, "mass")
    assert done.columns == [*df.columns, "pressure_pa", "uptake_mol_kg"]
    assert sorted(((r.pressure_pa, r.uptake_mol_kg) for r in done.collect()), key=str) == sorted([(101325.0, 1.0), (200000.0, None), (None, 2000.0), (None, None), (None, None)], key=str)
    report = {(r.pressureUnits, r.adsorptionUnits): (r.measurements, r.without_pressure, r.without_uptake) for r in units.conversion_report(done).collect()}
    assert report[("furlong", None)] == (1, 1, 1) and report[("bar", "mg/g")] == (1, 0, 1) and report[("Pa", "mol/g")] == (1, 0, 0)
    assert "BroadcastHashJoin" in plan(done) and "SortMergeJoin" not in plan(done)
    around = spark.createDataFrame([("a", "b", 2.0, 0), ("b", "c", 2.0, 0), ("c", "a", 0.25, 0), ("d", "d", 9.0, 0)], units.FACTORS)
    assert {r.unit: r.factor for r in units.paths_to(around, "c").collect()} == {"c": 1.0, "b": 2.0, "a": 4.0}


def test_properties_beside_measurements_move_no_row(spark, tmp_path):
    rows = [("hot" if i % 2 else ("Rare" if i % 4 else None if i % 8 else "none"), i) for i in range(4000)]
    measured = spark.createDataFrame(rows, "gas string, i long").selectExpr("*", "'own' AS formula", "1 AS salt")
    gases = spark.createDataFrame([("HOT", 1.0, "H"), ("hot", 2.0, "I"), ("rare", 3.0, "R")], "name string, mass double, formula string")
    names, paths = ("isospark_t_measured", "isospark_t_gases"), (str(tmp_path / "m"), str(tmp_path / "g"))
    enriched.lay_out(measured, gases, "gas", names, paths, buckets=8, share=300)
    joined = enriched.with_properties(spark, names)
    assert joined.columns == ["gas", "i", "formula", "salt", "mass"]
    assert {(r.gas, r.mass, r.formula, r.salt) for r in joined.collect()} == {("hot", 1.0, "own", 1), ("Rare", 3.0, "own", 1), (None, None, "own", 1), ("none", None, "own", 1)}
    assert joined.count() == 4000
    assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
    shares = {r.salt: r.n for r in spark.table(names[0]).where("gas_key = 'hot'").groupBy("salt").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(shares) == 7 and max(shares.values()) < 450


def test_grouped_runs_are_bounded_and_flat_again(spark, tmp_path):
    rows = [("long", i, float(i)) for i in range(2500)] + [("short", 0, 1.0), ("short", 1, None), (None, 0, 2.0)]
    df = spark.createDataFrame(rows, "filename string, point_idx int, pressure double").selectExpr("*", "5 AS run", "'x' AS points")
    grouped = chunks.grouped_runs(df, run=1000)
    assert {(r.filename, len(r.points)) for r in grouped.collect()} == {("long", 1000), ("long", 500), ("short", 2), (None, 1)}
    chunks.write_grouped(grouped, "isospark_t_grouped", str(tmp_path / "g"), buckets=4)
    back = chunks.flat_runs(spark.table("isospark_t_grouped"), df.columns)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert "Exchange" not in plan(spark.table("isospark_t_grouped").groupBy("filename").count())


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_csv_in_parts_is_the_whole_file(spark, tmp_path, newline):
    """Line ends, separators and quotes in values; blocks that begin inside a value, and values longer than a block."""
    rnd = random.Random(1)
    folder = tmp_path / "csv"
    folder.mkdir()
    want, was = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    for f in range(3):
        lines = ["name;note;n"]
        for i in range(400):
            note = "".join(rnd.choice(["a", "b c", '"', ";", newline, "é", " "]) for _ in range(rnd.choice([0, 3, 30, 30, 3000 if i % 97 == 0 else 5])))
            want.append((f"f{f}r{i}", note, i))
            quoted = '"' + note.replace('"', '""') + '"'
            lines.append(f"f{f}r{i};{quoted};{i}")
        text = newline.join(lines) + (newline if f else "")
        (folder / f"part-{f}.csv").write_bytes(text.encode())
    try:
        for size in (700, 10_000_000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = ingest.csv_records(spark, str(folder)).select(F.from_csv("record", "name string, note string, n int", {"sep": ";", "escape": '"', "maxCharsPerColumn": "-1", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}).alias("r")).select("r.*")
            assert sorted((r.name, r.note or "", r.n) for r in got.collect()) == sorted(want)
            if size == 700:
                assert ingest.csv_records(spark, str(folder)).count() == 1200
                assert spark.read.option("lineSep", "\n").text(str(folder)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_dataset_csv_in_parts_is_the_dataset(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = [(f"e{i}", 1.0, "bar", "mmol/g", 1, "M\nO;F" if i % 3 else None, ["x", "y\n"], i, 1.5, 2.5, 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, SINGLE)
    sinks.write_dataset(df.coalesce(2), path, "csv")
    both = [sorted(map(str, ingest.read_dataset_csv(spark, path, SINGLE, in_parts=x).collect())) for x in (True, False)]
    assert both[0] == both[1] == sorted(map(str, df.collect()))


def test_tries_of_a_response_in_a_stream_are_those_of_the_batch(spark, tmp_path):
    """Late, repeated and bad tries, in files that arrive one after the other: what the batch gives, the stream gives."""
    rnd, tries = random.Random(4), []
    for i in range(400):
        status, kind, body = rnd.choice([(200, "application/json", json.dumps({"name": f"n{i}"})), (200, "application/json", '{"na'), (500, "application/json", "{}"), (200, "text/html", "<p>")])
        tries.append((i, f"k{rnd.randrange(40)}" if i % 50 else None, "u", status, kind, body))
    tries += tries[:20]
    rnd.shuffle(tries)
    batch = {tuple(r) for r in ingest.latest_valid(spark.createDataFrame(tries, RESPONSE), "name string").selectExpr("key", "doc.name", "ordinal").collect()}
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for s in range(0, len(tries), 60):
        spark.createDataFrame(tries[s : s + 60], RESPONSE).coalesce(1).write.mode("append").parquet(source)
        if s in (120, 300) or s + 60 >= len(tries):
            streaming.write_latest(streaming.response_stream(spark, source, 1), "name string", out, check).awaitTermination()
    assert {tuple(r) for r in streaming.read_latest(spark, out).selectExpr("key", "doc.name", "ordinal").collect()} == batch
    assert len(batch) > 30 and datetime.now()


def test_index_of_an_array(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps([{"filename": "b", "more": [1]}, {"filename": None}, {"other": 2}, {"filename": "a"}]))
    assert [tuple(r) for r in ingest.read_index(spark, str(tmp_path / "i.json"), "filename STRING").orderBy("ordinal").collect()] == [(0, "b"), (1, None), (2, None), (3, "a")]
