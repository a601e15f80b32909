"""Hand-worked rows, plans, files and streams."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from isospark.functions.schemas import EXPERIMENT, REGISTRY, RESPONSE, SINGLE
from isospark.operators import cluster, isotherms, materials, profile
from isospark.plans import registry
from isospark.sources import ingest, sinks
from isospark.streaming import ingest as streaming

META = {c: None for c in ("DOI", "category", "date", "tabular_data", "isotherm_type", "digitizer", "articleSource", "concentrationUnits")}


def experiment(name, gases, points):
    data = [{"pressure": p, "total_adsorption": a, "species_data": [{"composition": c, "adsorption": x} for c, x in s]} for p, a, s in points]
    return {**META, "filename": name, "adsorbent": {"hashkey": "h", "name": "MOF"}, "adsorbates": [{"InChIKey": g, "name": g} for g in gases], "temperature": 300.0, "pressureUnits": "bar", "adsorptionUnits": "mmol/g", "isotherm_data": data}


GOLDEN = [
    experiment("e1", ["N2"], [(1.0, 2.0, []), (2.0, None, []), (-1.0, 3.0, [])]),
    experiment("e2", ["CO2", "CH4"], [(10.0, 9.0, [(0.25, 3.0), (0.75, 6.0)]), (20.0, 5.0, [(0.5, 5.0)])]),
    experiment("e3", ["CO2", "CH4"], [(4.0, 1.0, []), (4.0, 1.0, [(None, 1.0), (0.5, 1.0)])]),
    experiment("e4", ["N2"], []),
    experiment("e5", [], [(1.0, 1.0, [])]),
    experiment("e6", ["A", "B", "C"], [(1.0, 1.0, [])]),
]


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame(GOLDEN, EXPERIMENT).cache()


def test_single(golden):
    df = isotherms.single_component(golden)
    assert [(r.filename, r.point_idx, r.pressure, r.adsorbed_amount, r.composition) for r in df.orderBy("point_idx").collect()] == [("e1", 0, 1.0, 2.0, 1.0), ("e1", 2, -1.0, 3.0, 1.0)]
    p = profile.measurement_profile(df).first()
    assert (p.measurements, p.experiments, p.avg_per_experiment, p.neg_pressure, p.neg_pressure_pct) == (2, 1, 2, 1, 50.0)


def test_binary(golden):
    rows = isotherms.binary_mixture(golden, keep_total_pressure=True).orderBy("point_idx").collect()
    assert [(r.compound_1_composition, r.compound_2_composition, r.compound_1_pressure, r.compound_2_pressure, r.compound_1_adsorption, r.compound_2_adsorption, r.compound_2_filled) for r in rows] == [
        (0.25, 0.75, 2.5, 7.5, 3.0, 6.0, False), (0.5, 1.0, 10.0, 20.0, 5.0, 1.0, True)]
    assert rows[0].total_pressure == [10.0, 20.0]
    assert isotherms.binary_mixture(golden, fill_missing_species=False).count() == 1


def test_cardinalities(golden):
    assert {r.numGuests: r.experiments for r in isotherms.guest_cardinality(golden).collect()} == {0: 1, 1: 2, 2: 2, 3: 1}


def test_plans_have_no_shuffle_and_a_narrow_scan(spark, golden, tmp_path):
    path = str(tmp_path / "e")
    golden.withColumn("isotherm_data", F.transform("isotherm_data", lambda p: p.withField("junk", F.lit(1)))).write.parquet(path)
    for build in (isotherms.single_component, isotherms.binary_mixture):
        plan = build(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan and "junk" not in plan.split("ReadSchema")[1]


def test_enrichment(spark):
    reg = spark.createDataFrame([("nitrogen", 2, "x", 1, "b", ["X"], 1.0, "f", "s", 1, 1), ("nitrogen", 1, "n", 2, "b", ["N", "O"], 28.0, "N2", "N#N", 2, 0)], REGISTRY)
    names = spark.createDataFrame([("Nitrogen",), ("nitrogen",), ("Unobtainium",)], "name string")
    assert sorted((r.name, r.elements, r.heavy_atoms) for r in materials.enrich_guests(names, reg).collect() if r.elements) == [("Nitrogen", "N O", 2), ("nitrogen", "N O", 2)]
    assert {r.elements for r in materials.enrich_guests(names, reg, "NA").collect()} == {"N O", "NA"}
    tied = reg.unionByName(reg.withColumn("atoms", F.lit("m")).where("hit_rank = 1"))
    assert {r.atoms for order in (tied, tied.orderBy(F.desc("atoms"))) for r in materials.enrich_guests(names.limit(1), order).collect()} == {"m"}


@pytest.mark.parametrize(("n", "f", "k"), [(3, 0.1, 1), (30, 0.1, 3), (100, 0.07, 8), (0, 0.1, 0)])
def test_head_fraction(spark, n, f, k):
    assert ingest.head_fraction(spark.range(n).withColumnRenamed("id", "ordinal"), f).count() == k


def test_dbscan_line(spark):
    df = spark.createDataFrame(list(enumerate([0.0, 0.5, 1.0, 3.0, 5.0, 5.5, 6.0])), "id long, x double")
    labelled = cluster.dbscan(df, "id", ["x"], 0.75, 3)
    assert [r.cluster for r in labelled.orderBy("id").collect()] == [0, 0, 0, -1, 1, 1, 1]
    assert {r.cluster: r.rows for r in cluster.cluster_summary(labelled).collect()} == {-1: 1, 0: 3, 1: 3}
    assert cluster.cluster_rows(labelled, 1).count() == 3


def plain_dbscan(points, eps, least):
    """(id, point) -> cluster, by counting all neighbours."""
    near = [[j for j, (_, q) in enumerate(points) if sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) <= eps * eps] for _, p in points]
    core = [len(n) >= least for n in near]
    label = {}
    for i in sorted((i for i in range(len(points)) if core[i]), key=lambda i: points[i]):
        if i in label:
            continue
        number, todo = len(set(label.values())), [i]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = number
                todo += [y for y in near[x] if core[y]]
    return [label[i] if core[i] else min((label[j] for j in near[i] if core[j]), default=-1) for i in range(len(points))]


@pytest.mark.parametrize(("dims", "eps", "least"), [(1, 0.05, 4), (2, 0.3, 5), (2, 0.12, 3), (3, 0.4, 6)])
def test_dbscan_is_plain_with_dense_cells_and_repeated_ids(spark, dims, eps, least):
    rnd = random.Random(dims)
    centers = [[rnd.uniform(-2, 2) for _ in range(dims)] for _ in range(4)]
    points = [(i // 2 if i < 40 else i, [c + rnd.gauss(0, 0.15 * (1 + i % 3)) for c in centers[i % 4]]) for i in range(300)]
    points += [(1000 + i, points[i][1]) for i in range(30)]
    rnd.shuffle(points)
    cols = [f"x{k}" for k in range(dims)]
    schema = "id long, " + ", ".join(f"{c} double" for c in cols)
    df = spark.createDataFrame([(i, *p) for i, p in points] + [(5000, *[None] * dims), (5001, *[float("nan")] * dims)], schema)
    want = Counter((i, *p, c) for (i, p), c in zip(points, plain_dbscan(points, eps, least), strict=True))
    for dense in (True, False):
        got = cluster.dbscan(df, "id", cols, eps, least, dense).collect()
        assert len(got) == len(points) + 2 and all(r.cluster == -1 for r in got if r.id >= 5000)
        assert Counter(tuple(r) for r in got if r.id < 5000) == want
    assert cluster.dbscan(df.limit(0), "id", cols, eps, least).count() == 0


def test_dbscan_under_relabelling(spark):
    """Other ids and another order of rows give the same groups, with other numbers."""
    rnd = random.Random(2)
    xs = [rnd.choice((0, 3, 9)) + rnd.random() for _ in range(120)]
    groups = []
    for ids in (range(120), rnd.sample(range(1000), 120)):
        rows = list(zip(ids, xs, strict=True))
        found = cluster.dbscan(spark.createDataFrame(rnd.sample(rows, 120), "id long, x double"), "id", ["x"], 0.2, 4)
        sets = {}
        for r in found.collect():
            sets.setdefault(r.cluster, set()).add(r.x)
        groups.append((sets.pop(-1, set()), {frozenset(s) for s in sets.values()}))
    assert groups[0] == groups[1] and len(groups[0][1]) >= 3


def test_empty_tables(spark, golden):
    single = isotherms.exploded_single(golden.limit(0))
    assert tuple(profile.measurement_profile(single).first()) == (0, 0, None, 0, None, 0, None, 0, None)
    assert {r.nulls for r in profile.null_counts(single).collect()} == {0}
    assert profile.class_distribution(single, "filename").count() == profile.box_stats(single, ["pressure"]).count() == 0
    assert profile.unit_report(single).first().rows_kept == 0
    assert cluster.standardize(single, ["pressure"]).count() == 0
    assert materials.enrich_guests(spark.createDataFrame([("x",)], "name string"), spark.createDataFrame([], REGISTRY)).first().atoms is None


def test_points_are_conserved(golden):
    """Each point of an experiment with one or two gases is a row, or has a null."""
    points = golden.where("size(adsorbates) in (1, 2)").select(F.sum(F.size("isotherm_data"))).first()[0]
    single, binary = isotherms.exploded_single(golden), isotherms.binary_mixture(golden, not_null=["filename"])
    assert single.count() + binary.count() == points


def test_csv_as_pandas_writes_it(spark, tmp_path):
    import pandas as pd

    names = ["two\nlines", 'a "quoted" one', "semi;colon", None, "plain"]
    pd.DataFrame({"name": names}).to_csv(tmp_path / "p.csv", sep=";", index=False)
    assert [r.name for r in ingest.read_dataset_csv(spark, str(tmp_path / "p.csv"), "name STRING").collect()] == names
    (tmp_path / "n.csv").write_text("name;x\n" + "".join(f"{t};1.5\n" for t in ("#NA", "#N/A N/A", "1.#IND", "-1.#QNAN", "NA", "-nan", "word")))
    assert [r.name for r in ingest.read_dataset_csv(spark, str(tmp_path / "n.csv"), "name STRING, x DOUBLE").collect()] == [None] * 6 + ["word"]


def test_index_file(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps([{"filename": "b", "other": 1}, {"filename": "a"}]))
    assert [tuple(r) for r in ingest.read_index(spark, str(tmp_path / "i.json"), "filename STRING").collect()] == [(0, "b"), (1, "a")]


def test_csv_round_trip(spark, golden, tmp_path):
    df = isotherms.single_component(golden)
    sinks.write_dataset(df, str(tmp_path / "s"), "csv")
    back = ingest.read_dataset_csv(spark, str(tmp_path / "s"), SINGLE)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.select(*back.columns).collect()))


def test_stream_gives_what_a_batch_gives(spark, golden, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    bodies = [(i, "k", "u", 200 if i != 1 else 500, "application/json", r) for i, r in enumerate(golden.toJSON().collect())]
    spark.createDataFrame(bodies, RESPONSE).write.parquet(src)
    single, _ = streaming.measurements(streaming.response_stream(spark, src), EXPERIMENT)
    streaming.write_stream(single, out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == isotherms.single_component(golden).count()


def test_index_of_many_rows_is_numbered_by_ranges(spark):
    df = spark.range(0, 3000, 3).withColumn("name", F.concat(F.lit("n"), "id")).repartition(5)
    rows = ingest.numbered(df, "id").orderBy("id").collect()
    assert [(r.ordinal, r.id, r.name) for r in rows] == [(i, 3 * i, f"n{3 * i}") for i in range(1000)]
    assert ingest.numbered(df.limit(0), "id").count() == 0
    plan = registry.index_head_fraction(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "posexplode" not in plan and "FileScan json" in plan


def test_quantiles_are_exact_without_a_task_for_a_column(spark):
    for values in ([float(i * i % 97) for i in range(1001)], [5.0] * 40 + [1.0, None, 7.5], [2.0, 3.0], [4.0], [None], []):
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
        want = df.agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).first().q
        assert profile.quantiles(df, ["x"])["x"] == (pytest.approx(want, rel=1e-12) if want else want)
    df = spark.createDataFrame([(float(i),) for i in [*range(100), 1000]], "x double")
    box = profile.box_stats(df, ["x"])
    assert tuple(box.first()) == ("x", 25.0, 50.0, 75.0, 0.0, 99.0, 1)
    assert "percentile(" not in box._jdf.queryExecution().toString()
