"""DBSCAN on dense data, over many columns, beside clashing names."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from isospark.functions.graph import components
from isospark.functions.staging import stage
from isospark.operators import cluster, neighbours
from tests.test_isotherms import plain_dbscan


def frame(spark, points):
    cols = [f"x{i}" for i in range(len(points[0]))]
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], f"id long, {', '.join(f'{c} double' for c in cols)}"), cols


@pytest.mark.parametrize(("dims", "eps"), [(1, 0.02), (2, 0.4), (3, 0.8)])
def test_dense_cells_are_linked_as_their_points_are(spark, dims, eps):
    """Points in clumps, whose cells are full: some clumps are within eps of each other, some just not."""
    rng = np.random.default_rng(dims)
    middles = rng.uniform(0, 6 if dims > 1 else 1, (25, dims))
    points = np.concatenate([m + rng.normal(0, eps / 6, (60, dims)) for m in middles] + [rng.uniform(0, 6, (60, dims))]).round(4)
    df, cols = frame(spark, points.tolist())
    want = plain_dbscan(list(enumerate(map(tuple, points.tolist()))), eps, 6)
    for dense in (True, False) if dims == 2 else (True,):
        assert [r.cluster for r in cluster.dbscan(df, "id", cols, eps, 6, dense).orderBy("id").collect()] == want


def cells_of(spark, points, k, eps, least):
    """What cell_links is given for points of full cells, and the cells' numbers."""
    width = eps / k**0.5 * (1 - 1e-9)
    known = spark.createDataFrame([(i, list(map(float, p))) for i, p in enumerate(points)], "p long, z array<double>") if isinstance(points, list) else points
    known = known.withColumn("cell", F.array(*[F.floor(F.element_at("z", i + 1) / width) for i in range(k)]))
    cells = known.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.min("p").alias("rep")).where(F.col("m") >= least)
    known = stage(known.join(cells, "cell"))
    shifts = F.array(*[F.array(*[F.get("cell", F.lit(i)) + x for i, x in enumerate(s)]) for s in cluster._near_shifts(k, width, eps)])
    cells = stage(known.select("cell", "rep").distinct())
    pairs = stage(cells.select("rep", F.explode(shifts).alias("at")).alias("x").join(cells.alias("y"), F.expr("x.at = y.cell and x.rep < y.rep")).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")))
    corners = [(F.element_at("cell", i + 1) * width).alias(f"c{i}") for i in range(k)]
    return known, cluster.cell_links(known.select("rep", "z", *corners), pairs, spark.createDataFrame([], "a long, b long"), k, eps, width)


@pytest.mark.parametrize(("dims", "gap"), [(2, 1.0 + 1e-7), (2, 1.0 - 1e-7), (3, 1.0 + 1e-7), (3, 1.0 - 1e-7)])
def test_cells_at_the_very_edge(spark, dims, gap):
    """Two clumps whose nearest points are apart by just over, or just under, eps."""
    rng = np.random.default_rng(1)
    left, right = rng.uniform(0, 0.3, (200, dims)), rng.uniform(0, 0.3, (200, dims))
    left[0], right[0] = [0.3] + [0.1] * (dims - 1), [0.0] + [0.1] * (dims - 1)
    right[:, 0] += 0.3 + gap
    points, (links, _) = cells_of(spark, [*left.tolist(), *right.tolist()], dims, 1.0, 1)
    found = components(links)
    joined = points.join(found, points.rep == found.node, "left").select(F.coalesce("component", "rep").alias("c")).distinct().count()
    assert joined == (1 if gap < 1 else 2)


def test_dense_points_take_few_comparisons(spark):
    """200,000 points on 10 x 10, eps 0.4: some 1,250 full cells; all pairs of near cells would be 300 million comparisons."""
    n = 200_000
    points = spark.range(n, numPartitions=8).select(F.col("id").alias("p"), F.array(F.rand(1) * 10, F.rand(2) * 10).alias("z"))
    known, (links, tested) = cells_of(spark, stage(points), 2, 0.4, 5)
    assert tested <= 50 * n
    assert components(links).select("component").distinct().count() == 1


@pytest.mark.parametrize(("dims", "eps", "least"), [(8, 1.2, 5), (4, 0.5, 3), (5, 0.9, 1)])
def test_many_columns_are_brute_force(spark, monkeypatch, dims, eps, least):
    """Space halved by a sample, by rounds, and not at all, with repeated points and rows that take no part."""
    rng = np.random.default_rng(dims)
    points = np.concatenate([rng.normal(m, 0.35, (70, dims)) for m in rng.uniform(-2, 2, (6, dims))] + [rng.uniform(-3, 3, (80, dims))]).round(3)
    points = np.concatenate([points, points[:30]])
    df, cols = frame(spark, points.tolist())
    want = plain_dbscan(list(enumerate(map(tuple, points.tolist()))), eps, least)
    assert len(set(want)) > 3
    more = df.unionByName(spark.createDataFrame([(9000, None, *[1.0] * (dims - 1)), (9001, float("nan"), *[1.0] * (dims - 1))], df.schema))
    for most, sample in ((2048, 16_384), (40, 200), (25, 1)) if dims == 8 else ((30, 100),):
        monkeypatch.setattr(neighbours.leaves, "__defaults__", (most, sample))
        got = cluster.dbscan(more, "id", cols, eps, least).orderBy("id").collect()
        assert [r.cluster for r in got if r.id < 9000] == want
        assert [r.cluster for r in got if r.id >= 9000] == [-1, -1]


def test_no_part_keeps_more_than_it_may(spark):
    """Also where most points are as good as one place, and a column is all equal."""
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(0, 1e-9, (3000, 5)), rng.uniform(0, 100, (1000, 5))])
    points[:, 2] = 7.0
    rows = spark.createDataFrame([(i, p, 1) for i, p in enumerate(np.unique(points, axis=0).tolist())], "p long, z array<double>, n long")
    for sample in (500, 2):
        dealt = neighbours.leaves(rows, 5, 0.5, 150, sample)
        assert dealt.where("own").groupBy("leaf").count().agg(F.max("count")).first()[0] <= 150
        assert dealt.where("own").count() == rows.count()


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, float(i // 5), 1.0) for i in range(20)], "id long, x double, y double").selectExpr("*", "7L AS _z", "'n' AS _number", "1.5D AS p", "2 AS z", "true AS cell", "3 AS n", "4 AS rep", "5 AS full", "6 AS leaf", "7 AS own", "8 AS _m_x", "9 AS _s_x")
    for cols in (["x"], ["x", "y"]):
        got = cluster.dbscan(df, "id", cols, 0.5, 3)
        assert got.columns == [*df.columns, "cluster"]
        assert Counter(tuple(r)[3:] for r in got.collect()) == {(7, "n", 1.5, 2, True, 3, 4, 5, 6, 7, 8, 9, c): 5 for c in range(4)}
    scaled = cluster.standardize(df, ["x"])
    assert scaled.columns == df.columns
    assert {r._m_x for r in scaled.collect()} == {8}


def test_components_by_rounds_and_in_one_task(spark, monkeypatch):
    from isospark.functions import graph

    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(0, 400)] + [(1000, k) for k in range(1001, 1200)] + [(rnd.randrange(2000, 2400), rnd.randrange(2000, 2400)) for _ in range(220)] + [(5, 5)]
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    want, seen = {}, set()
    for start in sorted(near):
        if start in seen or near[start] == {start}:
            continue
        todo, own = [start], {start}
        while todo:
            for x in near[todo.pop()] - own:
                own.add(x)
                todo.append(x)
        seen |= own
        want |= dict.fromkeys(own, start)
    table = spark.createDataFrame(links, "a long, b long")
    for solved in (50_000, 100):
        monkeypatch.setattr(graph, "SOLVED", solved)
        assert {r.node: r.component for r in graph.components(table).collect()} == want
    assert graph.components(table.limit(0)).count() == 0
