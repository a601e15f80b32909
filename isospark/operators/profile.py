"""Data-quality reports; each is one scan, but for exact quartiles, which take two."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isospark.functions.schemas import VALID_UPTAKE_UNITS

#: Size of a KLL sketch, the share of ranks that it may be off by (some three times what it is in 99 of 100), values of an interval that are counted one by one.
SKETCH, SKETCH_ERROR, KEEP = 4096, 0.003, 16_384
_BAD = {"neg_pressure": "pressure < 0", "neg_uptake": "adsorbed_amount < 0", "bad_temperature": "temperature <= 0"}


def flag_invalid(df: DataFrame) -> DataFrame:
    """`df` with a boolean for each kind of bad value; null where the value is."""
    return df.withColumns({name: F.expr(rule) for name, rule in _BAD.items()})


def measurement_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Counts and percentages of bad values in one row. The number of experiments is exact unless `approximate`."""
    distinct = F.approx_count_distinct("filename") if approximate else F.countDistinct("filename")
    counts = df.agg(F.count(F.lit(1)).alias("measurements"), distinct.alias("experiments"), *[F.count_if(F.expr(rule)).alias(name) for name, rule in _BAD.items()])
    share = lambda name: F.round(F.lit(100.0) * F.col(name) / F.nullif("measurements", F.lit(0)), 2).alias(f"{name}_pct")
    each = [x for name in _BAD for x in (F.col(name), share(name))]
    return counts.select("measurements", "experiments", F.expr("measurements div nullif(experiments, 0)").alias("avg_per_experiment"), *each)


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls): null or NaN values of each column."""
    bad = lambda f: F.col(f.name).isNull() | (F.isnan(f.name) if f.dataType.typeName() in ("float", "double") else F.lit(False))
    counts = df.agg(*[F.count_if(bad(f)).alias(f.name) for f in df.schema])
    return counts.unpivot([], df.columns, "column", "nulls")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def filter_valid_units(df: DataFrame, units: tuple[str, ...] = VALID_UPTAKE_UNITS) -> DataFrame:
    return df.where(F.col("adsorptionUnits").isin(*units))


def unit_report(df: DataFrame, units: tuple[str, ...] = VALID_UPTAKE_UNITS) -> DataFrame:
    """One row; `invalid_units_reported` is units present less valid ones known, which can be below the true number."""
    unit = F.col("adsorptionUnits")
    ok = F.coalesce(unit.isin(*units), F.lit(False))
    found = df.agg(F.countDistinct(unit).alias("units_present"), F.countDistinct(F.when(~ok, unit)).alias("invalid_units_present"), F.count_if(~ok).alias("rows_removed"), F.count_if(ok).alias("rows_kept"))
    return found.select(F.lit(len(units)).alias("valid_units"), "units_present", "invalid_units_present", (F.col("units_present") - len(units)).alias("invalid_units_reported"), "rows_removed", "rows_kept")


def class_distribution(df: DataFrame, col: str) -> DataFrame:
    """(Class, Counts), most frequent first, ties by value; nulls don't count."""
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("Class")).agg(F.count(F.lit(1)).alias("Counts")).orderBy(F.desc("Counts"), "Class")


def _sketched(rank: int, n: int, sketch: str, side: int) -> Column:
    """What a KLL sketch of n values has at `rank`, safely below (side -1) or above (side 1)."""
    share = min(1.0, max(0.0, (rank + side * (SKETCH_ERROR * n + 1)) / max(1, n)))
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))


def quantiles(df: DataFrame, cols: list[str], shares: tuple[float, ...] = (0.25, 0.5, 0.75), keep: int = KEEP) -> dict[str, list[float] | None]:
    """Exact quantiles of each column by linear interpolation; nulls don't count, NaN is largest. None for a column without values.

    A scan sketches all columns (KLL), and each wanted rank gets an interval that its value is
    in but for a tiny chance. The next scan counts what is below each interval, and the values
    in it: by value if there should be at most `keep`, else they are sketched again. An interval
    that turns out to miss its rank is opened on that side, so results are exact. Only sketches
    and the values of the intervals are shuffled.
    """
    number = {c: F.col(c).cast("double") for c in cols}
    rows = df.select(*[x.alias(f"v{i}") for i, x in enumerate(number.values())])
    each = [(F.count(f"v{i}"), F.count_if(F.isnan(f"v{i}")), F.kll_sketch_agg_double(F.when(~F.isnan(f"v{i}"), F.col(f"v{i}")), SKETCH)) for i in range(len(cols))]
    known = rows.agg(*[x.alias(f"{name}{i}") for i, three in enumerate(each) for name, x in zip("nms", three, strict=True)])
    sizes = known.select(*[f"{x}{i}" for i in range(len(cols)) for x in "nm"]).first()
    wanted: dict[tuple[int, int], list] = {}  # of a column and rank: least and most value, how many values these may hold
    for i in range(len(cols)):
        n, plain = sizes[f"n{i}"], sizes[f"n{i}"] - sizes[f"m{i}"]
        for share in shares if n else ():
            at = share * (n - 1)
            wanted |= {(i, r): [-math.inf, math.inf, plain] for r in (math.floor(at), math.ceil(at)) if r < plain}
    found: dict[tuple[int, int], float] = {}

    def narrowed(sketches: DataFrame, of: dict[tuple[int, int], tuple[str, int, int]]) -> None:
        """Intervals from sketches; `of` each its sketch, how many values that has, and the rank among them."""
        ends = [_sketched(rank, n, sketch, side).alias(f"x{k}_{side + 1}") for k, (sketch, n, rank) in enumerate(of.values()) for side in (-1, 1)]
        got = sketches.select(*ends).first() if ends else None
        for k, (key, (_, n, rank)) in enumerate(of.items()):
            low, high = wanted[key][:2]
            margin = SKETCH_ERROR * n + 1
            # beyond the ends of the sketch nothing is known but the interval itself
            wanted[key] = [got[f"x{k}_0"] if rank > margin else low, got[f"x{k}_2"] if rank + margin < n - 1 else high, int(3 * margin)]

    narrowed(known, {key: (f"s{key[0]}", sizes[f"n{key[0]}"] - sizes[f"m{key[0]}"], key[1]) for key in wanted})
    while len(found) < len(wanted):
        open_ = [key for key in wanted if key not in found]
        value = lambda key: F.col(f"v{key[0]}")
        low, high = (lambda key, k=k: F.lit(float(wanted[key][k])) for k in (0, 1))
        inside = lambda key: (value(key) > low(key)) & (value(key) < high(key))
        few = {j: key for j, key in enumerate(open_) if wanted[key][2] <= keep}
        many = {j: key for j, key in enumerate(open_) if j not in few}
        counts = [x.alias(f"{name}{j}") for j, key in enumerate(open_) for name, x in zip("blih", (F.count_if(value(key) < low(key)), F.count_if(value(key) == low(key)), F.count_if(inside(key)), F.count_if(value(key) == high(key))), strict=True)]
        scan = rows.agg(*counts, *[F.kll_sketch_agg_double(F.when(inside(key), value(key)), SKETCH).alias(f"s{j}") for j, key in many.items()])
        picked = F.filter(F.array(*[F.when(inside(key), F.struct(F.lit(j).alias("j"), value(key).alias("v"))) for j, key in few.items()]), lambda x: x.isNotNull()) if few else None
        # at most `keep` values of each interval, about
        values = rows.select(F.explode(picked).alias("x")).groupBy("x.j", "x.v").agg(F.count(F.lit(1)).alias("n")).collect() if few else []
        of_interval = defaultdict(list)
        for r in values:
            of_interval[r["j"]].append((r["v"], r["n"]))
        got = scan.select(*[f"{x}{j}" for j in range(len(open_)) for x in "blih"]).first()
        again = {}
        for j, key in enumerate(open_):
            below, at_low, between, at_high = (got[f"{x}{j}"] for x in "blih")
            rank = key[1] - below
            if rank < 0 or rank >= at_low + between + (at_high if wanted[key][0] < wanted[key][1] else 0):
                wanted[key][0 if rank < 0 else 1] = -math.inf if rank < 0 else math.inf
                wanted[key][2] = sizes[f"n{key[0]}"]
            elif rank < at_low:
                found[key] = wanted[key][0]
            elif rank >= at_low + between:
                found[key] = wanted[key][1]
            elif j in few:
                rank -= at_low
                for v, n in sorted(of_interval[j]):
                    if rank < n:
                        found[key] = v
                        break
                    rank -= n
            elif between <= keep:
                wanted[key][2] = between
            else:
                again[key] = (f"s{j}", between, rank - at_low)
        narrowed(scan, again)
    out: dict[str, list[float] | None] = {}
    for i, c in enumerate(cols):
        n = sizes[f"n{i}"]
        ends = [(share * (n - 1), *(found.get((i, f(share * (n - 1))), math.nan) for f in (math.floor, math.ceil))) for share in shares] if n else []
        out[c] = [a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b for at, a, b in ends] if n else None
    return out


def box_stats(df: DataFrame, cols: list[str], approximate: bool = False) -> DataFrame:
    """Quartiles, whiskers (the last values within 1.5 interquartile ranges) and number of outliers of each column; whiskers and outliers of all columns in one scan. A column without values has no row."""
    if approximate:
        row = df.agg(*[F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000).alias(f"q{i}") for i, c in enumerate(cols)]).first()
        edges = {c: row[f"q{i}"] and [float(x) for x in row[f"q{i}"]] for i, c in enumerate(cols)}
    else:
        edges = quantiles(df, cols)
    names = ("q1", "median", "q3", "whisker_low", "whisker_high", "outliers")

    def stats(c: str) -> Column:
        q = edges[c]
        step = (q[2] - q[0]) * 1.5
        inside = F.col(c).between(q[0] - step, q[2] + step)
        values = (*map(F.lit, map(float, q)), F.min(F.when(inside, F.col(c))), F.max(F.when(inside, F.col(c))), F.count_if(~inside))
        return F.struct(F.lit(c).alias("column"), *[x.alias(name) for x, name in zip(values, names, strict=True)])

    known = [c for c in cols if edges[c]]
    if not known:
        return df.sparkSession.createDataFrame([], "column string, q1 double, median double, q3 double, whisker_low double, whisker_high double, outliers long")
    found = df.agg(*[stats(c).alias(f"s{i}") for i, c in enumerate(known)])
    return found.select(F.inline(F.array(*[f"s{i}" for i in range(len(known))])))


def scatter_frame(df: DataFrame, x: str, y: str, bins: tuple[float, float] | None = None) -> DataFrame:
    """The two columns of a chart; with `bins` (widths), counts by cell, so that a chart needs few rows."""
    if bins is None:
        return df.select(x, y)
    return df.groupBy(F.floor(F.col(x) / bins[0]).alias("x_bin"), F.floor(F.col(y) / bins[1]).alias("y_bin")).agg(F.count(F.lit(1)).alias("n"))
