"""The registered queries and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isospark.functions.schemas import BINARY, GUEST_INDEX, GUEST_PROPERTIES, HOST_INDEX, NAMED, SINGLE
from isospark.functions.staging import new_path, stage
from isospark.operators import chunks, cluster, enriched, isotherms, materials, profile, units
from isospark.plans import adapter
from isospark.plans.adapter import table
from isospark.sources import ingest, sinks

def _single(spark: SparkSession, sf: str) -> DataFrame:
    return isotherms.single_component(adapter.experiments(spark, sf))


def _joined(df: DataFrame) -> DataFrame:
    return df.select(*[F.array_join(c, ",").alias(c) if c == "adsorbates_name" else c for c in df.columns])


def single_component(spark, sf):
    return _joined(_single(spark, sf))


def binary_mixture(spark, sf):
    return isotherms.binary_mixture(adapter.experiments(spark, sf))


def guest_cardinality(spark, sf):
    return isotherms.guest_cardinality(adapter.experiments(spark, sf))


def species_ids(spark, sf):
    df = isotherms.with_species(adapter.experiments(spark, sf))
    return df.select("filename", "adsorbent_id", "adsorbent_name", *[F.array_join(c, ",").alias(c) for c in ("adsorbates_id", "adsorbates_name")])


def index_head_fraction(spark, sf):
    """An index of the orders, written and read as a landed one in JSON lines; each order's place by its key is its ordinal."""
    path = new_path(spark)
    entries = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("order-"), "o_orderkey").alias("filename"))
    ingest.numbered(entries, "o_orderkey").select("ordinal", "filename").write.json(path)
    index = ingest.read_index_lines(spark, path, "filename STRING")
    return ingest.head_fraction(index, 0.1)


def detail_urls(spark, sf):
    return ingest.detail_urls(table(spark, sf, "orders").selectExpr("concat('order-', o_orderkey) AS filename"), "filename", "https://example.org/isotherm/%s.json")


def responses_parsed(spark, sf):
    parsed, _ = ingest.parse_responses(adapter.responses(spark, sf), "k STRING")
    return ingest.experiments_from_docs(parsed.select("doc")).groupBy("k").agg(F.count(F.lit(1)).alias("documents"))


def responses_rejected(spark, sf):
    return ingest.parse_responses(adapter.responses(spark, sf), "k STRING")[1].select("ordinal", "status", "content_type", "reason")


def host_names(spark, sf):
    return ingest.host_names(ingest.parse_responses(adapter.named_documents(spark, sf), NAMED)[0])


def guest_names(spark, sf):
    return ingest.guest_names(ingest.parse_responses(adapter.named_documents(spark, sf), NAMED)[0])


def guest_properties(spark, sf):
    return materials.enrich_guests(table(spark, sf, "part").select(F.upper("p_name").alias("name")), adapter.registry(spark, sf))


def csv_round_trip(spark, sf):
    path = new_path(spark)
    sinks.write_dataset(_single(spark, sf), path, "csv")
    return _joined(ingest.read_dataset_csv(spark, path, SINGLE))


def binary_round_trip(spark, sf):
    """Mixtures with their lists of total pressures, written and read; of each list its size and the point's own value."""
    path = new_path(spark)
    sinks.write_dataset(isotherms.binary_mixture(adapter.experiments(spark, sf), keep_total_pressure=True), path, "csv")
    back = ingest.read_dataset_csv(spark, path, BINARY)
    return back.withColumn("pressures", F.size("total_pressure")).withColumn("own_pressure", F.get("total_pressure", F.col("point_idx"))).drop("total_pressure")


def guest_properties_round_trip(spark, sf):
    path = new_path(spark)
    sinks.write_dataset(materials.enrich_guests(table(spark, sf, "part").select(F.upper("p_name").alias("name")), adapter.registry(spark, sf), "NA"), path, "csv")
    return ingest.read_dataset_csv(spark, path, GUEST_PROPERTIES)


def host_round_trip(spark, sf):
    path = new_path(spark)
    sinks.write_dataset(ingest.host_names(ingest.parse_responses(adapter.named_documents(spark, sf), NAMED)[0]).where("name is not null"), path, "csv")
    return ingest.read_dataset_csv(spark, path, NAMED)


def guest_host_index(spark, sf):
    """Indexes of parts as guests and of customers as hosts, landed as JSON lines; a fifth of each, with the addresses of their documents."""
    found = []
    for name, key, field, schema in (("part", "p_partkey", "InChIKey", GUEST_INDEX), ("customer", "c_custkey", "hashkey", HOST_INDEX)):
        path = new_path(spark)
        entries = table(spark, sf, name).select(key, F.concat(F.lit(f"{name}-"), key).alias(field))
        ingest.numbered(entries, key).select("ordinal", field).write.json(path)
        head = ingest.head_fraction(ingest.read_index_lines(spark, path, schema), 0.2)
        found.append(ingest.detail_urls(head, field, f"https://example.org/{name}/%s.json").withColumnRenamed(field, "key"))
    return found[0].unionByName(found[1])


def measurement_profile(spark, sf):
    return profile.measurement_profile(_single(spark, sf))


def null_counts(spark, sf):
    return profile.null_counts(isotherms.exploded_single(adapter.experiments(spark, sf)))


def distinct_units(spark, sf):
    return profile.distinct_values(_single(spark, sf), "adsorptionUnits")


def unit_report(spark, sf):
    return profile.unit_report(_single(spark, sf))


def valid_units(spark, sf):
    return profile.filter_valid_units(_single(spark, sf)).select("filename", "point_idx", "adsorptionUnits", "adsorbed_amount")


def invalid_measurements(spark, sf):
    return profile.flag_invalid(_single(spark, sf)).where("neg_pressure or neg_uptake or bad_temperature").select("filename", "point_idx", "neg_pressure", "neg_uptake", "bad_temperature")


def class_distribution_events(spark, sf):
    return profile.class_distribution(table(spark, sf, "events"), "event_type")


def class_distribution_langs(spark, sf):
    return profile.class_distribution(table(spark, sf, "documents"), "lang")


def box_stats(spark, sf):
    return profile.box_stats(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]).unionByName(profile.box_stats(table(spark, sf, "events"), ["value"]))


def scatter_frame(spark, sf):
    return profile.scatter_frame(table(spark, sf, "part"), "p_size", "p_retailprice")


def scatter_bins(spark, sf):
    return profile.scatter_frame(table(spark, sf, "part"), "p_size", "p_retailprice", (5.0, 100.0))


def standardize(spark, sf):
    scaled = cluster.standardize(adapter.user_features(spark, sf), ["n", "mean"])
    return scaled.select("user_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("n", "mean")])


def dbscan_labels(spark, sf):
    scaled = stage(cluster.standardize(adapter.user_features(spark, sf), ["n", "mean"]))
    return cluster.dbscan(scaled, "user_id", ["n", "mean"], 0.4, 4).select("user_id", "cluster")


def dbscan_summary(spark, sf):
    scaled = stage(cluster.standardize(adapter.user_features(spark, sf), ["n", "mean"]))
    return cluster.cluster_summary(cluster.dbscan(scaled, "user_id", ["n", "mean"], 0.75, 5)).select("cluster", "rows")


def cluster_shares(spark, sf):
    scaled = stage(cluster.standardize(adapter.user_features(spark, sf), ["n", "mean"]))
    return cluster.cluster_summary(cluster.dbscan(scaled, "user_id", ["n", "mean"], 0.4, 4))


def cluster_rows(spark, sf):
    """The rows of the first cluster."""
    scaled = stage(cluster.standardize(adapter.user_features(spark, sf), ["n", "mean"]))
    return cluster.cluster_rows(cluster.dbscan(scaled, "user_id", ["n", "mean"], 0.4, 4), 0).select("user_id", "cluster")


def description_prompts(spark, sf):
    return materials.description_prompts(table(spark, sf, "part").select(F.col("p_name").alias("name")))


def index_array(spark, sf):
    """The index of nations, landed as one JSON array; a short list, as indexes are."""
    path = new_path(spark)
    entries = table(spark, sf, "nation").agg(F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", F.concat(F.lit("nation-"), "n_nationkey").alias("filename"), "n_name")))).alias("value"))
    entries.write.text(path)
    return ingest.read_index(spark, path, "filename STRING, n_name STRING")


def chunked_collection(spark, sf):
    """The orders collected in chunks of 1,000, the second one landed again with half its entries; what is landed, by chunk and run."""
    path = new_path(spark)
    index = stage(chunks.with_chunk(ingest.numbered(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey"), 1000))
    chunks.write_chunks(index.withColumn("run", F.lit(1)), path)
    chunks.write_chunks(index.where("chunk = 1 and o_orderkey % 2 = 0").withColumn("run", F.lit(2)), path)
    return chunks.read_chunks(spark, path, 0, 4).groupBy("chunk", "run").agg(F.count(F.lit(1)).alias("entries"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


def chunk_profiles(spark, sf):
    """A profile put together from the kept profiles of chunks of 500 experiments; its distinct counts are estimates, held against the exact ones: within four standard errors."""
    path = new_path(spark)
    single = stage(_single(spark, sf))
    chunk = F.floor(F.substring_index("filename", "-", -1).cast("long") / 500)
    chunks.chunk_profiles(single.withColumn("chunk", chunk)).write.parquet(path)
    merged = chunks.merged_profile(spark.read.parquet(path))
    exact = single.agg(F.countDistinct("filename").alias("experiments"), F.countDistinct("adsorptionUnits").alias("units"))
    near = lambda c: (F.abs(F.col(f"m.{c}") - F.col(f"e.{c}")) <= 4 * 1.04 / 2 ** (chunks.LOG_SLOTS / 2) * F.col(f"e.{c}") + 1).alias(f"{c}_near")
    # one row each
    return merged.alias("m").join(F.broadcast(exact.alias("e"))).select("m.measurements", "e.experiments", "e.units", near("experiments"), near("units"), "neg_pressure", "neg_pressure_pct", "neg_uptake", "neg_uptake_pct", "bad_temperature", "bad_temperature_pct")


def _in_si(spark, sf):
    gases = adapter.gas_properties(spark, sf).select(F.lower("name").alias("gas"), "molecular_weight")
    single = _joined(_single(spark, sf))
    known = single.withColumn("gas", F.lower("adsorbates_name")).join(gases, "gas", "left")
    return units.in_pa_and_mol_per_kg(known, units.factor_table(spark), "molecular_weight")


def measurements_in_si(spark, sf):
    """Single-gas measurements in Pa and mol/kg; null where no path of factors leads there, or it takes a molar mass that isn't known."""
    return _in_si(spark, sf).select("filename", "point_idx", F.round("pressure_pa", 3).alias("pressure_pa"), F.round("uptake_mol_kg", 6).alias("uptake_mol_kg"))


def conversion_report(spark, sf):
    return units.conversion_report(_in_si(spark, sf))


def measurement_properties(spark, sf):
    """Properties of the gas beside each measurement, by tables bucketed by gas; gases with over 500 rows are dealt to several shares."""
    names, paths = tuple(f"isospark_{x}_{uuid.uuid4().hex}" for x in ("measurements", "gases")), (new_path(spark), new_path(spark))
    enriched.lay_out(_joined(_single(spark, sf)), adapter.gas_properties(spark, sf), "adsorbates_name", names, paths, buckets=8, share=500)
    return enriched.with_properties(spark, names).select("filename", "point_idx", "adsorbates_name", "molecular_weight", "molecular_formula")


def grouped_round_trip(spark, sf):
    """Measurements grouped by experiment in a bucketed table, and flat again."""
    single = stage(_joined(_single(spark, sf)))
    table_name = f"isospark_grouped_{uuid.uuid4().hex}"
    chunks.write_grouped(chunks.grouped_runs(single, run=2), table_name, new_path(spark), buckets=8)
    return chunks.flat_runs(spark.table(table_name), single.columns)


def csv_parts_round_trip(spark, sf):
    """The CSV round trip by files that are read in parts, with line ends in each second experiment's material name."""
    path = new_path(spark)
    named = _single(spark, sf).withColumn("adsorbent_name", F.when(F.col("point_idx") % 2 == 0, F.concat("adsorbent_name", F.lit('\n;"x"'))).otherwise(F.col("adsorbent_name")))
    sinks.write_dataset(named, path, "csv")
    return _joined(ingest.read_dataset_csv(spark, path, SINGLE, in_parts=True)).select("filename", "point_idx", "adsorbent_name", "pressure", "adsorbed_amount")


def responses_latest(spark, sf):
    """Of the events of a user as tries of one response, the last valid one."""
    found = ingest.latest_valid(adapter.responses(spark, sf), "k STRING")
    return found.select("key", "doc.k", "ordinal")


def dbscan_many_columns(spark, sf):
    """Clusters of users by five numbers."""
    cols = ["n", "mean", "low", "high", "kinds"]
    scaled = stage(cluster.standardize(adapter.wide_user_features(spark, sf), cols))
    return cluster.dbscan(scaled, "user_id", cols, 1.1, 4).select("user_id", "cluster")


_FUNCTIONS = (
    single_component, binary_mixture, guest_cardinality, species_ids, index_head_fraction, detail_urls, responses_parsed, responses_rejected, host_names, guest_names,
    guest_properties, csv_round_trip, binary_round_trip, guest_properties_round_trip, host_round_trip, guest_host_index, measurement_profile, null_counts, distinct_units, unit_report, valid_units, invalid_measurements, class_distribution_events,
    class_distribution_langs, box_stats, scatter_frame, scatter_bins, standardize, dbscan_labels, dbscan_summary, cluster_shares, cluster_rows, description_prompts,
    index_array, chunked_collection, chunk_profiles, measurements_in_si, conversion_report, measurement_properties, grouped_round_trip, csv_parts_round_trip, responses_latest, dbscan_many_columns,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_UNITS = "['" + "', '".join(adapter.UNITS) + "']"
_VALID = "('" + "', '".join(adapter.UNITS[:11]) + "')"
_ORDERS = f"""flags AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS g, min(l_returnflag) AS f1, max(l_returnflag) AS f2 FROM lineitem GROUP BY 1),
    experiments AS (SELECT o_orderkey, 'order-' || o_orderkey AS filename, (o_orderkey % 101)::DOUBLE - 1 AS temperature,
        CASE WHEN o_custkey % 2 = 0 THEN 'bar' ELSE 'Pa' END AS "pressureUnits", ({_UNITS})[(o_custkey % 13 + 1)::INT] AS "adsorptionUnits",
        coalesce(g, 0)::INT AS "numGuests", o_custkey::VARCHAR AS adsorbent_id, o_orderpriority AS adsorbent_name, f1, f2
        FROM orders LEFT JOIN flags ON l_orderkey = o_orderkey),
    points AS (SELECT e.*, (row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INT AS point_idx,
        l_extendedprice / 1000 - 5 AS p, l_quantity AS q, l_tax, l_discount AS d, l_linenumber AS ln FROM experiments e JOIN lineitem ON l_orderkey = o_orderkey)"""
_SINGLE = f"""{_ORDERS}, exploded AS (SELECT filename, temperature, "pressureUnits", "adsorptionUnits", "numGuests", adsorbent_name, 'gas ' || f1 AS adsorbates_name,
        point_idx, p::FLOAT AS pressure, CASE WHEN l_tax <> 0 THEN q END::FLOAT AS adsorbed_amount, 1.0::DOUBLE AS composition FROM points WHERE "numGuests" = 1),
    single AS (SELECT * FROM exploded WHERE adsorbed_amount IS NOT NULL)"""
_FEATURES = """f AS (SELECT user_id, count(*)::DOUBLE AS n, avg(value) AS mean FROM events GROUP BY 1),
    z AS (SELECT user_id, (n - (SELECT avg(n) FROM f)) / (SELECT stddev_pop(n) FROM f) AS x, (mean - (SELECT avg(mean) FROM f)) / (SELECT stddev_pop(mean) FROM f) AS y FROM f)"""


def _dbscan(eps: float, least: int) -> str:
    return f"""{_FEATURES}, near AS (SELECT a.user_id AS a, b.user_id AS b FROM z a, z b WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= {eps}::DOUBLE ** 2),
    core AS (SELECT a FROM near GROUP BY 1 HAVING count(*) >= {least}),
    linked AS (SELECT near.a, near.b FROM near JOIN core c ON c.a = near.a JOIN core d ON d.a = near.b),
    reach AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON l.a = r.b),
    roots AS (SELECT a, min(b) AS root FROM reach GROUP BY 1),
    numbered AS (SELECT a, dense_rank() OVER (ORDER BY root) - 1 AS k FROM roots),
    labels AS (SELECT user_id, coalesce((SELECT min(k) FROM near JOIN numbered ON numbered.a = near.b WHERE near.a = user_id), -1)::INT AS cluster FROM z)"""


_GASES = """masses AS (SELECT 'gas ' || x AS gas, first(p_retailprice ORDER BY p_partkey) AS mass, first(p_brand ORDER BY p_partkey) AS formula
        FROM (SELECT *, substr('anxy', (p_partkey % 4 + 1)::INT, 1) AS x FROM part) GROUP BY x)"""
_SI = f"""{_SINGLE}, {_GASES}, si AS (SELECT single.*, pressure::DOUBLE * CASE "pressureUnits" WHEN 'bar' THEN 1e5 WHEN 'Pa' THEN 1 END AS pressure_pa, adsorbed_amount::DOUBLE *
        CASE WHEN "adsorptionUnits" IN ('mmol/g', 'mol/kg') THEN 1.0 WHEN "adsorptionUnits" = 'mol/g' THEN 1000.0 WHEN "adsorptionUnits" = 'mmol/kg' THEN 0.001 WHEN "adsorptionUnits" IN ('cm3(STP)/g', 'ml(STP)/g') THEN 1 / 22.414::DOUBLE
             WHEN "adsorptionUnits" = 'mg/g' THEN 1 / mass WHEN "adsorptionUnits" = 'g/g' THEN 1000 / mass WHEN "adsorptionUnits" IN ('wt%', 'g/100g', 'g Adsorbate / 100g Adsorbent') THEN 10 / mass END AS uptake_mol_kg
        FROM single LEFT JOIN masses ON gas = lower(adsorbates_name))"""


def _clusters(features: str, columns: str, eps: float, least: int) -> str:
    """DBSCAN of `features` (user_id and columns), standardized."""
    names = columns.split()
    scaled = ", ".join(f"({c} - (SELECT avg({c}) FROM f)) / (SELECT coalesce(nullif(stddev_pop({c}), 0), 1) FROM f) AS {c}" for c in names)
    apart = " + ".join(f"(a.{c} - b.{c}) ** 2" for c in names)
    return f"""WITH RECURSIVE f AS ({features}), z AS (SELECT user_id, {scaled} FROM f), near AS (SELECT a.user_id AS a, b.user_id AS b FROM z a, z b WHERE {apart} <= {eps}::DOUBLE ** 2),
    core AS (SELECT a FROM near GROUP BY 1 HAVING count(*) >= {least}), linked AS (SELECT near.a, near.b FROM near JOIN core c ON c.a = near.a JOIN core d ON d.a = near.b),
    reach AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON l.a = r.b), roots AS (SELECT a, min(b) AS root FROM reach GROUP BY 1),
    numbered AS (SELECT a, dense_rank() OVER (ORDER BY root) - 1 AS k FROM roots)
    SELECT user_id, coalesce((SELECT min(k) FROM near JOIN numbered ON numbered.a = near.b WHERE near.a = user_id), -1)::INT AS cluster FROM z"""


def _box(name: str, source: str) -> str:
    return f"""SELECT '{name}' AS "column", q1, median, q3, min(v) FILTER (ok) AS whisker_low, max(v) FILTER (ok) AS whisker_high, count(*) FILTER (NOT ok) AS outliers
    FROM (SELECT {name} AS v, q[1] AS q1, q[2] AS median, q[3] AS q3, {name} BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1]) AS ok
          FROM {source}, (SELECT quantile_cont({name}, [0.25, 0.5, 0.75]) AS q FROM {source})) GROUP BY q1, median, q3"""


_JSON = "status = 200 AND content_type LIKE 'application/json%'"
_RESPONSES = """r AS (SELECT event_id AS ordinal, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END::INT AS status,
    CASE WHEN event_id % 10 = 5 THEN 'text/html' ELSE 'application/json; charset=utf-8' END AS content_type, CASE WHEN event_id % 10 = 0 THEN substr(props, 1, 4) ELSE props END AS body FROM events)"""
_PROPERTIES = """WITH best AS (SELECT * FROM part WHERE p_name NOT LIKE '% ring' QUALIFY row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) = 1)
        SELECT upper(p.p_name) AS name, b.p_brand AS atoms, b.p_size AS heavy_atoms, b.p_type AS bonds, b.p_name AS elements, b.p_retailprice AS molecular_weight, b.p_brand AS molecular_formula,
        b.p_type AS "SMILE", b.p_size AS "H_acceptors", b.p_size AS "H_donors" FROM part p LEFT JOIN best b ON lower(p.p_name) = lower(b.p_name)"""
_MIXED = """SELECT filename, temperature, "pressureUnits", "adsorptionUnits", "numGuests", adsorbent_name, 'gas ' || f1 AS compound_1, 'gas ' || f2 AS compound_2, point_idx,
        (1 - d)::FLOAT AS compound_1_composition, CASE WHEN ln % 5 = 0 THEN 1.0 ELSE d + 0.0 END::FLOAT AS compound_2_composition, ((1 - d) * p)::FLOAT AS compound_1_pressure,
        (CASE WHEN ln % 5 = 0 THEN 1.0 ELSE d + 0.0 END * p)::FLOAT AS compound_2_pressure, (q * (1 - d))::FLOAT AS compound_1_adsorption,
        CASE WHEN ln % 5 = 0 THEN 1.0 ELSE q * d + 0.0 END::FLOAT AS compound_2_adsorption, ln % 5 = 0 AS compound_2_filled"""
SQL = {
    "single_component": f"WITH {_SINGLE} SELECT * FROM single",
    "csv_round_trip": f"WITH {_SINGLE} SELECT * FROM single",
    "binary_mixture": f"""WITH {_ORDERS} {_MIXED} FROM points WHERE "numGuests" = 2""",
    "binary_round_trip": f"""WITH {_ORDERS} {_MIXED}, count(*) OVER (PARTITION BY filename)::INT AS pressures, p::DOUBLE AS own_pressure FROM points WHERE "numGuests" = 2""",
    "guest_cardinality": f'WITH {_ORDERS} SELECT "numGuests", count(*) AS experiments FROM experiments GROUP BY 1',
    "species_ids": f"""WITH {_ORDERS} SELECT filename, any_value(adsorbent_id) AS adsorbent_id, any_value(adsorbent_name) AS adsorbent_name,
        coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), '') AS adsorbates_id, coalesce(string_agg(DISTINCT 'gas ' || l_returnflag, ',' ORDER BY 'gas ' || l_returnflag), '') AS adsorbates_name
        FROM experiments LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY filename""",
    "index_head_fraction": """SELECT ordinal, filename FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal, 'order-' || o_orderkey AS filename FROM orders)
        WHERE ordinal < ceil(0.1::DOUBLE * (SELECT count(*) FROM orders))""",
    "detail_urls": "SELECT 'order-' || o_orderkey AS filename, 'https://example.org/isotherm/order-' || o_orderkey || '.json' AS url FROM orders",
    "responses_parsed": f"WITH {_RESPONSES} SELECT k, count(*) AS documents FROM (SELECT json_extract_string(body, '$.k') AS k FROM r WHERE {_JSON} AND json_valid(body)) GROUP BY 1",
    "responses_rejected": f"""WITH {_RESPONSES} SELECT ordinal, status, content_type, CASE WHEN status <> 200 THEN 'status' WHEN content_type NOT LIKE 'application/json%' THEN 'content_type' ELSE 'body' END AS reason
        FROM r WHERE NOT ({_JSON} AND json_valid(body))""",
    "host_names": "SELECT CASE WHEN s_suppkey % 7 <> 0 THEN s_name END AS name FROM supplier",
    "guest_names": "SELECT CASE WHEN s_suppkey % 7 <> 0 THEN s_name ELSE '' END AS name FROM supplier",
    "guest_properties": _PROPERTIES,
    "guest_properties_round_trip": _PROPERTIES,
    "host_round_trip": "SELECT s_name AS name FROM supplier WHERE s_suppkey % 7 <> 0",
    "guest_host_index": """SELECT ordinal, key, 'https://example.org/part/' || key || '.json' AS url FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ordinal, 'part-' || p_partkey AS key FROM part)
        WHERE ordinal < ceil(0.2::DOUBLE * (SELECT count(*) FROM part))
        UNION ALL SELECT ordinal, key, 'https://example.org/customer/' || key || '.json' AS url FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS ordinal, 'customer-' || c_custkey AS key FROM customer)
        WHERE ordinal < ceil(0.2::DOUBLE * (SELECT count(*) FROM customer))""",
    "measurement_profile": f"""WITH {_SINGLE}, c AS (SELECT count(*) AS n, count(DISTINCT filename) AS e, count(*) FILTER (pressure < 0) AS a, count(*) FILTER (adsorbed_amount < 0) AS b, count(*) FILTER (temperature <= 0) AS t FROM single)
        SELECT n AS measurements, e AS experiments, n // nullif(e, 0) AS avg_per_experiment, a AS neg_pressure, round(100.0::DOUBLE * a / nullif(n, 0), 2) AS neg_pressure_pct,
        b AS neg_uptake, round(100.0::DOUBLE * b / nullif(n, 0), 2) AS neg_uptake_pct, t AS bad_temperature, round(100.0::DOUBLE * t / nullif(n, 0), 2) AS bad_temperature_pct FROM c""",
    "null_counts": f"WITH {_SINGLE} "
    + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) - count("{c}") AS nulls FROM exploded""" for c in ("filename", "temperature", "pressureUnits", "adsorptionUnits", "numGuests", "adsorbent_name", "adsorbates_name", "point_idx", "pressure", "adsorbed_amount", "composition")),
    "distinct_units": f'WITH {_SINGLE} SELECT DISTINCT "adsorptionUnits" FROM single',
    "unit_report": f"""WITH {_SINGLE} SELECT 11::INT AS valid_units, count(DISTINCT "adsorptionUnits") AS units_present, count(DISTINCT "adsorptionUnits") FILTER ("adsorptionUnits" NOT IN {_VALID}) AS invalid_units_present,
        count(DISTINCT "adsorptionUnits") - 11 AS invalid_units_reported, count(*) FILTER ("adsorptionUnits" NOT IN {_VALID}) AS rows_removed, count(*) FILTER ("adsorptionUnits" IN {_VALID}) AS rows_kept FROM single""",
    "valid_units": f'WITH {_SINGLE} SELECT filename, point_idx, "adsorptionUnits", adsorbed_amount FROM single WHERE "adsorptionUnits" IN {_VALID}',
    "invalid_measurements": f"""WITH {_SINGLE} SELECT filename, point_idx, pressure < 0 AS neg_pressure, adsorbed_amount < 0 AS neg_uptake, temperature <= 0 AS bad_temperature FROM single
        WHERE pressure < 0 OR adsorbed_amount < 0 OR temperature <= 0""",
    "class_distribution_events": 'SELECT event_type AS "Class", count(*) AS "Counts" FROM events GROUP BY 1',
    "class_distribution_langs": 'SELECT lang AS "Class", count(*) AS "Counts" FROM documents GROUP BY 1',
    "box_stats": " UNION ALL ".join((_box("l_quantity", "lineitem"), _box("l_extendedprice", "lineitem"), _box("value", "events"))),
    "scatter_frame": "SELECT p_size, p_retailprice FROM part",
    "scatter_bins": "SELECT floor(p_size / 5.0::DOUBLE)::BIGINT AS x_bin, floor(p_retailprice / 100.0::DOUBLE)::BIGINT AS y_bin, count(*) AS n FROM part GROUP BY 1, 2",
    "standardize": f"WITH {_FEATURES} SELECT user_id, round(x, 6) + 0.0 AS n, round(y, 6) + 0.0 AS mean FROM z",
    "dbscan_labels": f"WITH RECURSIVE {_dbscan(0.4, 4)} SELECT user_id, cluster FROM labels",
    "dbscan_summary": f"WITH RECURSIVE {_dbscan(0.75, 5)} SELECT cluster, count(*) AS rows FROM labels GROUP BY 1",
    "cluster_shares": f"WITH RECURSIVE {_dbscan(0.4, 4)} SELECT cluster, count(*) AS rows, round(count(*)::DOUBLE / (SELECT count(*) FROM labels), 6) AS share FROM labels GROUP BY 1",
    "cluster_rows": f"WITH RECURSIVE {_dbscan(0.4, 4)} SELECT user_id, cluster FROM labels WHERE cluster = 0",
    "description_prompts": "SELECT DISTINCT p_name AS name, 'Provide a brief description of ' || p_name || '.' AS prompt FROM part",
    "index_array": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ordinal, 'nation-' || n_nationkey AS filename, n_name FROM nation",
    "chunked_collection": """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders), landed AS (SELECT ordinal // 1000 AS chunk, ordinal, CASE WHEN ordinal // 1000 = 1 THEN 2 ELSE 1 END AS run FROM o
        WHERE ordinal // 1000 <> 1 OR o_orderkey % 2 = 0) SELECT chunk, run, count(*) AS entries, min(ordinal) AS first, max(ordinal) AS last FROM landed WHERE chunk <= 4 GROUP BY chunk, run""",
    "chunk_profiles": f"""WITH {_SINGLE}, c AS (SELECT count(*) AS n, count(DISTINCT filename) AS e, count(DISTINCT "adsorptionUnits") AS u, count(*) FILTER (pressure < 0) AS a, count(*) FILTER (adsorbed_amount < 0) AS b, count(*) FILTER (temperature <= 0) AS t FROM single)
        SELECT n AS measurements, e AS experiments, u AS units, true AS experiments_near, true AS units_near, a AS neg_pressure, round(100.0::DOUBLE * a / nullif(n, 0), 2) AS neg_pressure_pct,
        b AS neg_uptake, round(100.0::DOUBLE * b / nullif(n, 0), 2) AS neg_uptake_pct, t AS bad_temperature, round(100.0::DOUBLE * t / nullif(n, 0), 2) AS bad_temperature_pct FROM c""",
    "measurements_in_si": f"WITH {_SI} SELECT filename, point_idx, round(pressure_pa, 3) AS pressure_pa, round(uptake_mol_kg, 6) AS uptake_mol_kg FROM si",
    "conversion_report": f"""WITH {_SI} SELECT "pressureUnits", "adsorptionUnits", count(*) AS measurements, count(*) FILTER (pressure_pa IS NULL) AS without_pressure, count(*) FILTER (uptake_mol_kg IS NULL) AS without_uptake FROM si GROUP BY ALL""",
    "measurement_properties": f"WITH {_SINGLE}, {_GASES} SELECT filename, point_idx, adsorbates_name, mass AS molecular_weight, formula AS molecular_formula FROM single LEFT JOIN masses ON gas = lower(adsorbates_name)",
    "grouped_round_trip": f"WITH {_SINGLE} SELECT * FROM single",
    "csv_parts_round_trip": f"""WITH {_SINGLE} SELECT filename, point_idx, CASE WHEN point_idx % 2 = 0 THEN adsorbent_name || chr(10) || ';"x"' ELSE adsorbent_name END AS adsorbent_name, pressure, adsorbed_amount FROM single""",
    "responses_latest": f"""WITH {_RESPONSES} SELECT user_id::VARCHAR AS key, arg_max(json_extract_string(body, '$.k'), ordinal) AS k, max(ordinal) AS ordinal FROM r JOIN events ON event_id = ordinal WHERE {_JSON} AND json_valid(body) GROUP BY 1""",
    "dbscan_many_columns": _clusters("SELECT user_id, count(*)::DOUBLE AS n, avg(value) AS mean, min(value) AS low, max(value) AS high, count(DISTINCT event_type)::DOUBLE AS kinds FROM events GROUP BY 1", "n mean low high kinds", 1.1, 4),
}
