"""Small tables and brute-force versions."""

from isospark.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Null, empty, blank, short, repeated and tied rows; `row` and `id` clash with names that operators use inside.
EDGES = [
    (5, None), (4, ""), (3, " \n\t "), (2, "one"), (1, "a b c"), (1, "a b c"), (9, "a b c"), (None, "lost words here"), (None, None),
    (7, "x" * 5000), (8, "été 中文 😀 naïve"), (6, "under the mit license " * 40), (10, " ".join(f"w{i}" for i in range(120))), (11, " ".join(f"w{i}" for i in range(30, 100))),
    (12, "a  b \n\n c" + " " * 9), (13, "<|endoftext|> and <|startoftext|>x"),
]


def edges(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in EDGES]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "'k' AS key", "2 AS row", "3 AS fp")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf):
    return table(spark, sf, "documents")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def oracle_rows(name, sf):
    """(columns, sorted rows) of a registered query's SQL in DuckDB."""
    import duckdb

    from isospark.llm import queries

    con = duckdb.connect()
    for t in "documents labels conversations embeddings pages benchmark".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    found = con.sql(queries.SQL[name])
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    return [found.columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=str)
