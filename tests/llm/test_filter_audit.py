"""The filter audit against plain counting."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np

from isospark.llm import filter_audit
from isospark.llm.common import table
from tests.llm.helpers import edges, empty, rows_of

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain_audit(docs, labels):
    """Rows of COLUMNS from (doc_id, text, source) and (doc_id, quality, toxic), document by document."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    known = {}
    for i, q, t in labels:
        old = known.get(i, (0, 0))
        known[i] = (max(old[0], q or 0), max(old[1], t or 0))
    parts = defaultdict(list)
    for i, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        parts[source or ""].append(("".join(k for k, f in fails.items() if f), *(known.get(i, (0, 0)) if i is not None else (0, 0))))
    out = []
    for part, own in parts.items():
        rows, total = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                gone = [min((order.index(x) + 1 for x in fails), default=6) for fails, _, _ in own]
                here = [k for k, g in enumerate(gone) if g == step]
                total[f] += len(here)
                rows.append([part, order, step, sum(g > step for g in gone), len(here), sum(f in x[0] and g < step for x, g in zip(own, gone, strict=True)), sum(x[0] == f for x in own), sum(own[k][1] == 1 for k in here), sum(own[k][2] == 1 for k in here)])
        out += [(*r, total[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def check(docs, labels):
    got = sorted(tuple(r[c] for c in COLUMNS) for r in rows_of(filter_audit.audited(docs, labels)))
    want = plain_audit([(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()], [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()])
    assert got == want


def test_audit_of_the_table(spark, sf):
    check(table(spark, sf, "documents"), table(spark, sf, "labels"))


def test_audit_of_edges(spark):
    """Null and empty texts and sources, rows alike, one id with several texts, null ids, labels that repeat, are null or belong to nobody; long texts."""
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, None, 1), (9, 1, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality long, toxic long")
    docs = edges(spark).selectExpr("*", "1 AS part", "2 AS mask", "3 AS documents", "4 AS digest", "5 AS good", "6 AS toxic", "7 AS first")
    more = spark.createDataFrame([(1, "other", None), (1, "a b c", ""), (20, "A# " * 300, "t"), (21, "A# " * 300, None), (None, "A# " * 300, "t"), (22, " ".join(f"w{i}" for i in range(100_000)), "t")], "doc_id long, text string, source string")
    check(docs.unionByName(more, allowMissingColumns=True), labels)
    check(docs, labels.limit(0))
    assert filter_audit.audited(empty(spark), labels).count() == 0
    assert filter_audit.audited(empty(spark), labels).columns == COLUMNS


def test_one_text_that_very_many_rows_have(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 3 = 0, concat('own ', id), 'the same') AS text", "concat('s', id % 2) AS source")
    got = [r for r in rows_of(filter_audit.audited(docs, spark.createDataFrame([], "doc_id long, quality long, toxic long"))) if r["filter_order"] == "EABCD" and r["step"] == 1]
    assert {r["part"]: r["removed"] for r in got} == {"s0": 6666, "s1": 6666}  # ids 2 and 1 are the first of each source, and 1 of all


def test_removal_steps_are_min_plus():
    orders, steps = filter_audit.removal_steps(5)
    assert len(orders) == 120
    for mask in range(32):
        for k, order in enumerate(orders.tolist()):
            assert steps[mask, k] == next((i for i, f in enumerate(order) if mask >> f & 1), 5)
    weights = np.random.default_rng(0).integers(0, 9, (32, 3))
    found = filter_audit.audit(weights, orders, steps)
    assert (found["kept"][:, -1] == weights[0, 0]).all()
    assert (found["shapley"].sum(axis=1) == 120 * weights[1:, 0].sum()).all()


def test_sql_of_the_query(spark):
    from isospark.llm import queries
    from tests.llm.helpers import oracle_rows

    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op12_filter_audit"](spark, sf)
    columns, want = oracle_rows("op12_filter_audit", sf)
    assert sorted(got.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == want
