import math
import random
import re
from collections import Counter
from dataclasses import replace
from re import _parser

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isospark.llm import ann, licenses, toxicity
from isospark.llm.common import table
from tests.llm.helpers import documents, edges, empty, rows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = rows_of(toxicity.toxicity(docs, labels).join(labels, "doc_id"))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    hits = sum(r["predicted"] for r in held if r["toxic"])
    assert hits >= 0.8 * sum(r["toxic"] for r in held)
    assert sum(r["predicted"] for r in held if not r["toxic"]) <= 0.03 * len(held)


def test_toxicity_never_learns_held_out_labels(spark, sf):
    docs, labels = documents(spark, sf), table(spark, sf, "labels")
    flipped = labels.withColumn("toxic", (toxicity.held_out().cast("int") + labels.toxic) % 2)
    a, b = (toxicity.train_on(docs, x) for x in (labels, flipped))
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (9, None), (None, 1), (10, 0)], "doc_id long, toxic int")
    rows = rows_of(toxicity.toxicity(edges(spark), labels))
    assert len(rows) == edges(spark).count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity(empty(spark), labels).count() == 0
    assert {r["score"] for r in rows_of(toxicity.toxicity(edges(spark), labels.limit(0)))} == {0.5}


def scalar_ftrl(rows, start, bias):
    """One coordinate at a time, as McMahan et al. (2013) write it."""
    size = len(start)
    w0, l1 = [*start, bias], [toxicity.L1] * size + [0.0]
    z = [-(w * (toxicity.BETA / toxicity.ALPHA + toxicity.L2)) - math.copysign(k, w) * (w != 0) for w, k in zip(w0, l1, strict=True)]
    n = [0.0] * (size + 1)

    def weight(i):
        if abs(z[i]) <= l1[i]:
            return 0.0
        return -(z[i] - math.copysign(l1[i], z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for features, label in rows:
        at = [*features, size]
        w = {i: weight(i) for i in at}
        p = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values())))))
        for i in at:
            g = p - label
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
            z[i] += g - sigma * w[i]
            n[i] += g * g
    return [weight(i) for i in range(size)], weight(size)


def test_ftrl_is_the_scalar_one():
    rng = np.random.default_rng(3)
    start = rng.normal(size=60) * (rng.random(60) < 0.3)
    rows = [(np.unique(rng.integers(0, 60, 8)), float(rng.random() < 0.4)) for _ in range(500)]
    w, b = toxicity.ftrl(rows, start, -0.7)
    want, bias = scalar_ftrl([(f.tolist(), y) for f, y in rows], start.tolist(), -0.7)
    assert np.allclose(w, want, rtol=0, atol=1e-12) and abs(b - bias) < 1e-12
    assert 0 < np.count_nonzero(w) < 60


def test_features_are_words_runs_and_skips():
    one, other = (set(toxicity.Features(pa.array([t])).of(0).tolist()) for t in ("The cat, sat", "THE cat sat"))
    assert one == other and len(one) == 3 + 2 + 1
    assert set(toxicity.Features(pa.array(["the x sat"])).of(0).tolist()) & one >= set(toxicity.Features(pa.array(["the"])).of(0).tolist())
    assert len(set(toxicity.Features(pa.array(["the x sat"])).of(0).tolist()) & one) == 3  # the, sat and the skip over what is between


def test_toxicity_with_a_hot_text(spark):
    """Half of the labelled rows are one text: shares stay bounded, and both labels of it count."""
    rows = [(i, "the same line" if i % 2 else f"text number {i} {'awful vile' if i % 10 == 0 else 'kind'}") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(8000)], "doc_id long, toxic int")
    sample = toxicity.sampled(docs.join(labels, "doc_id").select("text", F.col("toxic").cast("double").alias("label")), 0.25, 4)
    sizes = Counter(r["share"] for r in sample.select("share").collect())
    assert len(sizes) == 4 and max(sizes.values()) < 1.3 * 500
    scored = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels, most_rows=2000, per_share=500).collect()}
    assert all(s > 0.5 for i, s in scored.items() if i % 10 == 0) and all(s < 0.3 for i, s in scored.items() if i % 2)


def test_toxicity_sample_is_bounded_with_copies(spark):
    rows = [("the same text", 1.0)] * 1000 + [(f"text {i}", float(i % 2)) for i in range(2000)]
    sample = rows_of(toxicity.sampled(spark.createDataFrame(rows, "text string, label double"), 0.1, 4))
    assert 250 <= len(sample) <= 350 and sum(r["text"] == "the same text" for r in sample) in (100, 101)
    assert max(Counter(r["share"] for r in sample).values()) <= 110
    whole = rows_of(toxicity.sampled(spark.createDataFrame(rows, "text string, label double"), 1.0, 4))
    assert Counter((r["text"], r["label"]) for r in whole) == Counter(rows) and len({(r["h"], r["label"], r["i"]) for r in whole}) == len(rows)
    nulls = spark.createDataFrame([(None, 1.0), (None, 1.0), ("", 0.0)], "text string, label double")
    assert toxicity.sampled(nulls, 1.0, 1).count() == 3


def brute(rows, k, every):
    out = {}
    for q, v in rows.items():
        if q % every == 0:
            out[q] = sorted(((-float(np.dot(v, w)), i) for i, w in rows.items() if i != q))[:k]
    return out


def test_neighbours_have_recall(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    want = brute(rows, 20, 20)
    got = Counter()
    for r in rows_of(ann.search(df)):
        assert abs(r["score"] - float(np.dot(rows[r["query_id"]], rows[r["vec_id"]]))) < 1e-9
        got[r["query_id"]] += r["vec_id"] in {i for _, i in want[r["query_id"]]}
    assert sum(got.values()) / (20 * len(want)) >= 0.9


def vectors(kind, n, rng):
    v = rng.standard_normal((n, 64))
    if kind == "clustered":
        v = rng.standard_normal((200, 64))[rng.integers(0, 200, n)] + 0.35 * v
    return v / np.linalg.norm(v, axis=1)[:, None]


@pytest.mark.parametrize(("kind", "n"), [("random", 20_000), ("clustered", 20_000), ("clustered", 100_000)])
def test_neighbours_have_recall_where_lists_are_skipped(spark, kind, n):
    """Random unit vectors are the hardest for lists; in clusters, few lists are probed."""
    v = vectors(kind, n, np.random.default_rng(1))
    asked = np.arange(0, len(v), 20)
    scores = v[asked] @ v.T
    scores[np.arange(len(asked)), asked] = -np.inf
    want = dict(zip(asked.tolist(), map(set, np.argpartition(-scores, 20, axis=1)[:, :20].tolist()), strict=True))
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": v.tolist()}))
    rows = ann.search(frame).collect()
    assert len(rows) == 20 * len(want)
    assert sum(r["vec_id"] in want[r["query_id"]] for r in rows) / len(rows) >= 0.9
    if kind == "clustered":
        middles = ann.centres(v[:20_000], n // ann.PER_LIST)
        assert ann.needed_probes(v[:20_000], middles, 20) < len(middles) / 4


def test_all_lists_are_exact(spark):
    v = vectors("random", 6000, np.random.default_rng(2))
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": v.tolist()}))
    rows = {}
    for r in ann.search(frame, recall=1.0).collect():
        rows.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    found = sum(i in {x for _, x in own} for q, own in brute(dict(enumerate(v)), 20, 20).items() for i in rows[q].values())
    assert found >= 0.995 * 20 * len(rows)


def sent(spark):
    """Rows that this session's stages have written for shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (stages.apply(i) for i in range(stages.size()))}


def test_a_query_is_sent_once_to_a_shard_of_lists(spark, monkeypatch):
    """With a row for each list it probes, a batch of queries outgrew its Python worker."""
    monkeypatch.setattr(ann, "PER_LIST", 4)
    v = vectors("random", 4000, np.random.default_rng(3))
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": v.tolist()}))
    before = sent(spark)
    rows = ann.search(frame, recall=1.0).collect()
    assert len(rows) == 20 * 200
    after = sent(spark)
    assert max(n for key, n in after.items() if key not in before) <= 20_000  # some 10 shards: at most 2,000 queries sent, 4,000 candidates, 21 results for each; 200,000 pairs of query and list
    want = brute(dict(enumerate(v)), 20, 20)
    assert all(r["vec_id"] == want[r["query_id"]][r["rank"] - 1][1] for r in rows)


@pytest.mark.parametrize("lists", [4, 40])
def test_neighbours_with_ties_in_cut_lists(spark, monkeypatch, lists):
    """Few different scores, copies, lists cut into several shards and tiles: all as brute force says."""
    monkeypatch.setattr(ann, "PER_LIST", 900 // lists)
    monkeypatch.setattr(ann, "BLOCK", 100)
    rng = np.random.default_rng(4)
    v = rng.integers(-2, 3, (1500, 5))
    v = {i: x for i, x in enumerate(v.astype(float)) if x.any()}
    ids = rng.permutation(len(v)).tolist()
    v = dict(zip(ids, v.values(), strict=True))
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(frame, recall=1.0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (-r["score"], r["vec_id"])
    assert {q: [own[i] for i in range(1, 21)] for q, own in got.items()} == brute(v, 20, 20)


def test_shards_hold_each_list_once():
    v = vectors("clustered", 3000, np.random.default_rng(5))
    middles = ann.centres(v, 60)
    counts = {**dict.fromkeys(range(58), 30), 3: 1000, 9: 400}
    shards = ann.shards_of(counts, middles, 200)
    assert {x: n for x, _, n in shards} == {**dict.fromkeys(range(58), 1), 3: 5, 9: 2}
    at = np.array([(first + i, x) for x, first, n in shards for i in range(n)])
    assert sorted(set(at[:, 0].tolist())) == list(range(at[-1, 0] + 1)) and (np.diff(at[:, 0]) >= 0).all()
    sizes = Counter()
    for x, first, n in shards:
        sizes.update({first + i: counts[x] / n for i in range(n)})
    assert max(sizes.values()) <= 200
    starts = np.flatnonzero(np.diff(at[:, 0], prepend=-1))
    for probes in (8, 60):
        least, first, later = ann.asked_shards(v[:50], middles, probes, at[:, 1], starts)
        for q, edge, a, b in zip(v[:50], least, first, later, strict=True):
            near = np.argsort(-(middles[:58] @ q))[:probes]
            assert sorted([*a, *b]) == sorted(set(at[np.isin(at[:, 1], near), 0].tolist()))
            assert len(a) == math.ceil(math.sqrt(len(a) + len(b))) and (middles[near] @ q >= edge - 1e-9).all()


def test_neighbours_edges(spark):
    v = [1.0, 2.0, 0.5]
    data = [(i, v) for i in range(60)] + [(60, [1.0, 2.0, 0.4]), (61, None), (62, [0.0, 0.0, 0.0]), (63, [1.0, None, 1.0]), (64, [1.0, float("nan"), 1.0]), (65, [float("inf"), 1.0, 1.0]), (66, [1.0]), (67, []), (None, v), (40, v), (41, [0.1, 0.1, 0.1])]
    rows = rows_of(ann.search(spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 AS q", "2 AS list")))
    for q in (0, 20, 40):
        mine = [r["vec_id"] for r in sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])]
        assert mine == [i for i in range(22) if i != q][:20]
    assert all(r["vec_id"] != 41 or r["score"] < 1 for r in rows)  # of two vectors of one id, the smaller one
    assert {r["query_id"] for r in rows} == {0, 20, 40, 60}
    few = spark.createDataFrame([(0, v), (1, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(few).collect()] == [(0, 1, 1, 1.0)]
    assert ann.search(few.limit(0)).count() == 0


def test_license_base(spark, sf):
    for df in (documents(spark, sf), edges(spark)):
        want = Counter()
        for r in rows_of(df.select("doc_id", "text")):
            words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or ""))
            places = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
            at = [p for p, _ in places]
            want[r["doc_id"], len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in places}))] += 1
        rows = rows_of(licenses.license_labels(df))
        assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows) == want
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)
    assert licenses.license_labels(empty(spark)).count() == 0


def test_license_rules():
    scan = licenses.Scanner().scan
    labels = lambda text: {m[2] for m in scan(text.encode())[2]}
    assert len(licenses.RULES) > 150
    assert labels("GNU Lesser General Public License") == {"lgpl"}
    assert labels("the GNU General Public License, version 3") == {"gpl-3"}
    assert labels("Creative Commons Attribution-NonCommercial-ShareAlike 4.0") == {"cc-by-nc-sa"}
    assert labels("SPDX-License-Identifier: BSD-3-Clause") == {"bsd-3-clause"}
    assert labels("a permit for limited nothing") == set()
    assert scan("é under the MIT license".encode())[1] == [(1, "mit")]


def example(tree, rnd):
    """A text that a parsed pattern matches."""
    out = ""
    for kind, value in tree:
        name = str(kind)
        if name == "LITERAL":
            out += chr(value)
        elif name == "IN":
            which, at = rnd.choice(value)
            out += chr(at if str(which) == "LITERAL" else rnd.randint(*at))
        elif name == "MAX_REPEAT":
            out += "".join(example(value[2], rnd) for _ in range(rnd.randint(value[0], min(int(value[1]), value[0] + 2))))
        elif name == "BRANCH":
            out += example(rnd.choice(value[1]), rnd)
        else:
            assert name == "SUBPATTERN"
            out += example(value[-1], rnd)
    return out


def brute_labels(text):
    """All rules on all places, no gate; of two detections, one within the other, the vague one goes, else the shorter, else the later rule's."""
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    line = " " + " ".join(words) + " "
    found = [(m.start(), m.end(), -r.priority, r.label) for r in licenses.RULES for m in re.compile(r.pattern.pattern, re.ASCII).finditer(line)]
    kept = []
    for begin, end, _, label in sorted(found, key=lambda d: (d[3] in licenses.VAGUE, d[0] - d[1], d[2], d[0])):
        holds = lambda k: begin <= k[0] and k[1] <= end and k[2] not in licenses.VAGUE  # noqa: B023, E731
        if not any(k[0] <= begin and end <= k[1] or label in licenses.VAGUE and holds(k) for k in kept):
            kept.append((begin, end, label))
    return {label for _, _, label in kept}


def test_license_labels_are_brute_force(spark, sf):
    """On documents, on an example of each rule, and on many examples in one text."""
    rnd = random.Random(9)
    examples = [example(_parser.parse(p), rnd) for _, _, patterns in licenses.SIGNATURES for p in patterns]
    texts = examples + [" and ".join(rnd.sample(examples, 12)) for _ in range(60)] + ["word " * 200 + e + " tail" * 300 + " " + e for e in rnd.sample(examples, 20)]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df in (documents(spark, sf).select("doc_id", "text"), edges(spark).select("doc_id", "text"), made):
        rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        base = {t: {label for phrase, label in licenses.BASE if f" {phrase} " in " " + " ".join(WORD.findall(t.lower() if t.isascii() else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))) + " "} for _, t in rows}
        want = Counter((d, ",".join(sorted(base[t] | brute_labels(t)))) for d, t in rows)
        assert Counter((r["doc_id"], r["labels"]) for r in licenses.license_labels(df).select("doc_id", "labels").collect()) == want


def test_license_rules_are_hundreds_and_reachable():
    assert len(licenses.RULES) >= 300
    assert all(max(map(len, r.gates)) >= 3 for r in licenses.RULES)
    scan, rnd = licenses.Scanner().scan, random.Random(1)
    for label, _, patterns in licenses.SIGNATURES:
        for p in patterns:
            assert any(label == m[2] for _ in range(20) for m in scan(example(_parser.parse(p), rnd).encode())[2]) or label in licenses.VAGUE, (label, p)


def test_license_long_text():
    text = "x" * 3_000_000 + " released under the " + "y" * 1000 + " license " + "word " * 300_000 + "gplv3"
    n, base, marks = licenses.Scanner().scan(text.encode())
    assert n == 300_007 and not base and marks[-1][2] == "gpl-3"


def test_license_gate_loses_no_match():
    gated, ungated = licenses.Scanner(), licenses.Scanner([replace(r, gates=(" ",)) for r in licenses.RULES])
    rnd = random.Random(4)
    for _, _, patterns in licenses.SIGNATURES:
        for p in patterns:
            for _ in range(20):
                text = example(_parser.parse(p), rnd)
                assert re.fullmatch(p, text)
                found = gated.scan(f"See: {text}.".encode())
                assert found[2] and found == ungated.scan(f"See: {text}.".encode())
    labels = lambda text: {m[2] for m in gated.scan(text.encode())[2]}
    wanted = {
        "GPLv2": "gpl-2", "gplv3": "gpl-3", "gpl3": "gpl-3", "AGPLv3": "agpl-3", "creativecommons.org/licenses/by-sa/4.0": "cc-by-sa", "FreeBSD license": "bsd-2-clause", "MS-PL": "ms-pl",
        "SSPL-1.0": "sspl-1", "BUSL-1.1": "busl-1.1", "GFDL-1.3": "gfdl-1.3", "GNU FDL": "gfdl", "PSF license": "python-2", "Internet Systems Consortium license": "isc", "see the licence": "unknown",
    }
    for text, label in wanted.items():
        assert labels(f"licensed under {text} here") - {"unknown"} == {label} - {"unknown"} and labels(text) == {label}
