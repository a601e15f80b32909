import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from isospark.llm import packing, toxicity
from isospark.llm.common import table
from isospark.llm.shingles import shingle_hashes
from tests.llm.helpers import SCHEMA, edges


def plain_trim(rows, window=50):
    """Of (id, text), the words left: those that no window covers which a smaller id has too."""
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    owner = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            owner[key] = min(owner.get(key, d), d)
    for (d, t), (_, w) in zip(rows, words, strict=True):
        gone = {k for i in range(len(w) - window + 1) if owner[tuple(w[i : i + window])] < d for k in range(i, i + window)}
        yield d, " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t


def test_run_is_brute_force(spark, sf):
    """All but the model's weights anew: plain near copies, windows and the library's ids."""
    docs = table(spark, sf, "documents")
    weights, bias = toxicity.train_on(docs, table(spark, sf, "labels"))
    kept = [(r["doc_id"], r["text"]) for r in docs.collect()]
    margins = {t: sum(weights[f] for f in toxicity.Features(pa.array([t])).of(0)) + bias for _, t in kept}
    kept = [(d, t) for d, t in kept if 1 / (1 + math.exp(-margins[t])) < 0.3]
    sets = [set(zip(*[re.findall(r"[^\x20\x09-\x0D]+", t.lower())[k:] for k in range(5)], strict=False)) or {t.lower()} for _, t in kept]
    first = {}
    for i in range(len(kept)):
        near = [j for j in range(len(kept)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        first[i] = near
    component = list(range(len(kept)))
    for _ in range(len(kept)):
        after = [min(component[j] for j in first[i]) for i in range(len(kept))]
        if after == component:
            break
        component = after
    least = {}
    for i, c in enumerate(component):
        least[c] = min(least.get(c, kept[i]), kept[i])
    trimmed = dict(plain_trim(sorted(least.values())))
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    ids = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in trimmed.items()}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(ids)
    tokens = Counter()
    for r in rows:
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
        tokens[r["doc_id"]] += r["length"]
    assert all(tokens[d] == len(x) for d, x in ids.items())


def test_each_stage_keeps_columns_and_survives_edges(spark, sf):
    docs = edges(spark)
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, sf)
        assert out.count() > 0
        if name != "packing":
            assert out.schema.names == docs.schema.names  # clashing extra columns as well
            assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert function(spark, docs.limit(0), sf).count() == 0


def test_near_copies_have_recall(spark):
    """All pairs of different texts of sf0.1 with a five-word Jaccard likeness of 0.8 or more, by brute force over shingles that fewer than 200 texts have."""
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    texts = list(dict.fromkeys(r["text"] or "" for r in docs.select("text").collect()))
    sets = [set(shingle_hashes(t.encode()).tolist()) for t in texts]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for h in s:
            holders[h].append(i)
    shared = Counter(pair for own in holders.values() if 1 < len(own) < 200 for pair in combinations(own, 2))
    pairs = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    numbered = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    component = {r["doc_id"]: r["component"] for r in corpus_pipeline.near_copies(numbered).collect()}
    assert len(pairs) >= 40
    assert sum(component[a] == component[b] for a, b in pairs) >= 0.99 * len(pairs)
    groups = defaultdict(list)
    for i, c in component.items():
        groups[c].append(i)
    for own in groups.values():  # each one of a group is near another one, or all are blank
        assert all(any(i != j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in own) for i in own if len(own) > 1)


def test_each_group_of_near_copies_keeps_one_document(spark, sf):
    """Rows with one id and different texts are judged by their texts, not by the id, in whatever order they come."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(0, a), (1, a), (1, b), (1, b), (2, c), (2, c + " end"), (3, None), (2, a), (None, b), (4, ""), (1, c + " more")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in order], SCHEMA)
        got = sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect())
        assert got == sorted([(False, 0, a), (False, 1, b), (False, 1, c + " more"), (False, 3, None), (True, None, b)])


def test_clashing_names_and_rows_alike_in_id_and_text(spark, sf):
    """Columns with names that the stages use inside keep their values; of rows alike in id and text the first by the others stays."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a, "en", "z"), (1, a, "en", "s"), (2, b, "en", "s"), (3, a, "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "10L AS n_chars", "7L AS _key", "'k' AS _z", "1.5D AS _part", "'n' AS _n", "8 AS _row", "9L AS row", "'x' AS `key`", "true AS first", "6 AS node", "map(1, 2) AS m")
    got = sorted((r["doc_id"], r["source"], r["_key"], r["_z"], r["_part"], r["_n"], r["_row"], r["row"], r["key"], r["first"], r["node"], r["m"][1]) for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect())
    assert got == [(i, s, 7, "k", 1.5, "n", 8, 9, "x", True, 6, 2) for i, s in ((1, "s"), (2, "s"))]
    for function in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_repeats):
        kept = function(spark, docs, sf)
        assert kept.columns == docs.columns
        assert {(r["_key"], r["_z"], r["_part"], r["_n"], r["_row"], r["row"], r["key"]) for r in kept.collect()} == {(7, "k", 1.5, "n", 8, 9, "x")}
    assert sum(r["length"] for r in corpus_pipeline.pack(spark, docs, sf).collect()) > 0


def test_a_very_long_text_goes_through_each_stage(spark, sf):
    words = " ".join(f"w{i}" for i in range(40_000))
    docs = spark.createDataFrame([(1, words, "en", "s", len(words)), (2, words + " end", "en", "s", len(words) + 4), (3, "x" * 1_000_000, "en", "s", 1_000_000)], SCHEMA)
    assert {r[0] < 0.3 for r in docs.select(toxicity.scorer(spark, np.zeros(1 << toxicity.BITS), -3.0)("text")).collect()} == {True}
    for _, function in corpus_pipeline.STAGES[1:-1]:
        docs = function(spark, docs, sf)
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} == {1, 3}
    assert {r["doc_id"] for r in corpus_pipeline.pack(spark, docs, sf).select("doc_id").collect()} == {1, 3}
