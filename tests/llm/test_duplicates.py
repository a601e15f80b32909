import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash

from isospark.functions import graph
from isospark.functions.graph import components
from isospark.llm import minhash, simhash, substrings
from isospark.llm.shingles import shingle_hashes
from tests.llm.helpers import documents, edges, empty, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def check_simhash(df):
    rows = rows_of(df.select("doc_id", "text"))
    fps = [plain_fingerprint(r["text"]) for r in rows]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    group = plain_components(range(len(rows)), pairs)
    least = {}
    for i, g in group.items():
        if (d := rows[i]["doc_id"]) is not None:
            least[g] = min(least.get(g, d), d)
    want = Counter((r["doc_id"], f"{fps[i]:016x}", least.get(group[i])) for i, r in enumerate(rows))
    assert Counter(tuple(r) for r in simhash.near_duplicates(df).collect()) == want


def test_simhash_is_brute_force(spark, sf):
    check_simhash(documents(spark, sf))


def test_simhash_edges(spark):
    check_simhash(edges(spark))
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_bit_planes_and_tiles(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (5, 40), dtype=np.uint64)) for _ in range(4)]))
    wanted = {(i, j) for i, a in enumerate(fps.tolist()) for j, b in enumerate(fps.tolist()) if (a ^ b).bit_count() <= 4}
    limits = simhash.exact_limits()
    q, f = simhash.BitPlanes(fps[:, None]).within(fps[:, None], limits)
    assert set(zip(q.tolist(), f.tolist(), strict=True)) == wanted
    table = spark.createDataFrame([(int(x), [int(x)]) for x in fps.view(np.int64)], "node long, fp array<long>")
    signed = fps.view(np.int64).tolist()
    want = plain_components(signed, [(signed[i], signed[j]) for i, j in wanted])
    for tile in (2048, 3):
        got = {r["node"]: r["component"] for r in components(simhash.links(table, simhash.block_masks(len(fps)), limits, tile)).collect()}
        assert {n: got.get(n, n) for n in signed} == want


@pytest.mark.parametrize("n", [10, 1 << 22, 1 << 30])
def test_masks_cover_all_small_differences(n):
    masks, rnd = simhash.block_masks(n), random.Random(3)
    for _ in range(2000):
        difference = sum(1 << b for b in rnd.sample(range(64), 4))
        assert any(not m & difference for m, in masks)


@pytest.mark.parametrize("few", [0, 10_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (95, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def check_substrings(df, window=50):
    rows = [(r["doc_id"], WORD.findall(r["text"] or "")) for r in rows_of(df.select("doc_id", "text"))]
    owner = {}
    for d, w in rows:
        for i in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[i : i + window])
                owner[key] = min(owner.get(key, d), d)
    want = Counter()
    for d, w in rows:
        gone = {k for i in range(len(w) - window + 1) if d is not None and owner[tuple(w[i : i + window])] < d for k in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in substrings.digests(df, window).collect()) == want


def test_substrings_are_brute_force(spark, sf):
    check_substrings(documents(spark, sf))


def test_substrings_edges(spark):
    check_substrings(edges(spark))
    assert substrings.digests(empty(spark)).count() == 0


def test_shared_passages_at_all_offsets(spark):
    rnd = random.Random(5)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for d in range(40):
        words = [f"{d}_{i}" for i in range(rnd.randrange(90))]
        a, n = rnd.randrange(21), rnd.choice([49, 50, 51])
        at = rnd.randrange(len(words) + 1)
        rows.append((d // 2 * 2 if d % 7 == 0 else d, " ".join(words[:at] + passage[a : a + n] + words[at:])))
    check_substrings(spark.createDataFrame(rows, "doc_id long, text string"))


def test_without_repeats_keeps_rows_and_columns(spark):
    df = edges(spark)
    got = substrings.without_repeats(df)
    assert got.columns == df.columns and got.count() == df.count()
    texts = {(r["doc_id"], r["text"]) for r in rows_of(got)}
    assert (11, "") in texts and (5, None) in texts and (12, "a  b \n\n c" + " " * 9) in texts


def test_minhash_rows(spark, sf):
    for df in (documents(spark, sf), edges(spark)):
        order = sorted(rows_of(df.selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(text) AS k")), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["k"]))
        want = Counter()
        for r, after in zip(order, order[1:] + order[:1], strict=True):
            n = len(r["text"])
            new = r["text"][: n - n // 3] + after["text"][: n // 3]
            own, other, nxt = (minhash.signature(shingle_hashes(t.encode())) for t in (r["text"], new, after["text"]))
            want[r["doc_id"], n, hashlib.sha256(new.encode()).hexdigest(), minhash.written(own), minhash.written(other), float((own == other).mean()), float((own == nxt).mean())] += 1
        assert Counter(tuple(r) for r in minhash.compared_to_next(df).collect()) == want
    assert minhash.compared_to_next(empty(spark)).count() == 0


def plain_signature(text):
    """MinHash with whole numbers, one shingle and one permutation at a time."""
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    words = word.findall(bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in (text or "").encode()))
    own = {w: int(pd.util.hash_array(np.array([w.decode()], object), categorize=False)[0]) for w in set(words)}
    mod = 1 << 64
    runs = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    hashes = []
    for run in runs:
        h = 0
        for w in run:
            h = (h * 0x9E3779B97F4A7C15 + own[w]) % mod
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % mod
        hashes.append(h ^ h >> 27)
    slots = [min(((a * h + b) % mod >> 32 for h in hashes), default=0xFFFFFFFF) & 0xFFFF for a, b in zip(minhash._A.tolist(), minhash._B.tolist(), strict=True)]
    return "".join(f"{x:04x}" for x in slots)


def test_minhash_is_the_plain_one(spark, sf):
    for df in (documents(spark, sf).limit(40), edges(spark)):
        texts = {(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()}
        want = Counter((d, plain_signature(t)) for d, t in texts)
        assert Counter(tuple(r) for r in minhash.fingerprints(df.select("doc_id", "text").distinct()).collect()) == want


def test_minhash_estimates_jaccard():
    rnd = random.Random(2)
    for share in (0.2, 0.5, 0.8):
        a = [f"w{rnd.random()}" for _ in range(2000)]
        b = a[: int(2000 * share)] + [f"v{rnd.random()}" for _ in range(2000 - int(2000 * share))]
        x, y = (shingle_hashes(" ".join(t).encode()) for t in (a, b))
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs(minhash.likeness(minhash.signature(x), minhash.signature(y)) - true) < 0.2


def test_minhash_near_duplicates(spark):
    base = [f"word{i}" for i in range(200)]
    rows = [(10, " ".join(base)), (11, " ".join(base[:100] + ["new"] + base[101:])), (12, " ".join(base)), (3, "else entirely and so on"), (4, None), (5, "")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {10: 10, 11: 10, 12: 10, 3: 3, 4: 4, 5: 4}
    assert minhash.near_duplicates(empty(spark)).count() == 0


def chains(rnd):
    """Texts in a chain, each near the next ones only, beside texts that share bands but are not near, copies and texts without words."""
    words = [f"w{i}" for i in range(460)]
    texts = [" ".join(words[4 * i : 4 * i + 160]) for i in range(60)] + [" ".join(words[:100] + [f"x{k}_{j}" for j in range(40)]) for k in range(12)] + [None, "", " "]
    base = [f"b{i}" for i in range(300)]
    texts += [" ".join(w if rnd.random() > 0.01 else f"e{k}_{i}" for i, w in enumerate(base)) for k in range(60)]
    return texts, rnd.sample(range(100, 1000), len(texts))


def plain_near(texts, ids, candidate=lambda i, j: True):
    sets = [set(shingle_hashes((t or "").encode()).tolist()) for t in texts]
    near = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    return plain_components(ids, [(ids[i], ids[j]) for i in range(len(ids)) for j in range(i) if near(i, j) and candidate(i, j)])


@pytest.mark.parametrize("tile", [1024, 7])
def test_minhash_links_past_the_smallest(spark, tile):
    texts, ids = chains(random.Random(5))
    sigs = [minhash.signature(shingle_hashes((t or "").encode())).reshape(minhash.BANDS, -1) for t in texts]
    want = plain_near(texts, ids, lambda i, j: (sigs[i] == sigs[j]).all(axis=1).any())
    frame = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame, tile=tile).collect()}
    assert got == want
    assert len(set(want.values())) < len(ids) - 60


@pytest.mark.parametrize("tile", [1024, 7])
def test_simhash_by_likeness_links_past_the_smallest(spark, tile):
    texts, ids = chains(random.Random(6))
    want = plain_near([t or "" for t in texts], ids)
    frame = spark.createDataFrame(list(zip(ids, texts, strict=True)), "node long, text string")
    got = {r["node"]: r["component"] for r in simhash.near_texts(frame, tile=tile).collect()}
    assert got == want
    assert simhash.near_texts(frame.limit(0)).count() == 0


def test_likeness_finds_what_the_threshold_has():
    """Pairs of sets of likeness 0.8, or just above, of all sizes: they share a band, and their fingerprints stay within the limits."""
    rng, limits = np.random.default_rng(0), simhash.likeness_limits(0.8)
    for size in (10, 40, 300):
        found = 0
        for _ in range(400):
            union = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            both = int(np.ceil(0.8 * size))
            cut = both + (size - both) // 2
            one, other = union[:cut], np.concatenate([union[:both], union[cut:]])
            steps = np.cumsum(np.unpackbits((simhash.wide_fingerprint(one) ^ simhash.wide_fingerprint(other)).view(np.uint8), bitorder="little"))
            found += all(steps[p - 1] <= r for p, r in limits.items()) and (minhash.band_words(one) == minhash.band_words(other)).any()
        assert found >= 0.98 * 400


def test_very_long_texts_and_clashing_columns(spark):
    """A text of 3 MB with and one without white space, beside a near copy."""
    words = [f"w{i}" for i in range(450_000)]
    rows = [(3, " ".join(words)), (2, " ".join(words[:-5])), (1, "x" * 3_000_000), (0, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS fp", "3 AS mark", "4 AS key", "5 AS component", "6 AS id")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()} == {3: 2, 2: 2, 1: 1, 0: 0}
    check_simhash(df)
    removed = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.digests(df).collect()}
    assert removed == {3: (450_000, 449_995), 2: (449_995, 0), 1: (1, 0), 0: (1, 0)}
    assert {r["doc_id"]: r["n_chars"] for r in minhash.compared_to_next(df).collect()} == {i: len(t) for i, t in rows}
