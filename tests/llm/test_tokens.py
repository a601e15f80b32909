import base64
import hashlib
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers as vocabularies
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from isospark.llm import bpe, common, packing, sharding, token_counts
from isospark.llm.queries import op6_byte_bpe
from tests.llm.helpers import documents, edges, empty, rows_of

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabularies.path(bpe.VOCABULARY), "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=RANKS, special_tokens={})
COUNTS = Tokenizer.from_file(vocabularies.path(token_counts.VOCABULARY))
WORDS = Tokenizer.from_file(vocabularies.path(packing.VOCABULARY))
TREE, MERGER, IDS = bpe.TreeBpe(RANKS), token_counts.RankMerger(vocabularies.path(token_counts.VOCABULARY)), packing.WordIds(vocabularies.path(packing.VOCABULARY))
ANY = st.one_of(st.text(max_size=60), st.text("aAb .,'sé中\n\t \x01\x1c12<|endoftext|>", max_size=80), st.builds(lambda a, n: a * n, st.sampled_from(["a", "ab", "the", "<|endoftext|>", "00"]), st.integers(0, 300)))


@settings(max_examples=400, deadline=None)
@given(st.lists(ANY, max_size=6))
def test_tokenizers_agree_with_their_libraries(texts):
    column = pa.array(texts, pa.string())
    encoded = TREE.encode_batch(column).to_pylist()
    assert encoded == [LIBRARY.encode_ordinary(t) for t in texts]
    assert TREE.decode_batch(pa.array(encoded, pa.list_(pa.int32()))).to_pylist() == [t.encode() for t in texts]
    assert MERGER.count_texts(column).tolist() == [len(COUNTS.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [np.frombuffer(i, np.int32).tolist() for i in IDS.encode(column)] == [WORDS.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_token_is_what_its_bytes_merge_to():
    assert all(TREE.reached[token] for token in RANKS)


def test_tree_on_long_matches():
    for text in ("a" * 20_001, "ab" * 7000, "xyz" * 3000 + "a" * 999):
        assert TREE.encode(text) == np.array(LIBRARY.encode_ordinary(text), np.int32).tobytes()


def test_words_go_up_the_tree(spark, sf):
    """Of the matches that are no tokens, all over a leaf's size are joined from halves; the plain rule sees windows only."""
    tree = bpe.TreeBpe(RANKS)
    joins, merged = [], []
    join, merge = tree.join, tree.merge
    tree.join = lambda a, b: (joins.append(1), join(a, b))[1]
    tree.merge = lambda data: (merged.append(len(data)), merge(data))[1]
    words = {m for r in documents(spark, sf).select("text").collect() for m in bpe.PATTERN.findall(r["text"])}
    long = [w.encode() for w in words if w.encode() not in RANKS and len(w.encode()) > bpe.LEAF_BYTES]
    assert len(long) > 5000
    assert all(tree.reduce(w) == merge(w) for w in long)
    assert len(joins) >= len(long)
    assert sum(merged) / len(merged) < 10


def test_decoding_goes_up_the_tree():
    ids = np.array(LIBRARY.encode_ordinary("of many words, " * 50_000), np.int32)
    assert len(ids) > 2 * bpe.LEAF_IDS
    assert TREE.decode(ids) == b"of many words, " * 50_000


def test_new_words_go_to_the_library_in_rows():
    """Also letters of Latin-1 in all pairs, words beside chunks that aren't one word, and a vocabulary without a suffix of word ends."""
    letters = [chr(c) for c in range(0x41, 0x180) if chr(c).isalpha()]
    texts = [" ".join(a + b for b in letters) for a in letters]
    texts += ["don't İa ªb e\u0301a ﬁn 12 a1b --- ½ straße ÉA A\u0301 Ŀl 中文 " + "xy" * 40]
    for rows in (True, False):
        ids, given = packing.WordIds(vocabularies.path(packing.VOCABULARY)), []
        ids.last &= rows
        library = ids._library
        ids._library = lambda part, f=library, n=given: (n.append(len(part)), f(part))[1]
        want = [WORDS.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(i, np.int32).tolist() for i in ids.encode(pa.array(texts))] == want
        if rows:
            small = str.maketrans({c: c.lower() for c in map(chr, range(0x41, 0x5B))})
            chunks = {t.translate(small) for text in texts for t in text.split()}
            words = {c for c in chunks if ids.WORD.fullmatch(c)}
            assert len(words) > 4_000
            assert sum(given) < len(chunks) - len(words) + len(words) / 50


def test_long_texts_are_whole():
    """Several MB, with and without white space."""
    rnd = np.random.default_rng(1)
    letters = "".join(np.array(list("abcdefghij0123456789+/"))[rnd.integers(0, 22, 3_000_000)])
    for text in (letters, " ".join(letters[i : i + 9] for i in range(0, 2_000_000, 9))):
        column = pa.array([text, "a b", text[:100_000]])
        assert [np.frombuffer(i, np.int32).tolist() for i in IDS.encode(column)] == [WORDS.encode(t, add_special_tokens=False).ids for t in column.to_pylist()]
        assert MERGER.count_texts(column).tolist() == [len(COUNTS.encode(t, add_special_tokens=False).ids) for t in column.to_pylist()]
        ids = TREE.encode_batch(column)
        assert ids.to_pylist()[2] == LIBRARY.encode_ordinary(text[:100_000])
        assert TREE.decode_batch(ids).to_pylist() == [t.encode() for t in column.to_pylist()]


MEMORY = """
import base64, os, resource, sys
import public_tokenizers, pyarrow as pa
from isospark.llm import packing, token_counts
made = token_counts.RankMerger(public_tokenizers.path(token_counts.VOCABULARY)).count_texts if sys.argv[1] == "counts" else packing.WordIds(public_tokenizers.path(packing.VOCABULARY)).encode
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1e3
made(pa.array(["warm up"]))
before = peak()
made(pa.array([base64.b64encode(os.urandom(24_000_000)).decode()]))
print(peak() - before)
"""


@pytest.mark.parametrize("what", ["counts", "ids"])
def test_memory_is_bounded(what):
    """32 MB of base64 in one text without white space."""
    done = subprocess.run([sys.executable, "-c", MEMORY, what], capture_output=True, text=True, check=True, timeout=300, cwd=str(Path(__file__).resolve().parents[2]))
    assert float(done.stdout.split()[-1]) < 600


def test_bpe_query(spark, sf):
    want = Counter()
    for r in rows_of(documents(spark, sf).select("doc_id", "text")):
        ids = LIBRARY.encode_ordinary(r["text"])
        want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in op6_byte_bpe(spark, sf).collect()) == want


def test_bpe_edges(spark):
    df = edges(spark)
    got = bpe.decode(bpe.encode(df)).collect()
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in got) == Counter((r["doc_id"], (r["text"] or "").encode()) for r in df.collect())
    assert bpe.decode(bpe.encode(empty(spark))).count() == 0


def test_token_counts(spark, sf):
    for df in (documents(spark, sf), edges(spark)):
        want = Counter()
        for r in rows_of(df.select("doc_id", "text")):
            text = r["text"] or ""
            n = len(COUNTS.encode(text, add_special_tokens=False).ids)
            want[r["doc_id"], len(text.encode()), n, n > 512] += 1
        assert Counter(tuple(r) for r in token_counts.token_counts(df).collect()) == want
    assert token_counts.token_counts(empty(spark)).count() == 0


def check_packing(df, capacity):
    rows = rows_of(packing.packed_documents(df, capacity))
    ids = [(r["doc_id"], [*WORDS.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in df.select("doc_id", "text").collect()]
    texts, copies = {}, Counter()
    for d, x in ids:
        texts.setdefault((d, len(x)), []).append(np.array(x, "<u4"))
        copies[d, len(x)] += 1
    covered = {k: np.zeros(k[1], int) for k in copies}
    for r in rows:
        k, span = (r["doc_id"], r["doc_tokens"]), slice(r["start"], r["start"] + r["length"])
        assert r["length"] > 0 and any(zlib.crc32(x[span].tobytes()) == r["ids_crc32"] for x in texts[k])
        covered[k][span] += 1
    assert all((covered[k] == n).all() for k, n in copies.items())
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"], r["padded_length"]))
    used = 0
    for spans in places.values():
        at = 0
        for offset, length, _ in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity and {p for _, _, p in spans} == {at if at & (at - 1) == 0 else capacity}
        used += at
    assert sorted(places) == list(range(len(places)))
    assert len(places) <= -(-used // int(capacity * 0.985)) + 1


def test_packing(spark, sf):
    check_packing(documents(spark, sf), 4096)
    check_packing(edges(spark), 64)
    check_packing(spark.createDataFrame([(i, "word " * 32) for i in range(200)], "doc_id long, text string"), 64)
    assert packing.packed_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("lengths", [{100: 100_000}, {7: 10**6}, {2049: 1000}, {1366: 999}, {4096: 5}, 60, 150, 300, 3000])
def test_packing_plan_has_little_padding(lengths):
    if isinstance(lengths, int):
        drawn = np.random.default_rng(0).lognormal(np.log(lengths), 1, 300_000).astype(int).clip(1, 4096)
        lengths = dict(Counter(drawn.tolist()))
    rows = packing.placements(packing.plan_patterns(lengths, 4096), 4096)
    used = Counter()
    for length, first, last, *_ in rows:
        assert first == used[length]
        used[length] = last + 1
    assert used == Counter(lengths)
    whole = max((base + (last - first) // each for _, first, last, each, base, _, stream, _ in rows if stream < 0), default=-1) + 1
    loose = sum(n * (last - first + 1) for n, first, last, _, _, _, stream, _ in rows if stream >= 0)
    assert sum(n * k for n, k in lengths.items()) >= 0.99 * 4096 * (whole + -(-loose // 4096) - 1)
    assert len(rows) < 20_000


def test_ranks_of_a_hot_row_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(common, "RUN", 10)
    df = spark.createDataFrame([(1, "a")] * 95 + [(1, "b")] * 2 + [(1, None)], "g int, x string")
    rows = common.ranked(df, ["g"], 4).collect()
    assert Counter((r["g"], r["x"]) for r in rows) == {(1, "a"): 95, (1, "b"): 2, (1, None): 1}
    assert sorted(r["rank"] for r in rows) == list(range(98))


def test_sharding(spark, sf):
    for df in (documents(spark, sf), edges(spark), edges(spark).union(edges(spark))):
        rows = rows_of(sharding.assign_shards(df))
        want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots.get(s, [])) for s in range(24)]
        assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(24))
    assert sharding.assign_shards(empty(spark)).count() == 0


def test_a_new_shard_moves_few_rows():
    before, after = sharding.ring(24, 1 << 14), sharding.ring(25, 1 << 14)
    moved = [(a, b) for a, b in zip(before, after, strict=True) if a != b]
    assert all(b == 24 for _, b in moved) and len(moved) < 0.06 * (1 << 14)
    counts = {c: 7 + c % 5 for c in range(1 << 14)}
    plans = [{(c, f + i): s for c, f, e, s, _ in sharding.bounded_plan(counts, n, 1 << 14) for i in range(e - f + 1)} for n in (24, 25)]
    assert sum(plans[0][k] != plans[1][k] for k in plans[0]) < 0.15 * len(plans[0])
