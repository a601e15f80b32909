"""The prefix trie against a plain one, and double arrays against dictionaries."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from isospark.llm import prefix_trie
from isospark.llm.common import table
from tests.llm.helpers import rows_of

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    """The nodes of (conv_id, turn, role, text), by the definition; turns of one number don't occur."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        built[c] = [*own.get(base, [])[:h], *turns[h:]]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in children[node])
    for node, own_members in members.items():
        ends = sorted(c for c in own_members if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own_members), len(node), parent, len(own_members), len(children[node]), leaves[node], saved[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS conv", "1 AS pos", "2 AS part", "3 AS d1", "4 AS n", "5 AS e1", "6 AS words")
    got = [tuple(r.values()) for r in rows_of(prefix_trie.prefix_trie(frame, **options))]
    assert sorted(got, key=str) == plain_trie(rows)


def talks(seed, convs=90):
    rng, rows = random.Random(seed), []
    pool = [("user", f"u{i} " * (i % 4)) for i in range(5)] + [("assistant", f"a{i} b c\n d") for i in range(4)] + [(None, None), ("", ""), ("system", "be good")]
    for c in range(convs):
        if rng.random() < 0.1 and c % 20:
            continue
        if c % 20 == 0 and rng.random() < 0.4:
            continue  # no beginning to take
        turns = [rng.choice(pool) for _ in range(rng.choice([1, 1, 2, 3, 5, 9]))] if rng.random() < 0.6 else [("user", "hello there"), ("assistant", "hi"), *[pool[k % 5] for k in range(c % 7)]]
        rows += [(c, None if k == 0 and rng.random() < 0.2 else k * 3 - 4, *t) for k, t in enumerate(turns)]
    rows += [(-7, 1, "user", "below zero"), (-20, 1, "user", "hello there"), (-20, 2, "assistant", "hi"), (None, 1, "user", "nobody's"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("band", "shard"), [(4096, 4096), (4096, 6), (2, 3), (1, 5)])
def test_trie_is_the_plain_one(spark, band, shard):
    """Whole in one shard, in shards by more and more turns, and in bands of few turns."""
    check(spark, talks(band + shard), band=band, shard=shard)


def test_copies_and_very_long_conversations(spark):
    """Many equal conversations, two that are alike for 300 turns, one beginning that all have."""
    rows = [(c, t, "user", f"same {t}") for c in range(1000, 1400) for t in range(4)]
    rows += [(c, t, "user", f"long {t}" if t < 300 or c == 2001 else "else") for c in (2001, 2002, 2003) for t in range(c - 1600)]
    rows += [(c, t, "user", "first" if t == 0 else f"{c} {t}") for c in range(3000, 3060) for t in range(3)]
    rows += [(4000, 1, "user", "word " * 60_000)]
    check(spark, rows, band=64, shard=40)


def test_turnless_conversations_and_empty_tables(spark):
    turnless = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    check(spark, [(turnless, 1, "user", "mine goes")])
    check(spark, [(turnless, 1, "user", "mine goes"), (40, 1, "user", "own")])
    nobody = spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)
    assert prefix_trie.prefix_trie(nobody).count() == prefix_trie.prefix_trie(nobody.limit(0)).count() == 0
    assert prefix_trie.prefix_trie(nobody.limit(0)).columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_rows_alike_and_turns_of_one_number(spark):
    """They stay each for itself, in an order of their own that doesn't depend on the rows'."""
    rows = [(20, 1, "user", "a"), (20, 1, "user", "a"), (20, 1, "user", "b"), (40, 1, "user", "b"), (40, 1, "user", "a"), (40, 1, "user", "a")]
    for some in (rows, rows[::-1]):
        got = rows_of(prefix_trie.prefix_trie(spark.createDataFrame(some, SCHEMA)))
        assert sorted((r["depth"], r["n_convs"]) for r in got) == [(0, 2), (1, 2), (2, 2), (3, 2)]


def test_ranges_that_split_a_conversation(spark):
    """A conversation with most of the rows is cut by the ranges, and its turns still count up."""
    rows = [(5, t, "user", f"t{t}") for t in range(3000)] + [(c, 0, "user", "x") for c in range(6, 40)]
    placed = prefix_trie.placed_turns(spark.createDataFrame(rows, SCHEMA).repartition(8))
    got = sorted((r["conv"], r["pos"]) for r in rows_of(placed))
    assert got == sorted([(5, t + 1) for t in range(3000)] + [(c, 1) for c in range(6, 40)])


def test_double_array_is_a_trie():
    rng = random.Random(3)
    for _ in range(30):
        roots = rng.randint(1, 4)
        rows = list({(rng.randrange(roots), tuple(rng.randint(1, rng.choice([3, 40])) for _ in range(rng.randint(1, 6)))) for _ in range(rng.randint(1, 80))})
        rows.sort()
        array, states = prefix_trie.forest(np.array([r for r, _ in rows]), np.array([c for _, x in rows for c in x]), np.array([len(x) for _, x in rows]))
        seen, at = {}, 0
        for root, codes in rows:
            now = root
            for d, c in enumerate(codes):
                child = array.base[now] + c
                assert array.check[child] == now
                assert states[at] == child == seen.setdefault((root, codes[: d + 1]), child)
                now, at = child, at + 1
        assert len(set(seen.values())) == len(seen)
        assert (array.step(np.array([0]), np.array([41])) == -1).all()


def test_trie_of_the_table(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r.values()) for r in rows_of(prefix_trie.prefix_trie(table(spark, sf, "conversations"), shard=16))]
    assert sorted(got, key=str) == plain_trie(rows)


def test_sql_of_the_query(spark):
    from isospark.llm import queries
    from tests.llm.helpers import oracle_rows

    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op13_prefix_trie"](spark, sf)
    columns, want = oracle_rows("op13_prefix_trie", sf)
    assert sorted(got.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == want
