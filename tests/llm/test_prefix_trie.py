"""The prefix trie against one that is built turn by turn."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tremor.llm import prefix_trie
from tremor.llm.common import id_crc, table

SCHEMA = "conv_id long, turn long, role string, text string, depth long, bytes long, path string, block string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Nodes of the trie of rows (conv_id, turn, role, text), by the contract's words."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
        own[c].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        if c is None:
            made[c] = turns
            continue
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        made[c] = own.get(base, [])[:h] + turns[h:]
    return nodes_of(made)


def nodes_of(made):
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    least = lambda p: min((c for c in members[p] if c is not None), default=None)
    ends = lambda p: ",".join(map(str, sorted(c for c in members[p] if c is not None and len(made[c]) == len(p))))
    return sorted(((least(p), len(p), least(p[:-1]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items()), key=key)


def key(row):
    return tuple((v is None, 0 if v is None else v) for v in row)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=key)


def own_trie(conversations):
    own = prefix_trie.sequences_of(conversations)
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(own, F.col("conv_id") - F.col("conv_id") % 5, id_crc("conv_id") % 9, 8))


def random_rows(seed, n, words, longest):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(-7, 3 * n), n):
        for turn in range(rng.randrange(1, longest)):
            out.append((c, None if turn == 0 and c % 4 == 0 else turn, ["user", "assistant", None][turn % 2 if c % 9 else 2], rng.choice(words), 1, 2, "x", "y"))
    return out


@pytest.mark.parametrize(("seed", "words", "longest", "partitions"), [(1, ["a", "b"], 12, 4), (2, ["a"], 6, 7), (3, ["a", "", None, "é日"], 30, 3), (4, [f"w{i}" for i in range(90)], 5, 5), (5, ["a"], 14, 40)])
def test_nodes_are_those_of_a_plain_trie(spark, seed, words, longest, partitions):
    rows = random_rows(seed, 60, words, longest)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(own_trie(spark.createDataFrame(rows, SCHEMA))) == brute([r[:4] for r in rows])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nulls_repeats_copies_and_long_ones(spark):
    rows = [(None, 1, "user", "n"), (None, None, "user", "m"), (3, 0, None, None), (3, 0, None, None), (4, None, "user", "q"), (4, 5, "user", "q")]
    rows += [(10 + i, t, "user", f"turn {t}") for i in range(25) for t in range(3)]  # copies
    rows += [(100, t, "user", f"turn {t % 7}") for t in range(700)]
    rows += [(205, t, "user", "x" * 5000 if t else "turn 0") for t in range(20)]
    rows = [(*r, 0, 0, "", "") for r in rows]
    assert got(own_trie(spark.createDataFrame(rows, SCHEMA))) == brute([r[:4] for r in rows])


def test_no_conversations(spark):
    assert own_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_turnless_conversations_end_at_the_root(spark):
    rows = [(c, 0, "user", "a", 0, 0, "", "") for c in (1, 2, 3, 4, 6, 7, 8, 9, 11, 12)]  # no base is there
    want = brute([r[:4] for r in rows])
    assert got(own_trie(spark.createDataFrame(rows, SCHEMA))) == want
    root = [r for r in want if r[1] == 0]
    assert len(root) == 1 and root[0][-1] != prefix_trie.NO_ENDS


def test_given_conversations(spark):
    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, path, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got(prefix_trie.op13_prefix_trie(spark, path)) == brute(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=40))
def test_nearest_smaller_values(values):
    values = np.array([-1, *values])
    before, after = prefix_trie.nearest_smaller(values)
    for i in range(1, len(values)):
        assert before[i] == max(j for j in range(i) if values[j] < values[i])
        assert after[i] == min((j for j in range(i + 1, len(values)) if values[j] < values[i]), default=len(values))
