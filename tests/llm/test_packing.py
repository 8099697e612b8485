"""Best-fit packing: plans against a simulation, pieces and ids against the library."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tremor.llm import packing
from tremor.llm.common import stored

HF = Tokenizer.from_file(P.path("word_bpe_49k.json"))


def filled(counts, plan):
    """The sequences of a plan, piece by piece; fails where a piece is missing, doubled, overlapping or beyond the capacity."""
    numbers, at = defaultdict(list), defaultdict(list)
    for length, first, n, sequence, each, offset in plan.rules:
        numbers[length] += range(first, first + n)
        for k in range(n):
            at[sequence + k // each].append((offset + k % each * length, length))
    assert {length: sorted(n) for length, n in numbers.items()} == {int(x): list(range(counts[x])) for x in np.flatnonzero(counts)}
    for places in at.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] < len(counts)
    assert sorted(at) == list(range(plan.n_sequences))
    return plan.n_sequences


def first_fit_decreasing(counts):
    free = []
    for length in range(len(counts) - 1, 0, -1):
        for _ in range(counts[length]):
            k = next((i for i, f in enumerate(free) if f >= length), None)
            if k is None:
                free.append(len(counts) - 1 - length)
            else:
                free[k] -= length
    return len(free)


def fewest(lengths, capacity):
    """The least number of sequences, by trying all ways; for a handful of pieces."""
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def go(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(lengths):
            best = len(free)
            return
        for i in {f: i for i, f in enumerate(free) if f >= lengths[k]}.values():
            go(k + 1, [*free[:i], free[i] - lengths[k], *free[i + 1 :]])
        go(k + 1, [*free, capacity - lengths[k]])

    go(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.integers(3, 60), st.lists(st.integers(1, 60), max_size=9), st.sampled_from(packing.SCHEMES))
def test_plans_of_few_pieces(capacity, lengths, scheme):
    lengths = [1 + n % capacity for n in lengths]
    counts = np.bincount(lengths, minlength=capacity + 1)
    n, least = filled(counts, packing.plan_of(counts, *scheme)), fewest(lengths, capacity)
    assert least <= n <= max(least + 1, 4 * least / 3)


@pytest.mark.parametrize("kind", ["uniform", "halves", "thirds", "one", "full", "small", "none"])
def test_plans_of_many_pieces(kind):
    rng = np.random.default_rng(7)
    lengths = {
        "uniform": rng.integers(1, 513, 2000), "halves": rng.integers(100, 320, 2000), "thirds": rng.integers(128, 180, 1500), "one": [300] * 999 + [5] * 100, "full": [512] * 50,
        "small": rng.integers(1, 20, 3000), "none": [],
    }[kind]
    counts = np.bincount(np.array(lengths, np.int64), minlength=513)
    plan = packing.best_plan(counts)
    assert filled(counts, plan) <= 1.01 * first_fit_decreasing(counts) + 1


def test_configurations_beat_greedy():
    """Three sizes of which longest-first makes a bad packing: the program over configurations finds the exact one."""
    counts = np.zeros(101, np.int64)
    counts[[44, 34, 28, 27]] = [600, 600, 1200, 1200]  # 44 + 28 + 28 and 34 + 27 + ... fill sequences
    plan = packing.plan_of(counts, 64, 1 / 8)
    assert filled(counts, plan) <= first_fit_decreasing(counts)
    counts = np.zeros(101, np.int64)
    counts[[50, 26, 24]] = [500, 1000, 1000]
    assert filled(counts, packing.plan_of(counts, 64, 1 / 8)) == 750


def test_grouping_rounds_up_by_equal_cardinality():
    counts = np.zeros(101, np.int64)
    counts[20:100] = 10
    groups = packing.grouped(counts, 8, 10)
    assert [n for _, _, n in groups] == [100] * 8 and [s for s, _, _ in groups] == [99, 89, 79, 69, 59, 49, 39, 29]


def want(texts, capacity):
    out = []
    for i, t in texts:
        ids = HF.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            own = ids[k : k + capacity]
            out.append((i, k // capacity, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    return out


def key(row):
    return tuple((v is None, 0 if v is None else v) for v in row)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pieces_are_the_library_s_and_fill_sequences(docs, texts, none, capacity):
    rows = packing.packed(stored(packing.pieces_of(docs.repartition(5), capacity=capacity), "pieces"), capacity).collect()
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want(texts, capacity), key=key)
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= capacity
    total = sum(r.length for r in rows)
    assert -(-total // capacity) <= len(by_sequence) <= 1.02 * total / capacity + 2
    assert packing.packed(stored(packing.pieces_of(none), "pieces")).count() == 0


def test_sequences_hold_the_ids(docs, none):
    pieces = {(r.sequence_id, r.offset): r for r in packing.packed(stored(packing.pieces_of(docs, capacity=256), "pieces"), 256).collect()}
    got = packing.sequences(docs, capacity=256).collect()
    crcs = []
    for r in got:
        ends = [*r.starts[1:], len(r.ids)]
        crcs += [(d, b - a, zlib.crc32(np.array(r.ids[a:b], "<u4").tobytes())) for d, a, b in zip(r.doc_ids, r.starts, ends)]
        assert len(r.ids) <= 256
    assert sorted(crcs, key=key) == sorted(((p.doc_id, p.length, p.ids_crc32) for p in pieces.values()), key=key)
    assert packing.sequences(none).count() == 0


def test_a_frequent_length_is_dealt_over_all_tasks(spark):
    """One length has nine tenths of all rows, over many tasks: each piece has a place of its own."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, "one two three").otherwise(F.concat(F.lit("x "), F.col("id").cast("string"))).alias("text")).repartition(16)
    rows = packing.packed(stored(packing.pieces_of(docs, capacity=32), "pieces"), 32).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) == 3000
    used = defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 32 and len(used) <= sum(used.values()) / 32 * 1.02 + 2
