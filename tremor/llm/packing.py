"""Best-fit packing of documents into sequences of equal capacity, by linear grouping.

A document longer than a sequence is cut into full pieces and a rest. How pieces go together depends on their lengths alone, of which there are
no more than the capacity. So the corpus gives a histogram of lengths, the plan is made from it, and pieces take the places of their length by their
running number:

1. Large lengths, in descending order, are cut into groups of equal cardinality, and each is rounded up to the greatest of its group.
2. For these few sizes, the least number of sequences is a linear program over configurations (how often a sequence holds each size), solved by
   column generation; each configuration is used as often as the whole part of its value says.
3. Actual lengths take the places of the rounded ones, which leaves gaps.
4. The large pieces that are left over and all small ones go, longest first, to the sequence with the smallest gap that takes them.

A plan is a list of rules: pieces number first .. first + n - 1 of a length stand in sequences from `sequence` on, `each` of them side by side in a
sequence, from `offset` on. Its size is bounded by the capacity, whatever the corpus.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor.llm.arrow_ids import BLOCK_CHARS, coder
from tremor.llm.common import doc_texts, stored, table, text_blocks

CAPACITY, END = 4096, 1
#: (groups, share of the capacity above which a length is large): each gives a plan, and the one of the fewest sequences is kept.
SCHEMES = ((64, 1 / 8), (128, 1 / 4), (256, 2 / 5))


@dataclass
class Plan:
    """Rules by length and running number, as columns, and the number of sequences."""

    rules: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)  # length, first, n, sequence, each, offset
    n_sequences: int = 0

    def columns(self) -> np.ndarray:
        return np.array(sorted(self.rules), np.int64).reshape(-1, 6).T


class Lengths:
    """What is left of a histogram: pieces of a length are handed out in the order of their running numbers."""

    def __init__(self, counts: np.ndarray):
        self.left, self.given = counts.astype(np.int64), np.zeros(len(counts), np.int64)

    def take(self, length: int, n: int) -> int:
        """The running number of the first of n pieces."""
        first = int(self.given[length])
        self.given[length] += n
        self.left[length] -= n
        return first


def grouped(counts: np.ndarray, groups: int, above: int) -> list[tuple[int, int, int]]:
    """Groups of equal cardinality of the lengths above a limit, in descending order: (size, least length, pieces); size is the greatest length of a group.

    A group's edge falls on a change of length, so that one length is never in two groups.
    """
    out, size, low, n, each = [], 0, 0, 0, -(-int(counts[above + 1 :].sum()) // groups)
    for length in range(len(counts) - 1, above, -1):
        if c := int(counts[length]):
            if n and n + c > each:
                out.append((size, low, n))
                n = 0
            size, low, n = (length if not n else size), length, n + c
    return out + [(size, low, n)] * bool(n)


def best_column(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the greatest worth: an unbounded knapsack over the capacity."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i, (s, v) in enumerate(zip(sizes, worth)):
        if v > 1e-12:
            for _ in range(capacity // s):
                better = best[:-s] + v > best[s:] + 1e-12
                if not better.any():
                    break
                best[s:][better] = (best[:-s] + v)[better]
                took[s:][better] = i
    column, at = np.zeros(len(sizes), np.int64), capacity
    value = float(best[capacity])
    # the choice at a capacity may have been made before a smaller one was bettered, which only adds worth
    while took[at] >= 0:
        column[took[at]] += 1
        at -= sizes[took[at]]
    return max(value, float(column @ worth)), column


def configurations(sizes: list[int], demand: list[int], capacity: int, most: int = 2000) -> list[tuple[np.ndarray, int]]:
    """(column, uses): the cutting-stock program over columns of sizes, by the revised simplex with columns from knapsacks; uses are rounded down."""
    m = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(most):
        prices = np.linalg.solve(basis.T, np.ones(m))
        value, column = best_column(sizes, prices, capacity)
        if value <= 1 + 1e-9:
            break
        uses, along = np.linalg.solve(basis, np.array(demand, float)), np.linalg.solve(basis, column.astype(float))
        ratio = np.where(along > 1e-8, uses / np.where(along > 1e-8, along, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    uses = np.floor(np.linalg.solve(basis, np.array(demand, float)) + 1e-6).astype(np.int64)
    return [(basis[:, j].round().astype(np.int64), int(uses[j])) for j in range(m) if uses[j] > 0]


def substituted(plan: Plan, lengths: Lengths, groups: list[tuple[int, int, int]], columns: list[tuple[np.ndarray, int]], capacity: int) -> list[tuple[int, int, int]]:
    """Deals actual lengths to the places of the configurations, longest first; gives (gap, first sequence, sequences)."""
    out = []
    at = [size for size, _, _ in groups]  # the longest length of each group that may be left
    for column, uses in columns:
        runs = [(plan.n_sequences, uses, 0)]  # first sequence, sequences, filled
        plan.n_sequences += uses
        for g, times in enumerate(column):
            for _ in range(times):
                split = []
                for first, n, filled in runs:
                    while n:
                        while at[g] >= groups[g][1] and not lengths.left[at[g]]:
                            at[g] -= 1
                        if at[g] < groups[g][1]:  # the group has no more: the place stays free
                            split.append((first, n, filled))
                            break
                        length, some = at[g], min(n, int(lengths.left[at[g]]))
                        plan.rules.append((length, lengths.take(length, some), some, first, 1, filled))
                        split.append((first, some, filled + length))
                        first, n = first + some, n - some
                runs = split
        out += [(capacity - filled, first, n) for first, n, filled in runs]
    return out


def best_fit(plan: Plan, lengths: Lengths, gaps: list[tuple[int, int, int]], capacity: int) -> None:
    """All that is left, longest first, each piece into the smallest gap that takes it; sequences with one gap are filled one after the other."""
    by_gap, order = defaultdict(list), []

    def free(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not by_gap[gap]:
                insort(order, gap)
            by_gap[gap].append((first, n))

    for g in gaps:
        free(*g)
    for length in range(capacity, 0, -1):
        while left := int(lengths.left[length]):
            k = bisect_left(order, length)
            if k == len(order):
                gap, first, n = capacity, plan.n_sequences, -(-left // (capacity // length))
                plan.n_sequences += n
            else:
                gap = order[k]
                first, n = by_gap[gap].pop()
                if not by_gap[gap]:
                    order.pop(k)
            each = gap // length
            full = min(n, left // each)
            if full:
                plan.rules.append((length, lengths.take(length, full * each), full * each, first, each, capacity - gap))
                free(gap - each * length, first, full)
            if full < n and (rest := min(int(lengths.left[length]), each)):
                plan.rules.append((length, lengths.take(length, rest), rest, first + full, rest, capacity - gap))
                free(gap - rest * length, first + full, 1)
                full += 1
            free(gap, first + full, n - full)


def plan_of(counts: np.ndarray, groups: int, large: float) -> Plan:
    """The plan for counts[length] pieces of each length up to the capacity."""
    capacity, plan, lengths = len(counts) - 1, Plan(), Lengths(counts)
    sizes = grouped(counts, groups, int(capacity * large))
    columns = configurations([s for s, _, _ in sizes], [n for _, _, n in sizes], capacity) if sizes else []
    best_fit(plan, lengths, substituted(plan, lengths, sizes, columns, capacity), capacity)
    return plan


def best_plan(counts: np.ndarray) -> Plan:
    return min((plan_of(counts, *s) for s in SCHEMES), key=lambda p: p.n_sequences)


def pieces_of(docs: DataFrame, tokenizer: str | None = None, end_id: int = END, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32; task and number (among the task's pieces of that length); ids, if they are kept.

    A null or empty text is one piece that has the end mark alone. Rows that repeat a doc_id give pieces each; an empty table gives none.
    Texts don't move; a task holds a block of texts.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"] + ["ids"] * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen, end, step = TaskContext.get().partitionId(), [0] * (capacity + 1), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for b in batches:
            doc_ids = iter(b.column("doc_id").to_pylist())
            for texts in text_blocks(b.column("text").to_pylist(), BLOCK_CHARS):
                out = []
                for ids, doc_id in zip(coder(path).encode(texts), doc_ids):
                    ids += end
                    for k in range(0, len(ids), step):
                        own = ids[k : k + step]
                        n = len(own) // 4
                        out.append((doc_id, k // step, k // 4, n, zlib.crc32(own), task, seen[n], *([own] * keep_ids)))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*out))], names)

    return doc_texts(docs).mapInArrow(cut, ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names))


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (stored, with length, task and number; other columns stay) with sequence_id and offset in place of task and number.

    The driver sees the histogram of lengths alone: as many rows as the capacity, at most. Running numbers over all tasks are a task's own
    plus the counts of the tasks before it, which are joined by task and length, so that a frequent length is dealt over all tasks.
    """
    counts = stored(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "length-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    length_at, first_at, _, sequence_at, each_at, offset_at = best_plan(histogram).columns()
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    names = [c for c in pieces.columns if c not in ("task", "number")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = int(first_at.max(initial=0)) + 1
        rule_at = length_at * scale + first_at
        for b in batches:
            length = b.column("length").to_numpy()
            number = b.column("number").to_numpy() + b.column("before").to_numpy()
            rule = np.searchsorted(rule_at, length * scale + np.minimum(number, scale - 1), side="right") - 1
            place, side = np.divmod(number - first_at[rule], each_at[rule])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence_at[rule] + place), pa.array(offset_at[rule] + side * length)], [*names, "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    numbered = pieces.join(starts, ["task", "length"])
    return numbered.mapInArrow(place, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "sequence_id long", "offset long"]))


def sequences(docs: DataFrame, tokenizer: str | None = None, end_id: int = END, capacity: int = CAPACITY) -> DataFrame:
    """The sequences themselves: sequence_id, ids (array<int>, at most the capacity), and for each piece in it doc_ids and starts (its place). One sequence is one group."""
    pieces = packed(stored(pieces_of(docs, tokenizer, end_id, capacity, keep_ids=True), "pieces"), capacity)
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in b.to_pylist():
                own = rows["parts"]
                ids = np.frombuffer(b"".join(p["ids"] for p in own), "<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows["sequence_id"]], pa.int64()), pa.array([ids.astype(np.int32)], pa.list_(pa.int32())), pa.array([[p["doc_id"] for p in own]], pa.list_(pa.int64())), pa.array([[p["offset"] for p in own]], pa.list_(pa.int64()))],
                    ["sequence_id", "ids", "doc_ids", "starts"],
                )

    return pieces.groupBy("sequence_id").agg(parts.alias("parts")).mapInArrow(joined, "sequence_id long, ids array<int>, doc_ids array<long>, starts array<long>")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4,096 tokens."""
    return packed(stored(pieces_of(table(spark, sf_dir, "documents")), "pieces"))
