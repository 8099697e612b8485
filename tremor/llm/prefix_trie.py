"""The prefix trie of conversations, from their sorted order and the longest common prefixes (LCP) of neighbours.

A conversation is the run of its turns' digests, 16 bytes each, so byte order is an order of turn sequences. Sorted, every trie node is an interval
of conversations, and the intervals are those of the Cartesian tree over the LCP array: an entry's interval ends at its nearest smaller values
on both sides. These are found in parallel:

1. The sorted order is cut into blocks, the partitions of a range sort. Each block finds the nearest smaller values inside it. Entries of equal LCP in one
   interval are one node; depths that no LCP has (turns on the way to a node, or after a conversation's last common turn) are filled in.
2. Intervals that touch a block's edge hold a prefix of its first or last row, so a block has at most as many of them as these rows have turns. A part
   that reaches both edges is as deep as the block's minimum, at most. Parts of neighbouring blocks belong together up to the LCP over the edge.
   Blocks, parts and edges are small tables that Spark joins.
3. What a node reports are sums over its interval: conversations, entries equal to its depth, ends of branches, shared bytes.

Texts never move beyond their digest and length. A row holds 24 bytes a turn of one conversation, a task one block of the sorted order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor.llm.common import id_crc, stored, table

WIDTH = 16  # bytes of a turn's digest
NO_ENDS = hashlib.sha256(b"").hexdigest()
NO_ID = np.iinfo(np.int64).max  # stands for a null conv_id, after all others
NODE = {"conv_id": "long", "depth": "long", "parent_conv_id": "long", "n_convs": "long", "n_children": "long", "n_leaves": "long", "saved_tokens": "long", "ends_sha256": "string"}
#: A block's report: its inner nodes, parts of nodes at its edges (ends: their members' own ids, comma-joined), and its first and last row.
REPORT = {"kind": "string", "block": "long", "side": "string", "p_side": "string", "equal": "long", "ended": "long", "shared": "long", "before": "long", "ends": "string", "first_path": "binary", "first_bytes": "array<long>", "last_path": "binary"} | NODE
ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def sequences_of(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (item: hex digest of role and text, bytes: UTF-8 length of the text), by turn.

    A null turn comes first, null roles and texts are empty; rows of equal turn stand in order of their digests. Null conv_ids are one conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    item = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), item.alias("item"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return own.select("conv_id", F.transform("t", lambda t: F.struct(t["item"].alias("item"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(sequences: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Each conversation with its first head (0 to most) turns in place of the like of conversation base's, if there is one; its own later turns follow.

    base has a bounded number of conversations for each value; only its first turns are joined.
    """
    heads = sequences.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_first"))
    named = sequences.withColumns({"_base": base, "_head": head.cast("int")})
    first = F.coalesce(F.slice("_first", F.lit(1), F.col("_head")), F.slice("turns", 1, 0))
    return named.join(heads, "_base", "left").select("conv_id", F.concat(first, F.slice("turns", F.col("_head") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax()) // WIDTH


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the nearest smaller value before (0 if there is none; place 0 counts as smaller than all) and after (the length, if there is none)."""
    m = len(values)
    before, after, open_ = np.zeros(m, np.int64), np.full(m, m, np.int64), [0]
    for i, v in enumerate(values.tolist()):
        if i:
            while len(open_) > 1 and values[open_[-1]] > v:
                after[open_.pop()] = i
            # an equal value before has the same smaller value before it
            before[i] = before[open_[-1]] if len(open_) > 1 and values[open_[-1]] == v else open_[-1]
            open_.append(i)
    return before, after


class Minima:
    """The least of any interval, from tables of runs of 1, 2, 4, ... entries."""

    def __init__(self, values: np.ndarray):
        self.runs = [values]
        while (half := 1 << (len(self.runs) - 1)) * 2 <= len(values):
            last = self.runs[-1]
            self.runs.append(np.minimum(last[:-half], last[half:]))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        level, out = np.frexp((end - start).astype(float))[1] - 1, np.empty(len(start), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.runs[k][start[at]], self.runs[k][end[at] - (1 << k)])
        return out


class Block:
    """Sorted conversations: ids, LCP with the row before (place 0: unknown), numbers of turns, and bytes of the first k turns of each."""

    def __init__(self, ids: list[int | None], lcp: list[int], sizes: list[list[int]]):
        self.m = m = len(ids)
        self.ids, self.lcp, self.turns = ids, np.array(lcp, np.int64), np.array([len(s) for s in sizes], np.int64)
        self.base = np.concatenate(([0], np.cumsum(self.turns + 1)))[:-1]
        flat = np.concatenate([[0, *s] for s in sizes]).astype(np.int64)
        total = np.cumsum(flat)
        self.bytes_to = total - np.repeat(total[self.base], self.turns + 1)
        self.least = Minima(np.array([NO_ID if i is None else i for i in ids], np.int64))
        inner = self.bytes_to[self.base + self.lcp]
        inner[0] = 0
        self.shared = np.concatenate(([0], np.cumsum(inner)))
        ends_branch = np.zeros(m, np.int64)
        ends_branch[:-1] = self.lcp[1:] < self.turns[:-1]  # the last row's: unknown
        self.branches = np.concatenate(([0], np.cumsum(ends_branch)))

    def ends(self, start: int, end: int, depth: int) -> str:
        """Ids of the rows from start on that have just depth turns, in ascending order: the first ones of their node."""
        k = start
        while k < end and self.turns[k] == depth:
            k += 1
        return ",".join(str(i) for i in self.ids[start:k] if i is not None)

    def ended(self, start: np.ndarray, end: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """How many rows of each interval have just depth turns: a run at its start."""
        # rows of one number of turns in a run: where it ends
        change = np.flatnonzero(np.diff(self.turns)) + 1
        stop = np.append(change, self.m)[np.searchsorted(change, start, side="right")]
        return np.where(self.turns[start] == depth, np.minimum(stop, end) - start, 0)

    def columns(self, start: np.ndarray, end: np.ndarray, depth: np.ndarray) -> dict[str, np.ndarray]:
        """Sums over intervals; equal is left to the caller."""
        return {
            "conv_id": self.least.of(start, end), "depth": depth, "n_convs": end - start, "ended": self.ended(start, end, depth), "n_leaves": self.branches[end] - self.branches[start],
            "shared": self.shared[end] - self.shared[start + 1], "before": np.where(depth > 0, self.bytes_to[self.base[start] + np.maximum(depth - 1, 0)], 0),
        }

    def inner(self) -> Iterator[dict]:
        """Nodes that touch neither edge, with the parent's smallest id, or the side of the part that it is and no id."""
        m, lcp = self.m, self.lcp
        if m < 3:
            return
        before, after = nearest_smaller(np.where(np.arange(m) > 0, lcp, -1))
        at = np.arange(1, m)
        _, first, equal = np.unique(np.stack([before[at], lcp[at]]), axis=1, return_index=True, return_counts=True)
        own = at[first]
        closed = (before[own] > 0) & (after[own] < m)
        own, equal = own[closed], equal[closed]
        alone = np.arange(1, m - 1)  # what a conversation has beyond its neighbours
        alone = alone[self.turns[alone] > np.maximum(lcp[alone], lcp[alone + 1])]
        start, end = np.concatenate([before[own], alone]), np.concatenate([after[own], alone + 1])
        deep, equal = np.concatenate([lcp[own], self.turns[alone]]), np.concatenate([equal, np.zeros(len(alone), np.int64)])
        if not len(start):
            return
        above = np.maximum(lcp[start], lcp[end])  # the parent's depth
        edge = np.where(lcp[start] == above, start, end)  # an entry of the parent
        inside = (before[edge] > 0) & (after[edge] < m)
        parent = np.full(len(start), NO_ID)
        parent[inside] = self.least.of(before[edge[inside]], after[edge[inside]])
        side = np.where(inside, "", np.where(before[edge] == 0, "L", "R"))
        times = deep - above
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        row = np.repeat(np.arange(len(start)), times)
        depth, top = above[row] + 1 + step, step == 0
        out = self.columns(start[row], end[row], depth)
        out["parent_conv_id"] = np.where(top, parent[row], out["conv_id"])
        out["p_side"] = np.where(top, side[row], "")
        out["equal"] = np.where(depth == deep[row], equal[row], 0)
        out["ends"] = [self.ends(s, e, d) if n else "" for s, e, d, n in zip(start[row].tolist(), end[row].tolist(), depth.tolist(), out["ended"].tolist())]
        yield out

    def parts(self) -> Iterator[dict]:
        """Parts of nodes at the edges: L holds the first row, whether it reaches the other edge (p_side: full) or not; R holds the last row alone."""
        m, lcp = self.m, self.lcp
        fall = np.minimum.accumulate(np.append(self.turns[0], lcp[1:]))  # the deepest common prefix of rows 0 to i
        depth = np.arange(self.turns[0] + 1)
        end = np.searchsorted(-fall, -depth, side="right")  # the first row that has less in common
        out = self.columns(np.zeros(len(depth), np.int64), end, depth)
        out["equal"] = np.bincount(lcp[1:][lcp[1:] == fall[1:]], minlength=len(depth))[: len(depth)]
        out["side"], out["p_side"] = np.full(len(depth), "L"), np.where(end == m, "full", "L")
        out["ends"] = [self.ends(0, e, d) for e, d in zip(end.tolist(), depth.tolist())]
        yield out
        rise = np.minimum.accumulate(np.append(self.turns[-1], lcp[:0:-1]))  # of the last row and those before it
        depth = np.arange(self.turns[-1] + 1)
        start = m - np.searchsorted(-rise, -depth, side="right")
        equal = np.bincount(lcp[:0:-1][lcp[:0:-1] == rise[1:]], minlength=len(depth))[: len(depth)]
        side = np.where(np.append(0, start[:-1]) > 0, "R", "L")  # of the parent
        own = start > 0
        depth, start = depth[own], start[own]
        if len(depth):
            out = self.columns(start, np.full(len(depth), m), depth)
            out["equal"], out["side"], out["p_side"] = equal[own], np.full(len(depth), "R"), side[own]
            out["ends"] = [self.ends(s, m, d) for s, d in zip(start.tolist(), depth.tolist())]
            yield out


def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a block of the sorted order has to say; rows: conv_id, path, bytes."""
    from pyspark import TaskContext

    block, ids, lcp, sizes, first, last = TaskContext.get().partitionId(), [], [], [], None, b""
    for b in batches:
        for conv_id, path, own in zip(b.column("conv_id").to_pylist(), b.column("path").to_pylist(), b.column("bytes").to_pylist()):
            first = path if first is None else first
            lcp.append(common_turns(last, path) if ids else 0)
            ids.append(conv_id)
            sizes.append(own)
            last = path
    if not ids:
        return
    made = Block(ids, lcp, sizes)
    yield rows_of([{"kind": "edge", "block": block, "first_path": first, "first_bytes": sizes[0], "last_path": last}])
    for kind, found in (("node", made.inner()), ("part", made.parts())):
        for columns in found:
            n = len(columns["depth"])
            for k in range(0, n, 10_000):
                some = {c: v[k : k + 10_000] for c, v in columns.items()}
                if kind == "node":
                    some["ends_sha256"] = [hashlib.sha256(e.encode()).hexdigest() if e else NO_ENDS for e in some.pop("ends")]
                yield columns_of(some | {"kind": [kind] * len(some["depth"]), "block": [block] * len(some["depth"])})


def rows_of(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], ARROW[t]) for c, t in REPORT.items()], list(REPORT))


def columns_of(columns: dict) -> pa.RecordBatch:
    n = len(columns["depth"])
    made = []
    for c, t in REPORT.items():
        values = columns.get(c)
        if values is None:
            made.append(pa.nulls(n, ARROW[t]))
        elif c in ("conv_id", "parent_conv_id"):
            made.append(pa.array(values, pa.int64(), mask=values == NO_ID))
        else:
            made.append(pa.array(values.tolist() if isinstance(values, np.ndarray) else values, ARROW[t]))
    return pa.RecordBatch.from_arrays(made, list(REPORT))


def edges_of(edges: DataFrame) -> DataFrame:
    """A row a block: LCP with the block before and with the next (-1: there is none), bytes shared over the edge before, turns of the last row."""
    order = Window.orderBy("block")  # a row a block, of a number alone
    numbers = edges.select("block", F.lag("block").over(order).alias("before"))
    lasts = edges.select(F.col("block").alias("before"), F.col("last_path").alias("before_path"))
    both = numbers.join(edges.select("block", "first_path", "first_bytes", F.octet_length("last_path").alias("last_bytes")), "block").join(lasts, "before", "left")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            lcp = [-1 if r["before"] is None else common_turns(r["before_path"], r["first_path"]) for r in rows]
            gain = [sum(r["first_bytes"][: max(k, 0)]) for r, k in zip(rows, lcp)]
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(lcp, pa.int64()), pa.array(gain, pa.int64()), pa.array([r["last_bytes"] // WIDTH for r in rows], pa.int64())], ["block", "lcp", "gain", "last_turns"])

    known = both.mapInArrow(compare, "block long, lcp long, gain long, last_turns long")
    return known.withColumn("next_lcp", F.coalesce(F.lead("lcp").over(order), F.lit(-1)))


def ends_digests(parts: DataFrame) -> DataFrame:
    """depth, chain, ends_sha256: the digest of the ids that the parts of a chain list, in order of blocks; a part at a time."""
    dealt = parts.where(F.col("ends") != "").select("depth", "chain", "block", "side", "ends").repartition("depth", "chain").sortWithinPartitions("depth", "chain", "block", "side")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        row = lambda: pa.RecordBatch.from_pylist([{"depth": key[0], "chain": key[1], "ends_sha256": state.hexdigest()}])
        for b in batches:
            for depth, chain, ends in zip(*(b.column(c).to_pylist() for c in ("depth", "chain", "ends"))):
                if key != (depth, chain):
                    if key:
                        yield row()
                    key, state = (depth, chain), hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
        if key:
            yield row()

    return dealt.mapInArrow(digest, "depth long, chain long, ends_sha256 string")


def with_children(nodes: DataFrame) -> DataFrame:
    """n_children and saved_tokens from the sums of an interval."""
    return nodes.withColumns({"n_children": F.col("equal") + 1 - F.col("ended"), "saved_tokens": F.col("shared") - (F.col("n_convs") - 1) * F.col("before")})


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences (conv_id, turns: array of (item, bytes)), a row each.

    conv_id: the smallest member (null ids come after all others); depth; parent_conv_id: the parent's (root: null); n_convs: sequences that start with it;
    n_children; n_leaves: childless nodes of its subtree; saved_tokens: over its subtree, each node's (n_convs - 1) times the bytes of its last turn;
    ends_sha256: the digest of the comma-joined ids of sequences that end there (null ids aren't written). A sequence without turns
    ends at the root; no sequences have no nodes. Copies of a sequence, however many, lie in as many blocks as their ids are dealt over.
    """
    flat = stored(sequences.select("conv_id", F.unhex(F.array_join(F.col("turns.item"), "")).alias("path"), F.col("turns.bytes").alias("bytes")), "paths")
    order = [F.col("path").asc(), F.col("conv_id").asc_nulls_last()]
    told = stored(flat.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(report, ", ".join(f"{c} {t}" for c, t in REPORT.items())), "blocks")
    of = lambda kind: told.where(F.col("kind") == kind)
    edges = stored(edges_of(of("edge")), "edges")
    # parts of neighbouring blocks belong together as deep as the edge between them lets them; at each depth there are two a block at most
    over = of("part").drop("first_path", "first_bytes", "last_path").join(edges, "block")
    linked = (F.col("side") == "L") & (F.col("depth") <= F.col("lcp"))
    at_end = (F.col("side") == "R") | (F.col("p_side") == "full")
    slim = over.select(
        "block", "side", "depth", F.when(F.col("side") == "R", F.col("p_side")).otherwise("L").alias("p_side"), "conv_id", "n_convs", "before", "ended", (~linked).cast("int").alias("starts"),
        (F.col("equal") + (linked & (F.col("lcp") == F.col("depth"))).cast("int")).alias("equal"), (F.col("shared") + F.when(linked, F.col("gain")).otherwise(0)).alias("shared"),
        (F.col("n_leaves") + (at_end & (F.col("next_lcp") < F.col("last_turns"))).cast("int")).alias("n_leaves"),
    )
    chained = stored(slim.withColumn("chain", F.sum("starts").over(Window.partitionBy("depth").orderBy("block", "side"))), "parts")
    digests = ends_digests(of("part").select("block", "side", "depth", "ends").join(chained.select("block", "side", "depth", "chain"), ["block", "side", "depth"]))
    first = lambda c: F.min_by(c, F.struct("block", "side"))
    whole = chained.groupBy("depth", "chain").agg(
        F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "equal", "ended", "shared", "n_leaves")), first("before").alias("before"),
        first("block").alias("block"), first("p_side").alias("p_side"),
    )
    whole = stored(whole.join(digests, ["depth", "chain"], "left").fillna({"ends_sha256": NO_ENDS}), "chains")
    # parents: known inside a block, else the chain of the part that is named
    least = chained.select("block", F.col("side").alias("p_side"), (F.col("depth") + 1).alias("depth"), "chain").join(whole.select((F.col("depth") + 1).alias("depth"), "chain", F.col("conv_id").alias("parent_conv_id")), ["depth", "chain"]).drop("chain")
    inner, columns = of("node"), [c for c in NODE if c != "parent_conv_id"]
    hanging = with_children(inner.where(F.col("p_side") != "")).select("block", "p_side", *columns).unionByName(with_children(whole).select("block", "p_side", *columns))
    placed = hanging.join(least, ["block", "p_side", "depth"], "left").select(*NODE)
    return with_children(inner.where(F.col("p_side") == "")).select(*NODE).unionByName(placed)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each with its first crc32(conv_id) % 9 turns from the conversation whose id is the multiple of five below it."""
    own = stored(sequences_of(table(spark, sf_dir, "conversations")), "sequences")
    return prefix_trie(rebuilt(own, F.col("conv_id") - F.col("conv_id") % 5, id_crc("conv_id") % 9, 8))
