"""MinHash near-dedup with ProbMinHash signatures over weighted word shingles.

Every shingle of a text sends arrivals of a Poisson process whose rate is its weight; each arrival falls into a random
register, and a register keeps the shingle of its earliest arrival. A shingle stops when its next arrival is later than all
registers of its text. Two texts agree in a register with the chance of their probability Jaccard, so bands of
registers bring likely pairs together. Texts that repeat a shingle are sketched a second time with weights of 1, which is how alike is measured.
Every pair that counts is verified on the whole shingle sets.

Texts with the same shingles become one class first, by a hash of the set. In a bucket of a band the classes meet a few
leaders of the bucket instead of each other, so a bucket of copies gives a few pairs for each member, however large it is.
Classes that meet and are alike are linked, and connected components give their groups. Where a bucket still has several groups,
members that neither led nor are in its largest group are held against all others of the bucket, in blocks of shingle
sets: a task has two blocks and gives at most one link for each group in them. So each pair of a bucket has been compared, or
its two classes are in one group already. Components of all links give each document its group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import blocks, discard, doc_texts, free_name, mix64, stored, table

WORDS, ALIKE = 5, 0.8
#: At a similarity of 0.8 a pair misses all of 30 bands of 5 registers of weight 1 with a chance of 7e-6; at 0.3 it meets with one of 7 %.
BANDS, ROWS = 30, 5
#: Leaders of a bucket, about; a bucket of few members is led by all of them.
LEADERS = 8
#: Shingles and classes of a block of a bucket, about: what bounds the memory of a task.
BLOCK_SHINGLES, BLOCK_CLASSES = 200_000, 500
PRIME = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME to each power below n at least, and their inverses, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(PRIME, -1, 2**64)
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, p, np.uint64))), dtype=np.uint64) for p in (PRIME, inverse)]
    return _powers[0], _powers[1]


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text, hash and count of each distinct shingle of small-lettered texts, in order; fewer words than a shingle's form one."""
    data = np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)
    is_word = data > 32  # blanks and control characters divide words
    edges = np.diff(np.concatenate(([0], is_word.view(np.int8))))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    p, inverse = powers(len(data) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], dtype=np.uint64)))
    word = mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    of = np.searchsorted(bounds, starts, side="right")
    n_words = np.bincount(of, minlength=len(texts))
    length = np.minimum(n_words, words)[of]  # of the shingles of this word's text
    first = np.concatenate(([0], np.cumsum(n_words)))[of]
    whole = np.arange(len(of)) + length <= first + n_words[of]
    h = np.zeros(len(of), np.uint64)
    for i in range(words):
        at = np.minimum(np.arange(len(of)) + i, max(len(of) - 1, 0))
        h = np.where(i < length, mix64(h * np.uint64(PRIME) + word[at] + np.uint64(i + 1)), h) if len(of) else h
    return distinct(of[whole], h[whole])


def distinct(of: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.zeros(0, int)
    return of[new], h[new], np.diff(np.append(new, len(h)))


def signatures(of: np.ndarray, h: np.ndarray, weight: np.ndarray, n_texts: int, registers: int) -> np.ndarray:
    """For each text the shingle that came first to each register; texts without shingles keep 0."""
    best, owner = np.full(n_texts * registers, np.inf), np.zeros(n_texts * registers, np.uint64)
    time, step, latest = np.zeros(len(h)), 0, np.full(n_texts, np.inf)
    while len(h):
        # few shingles left: several arrivals of each at once
        some = int(min(64, max(1, 100_000 // len(h))))
        draw = mix64(h[:, None] + (np.arange(step, step + some, dtype=np.uint64)[None, :] + np.uint64(1)) * np.uint64(PRIME))
        gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)
        arrival = time[:, None] + np.cumsum(gap, 1) / weight[:, None]
        register = (mix64(draw) % np.uint64(registers)).astype(np.int64) + of[:, None] * registers
        early = arrival < latest[of][:, None]
        when, where = arrival[early], register[early]
        np.minimum.at(best, where, when)
        won = when == best[where]
        owner[where[won]] = np.broadcast_to(h[:, None], arrival.shape)[early][won]
        time, step = arrival[:, -1], step + some
        latest = best.reshape(n_texts, registers).max(1)
        on = time < latest[of]
        of, h, weight, time = of[on], h[on], weight[on], time[on]
    return owner.reshape(n_texts, registers)


def banded(of: np.ndarray, h: np.ndarray, weight: np.ndarray, n_texts: int, bands: int, rows: int) -> np.ndarray:
    """A key of each text for each band."""
    found = signatures(of, h, weight, n_texts, bands * rows).reshape(n_texts, bands, rows)
    key = np.zeros((n_texts, bands), np.uint64)
    for i in range(rows):
        key = mix64(key * np.uint64(PRIME) + found[:, :, i] + np.uint64(i))
    return key


def buckets_of(of: np.ndarray, h: np.ndarray, count: np.ndarray, n_texts: int, bands: int, rows: int) -> list[np.ndarray]:
    """The buckets of each text by its weighted shingles, and by shingles of weight 1 where it repeats any.

    What counts as alike doesn't weigh shingles, so a pair whose repeats differ may agree in few weighted registers. Without repeats both weights are the same, so
    any alike pair meets in buckets of weight 1.
    """
    with_band = lambda keys: mix64(keys * np.uint64(PRIME) + np.arange(bands, dtype=np.uint64)).view(np.int64)
    keys = list(with_band(banded(of, h, 1 + np.log(count), n_texts, bands, rows)))
    again = np.unique(of[count > 1])
    own = np.isin(of, again)
    for i, more in zip(again, with_band(banded(np.searchsorted(again, of[own]), h[own], np.ones(own.sum()), len(again), bands, rows))):
        keys[i] = np.unique(np.concatenate((keys[i], more)))
    return keys


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, version (a hash of the text), the hash of the shingle set (two halves), its size and the buckets of each row; a text without words has no buckets."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, "text", 1_000_000):
                n = b.num_rows
                of, h, count = shingles(b.column("text").cast(pa.binary()).to_pylist())
                keys = buckets_of(of, h, count, n, bands, rows)
                halves = []
                for salt in (1, 2):
                    own = np.zeros(n, np.uint64)
                    np.add.at(own, of, mix64(h + np.uint64(salt * PRIME % 2**64)))
                    halves.append(pa.array(own.view(np.int64)))
                size = np.bincount(of, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("version"), *halves, pa.array(size), pa.array([k if y else None for k, y in zip(keys, size)], pa.list_(pa.int64()))], ["doc_id", "version", "set_a", "set_b", "size", "buckets"]
                )

    low = with_version(docs).withColumn("text", F.lower("text"))
    return low.mapInArrow(sketch, "doc_id long, version long, set_a long, set_b long, size long, buckets array<long>")


def with_version(docs: DataFrame) -> DataFrame:
    """doc_id, text and version, which with doc_id tells rows of different texts apart."""
    return doc_texts(docs).withColumn("version", F.xxhash64("text"))


def similarity(pairs: DataFrame) -> DataFrame:
    """a, b and similarity (Jaccard of the whole shingle sets) of each row of pairs (a, b, text_a, text_b)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, "text_a", 1_000_000):
                n = b.num_rows
                sides, sizes = [], []
                for name in ("text_a", "text_b"):
                    of, h, _ = shingles(b.column(name).cast(pa.binary()).to_pylist())
                    sides.append((of, h))
                    sizes.append(np.bincount(of, minlength=n))
                of, _, count = distinct(*map(np.concatenate, zip(*sides)))
                both = np.bincount(of[count == 2], minlength=n)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(both / np.maximum(sizes[0] + sizes[1] - both, 1))], ["a", "b", "similarity"])

    return pairs.select("a", "b", F.lower("text_a").alias("text_a"), F.lower("text_b").alias("text_b")).mapInArrow(measure, "a long, b long, similarity double")


def verified(pairs: DataFrame, texts: DataFrame, alike: float) -> DataFrame:
    """The rows of pairs (a, b) whose texts (node, text) are alike. b, the leader, may be a hot key: Spark splits its join.

    Both sides grow with the corpus, so neither is broadcast.
    """
    of_a = pairs.hint("merge").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = of_a.hint("merge").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return similarity(both).where(F.col("similarity") >= alike).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node it is connected with) of every node of links (a, b), by large-star and small-star steps.

    The least neighbours are stored before they are joined, so that Spark can split the join at a node with many neighbours.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    done = None
    while done != (found := tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())):
        done = found
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = stored(edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        lower = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        discard(edges, least)
        edges = stored(small.union(lower.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        discard(large, lower)
    # every edge of a finished forest goes to a root
    roots = stored(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct()), "roots")
    discard(edges)
    return roots


def with_leaders(members: DataFrame, wanted: int) -> DataFrame:
    """The members (bucket, node, size), and whether each leads its bucket: about wanted of them do, all of them if there are few.

    Aggregation before the shuffle keeps hot buckets small, and a hash of the node alone picks the same leaders in all bands.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    drawn = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / (1 << 30) < F.lit(wanted) / (F.col("n") - 1)
    return members.join(sizes, "bucket").select("bucket", "node", "size", drawn.alias("leads"))


def leader_pairs(members: DataFrame, alike: float) -> DataFrame:
    """Distinct (a, b): each member (bucket, node, size, leads) with the leaders of its bucket that have a size that lets them be alike."""
    # stored, so that Spark can split the join at a bucket of many members
    leaders = stored(members.where("leads").groupBy("bucket").agg(F.collect_list(F.struct("node", "size")).alias("leaders")), "leaders")
    met = members.join(leaders, "bucket").select("node", "size", F.explode("leaders").alias("l"))
    met = met.where((F.col("node") != F.col("l.node")) & (F.least("size", "l.size") >= F.greatest("size", "l.size") * (alike - 1e-9)))
    return met.select(F.greatest("node", "l.node").alias("a"), F.least("node", "l.node").alias("b")).distinct()


def block_tasks(members: DataFrame) -> DataFrame:
    """What is still to compare of members (bucket, node, size, root): rows (bucket, x, y, side, node, root) of tasks (bucket, x, y).

    A bucket's most common root is its core, the other members are its rest. Both are dealt by a hash into blocks; every block of the
    rest meets every block of the core and of the rest. side: x or y, or both where a block meets itself. Members of one root don't meet.
    """
    roots = members.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    rest_of = lambda c: F.sum(c) - F.max_by(c, F.struct("n", "root"))
    parts = lambda n, shingles: F.greatest(F.ceil(n / BLOCK_CLASSES), F.ceil(shingles / BLOCK_SHINGLES))
    mixed = roots.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("core"), F.max("n").alias("n"), F.max_by("shingles", F.struct("n", "root")).alias("shingles"), rest_of("n").alias("rest"), rest_of("shingles").alias("rest_shingles"))
    mixed = mixed.where("rest > 0").select("bucket", "core", parts(F.col("n"), F.col("shingles")).alias("cores"), parts(F.col("rest"), F.col("rest_shingles")).alias("rests"))
    mixed = stored(mixed, "mixed")  # so that Spark can split the join at a bucket of many members
    placed = members.join(mixed, "bucket").withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("root") == F.col("core"), F.col("cores")).otherwise(F.col("rests"))))
    task = lambda x, y, side: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(side).alias("side"))
    # blocks of the rest are 0, 1, ..., those of the core -1, -2, ...
    as_core = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1), lambda i: task(i, -1 - F.col("own"), "y"))
    with_cores = F.transform(F.sequence(F.lit(0).cast("long"), F.col("cores") - 1), lambda i: task(F.col("own"), -1 - i, "x"))
    with_rests = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1), lambda i: F.when(i < F.col("own"), task(i, F.col("own"), "y")).when(i > F.col("own"), task(F.col("own"), i, "x")).otherwise(task(i, i, "both")))
    tasks = F.when(F.col("root") == F.col("core"), as_core).otherwise(F.concat(with_cores, with_rests))
    return placed.select("bucket", "node", "root", F.explode(tasks).alias("t")).select("bucket", "t.x", "t.y", "t.side", "node", "root")


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of x has in common with each of y."""
    column, of = np.concatenate(x + y), np.repeat(np.arange(len(x) + len(y)), [len(s) for s in x + y])
    _, column, times = np.unique(column, return_inverse=True, return_counts=True)
    shared = times[column] > 1  # an element of one set alone is common to none
    column, of = np.cumsum(times > 1)[column[shared]] - 1, of[shared]
    order = np.argsort(column, kind="stable")
    column, of, width, found = column[order], of[order], 4096, np.zeros((len(x), len(y)), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, (a, a + width))
        table_ = np.zeros((len(x) + len(y), width), np.float32)
        table_[of[i:j], column[i:j] - a] = 1
        found += table_[: len(x)] @ table_[len(x) :].T
    return found


def block_links(tasks: DataFrame, sets: DataFrame, alike: float) -> DataFrame:
    """Links (a, b) that connect the alike members of each task of block_tasks, at most one for each of its roots less one. sets: node and its shingles."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        x, y = (group[group["side"].isin((s, "both"))] for s in "xy")
        root_x, root_y = x["root"].to_numpy(), y["root"].to_numpy()
        sizes = [np.array([len(s) for s in g["shingles"]]) for g in (x, y)]
        both = common_counts(list(x["shingles"]), list(y["shingles"]))
        near = (both / np.maximum(sizes[0][:, None] + sizes[1][None, :] - both, 1) >= alike) & (root_x[:, None] != root_y[None, :])
        i, j = np.nonzero(near)
        # one pair of nodes for each pair of roots, and of these the ones that join what isn't joined yet
        _, first = np.unique(np.stack([root_x[i], root_y[j]]), axis=1, return_index=True)
        parent: dict = {}

        def top(r: int) -> int:
            while parent.setdefault(r, r) != r:
                parent[r] = r = parent[parent[r]]
            return r

        out = []
        for k in first:
            p, q = top(root_x[i[k]]), top(root_y[j[k]])
            if p != q:
                parent[p] = q
                out.append((x["node"].iloc[i[k]], y["node"].iloc[j[k]]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return tasks.join(sets, "node").groupBy("bucket", "x", "y").applyInPandas(compare, "a long, b long")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """node and shingles, the hashes of its distinct shingles, of each row of texts (node, text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, "text", 1_000_000):
                of, h, _ = shingles(b.column("text").cast(pa.binary()).to_pylist())
                ends = np.cumsum(np.bincount(of, minlength=b.num_rows))
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(h.view(np.int64)))], ["node", "shingles"])

    return texts.select("node", F.lower("text").alias("text")).mapInArrow(make, "node long, shingles array<long>")


def grouped(docs: DataFrame, alike: float = ALIKE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, version, class_id and group_key of each row of docs (doc_id, text), as duplicate_groups describes them."""
    texts = with_version(docs)
    sketched = stored(sketches(docs, bands, rows), "sketches")
    one = F.struct(F.col("doc_id").isNull(), "doc_id", "version", "buckets")
    classes = sketched.groupBy("set_a", "set_b").agg(F.max("size").alias("size"), F.min(one).alias("one"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("node"), "set_a", "set_b", "size", "one.doc_id", "one.version", "one.buckets"), "classes")  # written once, so that nodes stay
    buckets = classes.where("buckets IS NOT NULL").select(F.explode("buckets").alias("bucket"), "node", "size")
    members = stored(with_leaders(buckets, LEADERS), "members")
    crowded = stored(classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "version", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id")), "crowded")
    keyed = texts.select("text", "version", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"))
    texts_of = stored(keyed.join(crowded.hint("merge"), ["doc_id", "no_id", "version"]).select("node", "text"), "crowded-texts")
    pairs = stored(leader_pairs(members, alike), "pairs")
    links = stored(verified(pairs, texts_of, alike), "links")
    roots = components(links)

    left = members.where("NOT leads").join(roots, "node", "left").select("bucket", "node", "size", F.coalesce("root", "node").alias("root"))
    tasks = stored(block_tasks(left), "block-tasks")
    if not tasks.isEmpty():
        late = texts_of.join(tasks.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
        more = stored(block_links(tasks, stored(shingle_sets(late), "shingle-sets"), alike), "links")
        discard(roots)
        roots = components(links.unionByName(more))
        discard(more)
    discard(members, crowded, texts_of, pairs, links, tasks)
    rooted = classes.join(roots, "node", "left").select("set_a", "set_b", "doc_id", F.coalesce("root", "node").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min(F.struct("set_a", "set_b")).alias("least"))
    named = rooted.drop("doc_id").join(groups, "root").select("set_a", "set_b", "class_id", F.concat(F.hex("least.set_a"), F.lit("-"), F.hex("least.set_b")).alias("group_key"))
    return sketched.select("doc_id", "version", "set_a", "set_b").join(named, ["set_a", "set_b"]).select("doc_id", "version", "class_id", "group_key")


def duplicate_groups(docs: DataFrame, alike: float = ALIKE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id (the least doc_id of its group) and group_key (a name of the group by its texts alone) of each row of docs (doc_id, text).

    A group is connected by links: pairs of texts whose sets of five-word shingles have a Jaccard similarity of alike or
    more, small-lettered words cut at white space. Texts of fewer words are one shingle; all texts without words,
    nulls included, are one group. Rows that repeat a doc_id with another text are grouped by their own text each, and where they fall into two
    groups of the same class_id, group_key tells these apart. Rows with a null doc_id are grouped like others; class_id is null for a
    group of such rows alone. An empty table gives no rows.
    """
    return grouped(docs, alike, bands, rows).drop("version")


def one_of_each_group(docs: DataFrame, alike: float = ALIKE) -> DataFrame:
    """One row of docs (doc_id, text and further columns) for each group: that of the least doc_id, nulls last, and of its texts the one of the least hash.

    Of rows that repeat both, one stays. An empty table gives no rows.
    """
    groups = grouped(docs, alike).groupBy("group_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "version")).alias("k")).select("k.*")
    names = {c: free_name(f"near_{c}", docs) for c in groups.columns}
    kept = stored(groups.withColumnsRenamed(names), "kept")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    keyed = docs.withColumns({names["no_id"]: docs["doc_id"].isNull(), names["id"]: F.coalesce(docs["doc_id"].cast("long"), F.lit(0)), names["version"]: F.xxhash64(text)})
    return keyed.join(kept, list(names.values()), "left_semi").dropDuplicates(list(names.values())).drop(*names.values())


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """duplicate_groups of all documents."""
    return duplicate_groups(table(spark, sf_dir, "documents"))
