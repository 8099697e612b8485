"""Alignment of two tokenizers: packed bitsets of token ends, cuts that both share, and links between the tokens of a group.

A block of texts is one run of bytes. Each tokenizer marks the bytes at which its tokens end in a bitset; the AND of both has the shared cuts, and select
lists them. The rank of a cut in a tokenizer's own bitset (popcounts of the words before, and of the word's lower bits) is the number of its tokens up to there, so two
cuts in a row give the range of tokens of either side: a group. Every token of one side is linked to every one of the other in its group.

How many documents hold a pair linked is counted over the corpus. The most frequent pairs (MOST_SHIPPED of them, whatever the corpus) are sent to all
tasks; counts of all others are joined by pair, and as they are the rare ones, no pair holds many rows of that join.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.arrow_ids import BYTE_LETTERS
from tremor.llm.common import doc_texts, stored, table, text_blocks

#: Entries of a worker's memory of chunks, and the longest chunk it keeps; a full memory starts anew. Chunks given to the libraries at once.
MEMORY, LONGEST_KEPT, AT_ONCE = 500_000, 48, 4_000
BLOCK_CHARS = 400_000
#: Pairs whose counts all tasks get; pairs that a task counts before it hands them on; links of a group that are listed one by one.
MOST_SHIPPED, MOST_HELD, LISTED = 200_000, 2_000_000, 4096
_pairs: dict[tuple[str, str], TokenizerPair] = {}


class TokenizerPair:
    """Ids of texts by a byte-level tokenizer (A, of a blank and the text) and by a piece model (B, which adds the blank itself).

    Neither joins tokens over the blank before a word or before a line end, so texts are cut there and chunks remembered. A text with other white space, or where
    a chunk's bytes aren't given back, goes to the libraries whole.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {letter: byte for byte, letter in enumerate(BYTE_LETTERS)}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte_of[c] for c in entry)
        self.b_bytes = [self.piece_bytes(i) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        self.a_known, self.b_known = {}, {}
        blank = self.b.piece_to_id("▁")
        self.by_chunk = self.b.encode("\na")[:1] == [blank] and all(self.b.encode(f"{x} {y}") == self.b.encode(x) + self.b.encode(y) and self.b.encode(f"{x}\n{y}") == self.b.encode(x) + self.b.encode(f"\n{y}")[1:] for x in ("a", "The.") for y in ("b", "9x"))

    def piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def both(self, texts: list[str]) -> Iterator[tuple[bytes, bytes] | None]:
        """Ids of each text by A and B, or None where one of them doesn't give the text's bytes back."""
        for k in range(0, len(texts), AT_ONCE):
            some = texts[k : k + AT_ONCE]
            for t, a, b in zip(some, self.a.encode_batch_fast([f" {t}" for t in some], add_special_tokens=False), self.b.encode(some, num_threads=1)):
                yield self.checked(f" {t}".encode(), a.ids, b)

    def checked(self, want: bytes, a: list[int], b: list[int]) -> tuple[bytes, bytes] | None:
        same = b"".join(map(self.a_bytes.__getitem__, a)) == want == b"".join(map(self.b_bytes.__getitem__, b))
        return (array("I", a).tobytes(), array("I", b).tobytes()) if same else None

    def learn(self, chunks: list[str]) -> None:
        """Ids of chunks: a word after a blank, or a line end and the word after it."""
        for k in range(0, len(chunks), AT_ONCE):
            some = chunks[k : k + AT_ONCE]
            lines = [c[:1] == "\n" for c in some]
            for c, line, a, b in zip(some, lines, self.a.encode_batch_fast([c if n else f" {c}" for c, n in zip(some, lines)], add_special_tokens=False), self.b.encode(some, num_threads=1)):
                plain = c and not WHITE.search(c[1:] if line else c)
                found = self.checked((c if line else f" {c}").encode(), a.ids, b[1:] if line else b) if plain else None
                self.a_known[c], self.b_known[c] = found or (None, None)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of each text; None for empty texts too."""
        a_known, b_known = self.a_known, self.b_known
        if len(a_known) > MEMORY:
            a_known.clear()
            b_known.clear()
        split = [t.replace("\n", " \n").split(" ") if self.by_chunk and not ("\n\n\n" in t or "\n\n " in t or t[-2:] == "\n\n") else [""] for t in texts]
        new = list(set().union(*split).difference(a_known))
        self.learn(new)
        out: list[tuple[bytes, bytes] | None] = []
        whole = []
        for t, chunks in zip(texts, split):
            try:
                out.append((b"".join(map(a_known.__getitem__, chunks)), b"".join(map(b_known.__getitem__, chunks))))
            except TypeError:  # a chunk that can't stand alone
                if t:
                    whole.append(len(out))
                out.append(None)
        for i, found in zip(whole, self.both([texts[i] for i in whole])):
            out[i] = found
        for c in new:
            if len(c) > LONGEST_KEPT:
                del a_known[c], b_known[c]
        return out


WHITE = re.compile(r"\s")


def tokenizer_pair(a_path: str, b_path: str) -> TokenizerPair:
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = TokenizerPair(a_path, b_path)
    return _pairs[a_path, b_path]


class Bitset:
    """Marked places in packed 64-bit words, with ranks by popcount."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @classmethod
    def at(cls, places: np.ndarray, n: int) -> Bitset:
        """places below n are marked."""
        flags = np.zeros(n + -n % 64, np.uint8)
        flags[places] = 1
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def __and__(self, other: Bitset) -> Bitset:
        return Bitset(self.words & other.words)

    def select(self) -> np.ndarray:
        """All marked places."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many marks stand before each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class Aligned:
    """A block of texts that have tokens, aligned: ids of both sides, ends of groups as numbers of tokens, and ends of documents as numbers of groups."""

    def __init__(self, pair: TokenizerPair, coded: list[tuple[bytes, bytes]]):
        self.pair = pair
        self.a, self.b = (np.frombuffer(b"".join(c[k] for c in coded), np.uint32).astype(np.int64) for k in (0, 1))
        a_ends, b_ends = np.cumsum(pair.a_sizes[self.a]), np.cumsum(pair.b_sizes[self.b])
        self.doc_a, self.doc_b = (np.cumsum([len(c[k]) // 4 for c in coded]) for k in (0, 1))
        n = int(a_ends[-1])
        a_marks, b_marks = Bitset.at(a_ends - 1, n), Bitset.at(b_ends - 1, n)
        cuts = a_marks & b_marks
        at = cuts.select()
        self.a_cuts, self.b_cuts = a_marks.rank(at) + 1, b_marks.rank(at) + 1
        self.doc_groups = cuts.rank(a_ends[self.doc_a - 1] - 1) + 1
        self.a_n, self.b_n = np.diff(self.a_cuts, prepend=0), np.diff(self.b_cuts, prepend=0)

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of each group."""
        total = np.concatenate(([0], np.cumsum(values)))[self.doc_groups]
        return np.diff(total, prepend=0)

    def link_counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document (its place in the block), pair (id of A times the vocabulary of B, plus id of B) and number of links of each, in order; a pair once a document."""
        width, scale = len(self.pair.b_bytes), len(self.pair.a_bytes) * len(self.pair.b_bytes)
        n = self.a_n * self.b_n
        doc = np.repeat(np.arange(len(self.doc_groups)), np.diff(self.doc_groups, prepend=0))
        listed = np.flatnonzero(n <= LISTED)
        group = np.repeat(listed, n[listed])
        k = np.arange(len(group)) - np.repeat(np.cumsum(n[listed]) - n[listed], n[listed])
        i, j = np.divmod(k, self.b_n[group])
        keys = doc[group] * scale + self.a[self.a_cuts[group] - self.a_n[group] + i] * width + self.b[self.b_cuts[group] - self.b_n[group] + j]
        keys, times = np.unique(keys, return_counts=True)
        large = np.flatnonzero(n > LISTED)
        if len(large):  # long runs without a shared cut: distinct ids of both sides with their counts
            keys, times = [keys], [times]
            for g in large:
                (a, a_times), (b, b_times) = (np.unique(ids[e - m : e], return_counts=True) for ids, e, m in ((self.a, self.a_cuts[g], self.a_n[g]), (self.b, self.b_cuts[g], self.b_n[g])))
                keys.append((doc[g] * scale + a[:, None] * width + b).ravel())
                times.append((a_times[:, None] * b_times).ravel())
            keys, place = np.unique(np.concatenate(keys), return_inverse=True)
            times = np.bincount(place, np.concatenate(times)).astype(np.int64)
        doc, keys = np.divmod(keys, scale)
        return doc, keys, times

    def written(self) -> Iterator[bytes]:
        """The groups of each document as text: A's ids, a bar, B's ids; groups are parted by semicolons."""
        texts, sizes = signs(len(self.pair.a_bytes), len(self.pair.b_bytes))
        group_a, group_b = (np.repeat(np.arange(len(n)), n) for n in (self.a_n, self.b_n))
        a, b = np.arange(len(self.a)), np.arange(len(self.b))
        order = np.empty(len(a) + len(b), np.int64)
        order[a + (self.b_cuts - self.b_n)[group_a]] = 2 * self.a + (a + 1 == self.a_cuts[group_a])
        order[b + self.a_cuts[group_b]] = 2 * (len(self.pair.a_bytes) + self.b) + (b + 1 == self.b_cuts[group_b])
        characters = texts[order]
        run = characters[characters != 0].tobytes()
        ends = np.cumsum(sizes[order])[self.doc_a + self.doc_b - 1].tolist()
        for start, end in zip([0, *ends], ends):
            yield run[start : end - 1]


_signs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def signs(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Each id's decimal with a comma, and with its group's closing mark (a bar after A's, a semicolon after B's), padded with zeros; and their lengths."""
    if (a, b) not in _signs:
        made = [f"{i}{mark}".encode() for n, last in ((a, "|"), (b, ";")) for i in range(n) for mark in (",", last)]
        width = max(map(len, made))
        _signs[a, b] = np.frombuffer(b"".join(m.ljust(width, b"\0") for m in made), np.uint8).reshape(-1, width), np.array([len(m) for m in made])
    return _signs[a, b]


def aligned_rows(docs: DataFrame, fields: str, of: Callable[[Aligned | None, int], dict[str, list]], a_path: str | None, b_path: str | None) -> DataFrame:
    """Rows of docs with doc_id and the fields that of gives for a block; of(None, n) gives those of n documents without tokens. Texts don't move."""
    a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    kinds = pa.schema([pa.field(f.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}[f.split()[1]]) for f in fields.split(", ")])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizer_pair(a_path, b_path)
        for batch in batches:
            doc_ids, at = batch.column("doc_id"), 0
            for texts in text_blocks(batch.column("text").to_pylist(), BLOCK_CHARS):
                coded = pair.encode(texts)
                some = [k for k, c in enumerate(coded) if c]
                none = [k for k, c in enumerate(coded) if not c]
                ids = doc_ids.slice(at, len(texts))
                at += len(texts)
                for places, block in ((some, Aligned(pair, [coded[k] for k in some]) if some else None), (none, None)):
                    if places:
                        own = of(block, len(places)) | {"doc_id": ids.take(pa.array(places))}
                        yield pa.RecordBatch.from_arrays([own[f.name] if f.name == "doc_id" else pa.array(own[f.name], f.type) for f in kinds], schema=kinds)

    return doc_texts(docs).mapInArrow(align, fields)


def alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, a_ids, b_ids, a_cuts and b_cuts of each document: group k has A's tokens a_cuts[k - 1] to before a_cuts[k] (from 0 on), and B's likewise.

    Texts that are null, empty, or not given back byte by byte by both tokenizers have empty arrays. Repeated rows give repeated results.
    """

    def arrays(block: Aligned | None, n: int) -> dict[str, list]:
        names = ("a_ids", "b_ids", "a_cuts", "b_cuts")
        if block is None:
            return dict.fromkeys(names, [[]] * n)
        out = {"a_ids": np.split(block.a.astype(np.int32), block.doc_a[:-1]), "b_ids": np.split(block.b.astype(np.int32), block.doc_b[:-1])}
        for c, cuts, ends in (("a_cuts", block.a_cuts, block.doc_a), ("b_cuts", block.b_cuts, block.doc_b)):
            out[c] = [(own - start).astype(np.int32) for own, start in zip(np.split(cuts, block.doc_groups[:-1]), [0, *ends])]
        return out

    return aligned_rows(docs, "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>", arrays, a_path, b_path)


def linked(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """A row a document: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct pairs with their numbers of links, packed.

    Documents without tokens have zeros and no digest ('').
    """
    state = {"next": 0}

    def digests(block: Aligned | None, n: int) -> dict[str, list]:
        from pyspark import TaskContext

        task = TaskContext.get()
        if state.get("task") != task.taskAttemptId():
            state.update(task=task.taskAttemptId(), next=task.partitionId() << 40)
        first = state["next"]
        state["next"] += n
        out = {"row": range(first, first + n)}
        if block is None:
            return out | {c: [0] * n for c in ("n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": [""] * n, "pairs": [b""] * n, "times": [b""] * n}
        doc, keys, times = block.link_counts()
        ends = np.searchsorted(doc, np.arange(n), side="right")
        parts = lambda values, kind: [p.tobytes() for p in np.split(values.astype(kind), ends[:-1])]
        wide = len(block.pair.a_bytes) * len(block.pair.b_bytes) >= 1 << 32
        return out | {
            "n_a": np.diff(block.doc_a, prepend=0), "n_b": np.diff(block.doc_b, prepend=0), "n_groups": np.diff(block.doc_groups, prepend=0), "n_links": block.per_doc(block.a_n * block.b_n),
            "groups_sha256": [hashlib.sha256(w).hexdigest() for w in block.written()], "pairs": parts(keys, "<u8" if wide else "<u4"), "times": parts(times, "<u4"),
        }

    return aligned_rows(docs, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary", digests, a_path, b_path)


def unpacked(pairs: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Pairs, which take 4 or 8 bytes by the size of both vocabularies, and their numbers of links, which take 4."""
    return np.frombuffer(pairs, "<u8" if len(pairs) > len(times) else "<u4").astype(np.int64), np.frombuffer(times, "<u4").astype(np.int64)


def pair_counts(links: DataFrame) -> DataFrame:
    """pair and n, the number of documents that hold it linked. Tasks count before the shuffle, in bounded memory."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        fresh, n = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([held[0], *fresh]), return_inverse=True)
            return keys, np.bincount(place[len(held[0]) :], minlength=len(keys)) + np.bincount(place[: len(held[0])], held[1], len(keys)).astype(np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(held[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in held], ["pair", "n"])

        for b in batches:
            for own in zip(b.column("pairs").to_pylist(), b.column("times").to_pylist()):
                fresh.append(unpacked(*own)[0])
                n += len(fresh[-1])
                if n > MOST_HELD:
                    held, fresh, n = merged(), [], 0
                    if len(held[0]) > MOST_HELD:
                        yield from rows()
                        held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held = merged()
        yield from rows()

    return links.select("pairs", "times").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def graded(counts: DataFrame, width: int) -> DataFrame:
    """counts with best: whether no pair of the same id of A is in more documents. Ids of A are as many as its vocabulary, so their greatest counts are sent to all tasks."""
    a = F.expr(f"pair div {width}")
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(links: DataFrame, width: int, shipped: int = MOST_SHIPPED) -> DataFrame:
    """links (stored) with n_best and count_sum in place of the pairs; a row each."""
    spark = links.sparkSession
    counts = stored(graded(stored(pair_counts(links), "pair-counts"), width), "graded-pairs")
    most = counts.orderBy(F.col("n").desc(), "pair").limit(shipped).toArrow().sort_by("pair")
    known = spark.sparkContext.broadcast((np.append(most["pair"].to_numpy(), -1), np.append(most["n"].to_numpy(), 0), np.append(most["best"].to_numpy(), False)))
    names = [c for c in links.columns if c not in ("pairs", "times")]
    kinds = {f.name: f.dataType.simpleString() for f in links.schema}

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n_docs, best = known.value
        for b in batches:
            n_best, count_sum, row, rest, rest_times = [], [], [], [], []
            for k, own, times in zip(b.column("row").to_pylist(), b.column("pairs").to_pylist(), b.column("times").to_pylist()):
                own, times = unpacked(own, times)
                at = np.searchsorted(pairs[:-1], own)
                hit = pairs[at] == own
                n_best.append(int(times @ (best[at] & hit)))
                count_sum.append(int(times @ (n_docs[at] * hit)))
                if not hit.all():
                    rest.append(own[~hit])
                    rest_times.append(times[~hit])
                    row.append(np.full(len(rest[-1]), k))
            yield of({c: b.column(c) for c in names} | {"n_best": n_best, "count_sum": count_sum}, b.num_rows)
            if rest:
                yield of({"rest_row": np.concatenate(row), "pair": np.concatenate(rest), "times": np.concatenate(rest_times)}, sum(map(len, rest)))

    fields = {c: kinds[c] for c in names} | dict.fromkeys(("n_best", "count_sum", "rest_row", "pair", "times"), "bigint")

    def of(columns: dict, n: int) -> pa.RecordBatch:
        arrow = {"bigint": pa.int64(), "string": pa.string()}
        made = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], arrow[t]) if c in columns else pa.nulls(n, arrow[t]) for c, t in fields.items()]
        return pa.RecordBatch.from_arrays(made, list(fields))

    found = stored(links.mapInArrow(look_up, ", ".join(f"{c} {t}" for c, t in fields.items())), "linked-counts")
    rest = found.where(F.col("pair").isNotNull()).select(F.col("rest_row").alias("row"), "pair", "times").join(counts, "pair")
    more = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    whole = found.where(F.col("pair").isNull()).select(*names, "n_best", "count_sum").join(more, "row", "left")
    return whole.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).drop("more_best", "more_sum")


def vocabulary_of_b(a_path: str | None = None, b_path: str | None = None) -> int:
    return tokenizer_pair(a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")).b.get_piece_size()


def link_table(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """a_id, b_id, n_docs and best of all pairs that are linked in docs: a table of tokens of one vocabulary in terms of the other."""
    width = vocabulary_of_b(a_path, b_path)
    counts = stored(pair_counts(stored(linked(docs, a_path, b_path), "links")), "pair-counts")
    return graded(counts, width).select(F.expr(f"pair div {width}").alias("a_id"), (F.col("pair") % width).alias("b_id"), F.col("n").alias("n_docs"), "best")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents aligned, their links scored by the corpus-wide counts of pairs."""
    links = stored(linked(table(spark, sf_dir, "documents")), "links")
    return scored(links, vocabulary_of_b()).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
