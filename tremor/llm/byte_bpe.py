"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The pre-tokens of a block of texts are linked lists of byte runs, side by side in arrays. A bucket
per merge rank holds the list positions of its pairs; a two-level bitmap of the ranks that have a
bucket gives the next rank by find-first-set. A popped bucket is merged at once: stale positions, whose pair
has changed since they were queued, are skipped, and of pairs that overlap the left one wins. So the cost is a few
array operations a rank and a few elements a merge, however long a pre-token is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tremor.llm.common import blocks, doc_texts, table

#: Entries of a worker's memory of pre-tokens, and the longest it keeps; a full memory starts anew.
MEMORY, LONGEST_KEPT = 250_000, 48
_coders: dict[str, ByteCoder] = {}


class RankQueue:
    """Buckets of list positions by rank, the lowest rank first."""

    def __init__(self, n_ranks: int):
        self.top, self.low, self.buckets = 0, [0] * ((n_ranks >> 8) + 1), {}

    def put(self, ranks: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for r, own in zip(ranks[np.concatenate(([0], cuts))].tolist() if len(ranks) else [], np.split(places, cuts)):
            if r in self.buckets:
                self.buckets[r].append(own)
            else:
                self.buckets[r] = [own]
                self.top |= 1 << (r >> 8)
                self.low[r >> 8] |= 1 << (r & 255)

    def pop(self) -> tuple[int, np.ndarray]:
        h = (self.top & -self.top).bit_length() - 1
        bits = self.low[h]
        r = (h << 8) + (bits & -bits).bit_length() - 1
        self.low[h] = bits & (bits - 1)
        if not self.low[h]:
            self.top &= self.top - 1
        own = self.buckets.pop(r)
        return r, np.unique(np.concatenate(own))


class ByteCoder:
    """Encodes and decodes by a file of ranks; memory: pre-token to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks_file: str):
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}
        self.size = max(ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, r in ranks.items():
            self.bytes_of[r] = token
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, r in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = r
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged_rank = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        #: Ranks whose merge can make a pair of a lower rank: these are merged one by one in a pre-token, others at once.
        self.falls = np.zeros(self.size, bool)
        for part in (self.keys // self.size, self.keys % self.size):
            self.falls[part[self.merged_rank < part]] = True
        self.whole, self.memory = ranks, {}
        self.find = regex.compile(public_tokenizers.PATTERN).findall

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.merged_rank[at], -1)

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each of these pre-tokens, none of them empty."""
        if not pieces:
            return []
        sizes = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n, last = len(data), np.cumsum(sizes)
        token, place = self.byte_rank[data], np.arange(n)
        end, before, stop_of = place + 1, place - 1, np.repeat(last, sizes)
        before[last - sizes] = -1
        alive, rank_at = np.ones(n, bool), np.full(n, -1)
        inner = np.flatnonzero(end < stop_of)
        rank_at[inner] = self.rank_of(token[inner], token[inner + 1])
        queue = RankQueue(self.size)
        queued = inner[rank_at[inner] >= 0]
        queue.put(rank_at[queued], queued)
        while queue.top:
            r, i = queue.pop()
            i = i[rank_at[i] == r]
            if not len(i):
                continue
            if len(i) > 1:
                if not self.falls[r]:  # in a run of overlapping pairs every second one goes
                    fresh = np.concatenate(([True], i[1:] != end[i[:-1]]))
                    at = np.arange(len(i))
                    taken = (at - np.maximum.accumulate(np.where(fresh, at, 0))) % 2 == 0
                else:  # the first of each pre-token, and then the queue again
                    taken = np.concatenate(([True], stop_of[i[1:]] != stop_of[i[:-1]]))
                    if not taken.all():
                        queue.put(np.full(int((~taken).sum()), r), i[~taken])
                i = i[taken]
            j = end[i]
            stop = end[i] = end[j]
            token[i], rank_at[j], alive[j], rank_at[i] = r, -1, False, -1
            more = stop < stop_of[i]
            right, after = i[more], stop[more]
            before[after] = right
            left = before[i]
            left = left[left >= 0]
            changed = np.concatenate((right, left))
            rank_at[changed] = ranks = self.rank_of(token[changed], token[end[changed]])
            if len(queued := changed[ranks >= 0]):
                queue.put(ranks[ranks >= 0], queued)
        ids, ends = token[alive].astype("<u4").tobytes(), (np.cumsum(alive)[last - 1] * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Texts share the work on the pre-tokens that are new to this worker."""
        split, memory = [self.find(t) for t in texts], self.memory
        if len(memory) > MEMORY:
            memory.clear()
        new = list(set().union(*split).difference(memory))
        if new:
            raw = [p.encode() for p in new]
            single = [self.whole.get(p) for p in raw]
            found = dict(zip((p for p, s in zip(new, single) if s is None), self.merged([p for p, s in zip(raw, single) if s is None])))
            found |= {p: s.to_bytes(4, "little") for p, s in zip(new, single) if s is not None}
            memory.update(found)
        out = [b"".join(map(memory.__getitem__, pieces)) for pieces in split]
        for p in new:
            if len(p) > LONGEST_KEPT:
                del memory[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def coder(ranks_file: str) -> ByteCoder:
    if ranks_file not in _coders:
        _coders[ranks_file] = ByteCoder(ranks_file)
    return _coders[ranks_file]


def default_ranks() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encoded(docs: DataFrame, ranks_file: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and n_tokens of each row of docs (doc_id, text).

    A null or empty text has no ids. Repeated rows give repeated results; other columns are left out. One pass
    without a shuffle; memory is bounded by a block of texts and the worker's memory of pre-tokens.
    """
    path = ranks_file or default_ranks()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, "text"):
                ids = coder(path).encode(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    return doc_texts(docs).mapInArrow(encode, "doc_id long, ids binary, n_tokens long")


def decoded(tokens: DataFrame, ranks_file: str | None = None) -> DataFrame:
    """doc_id and the text of each row of tokens (doc_id, ids as in encoded); null ids give the empty text.

    Ids that end inside a code point decode to the replacement character there.
    """
    path = ranks_file or default_ranks()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = coder(path).decode
        for b in batches:
            out = [text(x or b"").decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def round_trip(docs: DataFrame, ranks_file: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs: encodes, then decodes the ids again.

    A null or empty text has 0 tokens and the digests of nothing. One pass without a shuffle.
    """
    path = ranks_file or default_ranks()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, "text"):
                ids = coder(path).encode(b.column("text").to_pylist())
                sums = [pa.array([hashlib.sha256(f(x)).hexdigest() for x in ids], pa.string()) for f in (bytes, coder(path).decode)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), *sums], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    # in one worker a task, which holds the only memory of pre-tokens
    return doc_texts(docs).mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """round_trip of all documents."""
    return round_trip(table(spark, sf_dir, "documents"))
