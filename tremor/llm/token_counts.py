"""Token counts: byte-pair merging with a heap and a linked list; only the number of tokens is kept.

Each chunk of a text starts as a linked list of its code points. A heap holds the adjacent pairs
that are pieces of the vocabulary, keyed by rank and then place; the lowest is popped and merged until none
is left. The count is the initial symbols minus the merges; a code point outside the vocabulary counts
its UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import blocks, doc_texts, table

SPACE = "▁"
#: Entries of a worker's memory of chunks, and the longest chunk it keeps; a full memory starts anew.
MEMORY, LONGEST_KEPT = 600_000, 48
_counters: dict[str, PieceCounter] = {}


class PieceCounter(dict):
    """Chunk (a word after a blank, or a line end with the word after it) to its number of tokens."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        kept = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        by_score = sorted(kept, key=lambda i: (-sp.get_score(i), i))
        self.ranks = {sp.id_to_piece(i): r for r, i in enumerate(by_score)}
        pieces = list(self.ranks)
        if sp.encode("a  b") != sp.encode("a  b".replace(" ", SPACE)) or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("the model joins pieces across blanks, or folds them; its texts can't be cut there")
        self.cut_lines = not any("\n" in p for p in pieces)

    def __missing__(self, chunk: str) -> int:
        n = self.merged(chunk if chunk[:1] == "\n" else SPACE + chunk)
        if len(chunk) <= LONGEST_KEPT:
            if len(self) >= MEMORY:
                self.clear()
            self[chunk] = n
        return n

    def merged(self, symbols: str) -> int:
        ranks, n = self.ranks, len(symbols)
        count = n + sum(len(c.encode()) - 1 for c in symbols if c not in ranks)
        rank_at = [ranks.get(symbols[i : i + 2], -1) for i in range(n - 1)]
        rank_at.append(-1)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the symbol that starts here
        heap = [r * n + i for i, r in enumerate(rank_at) if r >= 0]
        heapify(heap)
        while heap:
            rank, i = divmod(heappop(heap), n)
            if rank_at[i] != rank:
                continue  # one of the two has been merged since
            j = end[i]
            stop = end[i] = end[j]
            rank_at[j] = -1
            count -= 1
            if stop < n:
                before[stop] = i
                if (r := ranks.get(symbols[i : end[stop]], -1)) >= 0:
                    heappush(heap, r * n + i)
                rank_at[i] = r
            else:
                rank_at[i] = -1
            if (p := before[i]) >= 0:
                if (r := ranks.get(symbols[p:stop], -1)) >= 0:
                    heappush(heap, r * n + p)
                rank_at[p] = r
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        chunks = (text.replace("\n", " \n") if self.cut_lines else text).split(" ")
        if "" in chunks or SPACE in text:  # runs of blanks are pieces of their own
            return sum(map(self.merged, re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))))
        return sum(map(self.__getitem__, chunks))


def counter(model: str) -> PieceCounter:
    if model not in _counters:
        _counters[model] = PieceCounter(model)
    return _counters[model]


def token_counts(docs: DataFrame, model: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of docs (doc_id, text; other columns are left out).

    A null or empty text has 0 bytes and 0 tokens. Repeated rows give repeated results, an empty
    table an empty one. Texts are counted whole, in one pass without a shuffle; memory is bounded by
    a block of texts and the worker's memory of chunks.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path).count
        for batch in batches:
            for b in blocks(batch, "text"):
                n = [of(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    texts = doc_texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return texts.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_counts of all documents."""
    return token_counts(table(spark, sf_dir, "documents"))
