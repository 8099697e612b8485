"""Token ids in Arrow's file format: fixed-size-list batches, read back by memory map or by a store's reader.

Each part of the corpus (a range of doc_id) is one file. Its ids, end marks included, form one run that is cut
into sequences of equal length; a row holds a sequence and its mask, which is true where the row has an id
(only the last row of a file is padded). A second file beside it holds doc_id, start and n_tokens of each document. So
the ids at any place of the corpus are found by arithmetic: MappedIds maps files of a mounted folder into memory and gives any sequence
or run of ids without a copy. In other stores the files are read batch by batch.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from unicodedata import is_normalized

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import doc_texts, stored, table, text_blocks
from tremor.sources.shared import new_path

#: Entries of a worker's memories of words and of their parts, and the longest word it keeps; a full memory starts anew.
MEMORY, LONGEST_KEPT = 600_000, 48
SEQUENCE, ROWS = 2048, 256  # ids of a sequence, sequences of a record batch
#: Texts handled at once, by characters.
BLOCK_CHARS = 500_000
#: Marks that end words; a run of them is a token run of its own to the tokenizer, as are the letters before it.
MARKS = ".,!?;:|*#$%&"
_coders: dict[str, WordCoder] = {}


class Words(dict):
    """Word to its ids; a word that isn't known is asked for once, and kept if it is short."""

    def __init__(self, of: Callable[[str], bytes]):
        self.of = of

    def __missing__(self, word: str) -> bytes:
        ids = self.of(word)
        if len(word) <= LONGEST_KEPT:
            self[word] = ids
        return ids


class WordCoder:
    """Encodes texts by a tokenizer that drops white space and small-letters A-Z, word by word, so that the library sees a word once.

    Of a word that is letters and then marks, the letters and the marks are remembered each.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_file(path), Words(self.of_word)
        self.letters, self.others = Words(self.of_letters), Words(self.of_text)
        joined = lambda *texts: b"".join(map(self.of_text, texts))
        self.by_word = joined("a b") == joined("a", "b")
        self.by_part = all(joined(f"Ab{m}.") == joined("ab", f"{m}.") for m in MARKS)
        self.by_letters = all(self.of_letters(plain_letters(w)) == joined(w) for w in ("a", "Hello", "unbelievably", "Éléphant", "ÑANDÚ", "straße", "Δοκιμή", "ПРИВЕТ"))

    def of_letters(self, part: str) -> bytes:
        """The ids of small letters: straight from the library's model, since nothing else of the tokenizer changes them."""
        text = part if part.isascii() else "".join(map(BYTE_LETTERS.__getitem__, part.encode()))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(text)]).tobytes()

    def of_text(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def of_word(self, word: str) -> bytes:
        head = word.rstrip(MARKS)
        small = plain_letters(head) if self.by_part else None
        if small is None:
            return self.of_text(word)
        ids = self.letters[small] if self.by_letters else self.others[head]
        return ids + self.others[word[len(head) :]] if len(head) < len(word) else ids

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return list(map(self.of_text, texts))
        for memory in (self.words, self.letters, self.others):
            if len(memory) > MEMORY:
                memory.clear()
        # str.split() also cuts at four control characters that aren't white space to the tokenizer
        return [b"".join(map(self.words.__getitem__, [t] if ODD.search(t) else t.split())) for t in texts]


ODD = re.compile("[\x1c-\x1f]")


def plain_letters(word: str) -> str | None:
    """A word of letters, in small ones, if that and its bytes are all that the tokenizer makes of it: ASCII, or Latin, Greek and Cyrillic in composed form."""
    if not word.isalpha():
        return None
    if word.isascii():
        return word.lower()
    small = "".join(map(str.lower, word))
    return small if max(word) < "\u0530" and small.isalpha() and is_normalized("NFC", word) else None


def byte_letters() -> list[str]:
    """The character that byte-level tokenizers write for each byte: itself if it prints, else the next one from 256 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in printing else next(others)) for b in range(256)]


BYTE_LETTERS = byte_letters()


def coder(path: str) -> WordCoder:
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_file(fs: pafs.FileSystem, path: str, batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> None:
    """Written under a name of its own and moved, so that a lost or doubled attempt leaves no half file."""
    own = f"{path}.{os.getpid()}-{os.urandom(4).hex()}"
    with fs.open_output_stream(own) as out, pa.ipc.new_file(out, schema) as writer:
        for b in batches:
            writer.write_batch(b)
    fs.move(own, path)


def sequences(ids: Iterator[np.ndarray], dtype: pa.DataType, length: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Record batches of (ids, mask), fixed-size lists of length; the last row of all is padded with 0."""
    kind, held, n = dtype.to_pandas_dtype(), [], 0
    for a in ids:
        held.append(a.astype(kind))
        n += len(a)
        while n >= length * rows:
            run = np.concatenate(held)
            yield batch_of(run[: length * rows], length, dtype)
            held, n = [run[length * rows :]], n - length * rows
    if n:
        yield batch_of(np.concatenate(held), length, dtype)


def batch_of(run: np.ndarray, length: int, dtype: pa.DataType) -> pa.RecordBatch:
    pad = -len(run) % length
    mask = np.ones(len(run) + pad, bool)
    mask[len(run) :] = False
    lists = [pa.FixedSizeListArray.from_arrays(a, length) for a in (pa.array(np.append(run, np.zeros(pad, run.dtype)), dtype), pa.array(mask))]
    return pa.RecordBatch.from_arrays(lists, ["ids", "mask"])


def schema_of(dtype: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(dtype, length)), ("mask", pa.list_(pa.bool_(), length))])


def opened(fs: pafs.FileSystem, path: str) -> pa.NativeFile:
    """A file to read: mapped into memory where it is local."""
    return pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)


class MappedIds:
    """Random access to the ids of local or mounted files, in order, as write_ids lists them (file and n_tokens of each). Without files there are no sequences, and tokens(0, 0) is empty."""

    def __init__(self, files: Sequence[tuple[str, int]]):
        self.readers = [pa.ipc.open_file(pa.memory_map(f)) for f, _ in files]
        self.tokens_before = np.concatenate(([0], np.cumsum([n for _, n in files], dtype=np.int64)))
        self.length = self.readers[0].schema.field("ids").type.list_size if files else 1
        self.sequences_before = np.concatenate(([0], np.cumsum([-(-n // self.length) for _, n in files], dtype=np.int64)))
        self.rows = [r.get_batch(0).num_rows for r in self.readers]  # all batches of a file but the last are as large as the first

    def __len__(self) -> int:
        return int(self.sequences_before[-1])

    def run(self, file: int, sequence: int, column: str) -> pa.Array:
        """The values of a file's sequence: a slice of the map."""
        batch = self.readers[file].get_batch(sequence // self.rows[file])
        lists = batch.column(column)
        return lists.values.slice((lists.offset + sequence % self.rows[file]) * self.length, self.length)

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the map) and mask of the k-th sequence of all files."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        file = int(np.searchsorted(self.sequences_before, k, side="right")) - 1
        k -= int(self.sequences_before[file])
        return self.run(file, k, "ids").to_numpy(), self.run(file, k, "mask").to_numpy(zero_copy_only=False)

    def tokens(self, first: int, end: int) -> np.ndarray:
        """The ids from place first to before end of all files: a view of the map if they stand in one sequence, else joined views."""
        if not 0 <= first <= end <= self.tokens_before[-1]:
            raise IndexError((first, end))
        parts, at = [], first
        while at < end:
            file = int(np.searchsorted(self.tokens_before, at, side="right")) - 1
            place = at - int(self.tokens_before[file])
            stop = min(end - at, self.length - place % self.length, int(self.tokens_before[file + 1]) - at)
            parts.append(self.run(file, place // self.length, "ids").to_numpy()[place % self.length :][:stop])
            at += stop
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_ids(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, length: int = SEQUENCE, rows: int = ROWS) -> DataFrame:
    """Writes docs (doc_id, text) as Arrow files under folder, in ascending doc_id; gives part, file, n_docs, n_tokens and first of each.

    A null or empty text gives its end mark alone. Null doc_ids come first; they, and rows of one doc_id, stand in order of their texts' hashes,
    so that many of them are dealt over several parts. An empty table writes no file. Parts are ranges of doc_id of about equal size; a task holds one record batch
    and one document. folder must be shared by all executors, in any store that pyarrow.fs opens.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    store(folder)[0].create_dir(store(folder)[1])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(folder)
        from pyspark import TaskContext

        part, docs, total, end = TaskContext.get().partitionId(), [], 0, np.array([end_id], "<u4").tobytes()
        dtype = pa.uint16() if coder(path).tokenizer.get_vocab_size() <= 65536 and end_id < 65536 else pa.uint32()

        def runs() -> Iterator[np.ndarray]:
            nonlocal total
            for b in batches:
                doc_ids = iter(b.column("doc_id").to_pylist())
                for texts in text_blocks(b.column("text").to_pylist(), BLOCK_CHARS):
                    for ids, doc_id in zip(coder(path).encode(texts), doc_ids):
                        run = np.frombuffer(ids + end, "<u4")
                        docs.append((doc_id, total, len(run)))
                        total += len(run)
                        yield run

        name = f"{base}/part-{part:06d}"
        made = sequences(runs(), dtype, length, rows)
        first = next(made, None)
        if first is None:
            return
        write_file(fs, f"{name}.arrow", (x for y in ([first], made) for x in y), schema_of(dtype, length))
        index = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*docs)], ["doc_id", "start", "n_tokens"])
        write_file(fs, f"{name}.index.arrow", iter([index]), index.schema)
        yield pa.RecordBatch.from_pylist([{"part": part, "file": f"{name}.arrow", "n_docs": len(docs), "n_tokens": total, "first": docs[0][0]}])

    # dealt before encoding, since the sample that finds the ranges runs what stands above it
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = doc_texts(docs).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return stored(dealt.mapInArrow(write, "part long, file string, n_docs long, n_tokens long, first long"), "id-files")


def read_ids(spark: SparkSession, files: DataFrame, folder: str, fields: str, of: Callable) -> DataFrame:
    """Reads the files that write_ids lists: of(doc_id, start in the corpus, ids) of each document, as rows of fields.

    The start of a file is the sum of the files before it, taken from the list of files alone. A file is read a record
    batch at a time; only the ids of the document at hand are kept.
    """
    from pyspark.sql import Window

    listed = files.select("part", "file", "n_tokens")
    # one row a file: its window holds the list of files, not the ids
    starts = listed.withColumn("before", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    names = [f.split()[0] for f in fields.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = store(folder)
        for b in batches:
            for file, before in zip(b.column("file").to_pylist(), b.column("before").to_pylist()):
                with opened(fs, file.removesuffix(".arrow") + ".index.arrow") as f:
                    index = pa.ipc.open_file(f).read_all()
                with opened(fs, file) as f:
                    yield from read_file(pa.ipc.open_file(f), index, before)

    def read_file(reader: pa.RecordBatchFileReader, index: pa.Table, before: int) -> Iterator[pa.RecordBatch]:
        batch, held, at, out = -1, np.zeros(0, np.uint32), 0, []  # held: ids from place at on
        for doc_id, start, n in zip(*(index.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens"))):
            held, at = held[start - at :], start
            parts, have = [held], len(held)
            while have < n:
                batch += 1
                row = reader.get_batch(batch)
                run = row.column("ids").flatten().to_numpy()
                if batch == reader.num_record_batches - 1:
                    run = run[row.column("mask").flatten().to_numpy(zero_copy_only=False)]
                parts.append(run)
                have += len(run)
            held = np.concatenate(parts) if len(parts) > 1 else held
            out.append(of(doc_id, before + start, held[:n]))
            if len(out) == 2000:
                yield rows_of(out)
                out = []
        if out:
            yield rows_of(out)

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)

    # the rows are few and short; dealt out anew, so that the files are read by many tasks
    return starts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").mapInArrow(read, fields)


def crc_row(doc_id: int | None, start: int, ids: np.ndarray) -> tuple:
    return doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())


def op6_arrow_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written by write_ids and read back by read_ids."""
    folder = new_path(spark, "arrow-ids")
    files = write_ids(table(spark, sf_dir, "documents"), folder)
    return read_ids(spark, files, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", crc_row)
