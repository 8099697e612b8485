"""Token counts, byte BPE and Arrow files against the libraries, on odd texts."""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tremor.llm import arrow_ids, byte_bpe, token_counts
from tremor.sources.shared import new_path

MODEL, RANKS, WORD = P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
HF = Tokenizer.from_file(WORD)
TEXT = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n▁aeintherå.,!İ")), max_size=60)


def key(row):
    return tuple((v is None, 0 if v is None else v) for v in row)


def test_counts_are_the_library_s(docs, texts, none):
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs).collect()), key=key)
    want = [(i, len((t or "").encode()), n := len(SP.encode(t or "")), n > 4096) for i, t in texts]
    assert got == sorted(want, key=key)
    assert token_counts.token_counts(none).count() == 0


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_counts_of_any_text(text):
    assert token_counts.counter(MODEL).count(text) == len(SP.encode(text))


def test_byte_bpe_is_the_library_s(docs, texts, none):
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip(docs).collect()), key=key)
    want = []
    for i, t in texts:
        ids = TIK.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=key)
    assert byte_bpe.round_trip(none).count() == 0
    back = sorted(((r.doc_id, r.text) for r in byte_bpe.decoded(byte_bpe.encoded(docs)).collect()), key=key)
    assert back == sorted(((i, t or "") for i, t in texts), key=key)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_byte_bpe_of_any_texts(texts):
    for text, ids in zip(texts, byte_bpe.coder(RANKS).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == TIK.encode_ordinary(text)


def test_full_memories_change_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMORY", 3)
    monkeypatch.setattr(arrow_ids, "MEMORY", 3)
    coder, words = byte_bpe.ByteCoder(RANKS), arrow_ids.WordCoder(WORD)
    for text in ("one two three four", "two five six. seven", "one one eight", ""):
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == TIK.encode_ordinary(text)
        assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == HF.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_words_of_any_texts(texts):
    for text, ids in zip(texts, arrow_ids.coder(WORD).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == HF.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("length,rows", [(2048, 256), (7, 2)])
def test_arrow_files_hold_all_ids(spark, docs, texts, length, rows):
    folder = new_path(spark, "ids")
    files = arrow_ids.write_ids(docs, folder, length=length, rows=rows)
    got = [tuple(r) for r in arrow_ids.read_ids(spark, files, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", arrow_ids.crc_row).collect()]
    want, start = [], 0
    hashed = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    run = []
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, hashed[x[1] or ""])):
        ids = HF.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        run += ids
    assert sorted(got, key=lambda r: r[1]) == want
    mapped = arrow_ids.MappedIds([(r.file, r.n_tokens) for r in files.orderBy("part").collect()])
    rng = np.random.default_rng(0)
    for a, b in np.sort(rng.integers(0, len(run) + 1, (200, 2)), axis=1).tolist() + [[0, 0], [0, len(run)], [len(run)] * 2]:
        assert mapped.tokens(a, b).tolist() == run[a:b]
    kept = [ids[mask] for ids, mask in map(mapped.sequence, range(len(mapped)))]
    assert np.concatenate(kept).tolist() == run and all(len(mapped.sequence(k)[0]) == length for k in (0, len(mapped) - 1))
    assert not mapped.sequence(0)[0].flags.writeable and not mapped.sequence(0)[0].flags.owndata  # a view of the map
    with pytest.raises(IndexError):
        mapped.tokens(0, len(run) + 1)
    one = files.first()
    with pafs.LocalFileSystem().open_input_file(one.file) as f:
        reader = pa.ipc.open_file(f)
        assert reader.schema.field("ids").type.list_size == length and reader.get_batch(0).num_rows <= rows
        last = reader.get_batch(reader.num_record_batches - 1)
        assert sum(map(sum, last.column("mask").to_pylist())) == one.n_tokens - (reader.num_record_batches - 1) * length * rows


def test_no_documents_no_files(spark, none):
    folder = new_path(spark, "ids")
    files = arrow_ids.write_ids(none, folder)
    assert files.count() == 0 and arrow_ids.read_ids(spark, files, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", arrow_ids.crc_row).count() == 0
