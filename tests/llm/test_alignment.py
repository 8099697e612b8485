"""Alignment against the libraries and a plain loop over byte offsets."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tremor.llm import alignment
from tremor.llm.common import stored, table

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
A = Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
WIDTH = B.get_piece_size()
#: Byte-level letters stand for themselves where they print, others follow from code point 256 on.
PRINTING = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE = {chr(b): b for b in PRINTING} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in PRINTING)}


def tokens(text):
    a = [(i, bytes(BYTE[c] for c in A.id_to_token(i))) for i in A.encode(f" {text}", add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        piece = B.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece[:3] == "<0x" else piece.replace("▁", " ").encode()))
    return a, b


def groups_of(text):
    if not text:
        return []
    a, b = tokens(text)
    whole = f" {text}".encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return []
    out, own_a, own_b, at_a, at_b, rest = [], [], [], 0, 0, iter(b)
    for i, x in a:
        own_a.append(i)
        at_a += len(x)
        while at_b < at_a:
            j, y = next(rest)
            own_b.append(j)
            at_b += len(y)
        if at_a == at_b:
            out.append((own_a, own_b))
            own_a, own_b = [], []
    return out


def brute(rows):
    groups = [(i, groups_of(t)) for i, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in groups]
    n = Counter(p for own in links for p in own)
    most = defaultdict(int)
    for (x, _), c in n.items():
        most[x] = max(most[x], c)
    out = []
    for (i, g), own in zip(groups, links):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        best = sum(k for p, k in own.items() if n[p] == most[p[0]])
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), best, sum(k * n[p] for p, k in own.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=key)


def key(row):
    return tuple((v is None, 0 if v is None else v) for v in row)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(links, shipped):
    return sorted((tuple(r) for r in alignment.scored(links, WIDTH, shipped).select(*COLUMNS).collect()), key=key)


@pytest.mark.parametrize("shipped", [0, 60, 200_000])
def test_links_and_counts(docs, texts, shipped):
    """With no pair sent to all tasks, some, and all of them."""
    assert got(stored(alignment.linked(docs.repartition(5)), "links"), shipped) == brute(texts)


def test_no_documents(none):
    assert alignment.scored(stored(alignment.linked(none), "links"), WIDTH).count() == 0
    assert alignment.alignment(none).count() == 0


def test_given_documents(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, path, "documents").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in alignment.op12_alignment(spark, path).select(*COLUMNS).collect()), key=key) == brute(rows)


def test_arrays_and_the_table_of_links(docs, texts):
    rows = {(r.doc_id, tuple(r.a_ids)): r for r in alignment.alignment(docs).collect()}
    for i, t in texts:
        want = groups_of(t)
        r = rows[i, tuple(x for a, _ in want for x in a)]
        a, b = [0, *r.a_cuts], [0, *r.b_cuts]
        assert [(r.a_ids[a[k] : a[k + 1]], r.b_ids[b[k] : b[k + 1]]) for k in range(len(r.a_cuts))] == want
    n = Counter(p for _, t in texts for p in {(x, y) for a, b in groups_of(t) for x in a for y in b})
    assert {(r.a_id, r.b_id): r.n_docs for r in alignment.link_table(docs).collect()} == n


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n▁aeintherå.,!'s\t\xa0")), max_size=50), min_size=1, max_size=4))
def test_any_texts(texts):
    pair = alignment.tokenizer_pair(A_PATH, B_PATH)
    assert pair.by_chunk
    coded = pair.encode(texts)
    wants = [groups_of(t) for t in texts]
    assert [c is not None for c in coded] == [bool(w) for w in wants]
    if some := [c for c in coded if c]:
        block, wants = alignment.Aligned(pair, some), [w for w in wants if w]
        assert [w.decode() for w in block.written()] == [";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in w) for w in wants]
        doc, keys, times = block.link_counts()
        assert list(zip(doc.tolist(), keys.tolist(), times.tolist())) == sorted((d, x * WIDTH + y, k) for d, w in enumerate(wants) for (x, y), k in Counter((x, y) for a, b in w for x in a for y in b).items())


def test_large_groups_are_counted_by_distinct_ids(monkeypatch):
    pair = alignment.tokenizer_pair(A_PATH, B_PATH)
    block = alignment.Aligned(pair, [c for c in pair.encode(["日本語 テキスト です🙂🙂", "unbelievably xxxxxxxxx yyyy", "x" * 997]) if c])
    want = block.link_counts()
    monkeypatch.setattr(alignment, "LISTED", 1)
    assert all((x == y).all() for x, y in zip(block.link_counts(), want))


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1))
def test_rank_and_select(places):
    places = np.array(sorted(places))
    marks = alignment.Bitset.at(places, 401)
    assert (marks.select() == places).all()
    assert marks.rank(np.arange(401)).tolist() == [int((places < k).sum()) for k in range(401)]
