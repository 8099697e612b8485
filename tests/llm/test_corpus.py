"""Learned and searching operators against brute force, on odd texts."""

from __future__ import annotations

import hashlib
import json
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.llm import class_lm, contamination, language_id, merkle, near_duplicates, quality, wrappers
from tests.llm.conftest import prose

DIR = "/root/testdata/sf0.001"


def key(row):
    return tuple((v is None, 0 if v is None else v) for v in row)


# Near duplicates


def shingle_set(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(rows):
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    sets = [shingle_set(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return {i: least[root(k)] for k, (i, _) in enumerate(rows)}


def edited(text, places):
    w = text.split()
    for p in places:
        w[p % len(w)] = f"edit{p}"
    return " ".join(w)


def test_groups_are_those_of_all_pairs(spark):
    base = prose(7, 150)
    rows = [(i, prose(i, 60)) for i in range(30)] + [(100 + i, edited(base, range(i % 5))) for i in range(40)] + [(200 + i, edited(base, [10 * i])) for i in range(14)]
    rows += [(300 + k, t) for k, t in enumerate(["", " ", "one two", "One  two", "one", base.upper(), "日本 " * 3])]
    got = {r.doc_id: r.class_id for r in near_duplicates.duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


@pytest.mark.parametrize("times", [5, 50, 500])
def test_pairs_whose_repeats_differ_are_found(spark, times):
    """100 pairs of texts at a similarity of about 0.96, of which one repeats its first 20 words: weights tell them apart, what counts as alike doesn't."""
    rng = random.Random(times)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(100):
        own = [rng.choice(words) for _ in range(400)]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join([*own[:20] * times, *own]))]
    rows += [(1000 + k, " ".join([*rows[0][1].split()[40 * k : 40 * k + 20] * times, *rows[0][1].split()])) for k in range(6)]  # both repeat, other lines
    got = {r.doc_id: r.class_id for r in near_duplicates.duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)
    assert all(got[2 * k + 1] == 2 * k for k in range(100))


def test_groups_of_odd_texts(docs, none, texts):
    got = near_duplicates.duplicate_groups(docs).collect()
    assert sorted((r.doc_id for r in got), key=lambda x: (x is None, x or 0)) == sorted((i for i, _ in texts), key=lambda x: (x is None, x or 0))
    by = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert by[200] == 100 and by[201] == 101 and by[1] == by[2] == by[3] == 0
    kept = near_duplicates.one_of_each_group(docs)
    assert kept.columns == docs.columns and kept.count() == len({r.group_key for r in got}) and {200, 201, 1}.isdisjoint(r.doc_id for r in kept.collect())
    assert near_duplicates.one_of_each_group(none).count() == 0
    assert near_duplicates.duplicate_groups(none).count() == 0


def test_rows_that_repeat_or_lack_a_key(spark):
    """Two unlike texts under one doc_id, a copy of one of them without a doc_id, an exact repeat, and rows that have no doc_id at all."""
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(1, a), (1, b), (None, edited(b, [3])), (None, c), (None, c), (5, edited(a, [7])), (1, a)]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, near_version int, near_id string")
    found = near_duplicates.grouped(docs).collect()
    keys = {}
    for r in found:
        keys.setdefault(r.group_key, []).append((r.doc_id, r.class_id))
    assert sorted((sorted(map(str, v)) for v in keys.values()), key=str) == sorted([["(1, 1)", "(1, 1)", "(5, 1)"], ["(1, 1)", "(None, 1)"], ["(None, None)", "(None, None)"]], key=str)
    kept = near_duplicates.one_of_each_group(docs)
    assert kept.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", a), ("1", b), ("None", c)])


def test_common_counts():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 9000, n)) for n in rng.integers(1, 6000, 40)]
    got = near_duplicates.common_counts(sets[:15], sets[15:])
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[15:]] for a in sets[:15]]).all()


@pytest.mark.parametrize("block", [500, 7])
def test_alike_pairs_of_a_crowded_bucket_are_found(spark, monkeypatch, block):
    """All texts share all buckets: 60 near copies, 60 unlike texts, and small groups of alike ones among them, a chain included."""
    monkeypatch.setattr(near_duplicates, "banded", lambda of, h, count, n_texts, bands, rows: np.zeros((n_texts, bands), np.uint64))
    monkeypatch.setattr(near_duplicates, "BLOCK_CLASSES", block)
    rows = [(i, edited(prose(700, 120), [i])) for i in range(60)] + [(1000 + i, prose(2000 + i, 120)) for i in range(60)]
    rows += [(3000 + 10 * i + j, edited(prose(3000 + i, 120), [40] * j)) for i in range(6) for j in range(2)]
    rows += [(4000 + j, edited(prose(5000, 120), list(range(10, 10 + 8 * j)))) for j in range(5)]
    got = {r.doc_id: r.class_id for r in near_duplicates.duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


def test_registers_agree_as_the_probability_jaccard():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2**63, 60).astype(np.uint64), None
    b = np.concatenate([a[:40], rng.integers(0, 2**63, 20).astype(np.uint64)])
    wa, wb = 1 + rng.random(60), 1 + rng.random(60)
    wb[:40] = wa[:40]
    weights = [dict(zip(a.tolist(), wa / wa.sum())), dict(zip(b.tolist(), wb / wb.sum()))]
    jp = sum(1 / sum(max(weights[0].get(e, 0) / weights[0][d], weights[1].get(e, 0) / weights[1][d]) for e in {*weights[0], *weights[1]}) for d in set(weights[0]) & set(weights[1]))
    m = 4000
    sig = near_duplicates.signatures(np.repeat([0, 1], 60), np.concatenate([a, b]), np.concatenate([wa, wb]), 2, m)
    assert abs((sig[0] == sig[1]).mean() - jp) < 4 * math.sqrt(jp * (1 - jp) / m)


def test_components(spark):
    links = [(1, 2), (2, 3), (4, 3), (9, 8), (8, 7), (20, 21), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in near_duplicates.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in (1, 2, 3, 4)) and all(got[i] == 7 for i in (7, 8, 9)) and got[21] == 20
    assert all(got[100 + i] == 100 for i in range(41))


# Decontamination


def test_contamination_is_that_of_all_pairs(spark, docs, none, texts):
    items = [(1, prose(900, 20)), (2, prose(901, 60)), (3, prose(902, 150)), (4, "two words"), (5, ""), (6, None), (7, prose(900, 20))]
    planted = [(1000, prose(5, 300) + " " + items[0][1] + " " + prose(6, 700)), (1001, items[1][1].upper().replace(" ", "  ")), (1002, prose(8, 2000) + "\n" + items[2][1]), (1003, "Two, words!"), (1004, edited(items[1][1], [10]))]
    rows = texts + planted
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    sets = lambda t, n=5: {tuple(words(t)[i : i + n]) for i in range(len(words(t)) - n + 1)}
    whole = {}
    for i, t in rows:
        whole.setdefault(i, set()).update(sets(t))
    want = {(i, j, round(len(s & sets(t)) / len(sets(t)), 9)) for i, s in whole.items() for j, t in items if sets(t) and len(s & sets(t)) >= 0.8 * len(sets(t))}
    want |= {(i, j, 1.0) for i, t in rows for j, x in items if 0 < len(words(x)) < 5 and tuple(words(x)) in sets(t, len(words(x)))}
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, round(r.containment, 9)) for r in contamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), table).collect()}
    assert got == want and {(1000, 1, 1.0), (1001, 2, 1.0), (1002, 3, 1.0), (1003, 4, 1.0)} <= got
    assert contamination.contaminated(none, table).count() == 0
    assert contamination.contaminated(docs, table.limit(0)).count() == 0
    assert contamination.without_contaminated(docs, table).columns == docs.columns
    clashing = docs.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("hit", "HIT_", "item_id", "sh", "containment", "version")])
    left = contamination.without_contaminated(clashing, table)
    assert left.columns == clashing.columns and {r.doc_id for r in left.collect()} == {i for i, _ in texts} - {i for i, _, _ in want}


def test_items_of_few_words(spark):
    items = [(1, "one two three four"), (2, "Zebra"), (3, "seven, eight"), (4, "!!"), (5, "a b c"), (5, "b c d")]
    rows = [(10, prose(1, 300) + " one, TWO three four " + prose(2, 300)), (11, "one two three five four zebra"), (12, "seven"), (13, "x seven eight"), (14, "b c d"), (14, "zebras")]
    got = {tuple(r) for r in contamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(10, 1, 1.0), (11, 2, 1.0), (13, 3, 1.0), (14, 5, 1.0)}


def test_no_items_keep_the_type_of_item_id(spark):
    docs = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    for items in (spark.createDataFrame([], "item_id string, text string"), spark.createDataFrame([("a", "?!"), ("b", None), (None, "")], "item_id string, text string")):
        found = contamination.contaminated(docs, items)
        assert dict(found.dtypes) == {"doc_id": "bigint", "item_id": "string", "containment": "double"} and found.isEmpty()
        assert contamination.without_contaminated(docs, items).count() == 1


def test_short_items_inside_long_documents(spark):
    """Items of 1 to 14 shingles, and more of one, each inside its own document, an edited one, and one that is only partly there."""
    items = [(i, prose(6000 + i, (i + 4 if i < 15 else 5))) for i in range(1, 31)]
    rows = [(100 + i, prose(7000 + i, 400) + " " + t + " " + prose(8000 + i, 500)) for i, t in items]
    rows += [(200, prose(9000, 400) + " " + " ".join(items[7][1].split()[:-1]) + " " + prose(9001, 400)), (201, prose(9002, 400) + " " + " ".join(items[7][1].split()[:7]) + " " + prose(9003, 400))]
    table = spark.createDataFrame(items, "item_id long, text string")
    for some in (table, table.where("item_id <= 8")):
        got = {(r.doc_id, r.item_id): r.containment for r in contamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), some).collect()}
        assert got == {(100 + r.item_id, r.item_id): 1.0 for r in some.collect()} | {(200, 8): 7 / 8}


def test_the_fit_is_that_of_plain_logistic_regression(spark):
    """The same pairs, drawn apart from the library, and Newton steps on their differences: the library's weights come as low and rank the texts alike."""
    rng = np.random.default_rng(12)
    rows = [(i, prose(i, 30 + i % 40) if i % 3 else " ".join("#|*7"[int(k)] * 3 for k in rng.integers(0, 4, 30)) + prose(i, 12), int(i % 3 > 0 and i % 11 > 0)) for i in range(150)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    found = quality.fit(docs, labels)
    order = {r.doc_id: k for k, r in enumerate(docs.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").collect())}
    sides = [sorted((r for r in rows if r[2] == q), key=lambda r: order[r[0]]) for q in (0, 1)]
    rare = min((0, 1), key=lambda q: len(sides[q]))
    few, many = sides[rare], sides[1 - rare]
    each = max(quality.PAIRS, -(-len(many) // len(few)))
    met = [(a, (a * each + k) % len(many)) for a in range(len(few)) for k in range(each)]
    ups = spark.createDataFrame(met, "a int, at int").select("a", "at", (F.xxhash64("a", F.col("at")) % 2 == 0).alias("up")).collect()
    x = quality.features([t.encode() for _, t, _ in few + many])
    pairs = np.array([x[r.a] - x[len(few) + r["at"]] for r in ups]) * (1 if rare == 1 else -1)
    pairs *= np.array([1 if r.up else -1 for r in ups])[:, None]
    y = np.array([r.up for r in ups], float)
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (pairs @ w)).mean() + 5e-5 * w @ w
    w = np.zeros(pairs.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-(pairs @ w)))
        w -= np.linalg.solve((pairs * (p * (1 - p))[:, None]).T @ pairs / len(y) + 1e-4 * np.eye(len(w)), pairs.T @ (p - y) / len(y) + 1e-4 * w)
    own = np.array(found.weights)
    assert loss(w) <= loss(own) + 1e-9 and loss(own) <= loss(w) + 0.01
    assert np.corrcoef(x @ own, x @ w)[0, 1] > 0.98


# Fingerprints


def brute_tree(text):
    """The sections of a text's tree: (digest, [(digest, [leaf, ...]), ...]) each."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    paragraphs = []
    for line in text.split("\n"):
        leaves = [sha(s) for s in re.sub("([.!?|] )", "\\1\x1f", line).split("\x1f")]
        paragraphs.append((sha("".join(leaves)), [x[:8] for x in leaves]))
    cut, out = [], []
    for k, p in enumerate(paragraphs):
        cut.append(p)
        if p[0][-1] in "0123" or k == len(paragraphs) - 1:
            out.append((sha(" ".join(f"{d}({' '.join(x)})" for d, x in cut)), cut))
            cut = []
    return out


def brute_print(tree):
    body = "".join(f"{d}{{{' '.join(f'{q}({' '.join(x)})' for q, x in ps)}}}" for d, ps in tree)
    return hashlib.sha256(body.encode()).hexdigest() + "[" + body + "]"


def brute_likeness(a, b):
    if a == b:
        return 1.0
    a, b = (Counter((d, tuple((q, tuple(x)) for q, x in ps)) for d, ps in tree) for tree in (a, b))
    same = sum(n * len(x) for s, n in (a & b).items() for _, x in s[1])
    pa, pb = (Counter(p for s in one.elements() for p in s[1]) for one in (a - b, b - a))
    same += sum(n * len(x) for (_, x), n in (pa & pb).items())
    la, lb = (Counter(x for p in one.elements() for x in p[1]) for one in (pa - pb, pb - pa))
    same += (la & lb).total()
    return 2 * same / (2 * same + (la - lb).total() + (lb - la).total())


def test_repeats_are_matched_one_to_one(spark):
    pairs = [("a. b. ", "a. a. b. "), ("x\n" * 5, "x\n" * 3), ("", "a. "), ("a. b. c. ", "c. b. a. "), ("\n".join(prose(i % 3, 20) for i in range(30)), "\n".join(prose(i % 3, 20) for i in range(21)) + " more. one")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", merkle.likeness(merkle.sections(F.col("a")), merkle.sections(F.col("b"))).alias("l"))
    got = {(r.a, r.b): r.l for r in df.collect()}
    assert all(abs(got[p] - brute_likeness(*map(brute_tree, p))) < 1e-9 for p in pairs)
    assert got[pairs[0]] < 1 and got[pairs[1]] < 1


def test_fingerprints(spark, docs, none, texts):
    got = {}
    for r in merkle.fingerprints(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    hashed = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(((i, t or "") for i, t in texts), key=lambda x: (x[0] is not None, x[0] or 0, hashed[x[1]], x[1]))
    prints, found = {}, 0
    for (i, t), (_, following) in zip(order, [*order[1:], order[0]]):
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        own, other, then = map(brute_tree, (t, edited, following))
        row = next(r for r in got[i] if r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(t) and r.fingerprint == brute_print(own))
        assert row.edited_fingerprint == brute_print(other)
        assert abs(row.near_edited - brute_likeness(own, other)) < 1e-9 and abs(row.near_next - brute_likeness(own, then)) < 1e-9
        prints.setdefault(t, set()).add(row.fingerprint)
        found += 0 < row.near_edited < 1
    assert found > 5 and all(len(v) == 1 for v in prints.values()) and len({next(iter(v)) for v in prints.values()}) == len(prints)
    assert sum(map(len, got.values())) == len(texts) and merkle.fingerprints(none).count() == 0


def test_roots_cover_whole_digests(spark):
    """Leaves whose first digits agree."""
    a, b = "item number 69710", "item number 73751"
    x, y = (r.f for r in spark.createDataFrame([(a,), (b,)], "t string").select(merkle.fingerprint(F.col("t")).alias("f")).collect())
    assert x[:64] != y[:64]


def test_place_in(spark):
    bounds = [3, 5, 8, 13, 21, 34]
    for n in range(len(bounds) + 1):
        got = spark.range(40).select("id", merkle.place_in(bounds[:n], F.col("id")).alias("at")).collect()
        assert all(r["at"] == sum(b < r["id"] for b in bounds[:n]) for r in got)


def test_edits_show_in_their_branch(spark):
    text = "\n".join(prose(i, 60) for i in range(20))
    changed = text.replace(prose(10, 60), prose(99, 60))
    df = spark.createDataFrame([(text, changed), (text, text)], "a string, b string").select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    found = [r.d for r in df.select(merkle.differing(F.col("a"), F.col("b")).alias("d")).collect()]
    at = [(i, j) for i, (_, ps) in enumerate(brute_tree(text)) for j in range(len(ps))][10]
    assert found[1] == [] and [(x.section, x.paragraph) for x in found[0]] == [at]


# Language, quality and language model


def test_language_by_brute_force(spark):
    alphabets = {"xx": "abcdefgh", "yy": "klmnopqr"}
    rng = np.random.default_rng(1)
    word = lambda a: "".join(rng.choice(list(a), 5))
    rows = [(i, " ".join(word(alphabets[lang]) for _ in range(60)), lang) for i in range(60) for lang in (["xx", "yy"][i % 2],)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, masks = language_id.learn(train)
    assert langs == ["xx", "yy"]
    odd = [(1, None), (2, "12 !?"), (3, ""), (4, "ABCDE fghab"), (5, "klmno " * 5000), (6, "日本")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(spark.createDataFrame(odd, "doc_id long, text string"), langs, masks).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "xx" and got[5][0] == "yy" and got[6] == ("xx", 0.0)


def test_language_against_exact_sets(spark):
    """70 languages, more than a word of a mask: hits of the filters are those of exact sets but for chance, and each text gets its language."""
    rng = np.random.default_rng(2)
    alphabet = [chr(c) for c in range(0x4E00, 0x4E00 + 700)]
    word = lambda k: "".join(rng.choice(alphabet[10 * k : 10 * k + 10], 4))
    rows = [(i, " ".join(word(i % 70) for _ in range(40)), f"l{i % 70:02d}") for i in range(140)]
    langs, masks = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langs == sorted({r[2] for r in rows}) and masks.shape == (2, language_id.SLOTS)
    exact = {}
    for _, t, lang in rows:
        _, g, _ = language_id.grams([t])
        exact.setdefault(lang, set()).update(g.tolist())
    fresh = [(1000 + k, " ".join(word(k) for _ in range(60))) for k in range(0, 70, 7)] + [(2000, rows[3][1] + " " + rows[4][1] + " " + rows[4][1])]
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(fresh, "doc_id long, text string"), langs, masks).collect()}
    for i, t in fresh:
        _, g, _ = language_id.grams([t])
        shares = {lang: sum(x in own for x in g.tolist()) / len(g) for lang, own in exact.items()}
        assert got[i].lang_pred == max(shares, key=shares.get) and abs(got[i].score - max(shares.values())) < 0.01


def test_language_without_rows(docs, none):
    langs, masks = language_id.learn(none)
    assert langs == [] and {r.lang_pred for r in language_id.predict(docs, langs, masks).collect()} == {"und"}


def test_ngrams_do_not_cross_words():
    doc, gram, has = language_id.grams(["ab cd", "", "e", "ab"])
    assert np.bincount(doc, minlength=4).tolist() == [4, 0, 1, 2] and has.tolist() == [True, False, True, True]
    assert set(gram[doc == 3]) < set(gram[doc == 0])


def test_quality(spark, docs, none):
    rows = [(i, prose(i, 80) if i % 3 else re.sub(r"(\w+)", lambda m: m[1].upper() + "!!", prose(i, 80))) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)] + [(5, None), (6, 3), (None, 1), (1, 0)], "doc_id long, quality int")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    ranking = quality.fit(table, labels)
    got = {r.doc_id: r for r in quality.scored(table, ranking).collect()}
    assert all(got[i].predicted == int(i % 3 > 0) for i in range(90, 120)) and all((r.score >= 0.3) == (r.predicted == 1) for r in got.values())
    assert quality.scored(docs, ranking).count() == docs.count() and quality.scored(none, ranking).count() == 0
    twice = table.unionByName(table.withColumn("text", F.upper("text")))
    assert quality.fit(twice, labels) == quality.fit(twice.repartition(7), labels)
    flat = quality.fit(table, labels.where("quality = 1"))
    assert {round(r.score, 9) for r in quality.scored(table, flat).collect()} == {0.3}


def test_language_model(spark, docs, texts, none):
    """Against a model built from the classes by hand: 60 words are clustered, 30 of them one at a time; the others have their last mark's class."""
    train_texts = [prose(i, 200) for i in range(30)]
    train = spark.createDataFrame(list(enumerate(train_texts)), "doc_id long, text string")
    counts = class_lm.word_counts(train).cache()
    words, n = class_lm.vocabulary(counts, 60)
    model = class_lm.learn(class_lm.word_ids(train, words), counts, words, n, anchors=30, classes=5)
    tokens = lambda t: re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) + [""]
    c = Counter(w for t in train_texts for w in tokens(t))
    assert len(words) == 61 and words[0] == "" and all(c[w] == k for w, k in zip(words, n)) and min(n[1:]) >= max(c[w] for w in set(c) - set(words))
    known = dict(zip(words, model.class_of.tolist()))
    assert set(known.values()) <= set(range(6)) and known[""] == 0 and len(set(known.values())) > 3
    of = lambda w: known[w] if w in known else 6 + ".,!?:;".find(w[-1]) + 1
    mass, pairs = Counter({6 + k: 0.1 for k in range(7)}), Counter()
    for w, k in c.items():
        mass[of(w)] += k + 0.1
    for t in train_texts:
        run = [0, *map(of, tokens(t))]
        pairs.update(zip(run, run[1:]))
    after, total = Counter(), sum(mass.values())
    for (x, _), k in pairs.items():
        after[x] += k

    def score(t):
        run = ["", *tokens(t)]
        return sum(math.log10((pairs[of(x), of(w)] + 20 * mass[of(w)] / total) / (after[of(x)] + 20) * (c[w] + 0.1) / mass[of(w)]) for x, w in zip(run, run[1:]))

    base, v = sum(c.values()), len(c)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in class_lm.scored(class_lm.word_ids(docs, words), counts, model).collect()), key=key)
    want = [(i, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), base, round(sum(math.log10((c[w] + 0.1) / (base + 0.1 * (v + 1))) for w in tokens(t)), 4), round(score(t), 4)) for i, t in texts]
    for x, y in zip(got, sorted(want, key=key)):
        assert x[:4] == y[:4] and x[4] == pytest.approx(y[4], abs=2e-4) and x[5] == pytest.approx(y[5], abs=2e-4)
    # one unknown word in each class of a last mark, the words of each class, and all transitions sum to 1
    for before in range(len(model.step)):
        assert abs(sum(10 ** model.step[before, j] * m for j, m in mass.items()) - 1) < 1e-9
    assert class_lm.scored(class_lm.word_ids(none, words), counts, model).count() == 0
    empty = class_lm.word_counts(none)
    words, n = class_lm.vocabulary(empty)
    rows = class_lm.word_ids(docs, words)
    assert class_lm.scored(rows, empty, class_lm.learn(class_lm.word_ids(none, words), empty, words, n)).count() == len(texts)


def test_sweeps_find_kinds_of_words(spark):
    """A language of two alternating kinds of words: words beyond the anchors join the class of their kind."""
    rng = np.random.default_rng(4)
    kinds = [[f"{k}{i}" for i in range(40)] for k in "ab"]
    texts = [" ".join(kinds[j % 2][int(40 * rng.random() ** 2)] for j in range(60)) for _ in range(40)]
    train = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = class_lm.word_counts(train).cache()
    words, n = class_lm.vocabulary(counts)
    rows = class_lm.word_ids(train, words)
    model = class_lm.learn(rows, counts, words, n, anchors=12, classes=2)
    found = {(w[0], k) for w, k in zip(words[1:], model.class_of[1 : len(words)].tolist())}
    assert len(found) == 2 and len({k for _, k in found}) == 2


def brute_likelihood(texts, words, class_of):
    """Of the class bigrams of texts whose words are all in the vocabulary, an end before and after each."""
    place = {w: i for i, w in enumerate(words)}
    pairs = Counter()
    for t in texts:
        c = [0, *(int(class_of[place[w]]) for w in t.split()), 0]
        pairs.update(zip(c, c[1:]))
    before, after = Counter(), Counter()
    for (x, y), k in pairs.items():
        before[x] += k
        after[y] += k
    return sum(sum(k * math.log(k) for k in side.values()) * sign for side, sign in ((pairs, 1), (before, -1), (after, -1)))


def test_sweeps_are_kept_only_if_the_likelihood_rises(spark, monkeypatch):
    rng = np.random.default_rng(9)
    kinds = [[f"{k}{i}" for i in range(25)] for k in "abcd"]
    texts = [" ".join(kinds[(j + int(rng.random() < 0.2)) % 4][int(25 * rng.random() ** 2)] for j in range(50)) for _ in range(60)]
    train = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = class_lm.word_counts(train).cache()
    words, n = class_lm.vocabulary(counts, least=1)
    rows = class_lm.word_ids(train, words).cache()
    found = [class_lm.learn(rows, counts, words, n, anchors=15, classes=4, sweeps=k) for k in (1, 2, 5)]
    told = [brute_likelihood(texts, words, m.class_of) for m in found]
    assert told[0] < told[1] <= told[2]
    joint = class_lm.bigram_table(rows, found[2].class_of, int(found[2].class_of.max()) + 1)
    assert abs(class_lm.likelihood(joint) - told[2]) < 1e-6
    plain, calls = class_lm.sweep, []

    def spoiled(rows, class_of, joint, first, end, allowed):
        calls.append(first)
        out = plain(rows, class_of, joint, first, end, allowed)
        if len(calls) > 1:
            out[1:end] = 1 + np.arange(end - 1) % 4
        return out

    monkeypatch.setattr(class_lm, "sweep", spoiled)
    assert (class_lm.learn(rows, counts, words, n, anchors=15, classes=4, sweeps=5).class_of == found[0].class_of).all() and calls == [16, 1]


def test_best_class_by_hand():
    rng = np.random.default_rng(6)
    joint = rng.integers(1, 200, (5, 5)).astype(float)
    counts = rng.integers(0, 4, (30, 10)) * (rng.random((30, 10)) < 0.5)
    own = np.where(rng.random(30) < 0.5, class_lm.NONE, rng.integers(1, 4, 30)).astype(np.uint8)
    for w in np.flatnonzero(own != class_lm.NONE):  # what a word has with each class is part of the table
        joint[own[w]] += counts[w, :5]
        joint[:, own[w]] += counts[w, 5:]
    x = lambda v: v * math.log(v) if v > 0 else 0.0

    def gain(w, k):
        row, col = joint[k].copy(), joint[:, k].copy()
        rows, cols = joint[k].sum(), joint[:, k].sum()
        if own[w] == k:
            row, col, rows, cols = row - counts[w, :5], col - counts[w, 5:], rows - counts[w, :5].sum(), cols - counts[w, 5:].sum()
        parts = [(row[j], counts[w, j]) for j in range(5)] + [(col[j], counts[w, 5 + j]) for j in range(5)]
        return sum(x(b + m) - x(b) for b, m in parts) - (x(rows + counts[w, :5].sum()) - x(rows)) - (x(cols + counts[w, 5:].sum()) - x(cols))

    of, cell = np.nonzero(counts)
    got = class_lm.best_classes(own, of, cell, counts[of, cell], joint, range(1, 4))
    assert all(gain(w, got[w]) >= max(gain(w, k) for k in range(1, 4)) - 1e-6 for w in range(30))


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(0)
    b = np.zeros((20, 20))
    kind = rng.integers(0, 2, 20)
    for i in range(20):
        for j in range(20):
            b[i, j] = 50 if kind[i] != kind[j] else 0
    own = class_lm.exchange(b, 2, 10)
    assert len({(k, o) for k, o in zip(kind, own)}) == 2


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a><li>About</ul></nav>
<div class="cookie-banner">We use cookies.</div><article><h1>Head &amp; tail</h1><p>One<b>two</b> three<br>four&nbsp;five<p>Six &lt;b&gt; seven</p><aside>Aside</aside><ul><li>x<li>y</ul></article>
<div class="comments"><p>Nice!</p></div><form><input value=1>Mail</form><footer>&copy; all</footer></body></html>"""
WANT = "Head & tail\n\nOnetwo three four five\n\nSix <b> seven\n\nx\n\ny"


def test_article_of_a_page(spark, none):
    plain = PAGE.replace("<article>", '<div class="post-1">').replace("</article>", "</div>")
    rows = [(1, "http://a.example/1", PAGE), (2, "http://b.example/1", plain), (3, None, None), (4, "odd", ""), (5, "http://a.example/2", PAGE[:200]), (1, "http://a.example/1", PAGE), (6, "http://c.example", "just text"), (7, "http://d.example", "<p>" * 300 + "deep"), (8, "http://e.example", "<a href='x" * 2000)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, host string")
    got = wrappers.extract(pages).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by[1].text == WANT == by[2].text and by[1].n_chars == len(WANT)
    assert by[3].text == by[4].text == "" and by[6].text == "just text" and by[7].text == "deep"
    assert wrappers.extract(pages.limit(0)).count() == 0


def tree(page):
    return wrappers.bare(wrappers.parse(page)[1])


def test_wrapper_of_aligned_pages():
    a = tree("<div><h1>A</h1><p>x</p></div>")
    b = tree("<div><h1>B</h1><img><ul><li>1<li>2</ul><p>x</p><p>y</p></div>")
    c = tree("<div><h1>C</h1><ul><li>1<li>2<li>3<li>4</ul><p>z</p></div>")
    ab = wrappers.aligned(a, b)
    assert wrappers.as_regex(ab) == "<div><h1>#</h1>(<ul><li>#</li><li>#</li></ul>)?(<p>#</p>)+</div>"
    assert wrappers.as_regex(wrappers.aligned(ab, c)) == "<div><h1>#</h1>(<ul><li>#</li>(<li>#</li>)+</ul>)?(<p>#</p>)+</div>"
    pairs = wrappers.aligned(tree("<dl><dt>a<dd>b</dl>"), tree("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>"))
    assert wrappers.as_regex(pairs) == "<dl>(<dt>#</dt><dd>#</dd>)+</dl>"
    assert wrappers.as_regex(wrappers.aligned(pairs, tree("<dl><dt>a<dd>b</dl>"))) == "<dl>(<dt>#</dt><dd>#</dd>)+</dl>"


def accepts(items):
    """A wrapper as an expression over pages written by as_regex."""
    out = ""
    for x in items:
        if wrappers.is_text(x):
            out += "#?"
        else:
            own = accepts(x[2])
            own = f"<{re.escape(x[0])}>{own}</{wrappers.tag_of(x[0])}>" if x[0] else own
            out += f"(?:{own}){['', '+', '?', '*'][x[1]]}"
    return out


def test_wrappers_accept_their_pages(spark):
    """Every page of a host reads as its wrapper says, and each of its texts has a slot."""
    rng = np.random.default_rng(8)
    pages = []
    for i in range(120):
        inner = "".join(f"<p>{prose(i * 50 + k, 9)}</p>" for k in range(rng.integers(1, 5)))
        more = "".join(f"<dt>t{k}<dd>{i}" for k in range(rng.integers(0, 4)))
        page = f"<body><div class=top><div>Same</div></div>{'<div class=promo>Buy</div>' if rng.random() < 0.4 else ''}<div class=x><h1>T{i}</h1>{inner}{f'<dl>{more}</dl>' if more else ''}</div><footer>F</footer></body>"
        pages.append((i, f"http://h{i % 3}.example/{i}", page))
    found = {r.host: json.loads(r.wrapper) for r in wrappers.wrappers(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)).collect()}
    assert set(found) == {"h0.example", "h1.example", "h2.example"}
    for i, _, page in pages:
        w = found[f"h{i % 3}.example"]
        assert re.fullmatch(accepts(w), wrappers.as_regex(tree(page)))
        texts, _, at = wrappers.slots_of_page(json.dumps(w), page)
        assert len(at) == len(texts) and max(at.values()) < len(wrappers.slots(w))


def brute_articles(pages, wrapper):
    """Articles of one host's pages by their wrapper: the texts of slots inside its unnamed element of most text that change from page to page."""
    taken = [wrappers.slots_of_page(json.dumps(wrapper), p) for p in pages]
    seen = {}
    for texts, _, at in taken:
        for k, slot in at.items():
            seen.setdefault(slot, set()).add(texts[k])
    return ["\n\n".join(t for k, t in enumerate(texts) if len(seen[at[k]]) > 1) for texts, _, at in taken]


def test_slots_and_not_paths_decide(spark):
    """Elements of one path: a notice that never changes stands before the text that does. A union of paths can't part them."""
    pages = [(i, f"http://h.example/{i}", f"<body><div><div>Same for all</div><div>{prose(i, 50)}</div><div>Share it</div></div></body>") for i in range(8)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract(df).collect()}
    wrapper = json.loads(wrappers.wrappers(df).first().wrapper)
    assert [got[i] for i in range(8)] == [prose(i, 50) for i in range(8)] == brute_articles([p for _, _, p in pages], wrapper)


def test_text_that_never_changes_is_frame(spark):
    pages = [(i, f"http://h.example/{i}", f"<div class=x><div>Same for all</div><div><p>{prose(i, 50)}</p></div></div>") for i in range(8)]
    got = wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all(r.text == prose(r.page_id, 50) for r in got)


def test_deep_pages_and_states_of_pages(spark):
    deep = "<article>" + "<div>" * 3000 + "<p>body text</p><nav>menu text</nav><div class=sidebar><p>side</p></div>" + "</div>" * 3000 + "<p>after</p></article><p>outside</p>"
    rows = [(1, "http://a.example", deep), (2, "http://b.example", "<body class='has-sidebar no-comments'><main class='search-results'><article class='no-sidebar with-menu'><p>kept</p><div class='site-sidebar'>gone</div></article></main></body>")]
    rows += [(3, "http://c.example", "<div class=menu><p>all of it is noise</p></div>"), (4, "http://d.example", "<div id=heading-one><p>a b c</p></div><div id=sidebar>no</div>")]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "body text\n\nafter", 2: "kept", 3: "all of it is noise", 4: "a b c"}


def texts_of(spark, pages, host="h.example"):
    rows = [(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    return [got[i] for i in range(len(pages))]


def test_copies_and_shared_quotations_are_no_frame(spark):
    """Six articles, two views and five copies of another one, and a quotation that two articles share: all of it is text, whatever repeats."""
    page = lambda i, more="": f"<body><nav>Home</nav><article><h1>T{i}</h1><div>{prose(i, 60)}</div>{more}</article><footer>F</footer></body>"
    quoted = f"<div>{prose(77, 25)}</div>"
    pages = [page(i, quoted if i < 2 else "") for i in range(6)]
    shown = f"<article><h1>Z</h1><section><div>{prose(50, 80)}</div><div>{prose(51, 40)}</div></section></article>"
    pages += [f"<body><nav>Home</nav>{shown}</body>", f"<body class=print>{shown}<p>printed</p></body>"] + [f"<body><nav>Home</nav>{shown}</body>"] * 5
    want = [f"T{i}\n\n{prose(i, 60)}" + (f"\n\n{prose(77, 25)}" if i < 2 else "") for i in range(6)] + [f"Z\n\n{prose(50, 80)}\n\n{prose(51, 40)}"] * 7
    assert texts_of(spark, pages) == want


def test_the_wrapper_knows_more_than_the_page(spark):
    """An unnamed box inside the article that is the same on all pages: a page's own tree can't tell it from text, its host's pages do."""
    pages = [f"<article><h1>T{i}</h1><p>{prose(i, 50)}</p><div>Join the club today and read on</div><p>{prose(100 + i, 30)}</p></article>" for i in range(7)]
    got, want = texts_of(spark, pages), [f"T{i}\n\n{prose(i, 50)}\n\n{prose(100 + i, 30)}" for i in range(7)]
    assert got == want
    alone = [wrappers.text_of("[]", (), p) for p in pages]
    assert all("Join the club" in t for t in alone) and alone != want


def test_frame_never_takes_most_of_a_page(spark):
    """A page whose article is what most pages have as a box keeps it."""
    box = f"<div>{prose(5, 60)}</div>"
    pages = [f"<article><h1>T{i}</h1><p>{prose(i, 150)}</p>{box}</article>" for i in range(6)] + [f"<article><h1>Only</h1>{box}</article>"]
    got = texts_of(spark, pages)
    assert got[-1] == f"Only\n\n{prose(5, 60)}" and got[0] == f"T0\n\n{prose(0, 150)}"


@pytest.mark.parametrize(
    ("inner", "kept"),
    [
        ("<div class='menu-recipe'>{0}</div>", True), ("<div class='search-engine-history'>{0}</div>", True), ("<div id='responses'>{0}</div>", False), ("<div class='comment-list'>{0}</div>", False),
        ("<div class='cookie-banner'>{0}</div>", False), ("<div class='related-articles'>{0}</div>", False), ("<div class='with-sidebar'>{0}</div>", True), ("<section class='social-history'>{0}</section>", True),
    ],
)
def test_names_of_elements(spark, inner, kept):
    pages = [f"<article><h1>T{i}</h1><p>{prose(i, 40)}</p>{inner.format(prose(100 + i, 20))}</article>" for i in range(4)]
    assert texts_of(spark, pages) == [f"T{i}\n\n{prose(i, 40)}" + (f"\n\n{prose(100 + i, 20)}" if kept else "") for i in range(4)]


def test_site_header_in_main(spark):
    pages = [f"<main><header><div>Site {i}</div></header><header><h1>T{i}</h1></header><p>{prose(i, 40)}</p></main>" for i in range(4)]
    assert texts_of(spark, pages) == [f"T{i}\n\n{prose(i, 40)}" for i in range(4)]


# Registered queries


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_queries_and_pipeline(spark):
    import corpus_pipeline
    from tremor.llm.queries import ORACLES, QUERIES

    for name in ("op2_html_extraction", "op4_fingerprints", "op6_arrow_ids"):
        n = spark.read.parquet(f"{DIR}/{'pages' if name.startswith('op2') else 'documents'}.parquet").count()
        assert QUERIES[name](spark, DIR).count() == n
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    hits = {tuple(r) for r in QUERIES["op10_decontamination"](spark, DIR).collect()}
    assert hits == set(con.sql(ORACLES["op10_decontamination"]).fetchall())
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(stage(spark, steps[-1], DIR))
        assert steps[-1].columns == docs.columns
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in steps]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    held = [i for i in ids[0] if i in labels and zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((i in ids[1]) == bool(labels[i]) for i in held) >= 0.9 * len(held)
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, steps[-1], DIR).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(last) == ids[-1] and all(r.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest() for i, r in last.items())


def test_stages_on_odd_tables(spark, docs, none):
    """Null keys and texts, ties, repeats, clashing columns and an empty table go through every stage."""
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        assert name == "byte_bpe" or out.columns == docs.columns
        assert out.count() <= docs.count() and (name != "byte_bpe" or out.count() == docs.count())
        assert stage(spark, none, DIR).count() == 0
