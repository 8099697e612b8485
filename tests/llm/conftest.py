from __future__ import annotations

import random

import pytest

WORDS = "the of and to in is that it was for on are with as by at from this have not but had his they she which you one we all her would there their been if who will more no out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = [rng.choice(WORDS) for _ in range(n)]
    return " ".join(w + "." if i % 9 == 8 else w for i, w in enumerate(out)).capitalize()


#: Empty, null, tiny, odd and very long texts, ties and repeated rows.
ODD = [None, "", " ", "\n\n", "a", "A.", "é", "日本語 テキスト です", "🙂🙂", "x" * 50_000, "the " * 20_000, "a\tb\r\nc", "  two  blanks ", "İstanbul ΣΑΣ.", "\x1c\x1f odd", "<|endoftext|> <s> ▁"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, version long, n_tokens long, word string"


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    rows = list(enumerate(ODD))
    rows += [(100 + i, prose(i, 40 + 7 * i)) for i in range(40)]
    rows += [(200, prose(0, 40)), (200, prose(0, 40)), (201, prose(1, 47)), (None, prose(2, 30)), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with further columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, "en" if i is None or i % 2 else None, "s", 1, 0.5, "x", 7, 3, "w") for i, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
