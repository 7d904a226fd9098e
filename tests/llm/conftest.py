import random

import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, class string, bucket int, size string, key string, label int, score double"


def make_text(rng: random.Random, words: int) -> str:
    syllables = ["an", "the", "or", "in", "ti", "on", "re", "st", "he", "nd"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, a shared passage, and odd rows."""
    rng = random.Random(5)
    rows = [(i, make_text(rng, rng.randint(3, 400))) for i in range(120)]
    passage = make_text(rng, 60)
    for i in (3, 17, 40):
        w = rows[i][1].split()
        at = len(w) // 2
        rows[i] = (i, " ".join([*w[:at], passage, *w[at:]]))
    rows += [(200 + i, rows[i][1]) for i in range(5)]
    for i in range(5, 12):
        w = (rows[i][1] + " " + make_text(rng, 120)).split()
        rows[i] = (i, " ".join(w))
        w[len(w) // 2] = "changed"
        rows.append((300 + i, " ".join(w)))
    return rows


@pytest.fixture(scope="session")
def odd(spark, corpus):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows and columns of clashing names."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t), "c", 1, "z", "k", 1, 0.5) for i, t in corpus[:20]]
    blank = (None,) * 6
    rows += [(1000, None, None, None, None, *blank), (1001, "", "en", "s0", 0, *blank), (1002, " \n\t ", "en", "s1", 4, *blank), (1003, "word", None, "s1", 4, *blank)]
    rows += [(1004, "long " * 40_000, "en", "s2", 200_000, *blank), (None, "no id here " * 8, "en", "s0", 88, *blank), (1005, "é漢😀 ßÀ　x", "fr", "", 10, *blank)]
    rows += [rows[0], rows[0]]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t)) for i, t in corpus], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
