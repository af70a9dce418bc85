import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, `key` long, score string"


def make_rows(seed=3, n=90):
    """Documents with copies, near copies, shared passages, nulls, blanks and a very long text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    vocabulary = [word() for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = text(60)
    texts = [text(rng.randint(1, 160)) for _ in range(n)]
    for k in range(0, n, 9):
        texts[k] = texts[0] if k % 2 else texts[k]
        words = text(120).split() if k == 0 else texts[k - 1].split()
        if len(words) > 40:
            words[rng.randrange(len(words))] = "changed"
            texts[k] = " ".join(words)
    for k in range(4, n, 11):
        texts[k] = texts[k] + "\n" + passage + " " + text(8)
    texts[7] = texts[8] = texts[17] = texts[26] = text(70)
    texts[30] = " \t\n "
    texts[31] = ""
    texts[32] = None
    texts[33] = "one two three"
    texts[34] = "ONE two Three"
    texts[35] = text(9000)
    texts[36] = "x" * 30000
    texts[37] = "la " * 300
    texts[38] = "Ünïcode — ½ 漢字 😀 text\x0bwith\x0cseparators kept here"
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None]), 1, "clash", i, "x") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated ids, repeated rows, nulls everywhere."""
    rows = [
        (None, "some text of its own " * 6, None, None, None, None, None, None),
        (None, None, None, None, None, None, None, None),
        (5, "same words again and again in this row here " * 3, "en", "a", 1, "s", 1, "s"),
        (5, "same words again and again in this row here " * 3, "en", "a", 1, "s", 1, "s"),
        (5, "another text under the same id " * 5, "en", None, 1, None, 1, None),
        (6, "", None, "a", None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)
