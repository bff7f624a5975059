import random

import pytest


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["la", "the", "der", "on"]) + rng.choice("abcdefghij") + str(rng.randint(0, 99)) + rng.choice(["", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Null, empty and very long texts, repeated rows, ties, a null id, and columns named like the operators' own."""
    names = ["doc_id", "text", "lang", "source", "n_chars", "score", "kept", "node", "length", "digest", "key", "n_words", "first_ids", "component_id", "lang_pred", "sequence_id", "_key", "_nth", "_words", "_at", "n", "word"]
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in names[5:])
    same = prose(1, 120)
    texts = [None, "", " \n\t ", "x", same, same, same + " more", prose(2, 30000), "wort" * 30000, "a " * 5000, "日本語 テスト 😀 " * 60, "\x00\x1f \x85 b", prose(3, 300)]
    rows = [(i, t, None if i % 3 == 0 else "en", None, None if i % 2 else 7, *["clash"] * (len(names) - 5)) for i, t in enumerate(texts)]
    rows += [rows[4], rows[0], (None, prose(4, 80), *rows[0][2:]), (4, prose(5, 90), *rows[0][2:])]
    return spark.createDataFrame(rows, kinds)


@pytest.fixture(scope="session")
def empty(spark, awkward):
    return spark.createDataFrame([], awkward.schema)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, None) for i in range(12)] + [(None, 1, 0), (4, None, 1), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
