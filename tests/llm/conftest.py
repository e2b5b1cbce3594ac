import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, `row` long, kept boolean, score double"


def documents(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    made = [(i, t, "en", "s", None if t is None else len(t), "x", 1, False, 0.5) for i, t in rows]
    return spark.createDataFrame(made, SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: documents(spark, rows)


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, ties, repeated rows, a null key, a long text, many near copies."""
    random.seed(5)
    words = [f"w{n}" for n in range(400)]
    base = random.choices(words, k=300)
    rows = [(n, " ".join(random.choices(words, k=random.randint(1, 80)))) for n in range(60)]
    for n in range(60, 100):
        copy = base[:]
        copy[n] = "changed"
        rows.append((n, " ".join(copy)))
    rows += [(200, None), (201, ""), (202, "   \n "), (203, "One two"), (204, "one TWO"), (205, "One two")]
    rows += [(206, "same text here"), (206, "same text here"), (206, "other text here"), (None, "no key"), (None, "no key")]
    rows += [(207, " ".join(random.choices(words, k=60_000))), (208, "x" * 300_000), (209, "Grüße, ΣΑΣ İ <|endoftext|> é")]
    return rows
