import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, code long, row string, keys string, k1 long, part "
    "int, `order` string, cell string, tokens long, window long, h1 long, label int, y double"
)
WORDS = "the of and reading water river stone light under over again never bright cold winter summer letter number window garden little house road north south".split()


def row(doc_id, text, lang="en", source="src1"):
    return (doc_id, text, lang, source, None if text is None else len(text), 1, 2, "r", "k", 3, 4, "o", "c", 5, 6, 7, 8, 9.0)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names."""
    random.seed(3)
    prose = [" ".join(random.choice(WORDS) for _ in range(60)) + "." for _ in range(30)]
    rows = [row(k, "\n".join(prose[k : k + 4])) for k in range(26)]
    rows += [row(100, None), row(101, ""), row(102, " \n\t"), row(103, "one"), row(104, "été œuvre 漢字 😀 end")]
    rows += [row(105, prose[0]), row(105, prose[0]), row(106, prose[0], None, None), row(None, prose[1]), row(None, None, None, None)]
    rows += [row(107, " ".join(prose) * 20), row(108, "x" * 70000), row(109, "a " * 40000)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
