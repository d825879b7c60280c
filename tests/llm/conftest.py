import random
import string

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASH = ("tokens", "line_no", "kept_lines", "copy", "n", "path", "component", "lead", "ids", "block", "h1", "score", "w")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text) or (doc_id, text, lang) rows, with further columns of clashing names."""

    def make(rows, clash=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name in CLASH if clash else ():
            df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


@pytest.fixture(scope="session")
def word_list():
    r = random.Random(7)
    return ["".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(2, 8))) for _ in range(4000)]


@pytest.fixture(scope="session")
def awkward(word_list):
    """Null, empty, blank, very long and repeated texts."""
    r = random.Random(3)
    long = " ".join(r.choices(word_list, k=60_000))
    odd = "ünï çødé 　 x́ 深い  \t two\tspaces\x0b \r\n<|endoftext|> 'S DON'T 12.5 ▁ end "
    return [
        (1, None), (2, ""), (3, " \t\n\n "), (4, long), (5, odd), (6, long), (7, "one"), (7, "one"),
        (None, "no id " + long[:500]), (8, "\n"), (9, " lead and trail "), (10, "\n".join(["same line of nine words that all come again"] * 3)),
    ]
