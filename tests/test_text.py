"""Scalar functions against plain Python on awkward and random texts."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from redline import constants as K
from redline.functions import diffing
from redline.functions import text as X

TEXTS = [
    "", "  ", "a", "Naïve café foo_bar b2 x", "LEFT left-right", "İstanbul Σίσυφος ΟΔΟΣ", "[a] [b",
    "lone ] here", "\x1c\x1ftab\tnbsp\xa0 em sp　 end\n", "12 mm, 3.5mL 120 mmHg 4 ML 7deg 5 cm",
    "Right left bilateral", "right right left", "leftover left_ rightly", "x" * 130 + ", . tail",
    "[left/right] and [generic] and [_laterality_]", "a\r\nb\x0bc d", "the and of right ab abc 12",
]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    alphabet = "abz09 _-éñ\n\t\xa0[]ABΣ"
    extra = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    return TEXTS + extra


def column(spark, texts, expr):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(2)
    return [r["v"] for r in d.select("i", expr(F.col("t")).alias("v")).orderBy("i").collect()]


def test_whitespace_covers_python():
    assert sorted(K.WHITESPACE) == [chr(i) for i in range(0x110000) if chr(i).isspace()]


def test_strip_and_normalize(spark, texts):
    assert column(spark, texts, X.strip) == [t.strip() for t in texts]
    assert column(spark, texts, X.normalize) == [re.sub(r"\s+", " ", t.strip().lower()) for t in texts]


def test_tokens(spark, texts):
    tokens = [re.findall(r"[a-z0-9]{2,}\b", t.lower()) for t in texts]
    assert column(spark, texts, X.all_tokens) == tokens
    want = [[w for w in ws if len(w) >= 3 and w not in K.STOP_WORDS] for ws in tokens]
    assert column(spark, texts, X.terms) == want
    sets = [set(ws) - set(K.STOP_WORDS) for ws in tokens]
    assert [set(v) for v in column(spark, texts, X.token_set)] == sets


def test_spans_measurements_lines(spark, texts):
    def spans(t):
        found = re.findall(r"\[[^\]]*\]", t)
        return found or (["["] if "[" in t else ["]"] if "]" in t else [])

    assert column(spark, texts, X.bracket_spans) == [spans(t) for t in texts]
    unit = r"\d+(?:\.\d+)?\s*(?:mL|ml|mm|cm|cc|mmHg|mm\s*hg|kPa|degrees?|deg)"
    assert column(spark, texts, X.measurements) == [re.findall(unit, t) for t in texts]
    assert column(spark, texts, X.split_lines) == [t.splitlines() for t in texts]


def test_laterality(spark, texts):
    def side(t):
        words = [w.lower() for w in re.findall(r"\b(left|right|bilateral)\b", t, re.IGNORECASE)]
        if "bilateral" in words:
            return "bilateral"
        n = words.count("left") - words.count("right")
        return "left" if n > 0 else "right" if n < 0 else None

    assert column(spark, texts, X.laterality) == [side(t) for t in texts]


def test_generic_term(spark):
    parts = ["Lumbar spine", " Knee joint ", "spine", " spine", "Neck region", "a bone joint", "Hand", ""]
    assert column(spark, parts, X.generic_term) == [
        "lumbar", "knee", "spine", "spine", "neck", "a bone", "hand", "",
    ]


def test_snippet(spark):
    got = column(spark, ["", " a  b\n", "x" * 119 + ",,,yyy", "y" * 120], X.snippet)
    assert got == ["No significant abnormality.", "a b", "x" * 119 + " ...", "y" * 120]


def test_round_unit_is_python_round(spark):
    pairs = [(n, d) for d in range(1, 200) for n in range(d // 4 + 1, d + 1)]
    d = spark.createDataFrame(pairs, "n int, d int").repartition(2)
    x = F.col("n") / F.col("d")
    for digits in (2, 4, 6):
        rows = d.select("n", "d", X.round_unit(x, digits).alias("r")).collect()
        assert all(r["r"] == round(r["n"] / r["d"], digits) for r in rows)


def _reference_match(a, b):
    return sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_matched_length_equals_difflib():
    rng = random.Random(5)
    for _ in range(120):
        letters = rng.choice(["ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz éñ\U0001f600"])
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 350)))
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 30)] = [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        assert diffing.matched_length(a, "".join(b)) == _reference_match(a, "".join(b))


def test_hash_collisions_do_not_matter():
    # Thue-Morse texts defeat polynomial hashes modulo a power of two.
    s = "a"
    for _ in range(11):
        s += s.translate(str.maketrans("ab", "ba"))
    a, b = s[:2048], s[2048:4096]
    assert diffing.matched_length(a[:700], b[:700]) == _reference_match(a[:700], b[:700])


def test_char_edits(spark):
    rows = [("abc", "abcdef"), ("abcdef", "abc"), ("abc", "xyz"), ("a  b", " A b "), ("", ""), ("aa", "zz")]
    d = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    got = [tuple(r)[2:] for r in diffing.with_char_edits(d, "a", "b").collect()]
    assert [g[:2] for g in got] == [(3, 0), (0, 3), (3, 3), (0, 0), (0, 0), (2, 2)]
    assert [g[2] for g in got] == [1 - 6 / 9, 1 - 6 / 9, 1.0, 0.0, 0.0, 1.0]


def test_matching_reads_a_text_a_few_times_however_many_blocks_differ(monkeypatch):
    rng = random.Random(11)
    lines = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(70)) for _ in range(400)]
    other = [line if n % 3 else line[::-1] for n, line in enumerate(lines)]
    a, b = "\n".join(lines), "\n".join(other)
    seen, of = [], diffing._Windows.of
    monkeypatch.setattr(diffing._Windows, "of", lambda self, lo, hi, *rest: seen.append(hi - lo) or of(self, lo, hi, *rest))
    kept = sum(70 for n in range(400) if n % 3)
    assert kept < diffing.matched_length(a, b) < len(a)
    assert sum(seen) < 12 * (len(a) + len(b))


@pytest.mark.parametrize("alphabet", ["a", "ab", "abc ", "abcdefghij "])
@pytest.mark.parametrize("small", [1, 64 * 64])
def test_matching_of_repetitive_texts_equals_difflib(monkeypatch, alphabet, small):
    monkeypatch.setattr(diffing, "_SMALL", small)
    rng = random.Random(len(alphabet))
    for _ in range(25):
        a, c = ("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 250))) for _ in range(2))
        cut = rng.randint(0, len(a))
        for b in (c, a[cut:] + c[:20] + a[:cut]):
            want = sum(x.size for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
            assert diffing.matched_length(a, b) == want
