"""Scalar text functions as Column expressions: no Python runs per row.

White space follows Unicode (``WHITESPACE``) and not the ASCII class of Java
regular expressions, and word boundaries are spelled out, so that results do
not depend on the JDK.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redline import constants as K

# As a property class this is several times faster than a list of the characters.
_WS_CLASS = r"[\s\x1c-\x1f]"
_WS_RUN = f"(?U){_WS_CLASS}+"
_LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_NOT_IN_WORD = r"(?![\p{L}\p{N}_])"
# Fixed value: a number followed by one of the units that must survive editing.
_MEASUREMENT = (
    r"(?U)\d+(?:\.\d+)?" + _WS_CLASS + r"*(?:mL|ml|mm|cm|cc|mmHg|mm" + _WS_CLASS
    + r"*hg|kPa|degrees?|deg)"
)


def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use`` as a lambda variable.

    The optimizer merges projections, and what it moves into the lambda of a
    higher-order function runs once per element.  A bound value never does.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Unicode strip on both sides."""
    return F.trim(c, F.lit(K.WHITESPACE))


def strip_newlines(c: Column) -> Column:
    return F.trim(c, F.lit("\n"))


def is_blank(c: Column) -> Column:
    return strip(text(c)) == ""


def collapse(c: Column) -> Column:
    """Trim and turn each run of white space into one blank."""
    return F.regexp_replace(strip(text(c)), _WS_RUN, " ")


def normalize(c: Column) -> Column:
    """Comparison form of a text: trimmed, lower case, single blanks, null as empty."""
    return F.regexp_replace(F.lower(strip(text(c))), _WS_RUN, " ")


def same(a: Column, b: Column) -> Column:
    """Equal in comparison form; texts that are equal as they stand are not normalized."""
    return a.eqNullSafe(b) | (normalize(a) == normalize(b))


def contains_normalized(needle: Column, haystack: Column) -> Column:
    """Both arguments already normalized; an empty needle is always present."""
    return (needle == "") | F.contains(haystack, needle)


def all_tokens(c: Column) -> Column:
    """Lower-case ASCII alphanumeric runs of two or more that end a word, in order."""
    return F.regexp_extract_all(
        F.lower(text(c)), F.lit("([a-z0-9]{2,})" + _NOT_IN_WORD), F.lit(1)
    )


def terms(c: Column) -> Column:
    """Tokens of three or more characters without stop words, repeats kept."""
    return F.filter(
        all_tokens(c), lambda t: (F.length(t) >= K.MIN_TERM_LENGTH) & ~t.isin(*K.STOP_WORDS)
    )


def token_set(c: Column) -> Column:
    """Distinct tokens without stop words."""
    return F.array_except(all_tokens(c), F.array(*[F.lit(w) for w in K.STOP_WORDS]))


def body_part_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeats; 0 when both are empty."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(0.0)).otherwise(shared / union)


def bracket_spans(c: Column) -> Column:
    """Bracketed spans, or the lone bracket when none is closed."""
    t = text(c)
    spans = F.regexp_extract_all(t, F.lit(r"\[[^\]]*\]"), F.lit(0))
    return (
        F.when(F.size(spans) > 0, spans)
        .when(F.contains(t, F.lit("[")), F.array(F.lit("[")))
        .when(F.contains(t, F.lit("]")), F.array(F.lit("]")))
        .otherwise(F.array().cast("array<string>"))
    )


def drop_brackets(c: Column) -> Column:
    return F.regexp_replace(c, r"[\[\]]", "")


def measurements(c: Column) -> Column:
    """Every measurement of a text, in order, repeats kept."""
    return F.regexp_extract_all(text(c), F.lit(_MEASUREMENT), F.lit(0))


def missing_measurements(dictation: Column, report: Column) -> Column:
    """Measurements of the dictation whose lower-case text the report lacks."""
    found = F.transform(measurements(dictation), strip)
    return bind(
        F.lower(text(report)),
        lambda low: F.filter(found, lambda m: (m != "") & ~F.contains(low, F.lower(m))),
    )


def laterality(c: Column) -> Column:
    """``bilateral`` when named, else the side named more often, else null."""
    t = text(c)

    def count(word: str) -> Column:
        return F.regexp_count(t, F.lit(r"(?iU)(?<![\p{L}\p{N}_])" + word + _NOT_IN_WORD))

    left, right = count("left"), count("right")
    return (
        F.when(count("bilateral") > 0, "bilateral")
        .when(left > right, "left")
        .when(right > left, "right")
    )


def generic_term(body_part: Column) -> Column:
    """Body part in lower case without its first matching suffix."""
    term = F.lower(strip(text(body_part)))
    out = term
    for suffix in reversed(K.GENERIC_SUFFIXES):
        out = F.when(
            F.endswith(term, F.lit(suffix)) & (F.length(term) > len(suffix)),
            F.left(term, F.length(term) - len(suffix)),
        ).otherwise(out)
    return out


def placeholders_in(c: Column) -> Column:
    """The known placeholders that occur in a text, in fixed order."""
    known = F.array(*[F.lit(p) for p in K.PLACEHOLDERS])
    return bind(text(c), lambda t: F.filter(known, lambda p: F.contains(t, p)))


# Fixed value: what stands for an empty dictation.
NO_DICTATION = "No significant abnormality."


def snippet(dictation: Column) -> Column:
    """At most 120 characters of a dictation on one line."""
    one_line = collapse(dictation)
    full = F.when(one_line == "", F.lit(NO_DICTATION)).otherwise(one_line)
    cut = F.concat(F.rtrim(F.left(full, F.lit(120)), F.lit(" ,.;")), F.lit(" ..."))
    return F.when(F.length(full) > 120, cut).otherwise(full)


def split_lines(c: Column) -> Column:
    """Lines under every Unicode line break; a final break adds no line."""
    parts = F.split(c, _LINE_BREAK, -1)
    last_empty = F.element_at(parts, -1) == ""
    return F.when(last_empty, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def quoted_list(items: Column) -> Column:
    """An array of strings as one bracketed, quoted list for messages."""
    return F.concat(
        F.lit("["),
        F.array_join(F.transform(items, lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", "),
        F.lit("]"),
    )


def round_unit(x: Column, digits: int) -> Column:
    """Round a value of [0, 1] on its exact binary form, ties to even.

    ``round`` works on the shortest decimal form and so differs from Python's
    on ties.  Scaled by 2**62 the value is an exact integer, and the rest is
    integer arithmetic on decimals.
    """
    one = F.lit(1 << 62).cast("decimal(20,0)")
    scaled = (x * float(1 << 62)).cast("bigint").cast("decimal(20,0)") * F.lit(10**digits).cast("decimal(8,0)")
    low = F.call_function("div", scaled, one)
    twice = (scaled % one) * 2
    up = (twice > one) | ((twice == one) & (low % 2 == 1))
    return (low + F.when(up, 1).otherwise(0)).cast("double") / float(10**digits)
