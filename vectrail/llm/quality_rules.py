"""Quality rules, line first.

Every line is judged alone; failing lines go, then documents that lost too
much of their text go.  Everything is one JVM-side projection: no shuffle, no
Python, and the plan is a scan followed by a generator.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import replacing

BOILERPLATE = (
    "javascript|lorem ipsum|all rights reserved|copyright (©|\\(c\\)|[0-9]{4})|cookie(s)? policy|"
    "uses? cookies|accept (all )?cookies|privacy policy|terms of (use|service)|terms and conditions|"
    "licensed under|click here|read more|sign up (now|for)|subscribe (to|now)|follow us|share this|"
    "powered by|skip to (main )?content|page not found|[{}]"
)
NAVIGATION = "home|about( us)?|contact( us)?|log ?in|sign in|register|search|menu|site ?map|next|previous|back to top|faq|help"
SEPARATORS = "[|»›·•]| > "
TERMINAL = "[.!?…。！？][\"'”’»)\\]]*$"


@dataclass(frozen=True)
class LineRules:
    """``max_punctuation``: share of a line's characters that are neither
    letters, digits, marks nor space.  ``min_separators``: from so many on a
    line is navigation.  ``max_loss``: a document that loses a larger share of
    its characters is rejected."""

    min_words: int = 3
    max_punctuation: float = 0.15
    min_separators: int = 2
    max_loss: float = 0.5


def line_passes(trimmed: Column, low: Column, rules: LineRules = LineRules()) -> Column:
    """Whether a line stays, of the line without outer white space and the same
    in lower case."""
    return (
        F.regexp_like(trimmed, F.lit(TERMINAL))
        & (F.regexp_count(trimmed, F.lit(r"\S+")) >= rules.min_words)
        & (F.regexp_count(trimmed, F.lit(SEPARATORS)) < rules.min_separators)
        & (
            F.length(F.regexp_replace(trimmed, r"[\p{L}\p{N}\p{M}\s]+", ""))
            <= F.lit(rules.max_punctuation) * F.length(trimmed)
        )
        & ~F.regexp_like(low, F.lit(f"^({NAVIGATION})( ?[/,>-] ?({NAVIGATION}))*[.!?]?$"))
        & ~F.regexp_like(low, F.lit(BOILERPLATE))
    )


def good_lines(text: Column, rules: LineRules = LineRules()) -> Column:
    """The lines of a text that stay.  Lambdas are interpreted and share no
    subexpressions, so each step binds what the next one uses more than once."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("x"), F.regexp_replace(x, r"^\s+|\s+$", "").alias("t")))
    lowered = F.transform(trimmed, lambda s: F.struct(s["x"].alias("x"), s["t"].alias("t"), F.lower(s["t"]).alias("l")))
    return F.transform(F.filter(lowered, lambda s: line_passes(s["t"], s["l"], rules)), lambda s: s["x"])


def clean_lines(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The documents that pass, with cleaned text and ``chars_before``,
    ``chars_after`` (both without line breaks).

    Null, empty and blank texts hold nothing to keep and are rejected, as is a
    document whose every line fails.  Repeated rows are judged alike and all
    stay.  Other columns pass through; one named like an output is replaced.
    """
    chars = lambda x: F.length(F.replace(x, F.lit("\n"), F.lit("")))
    # Lambdas bind each intermediate once; a Filter over a Project would be
    # pushed below it and clean every document twice.
    judged = F.filter(
        F.transform(
            F.transform(
                F.array(F.col(text_col)),
                lambda t: F.struct(
                    t.alias("t"),
                    F.array_join(good_lines(t, rules), "\n").alias("c"),
                ),
            ),
            lambda s: F.struct(s["c"].alias("c"), chars(s["t"]).alias("b"), chars(s["c"]).alias("a")),
        ),
        lambda s: (s["a"] > 0) & (s["b"] - s["a"] <= F.lit(rules.max_loss) * s["b"]),
    )
    src = replacing(docs, "chars_before", "chars_after")
    cols = [F.col(f"`{c}`") for c in src.columns if c != text_col]
    out = src.select(*cols, F.explode(judged).alias("__judged"))
    names = [F.col("__judged.c").alias(c) if c == text_col else F.col(f"`{c}`") for c in src.columns]
    return out.select(
        *names, F.col("__judged.b").alias("chars_before"), F.col("__judged.a").alias("chars_after")
    )


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def oracle(rules: LineRules = LineRules()) -> str:
    low = "lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))"
    trimmed = "regexp_replace(x, '^\\s+|\\s+$', '', 'g')"
    passes = f"""
        regexp_matches({trimmed}, '{_quoted(TERMINAL)}')
        AND len(regexp_extract_all({trimmed}, '\\S+')) >= {rules.min_words}
        AND len(regexp_extract_all({trimmed}, '{SEPARATORS}')) < {rules.min_separators}
        AND length(regexp_replace({trimmed}, '[\\p{{L}}\\p{{N}}\\p{{M}}\\s]+', '', 'g'))
            <= {rules.max_punctuation} * length({trimmed})
        AND NOT regexp_matches({low}, '^({NAVIGATION})( ?[/,>-] ?({NAVIGATION}))*[.!?]?$')
        AND NOT regexp_matches({low}, '{_quoted(BOILERPLATE)}')"""
    return f"""
    WITH c AS (
      SELECT *, array_to_string(list_filter(string_split(text, chr(10)), lambda x: {passes}), chr(10)) AS t2
      FROM documents),
    m AS (
      SELECT doc_id, t2 AS text, lang, source, n_chars,
             length(replace(text, chr(10), '')) AS chars_before,
             length(replace(t2, chr(10), '')) AS chars_after
      FROM c)
    SELECT * FROM m WHERE chars_after > 0 AND chars_before - chars_after <= {rules.max_loss} * chars_before"""
