"""Column expressions for article text. Everything here stays inside Catalyst."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import ENGLISH_STOP_WORDS, LOG_TEXT_CHARS, NA_STRINGS, TOKEN_PATTERN, WHITESPACE


def quoted(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(text: Column | str) -> Column:
    """Trim all white space, not only blanks.

    A character set, not an anchored regular expression: linear also on long inner runs of blanks.
    """
    return F.btrim(text, F.lit(WHITESPACE))


def joined_text(*parts: Column | str) -> Column:
    """Lower-cased, stripped concatenation; a null part leaves its separating blanks in place."""
    filled = [F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts]
    return strip(F.lower(reduce(lambda left, right: F.concat(left, F.lit(" "), right), filled)))


def has_text(*parts: Column | str) -> Column:
    """Whether `joined_text` of the parts has any length.

    Asked of the parts one after the other, mostly the first settles it. A filter on the joined
    text itself would be pushed below it and build every text twice.
    """
    return reduce(
        lambda left, right: left | right,
        [F.coalesce(F.length(strip(part)) > 0, F.lit(False)) for part in parts],
    )


def is_blank(text: Column | str) -> Column:
    return F.length(strip(text)) == 0


def log_text(text: Column | str) -> Column:
    """The part of a text that the log keeps, counted in code points."""
    return F.substring(text, 1, LOG_TEXT_CHARS)


def null_if_na(column: Column) -> Column:
    """Null for the strings that CSV files use for a missing value."""
    return F.when(column.isin(*NA_STRINGS), None).otherwise(column)


def sql_string(value: str) -> str:
    """A raw Spark SQL string literal; the values are patterns and stop words."""
    if "'" in value:
        raise ValueError(f"a quote is not allowed here: {value!r}")
    return f"r'{value}'"


def tokens_sql(text: str, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> str:
    """SQL for the array of words of `text`, in order and with repeats, without stop words."""
    words = f"regexp_extract_all(lower(coalesce({text}, '')), {sql_string(TOKEN_PATTERN)}, 0)"
    usable = [w for w in dict.fromkeys(stop_words) if "'" not in w]
    if not usable:
        return words
    return f"filter({words}, w -> w NOT IN ({', '.join(map(sql_string, usable))}))"


def bigrams_sql(tokens: str) -> str:
    """SQL for the pairs of neighbouring words, joined by a blank."""
    return (
        f"CASE WHEN size({tokens}) < 2 THEN CAST(array() AS array<string>) ELSE "
        f"zip_with(slice({tokens}, 1, size({tokens}) - 1), slice({tokens}, 2, size({tokens}) - 1),"
        f" (a, b) -> concat(a, ' ', b)) END"
    )


def neighbours_sql(tokens: str, value: str) -> str:
    """SQL for an array of `value`, an expression of `a` and `b`, for neighbouring words a and b."""
    n = f"greatest(size({tokens}) - 1, 0)"
    return f"zip_with(slice({tokens}, 1, {n}), slice({tokens}, 2, {n}), (a, b) -> {value})"


def terms_sql(tokens: str) -> str:
    """SQL for words followed by word pairs."""
    return f"concat({tokens}, {bigrams_sql(tokens)})"


def tokens(text: str, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    return F.expr(tokens_sql(text, stop_words))


def bigrams(tokens_column: str) -> Column:
    return F.expr(bigrams_sql(tokens_column))


def terms(tokens_column: str) -> Column:
    return F.expr(terms_sql(tokens_column))
