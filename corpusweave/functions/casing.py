"""Identifier case styles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = r"\p{Lu}"


def words_at_capitals(text: Column) -> Column:
    """`userName` gives `user`, `Name`: every capital starts a word."""
    return F.regexp_extract_all(text, F.lit(r"\p{Lu}[^\p{Lu}]*|^[^\p{Lu}]+"), F.lit(0))


def case_style(text: Column) -> Column:
    """lower, upper, snake, screaming, kebab, camel, pascal, mixed or unknown."""
    has_upper = text.rlike(UPPER)
    has_lower = text.rlike(r"\p{Ll}")
    has_uncased = text.rlike(r"[\p{Lt}\p{Lm}\p{Lo}]")
    words = words_at_capitals(text)
    long_words = F.size(F.filter(words, lambda w: F.length(w) > 1))
    all_long = long_words == F.size(words)
    clean = all_long | (long_words <= 1)
    return (
        F.when(text == "", "unknown")
        .when(F.length(text) == 1, "lower")
        .when(text.contains("_") & ~has_lower & ~has_uncased, "screaming")
        .when(text.contains("_"), "snake")
        .when(text.contains("-"), "kebab")
        .when(~has_lower & ~has_uncased, "upper")
        .when(~has_upper & ~has_uncased, "lower")
        .when(~(has_upper & has_lower), "unknown")
        .when(~clean, "mixed")
        .when(F.substring(text, 1, 1).rlike(UPPER), "pascal")
        .otherwise("camel")
    )


def identifier_words(text: Column) -> Column:
    """Lower-case words of an identifier in any style; digits stay with their word."""
    spaced = F.regexp_replace(text, r"(\p{Lu})([^\p{Lu}])", " $1$2")
    separator = (
        F.when(text.contains("_"), F.split(text, "_"))
        .when(text.contains("-"), F.split(text, "-"))
        .otherwise(F.split(spaced, r"[^\p{L}\p{N}]+"))
    )
    return F.transform(F.filter(separator, lambda w: w != ""), lambda w: F.lower(w))


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))


def in_style(text: Column, style: Column) -> Column:
    """`text` rewritten in a style; mixed and unknown fall back to Pascal."""
    words = identifier_words(text)
    pascal = F.array_join(F.transform(words, _capital), "")
    camel = F.concat(
        F.coalesce(F.get(words, F.lit(0)), F.lit("")),
        F.array_join(F.transform(F.slice(words, F.lit(2), F.size(words)), _capital), ""),
    )
    plain = F.array_join(words, "")
    return (
        F.when(text == "", "")
        .when(
            F.length(text) == 1,
            F.when(style.isin("upper", "screaming"), F.upper(text)).otherwise(F.lower(text)),
        )
        .when(style == "lower", plain)
        .when(style == "upper", F.upper(plain))
        .when(style == "snake", F.array_join(words, "_"))
        .when(style == "screaming", F.upper(F.array_join(words, "_")))
        .when(style == "kebab", F.array_join(words, "-"))
        .when(style == "camel", camel)
        .otherwise(pascal)
    )
