"""Line-first cleaning: rules judge every line, failed lines go, documents that lose too much go.

DataFrame expressions only; every document stays in its own row, so there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

# Phrases that mark a line as page furniture.
BOILERPLATE = [
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "lorem ipsum", "click here", "read more", "sign up for our newsletter", "share this page",
    "back to top", "skip to content", "powered by",
]
#: Marks that stand between the entries of a menu.
SEPARATOR = r"[|»›•·→]"
#: A line may end with a sentence mark and closing quotes or brackets.
SENTENCE_END = r"[.!?…:;。！？][\"'”’»)\]]*[\x20\x09-\x0D]*$"
MENU_MARKS = 3  # a line with this many separators, and one for every four words at least, is a menu
SHORT_WORDS = 3  # a line of fewer words without a sentence end is a fragment


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def line_fails(line: Column) -> Column:
    """Punctuation, navigation and boilerplate rules for one line that has a word."""
    words, marks = F.regexp_count(line, F.lit(WORD)), F.regexp_count(line, F.lit(SEPARATOR))
    symbols, no_end = F.regexp_count(line, F.lit(SYMBOL)), ~line.rlike(SENTENCE_END)
    boilerplate = F.lower(line).rlike("|".join(BOILERPLATE))
    navigation = (marks >= MENU_MARKS) & (marks * 4 >= words)
    punctuation = (symbols * 2 > words) | (no_end & (words < SHORT_WORDS)) | ~line.rlike(r"\p{L}")
    return boilerplate | navigation | punctuation


def repeat_words(hashes: str, size: int = 8) -> Column:
    """Words inside windows of `size` words that stand in the text more than once.

    Windows are named by hashing pairs of pairs of pairs of word hashes. Only texts with an equal
    pair of names sort them; equal names are then neighbours, and the
    places found count `size` words each, less what the next one covers too.
    """
    name, span = F.col(hashes), 1
    while span < size:
        name = F.zip_with(name, F.slice(name, span + 1, F.greatest(F.size(name) - span, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        span *= 2
    return F.when(F.size(hashes) >= size, F.slice(name, F.lit(1), F.greatest(F.size(hashes) - size + 1, F.lit(0)))).otherwise(
        F.array().cast("array<bigint>"))


def _measured(docs: DataFrame, size: int = 8) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    one = docs.select("doc_id", text.alias("text")).withColumn("words", words_of(F.col("text")))
    one = one.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    one = one.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    one = one.withColumn("names", repeat_words("hashes", size))
    again = F.size(F.array_distinct("names")) < F.size("names")
    ranked = F.array_sort(F.transform("names", lambda n, i: F.struct(n.alias("n"), i.alias("i"))))
    one = one.withColumn("ranked", F.when(again, ranked))
    after = F.slice("ranked", F.lit(2), F.size("ranked"))
    before = F.concat(F.array(F.lit(None).cast("struct<n:bigint,i:int>")), F.slice("ranked", F.lit(1), F.size("ranked") - 1))
    trio = F.arrays_zip(before.alias("p"), F.col("ranked").alias("x"), after.alias("q"))
    kept = F.filter(trio, lambda t: F.coalesce(t["p"]["n"] == t["x"]["n"], F.lit(False)) | F.coalesce(t["q"]["n"] == t["x"]["n"], F.lit(False)))
    one = one.withColumn("places", F.when(again, F.array_sort(F.transform(kept, lambda t: t["x"]["i"]))))
    gaps = F.zip_with(F.slice("places", F.lit(1), F.size("places") - 1), F.slice("places", F.lit(2), F.size("places")), lambda a, b: F.least(b - a, F.lit(size)))
    covered = F.aggregate(gaps, F.lit(size), lambda s, g: s + g)
    return one.select(
        "doc_id", "text", "lines",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(again, covered).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def clean_lines(docs: DataFrame, most_lost: int = 50, least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """Line rules, cleaned text and verdict for each document.

    Words are runs of anything but ASCII white space. Base failure: fewer than `least_words` words, or
    over `most_repeated` % of the words in repeated 8-word windows. Otherwise a document is
    kept unless the lines that fail hold over `most_lost` % of its characters. `clean_text` has the
    lines that passed. Null and blank texts have no words and fail; each row is judged by itself, so
    equal rows get equal results; an empty table gives an empty table; further columns are ignored.
    """
    judged = _measured(docs).withColumn("good_lines", F.filter("lines", lambda x: ~line_fails(x)))
    chars = F.char_length(F.array_join("lines", "")).cast("long")
    left = F.char_length(F.array_join("good_lines", "")).cast("long")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return judged.withColumns({"n_chars_in_lines": chars, "n_chars_lost": chars - left, "base_failed": failed}).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (100 * F.col("n_chars_lost") <= most_lost * F.col("n_chars_in_lines"))).alias("kept"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("good_lines")).cast("long").alias("n_lines_failed"),
        "n_chars_lost", F.array_join("good_lines", "\n").alias("clean_text"))


def op5_line_quality(spark, sf_dir: str) -> DataFrame:
    return clean_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("clean_text")


QUERIES = {"op5_line_quality": (op5_line_quality, None)}
