"""Benchmark decontamination by a positional inverted index.

The index keeps, for every word that some benchmark item uses, each document and place where the corpus has it. A phrase
is looked up by its rarest words: their places, moved back by the offset within the
phrase, must fall together. What is left is compared word by word.
Everything here is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.llm.storage import small, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands after the last word of a document, so that its place tells how many words there are.
END = ""
#: Vocabularies and phrase lists up to this many rows are broadcast (some 100 MB); longer ones are shuffled.
BROADCAST_ROWS = 1_000_000


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII only take the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, size: int = 10) -> DataFrame:
    """Distinct windows of the items: window_id, words, n; and the items of each: item_ids."""
    split = items.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = split.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), F.lit(size)).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item_id").alias("item_ids")).select(
        F.sha2(F.array_join("words", " "), 256).alias("window_id"), "words", F.size("words").alias("n"), "item_ids")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of the row that needs no unique ids."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings (term, row_key, pos) of the words in `vocabulary` and of the end marks, sorted by term and stored."""
    terms = small(vocabulary.select("term").union(docs.sparkSession.createDataFrame([(END,)], "term string")).distinct(), BROADCAST_ROWS)
    every = keyed(docs).select("row_key", F.posexplode(F.array_append(words_of(F.col("text")), END)).alias("pos", "term"))
    return written(every.join(terms, "term").sortWithinPartitions("term", "row_key", "pos"), "postings")


def rarest_terms(index: DataFrame, windows: DataFrame, most: int = 2) -> DataFrame:
    """The `most` rarest words of each window that can occur at all: window_id, n, rank, term, offset."""
    counts = index.groupBy("term").agg(F.count("*").alias("places"))
    each = windows.select("window_id", "n", F.posexplode("words").alias("offset", "term")).join(counts, "term", "left")
    ahead = Window.partitionBy("window_id")
    ranked = each.withColumn("known", F.count("places").over(ahead)).withColumn("rank", F.row_number().over(ahead.orderBy("places", "offset")))
    return ranked.filter((F.col("known") == F.col("n")) & (F.col("rank") <= most)).select("window_id", "n", "rank", "term", "offset")


def offset_lists(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """Where each window would start, by the places of its chosen words: window_id, n, rank, row_key, start."""
    return index.join(small(chosen, BROADCAST_ROWS), "term").select(
        "window_id", "n", "rank", "row_key", (F.col("pos") - F.col("offset")).alias("start")).filter("start >= 0")


def candidate_starts(lists: DataFrame) -> DataFrame:
    """Starts on which the lists of all chosen words agree (equal rows vote twice; the words are compared later)."""
    agreed = lists.groupBy("window_id", "row_key", "start").agg(F.count("*").alias("votes"), F.min("n").alias("n"))
    return agreed.filter(F.col("votes") >= F.least(F.col("n"), F.lit(2))).select("window_id", "row_key", "start")


def phrase_matches(docs: DataFrame, windows: DataFrame, candidates: DataFrame, size: int = 10) -> DataFrame:
    """Candidates whose words all stand there: row_key, window_id, start, n."""
    by_doc = candidates.groupBy("row_key").agg(F.collect_list(F.struct("window_id", "start")).alias("found"))
    texts = keyed(docs).select("row_key", "text").join(by_doc, "row_key").select(
        "row_key", words_of(F.col("text")).alias("w"), "found").select("row_key", "w", F.explode("found").alias("f"))
    reach = texts.select("row_key", F.col("f.window_id").alias("window_id"), F.col("f.start").alias("start"),
                         F.slice("w", F.col("f.start") + 1, F.lit(size)).alias("ahead"))
    known = small(windows.select("window_id", "words", "n"), BROADCAST_ROWS)
    return reach.join(known, "window_id").filter(F.slice("ahead", F.lit(1), F.col("n")) == F.col("words")).select(
        "row_key", "window_id", "start", "n").distinct()


def proximity_matches(lists: DataFrame, slop: int = 5) -> DataFrame:
    """Where the two rarest words of a window stand in order but up to `slop` words too near or too far: row_key, window_id, start, gap."""
    a = lists.filter("rank = 1").select("window_id", "row_key", "start")
    b = lists.filter("rank = 2").select("window_id", "row_key", F.col("start").alias("other"))
    gap = F.abs(F.col("other") - F.col("start"))
    return a.join(b, ["window_id", "row_key"]).filter((gap >= 1) & (gap <= slop)).select("row_key", "window_id", "start", gap.alias("gap"))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 5) -> DataFrame:
    """Per document: words inside any exact occurrence of an item's window, and the items met.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. A window is
    `size` consecutive words of an item, or the whole item if it is shorter. Null and wordless texts have no words and no
    hits; an item without words has no window; equal rows give equal results; an item given twice counts
    once, an item without id is not reported; empty tables give no rows, or rows without hits. `near_items` lists items met only
    loosely: two rarest words of a window at most `slop` words off.
    """
    windows = written(item_windows(items, size), "windows")
    index = build_index(docs, windows.select(F.explode("words").alias("term")))
    lists = written(offset_lists(index, rarest_terms(index, windows)), "lists")
    matches = written(phrase_matches(docs, windows, candidate_starts(lists), size), "matches")
    hit = matches.select("row_key", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos")).distinct()
    hits = hit.groupBy("row_key").agg(F.count("*").alias("n_hit"))
    owners = windows.select("window_id", F.explode("item_ids").alias("item_id"))
    met = matches.select("row_key", "window_id").distinct().join(owners, "window_id").groupBy("row_key").agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    near = proximity_matches(lists, slop).select("row_key", "window_id").distinct().join(owners, "window_id").groupBy("row_key").agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("near_items"))
    lengths = index.filter(F.col("term") == END).groupBy("row_key").agg(F.max("pos").cast("long").alias("n_words"))
    found = lengths.join(hits, "row_key", "left").join(met, "row_key", "left").join(near, "row_key", "left")
    none = F.array().cast("array<string>")
    return keyed(docs).select("doc_id", "row_key").join(found, "row_key").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"),
        F.array_except(F.coalesce("near_items", none), F.coalesce("item_ids", none)).alias("near_items"), "row_key")


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "near_items")


QUERIES = {"op8_benchmark_decontamination": (op8_benchmark_decontamination, None)}
