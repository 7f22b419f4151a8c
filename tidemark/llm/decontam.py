"""Benchmark decontamination: a prefix-filtered join of item windows with document positions.

A window is 13 consecutive words of an item (all words of a shorter one). An occurrence holds every word
of the window, so one necessary prefix word is enough to find it: the rarest, by its count over all
documents; a window with a word that no document has cannot occur. Consecutive windows with the same
rarest word at the same place form one probe. Document positions join probes on that word; the length
of the document bounds which windows of the probe fit around the position, and the rest is an exact
comparison of word slices. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

WINDOW = 13
#: Contaminated: at least one word in this many is hit.
SHARE = 20
#: Probes and item words are broadcast up to so many rows (a row is some 300 bytes at most for ordinary words);
#: beyond it, keys alone are shuffled and texts are joined to the positions found.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes that part words: all of ASCII but digits and letters.
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words of a text; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _BREAK), "")


def _probes(items: DataFrame, counts: DataFrame) -> DataFrame:
    """word, item, at (its place), lo, hi (first and last window start that it probes), size (of a window),
    near (the item's words from lo to the end of the last window)."""
    placed = items.select("item", "words", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    ranked = placed.join(counts, "word", "left").withColumn("rank", F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "word", "at"))
    window = Window.partitionBy("item", "words").orderBy("at").rowsBetween(0, WINDOW - 1)
    size = F.least("n", F.lit(WINDOW))
    starts = ranked.withColumn("least", F.min("rank").over(window)).where(F.col("at") + size <= F.col("n")).where("least.seen > 0")
    probe = starts.groupBy("item", "words", F.col("least.word").alias("word"), F.col("least.at").alias("at")).agg(
        F.min("at").alias("lo"), F.max("at").alias("hi"), F.any_value(size).alias("size"))
    return probe.select("word", "item", "at", "lo", "hi", "size", F.slice("words", F.col("lo") + 1, F.col("hi") - F.col("lo") + F.col("size")).alias("near"))


def _small(df: DataFrame, width: Column) -> bool:
    """Is the frame within the bounds of a broadcast?"""
    rows, size = df.agg(F.count("*"), F.sum(width)).first()
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def _fits() -> tuple[Column, Column]:
    """First and last window start that the document's length allows around place `d` of `n`."""
    return F.greatest(F.col("lo"), F.col("at") - F.col("d")), F.least(F.col("hi"), F.col("n") - F.col("size") + F.col("at") - F.col("d"))


def _occurrences() -> Column:
    """Places in the document where windows of the probe really occur."""
    first, last = _fits()
    here = lambda s: F.slice("words", F.col("d") - F.col("at") + s + 1, F.col("size"))
    there = lambda s: F.slice("near", s - F.col("lo") + 1, F.col("size"))
    return F.transform(F.filter(F.sequence(first, last), lambda s: here(s) == there(s)), lambda s: s - F.col("at") + F.col("d"))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated for each row of `docs`.

    A document word inside any occurrence of a window is hit; the others are as their names say, items
    listed by id. Null and empty texts have no words and no hits; empty items have no window; items of
    one id count once, and an item without id is hit but not listed; repeated rows get equal results, and
    rows that share an id each get that of their own text; other columns are ignored.
    """
    # a row is known by its id and text, so that rows that share an id do not mix
    base = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"), F.coalesce(F.xxhash64(F.col(text).cast("string")), F.lit(0)).alias("mark"))
    items = benchmark.select(F.coalesce(F.col(item_key).cast("string"), F.lit("")).alias("item"), words(F.col(item_text)).alias("words")).where(F.size("words") > 0).distinct()
    vocabulary = items.select(F.explode("words").alias("word")).distinct()
    if _small(vocabulary, F.octet_length("word")):
        vocabulary = F.broadcast(vocabulary)
    counts = base.select(F.explode(words(F.col("text"))).alias("word")).join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("seen"))
    # a table of the item windows' size; its bytes decide how it is joined
    probes = stored(_probes(items, counts), "probes")
    if _small(probes, F.octet_length("word") + F.octet_length(F.array_join("near", " ")) + 40):
        probes = F.broadcast(probes)
    # only positions leave the task, and only those with a probe that fits; texts meet them by row
    placed = base.select("id", "mark", words(F.col("text")).alias("words")).select("id", "mark", F.size("words").alias("n"), F.posexplode("words").alias("d", "word"))
    first, last = _fits()
    found = placed.join(probes, "word").where(first <= last)
    found = found.groupBy(F.col("id").alias("its_id"), F.col("mark").alias("its_mark")).agg(
        F.collect_set(F.struct("d", "n", "item", "at", "lo", "hi", "size", "near")).alias("probes"))
    met = base.join(found, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("mark") == F.col("its_mark")))
    texts = met.dropDuplicates(["id", "mark"])  # of rows that may be hit only
    # the explode keeps the words in a column: they are made once for each row
    tried = texts.select("id", "mark", words(F.col("text")).alias("words"), "probes").select("id", "mark", "words", F.explode("probes").alias("probe"))
    found = tried.select("id", "mark", "words", "probe.*").select("id", "mark", "item", "size", _occurrences().alias("places")).where(F.size("places") > 0)
    spans = F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("size") - 1)))
    hits = found.groupBy(F.col("id").alias("hit_id"), F.col("mark").alias("hit_mark")).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(spans)))).cast("long").alias("n_hit"),
        F.array_sort(F.array_remove(F.collect_set("item"), "")).alias("items"))
    same = F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("mark") == F.col("hit_mark"))
    n_hit, n = F.coalesce("n_hit", F.lit(0)), F.col("n").cast("long")
    return base.select("id", "mark", F.size(words(F.col("text"))).alias("n")).join(hits, same, "left").select(
        F.col("id").alias(key), n.alias("n_words"), n_hit.cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (SHARE * n_hit >= n)).alias("contaminated"))
