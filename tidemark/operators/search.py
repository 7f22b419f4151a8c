"""bm25 text search as scans, and over a written token index.

A search over a table needs no posting lists: term counts come from higher-order functions on each
row, the four corpus statistics are one global aggregate, and the only exchange is the top-k.
`write_index` / `search_index` keep the same scores for repeated queries over one corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import contains_folded, overlapping_count, phrase_count, phrase_tokens, tokens

# bm25 parameters and the floor of a non-positive idf.
K1, B, MIN_IDF = 1.2, 0.75, 1e-6
MIN_GRAM = 3


def bm25_term(f: Column, n: Column, total: Column, dl: Column, avgdl: Column) -> Column:
    idf = F.log((total - n + 0.5) / (n + 0.5))
    idf = F.when(idf <= 0, F.lit(MIN_IDF)).otherwise(idf)
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avgdl))


def _scored(rows: DataFrame, freqs: list[Column], dl: Column) -> DataFrame:
    """Rows that hold every term, with `score` (more negative is better).

    Statistics cover the whole corpus, rows a reader will not see included.
    """
    counted = rows.select("*", dl.alias("_dl"), *[f.alias(f"_f{i}") for i, f in enumerate(freqs)])
    stats = counted.agg(F.count("*").alias("N"), F.sum("_dl").alias("L"),
                        *[F.count_if(F.col(f"_f{i}") > 0).alias(f"n{i}") for i in range(len(freqs))])
    s = stats.select(F.struct("*")).scalar()
    matched = counted.where(reduce(lambda a, b: a & b, [F.col(f"_f{i}") > 0 for i in range(len(freqs))]))
    matched = matched.withColumn("_s", s)
    total, avgdl = F.col("_s.N").cast("double"), F.col("_s.L") / F.col("_s.N")
    terms = [bm25_term(F.col(f"_f{i}").cast("double"), F.col(f"_s.n{i}"), total, F.col("_dl"), avgdl)
             for i in range(len(freqs))]
    score = -reduce(lambda a, b: a + b, terms)
    return matched.withColumn("score", score).drop("_dl", "_s", *[f"_f{i}" for i in range(len(freqs))])


def literal_matches(rows: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Rows holding every whitespace term of the query as a phrase, scored by bm25."""
    phrases = [p for p in (phrase_tokens(t) for t in query.split()) if p]
    if not phrases:
        return rows.where(F.lit(False)).withColumn("score", F.lit(None).cast("double"))
    tokenised = rows.withColumn("_tok", tokens(text))
    freqs = [phrase_count(F.col("_tok"), p) for p in phrases]
    return _scored(tokenised, freqs, F.size("_tok")).drop("_tok")


def fuzzy_matches(rows: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Substring search: terms of three or more characters are scored over trigrams, shorter ones
    only filter. With short terms alone the score is NULL."""
    terms = query.split()
    long_terms = [t for t in terms if len(t) >= MIN_GRAM]
    short = [t for t in terms if len(t) < MIN_GRAM]
    keep = F.lit(bool(terms))
    for t in short:
        keep = keep & contains_folded(text, t)
    if not long_terms:
        return rows.where(keep).withColumn("score", F.lit(None).cast("double"))
    folded = rows.withColumn("_low", F.lower(F.col(text)))
    freqs = [overlapping_count(F.col("_low"), t.lower()) for t in long_terms]
    grams = F.greatest(F.length("_low") - (MIN_GRAM - 1), F.lit(0))
    return _scored(folded, freqs, grams).drop("_low").where(keep)


def matches(rows: DataFrame, query: str, fuzzy: bool = False, text: str = "text") -> DataFrame:
    return fuzzy_matches(rows, query, text) if fuzzy else literal_matches(rows, query, text)


def is_scored(query: str, fuzzy: bool) -> bool:
    return not fuzzy or any(len(t) >= MIN_GRAM for t in query.split())


def ranked(found: DataFrame, scored: bool, tie_break: bool = True) -> list[Column]:
    """Sort columns: best score first, newest first when nothing is scored."""
    tail = ["device_id", "id"] if tie_break else ["id"]
    if scored:
        return [F.col(c) for c in ("score", "start_utc_ms", *tail)]
    return [F.col("start_utc_ms").desc(), *[F.col(c) for c in tail]]


def address_end(start: str = "start_utc_ms", end: str = "end_utc_ms") -> Column:
    """A point row still gets a non-empty address."""
    return F.greatest(F.col(end), F.col(start) + 1)


# ------------------------------------------------------------- written index

INDEX_BUCKETS = 256  # term buckets of a written index; writer and reader must agree


def postings(rows: DataFrame, text: str = "text", buckets: int = INDEX_BUCKETS) -> DataFrame:
    """(term, id, tf, positions, dl, bucket): one row per term of a document."""
    # The length is settled below the explode; above it, it would be counted again for every token.
    whole = rows.select("id", tokens(text).alias("_t")).select("id", "_t", F.size("_t").alias("dl"))
    tok = whole.select("id", "dl", F.posexplode("_t").alias("pos", "term"))
    return (tok.groupBy("id", "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"),
                                          F.first("dl").alias("dl"))
            .withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")))


def write_index(rows: DataFrame, path: str, text: str = "text", part: int = 0, buckets: int = INDEX_BUCKETS) -> None:
    """Write postings by part and term bucket, document lengths beside them.

    Files are split by a hash of the document inside a bucket, so a very common term is many files
    and not one task. A part is overwritten as a whole, so a repeated write changes nothing;
    changed documents are handled by rewriting their part.
    """
    spread = F.pmod(F.xxhash64("id"), F.lit(16))
    target = F.lit(part).cast("bigint")

    def save(df: DataFrame, name: str, *by: str) -> None:
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", *by)
         .parquet(f"{path}/{name}"))

    save(postings(rows, text, buckets).withColumn("part", target).repartition("bucket", spread)
         .sortWithinPartitions("bucket", "term"), "postings", "bucket")
    save(rows.select("id", F.size(tokens(text)).alias("dl"), target.alias("part")), "lengths")


def append_index(rows: DataFrame, path: str, batch_id: int, text: str = "text", buckets: int = INDEX_BUCKETS) -> None:
    """A micro-batch as its own part: index upkeep for a stream, safe to replay."""
    write_index(rows, path, text, batch_id, buckets)


def search_index(spark: SparkSession, path: str, query: str, buckets: int = INDEX_BUCKETS) -> DataFrame:
    """(id, score) of documents that hold every single-token term, read from the index.

    Only the term buckets of the query are read; document frequencies come from the same rows.
    """
    terms = [t for q in query.split() for t in phrase_tokens(q)]
    if len(terms) != len(query.split()):
        raise ValueError("the index answers single-token terms; scan for phrases")
    lengths = spark.read.parquet(f"{path}/lengths")
    stats = lengths.agg(F.count("*").alias("N"), F.sum("dl").alias("L")).select(F.struct("*")).scalar()
    numbers = F.array_distinct(F.array(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)).cast("int") for t in set(terms)]))
    wanted = spark.range(1).select(numbers.alias("b")).first().b  # at most one value per query term
    hits = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(wanted) & F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count("*").alias("n"))
    scored = (hits.join(F.broadcast(df), "term").withColumn("_s", stats)
              .withColumn("part", bm25_term(F.col("tf").cast("double"), F.col("n"), F.col("_s.N").cast("double"),
                                            F.col("dl"), F.col("_s.L") / F.col("_s.N"))))
    repeat = {t: terms.count(t) for t in set(terms)}
    weight = F.create_map(*[F.lit(x) for t, n in repeat.items() for x in (t, float(n))])[F.col("term")]
    return (scored.groupBy("id").agg(F.count("*").alias("k"), F.sum(F.col("part") * weight).alias("s"))
            .where(F.col("k") == len(repeat)).select("id", (-F.col("s")).alias("score")))
