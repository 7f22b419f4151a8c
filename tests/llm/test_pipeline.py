"""The corpus pipeline on rows without id, with shared ids and repeated ones, against a brute force."""

import hashlib
import random
from collections import Counter

import corpus_pipeline


def test_verdicts_hold_for_rows(spark, tmp_path):
    r = random.Random(3)
    plain = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrt"]

    def words(n):
        return [r.choice(plain) for _ in range(n)]

    def toxic():
        w = words(60)
        for k in range(0, 60, 6):
            w[k] = ("vileword", "nastyone")[k % 4 // 2]
        return " ".join(w)

    def low():
        return " ".join(x.upper() + "!!" for x in words(60))

    def good():
        return " ".join(words(60))

    rows, labels = [], []
    for i in range(600):
        kind = i % 3
        rows.append((i, (good, toxic, low)[kind]()))
        labels.append((i, int(kind != 2), int(kind == 1)))
    item = " ".join(f"item{k}" for k in range(20))
    bad = [toxic(), toxic(), low(), low(), item + " and", item + " or"]
    copied, once, shared, repeated, nameless = (good() for _ in range(5))
    near = copied.split()
    near[30] = "edit"
    special = [(None, x) for x in bad] + [(9001, bad[0]), (9001, shared), (9002, bad[2]), (9002, once), (9003, bad[4]), (9003, good())]
    stay = [(9001, shared), (9002, once), special[-1]]
    special += [(9010, copied), (None, " ".join(near)), (None, copied), (9009, " ".join(near)), (9010, copied)]
    stay += [(9009, " ".join(near))]
    special += [(9020, repeated)] * 3 + [(None, nameless)] * 2 + [(None, x := good())]
    stay += [(9020, repeated), (None, nameless), (None, x)]
    own = dict.fromkeys(t for _, t in special)
    spark.createDataFrame([(i, t, None, None, None) for i, t in rows + special], "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in own}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = Counter((x["doc_id"], sha[x["decoded_sha256"]]) for x in out.collect() if x["decoded_sha256"] in sha)
    assert got == Counter(stay)


def test_near_copies_keeps_one_of_repeated_rows(spark, tmp_path):
    rows = [(1, " "), (1, " "), (1, None), (2, " "), (None, ""), (None, ""), (3, "a b c"), (3, "a b c"), (None, "a b c"), (None, "q"), (None, "q"), (4, "a b d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, corpus_pipeline.near_copies(spark, docs, "").collect()))
    assert got == Counter([(1, " "), (1, None), (2, " "), (None, ""), (None, ""), (3, "a b c"), (None, "q"), (4, "a b d")])
    assert corpus_pipeline.near_copies(spark, docs.where("false"), "").count() == 0


def test_stages_take_empty_tables_and_clashing_names(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "benchmark words of an item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "plain words in a row", None, 7, "m", 1), (None, None, None, 7, "m", 1), (3, "", 4, 7, "m", 1), (3, "w " * 50_000, 4, 7, "m", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key long, row int, mark string, predicted int")
    docs.repartition(2).write.parquet(f"{tmp_path}/docs.parquet")
    read = spark.read.parquet(f"{tmp_path}/docs.parquet")
    for given in (docs, read):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given, str(tmp_path))
            assert out.columns == docs.columns and out.schema == given.schema, name
            if name in ("near_copies", "decontamination"):
                assert Counter(map(tuple, out.collect())) == Counter(rows), name
            assert stage(spark, given.where("false"), str(tmp_path)).count() == 0, name
        assert corpus_pipeline.tokens(spark, given, str(tmp_path)).count() == 4
    numbered, name = corpus_pipeline._numbered(read)
    assert name == "row_" and numbered.select(name).distinct().count() == 4


def test_rows_go_to_python_once_in_small_batches(spark, tmp_path):
    import numpy as np
    from pyspark.sql import functions as F
    from tidemark.llm import quality_mil, storage
    rng, q = np.random.default_rng(1), quality_mil
    shapes = ((q.WIDTH, q.HIDDEN), (q.HIDDEN,), (q.HIDDEN, q.GATE), (q.HIDDEN, q.GATE), (q.GATE,), (q.HIDDEN,), (1,))
    model = q.Model(*(rng.normal(size=s) for s in shapes))
    rows = [(k, " ".join(rng.choice(["some", "words", "of", "a", "text"], k)) if k % 7 else None, k) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, Text string, n int").repartition(3)
    plain = {r["doc_id"]: round(r["score"], 9) for r in q.score(docs, model).collect()}
    whole = q.score(docs, model, whole=True)
    assert " AS text#" not in whole._jdf.queryExecution().analyzed().toString()
    assert {(r["row"]["doc_id"], r["row"]["Text"], r["row"]["n"], round(r["score"], 9)) for r in whole.collect()} == {(*r, plain[r[0]]) for r in rows}
    numbers = docs.select("doc_id", F.col("n").alias("text"))  # a text of another type is cast beside its row
    assert {(r["row"]["text"], round(r["score"], 9)) for r in q.score(numbers, model, whole=True).collect()} == {
        (r["doc_id"], round(r["score"], 9)) for r in q.score(numbers, model).collect()}
    spark.conf.unset(storage.BATCH_CONF)
    storage.small_batches(spark)
    sizes = spark.range(2000).select(F.repeat(F.lit("x"), 10_000).alias("t")).coalesce(1).mapInArrow(
        lambda it: (type(b).from_pydict({"n": [b.nbytes]}) for b in it), "n long").collect()
    assert max(r["n"] for r in sizes) < 2 * storage.BATCH_BYTES and sum(r["n"] for r in sizes) >= 20_000_000
