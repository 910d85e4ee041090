"""The mix as documents is the same however the input is partitioned."""

from collections import Counter

from pyspark.sql import functions as F

from featurelab.llm import mixture


def _rows(df):
    return Counter(tuple(r) for r in mixture.mix_documents(df).select("doc_id", "text", "source", "n_chars").collect())


def test_documents_do_not_depend_on_partitioning(spark):
    docs = spark.createDataFrame(
        [(i, " ".join(f"w{i}x{j}" for j in range(5 + 37 * i % 400)), "abc"[i % 3] if i % 7 else None, 0) for i in range(150)]
        + [(3, "the same row again and again", "a", 0)] * 40 + [(None, "no id", None, 0)] * 3 + [(5, None, "a", 0), (6, "", None, 0)],
        "doc_id long, text string, source string, n_chars long")
    want = _rows(docs.coalesce(1))
    assert want == _rows(docs.repartition(7, F.rand(1))) == _rows(docs.orderBy(F.desc("text")))
    words = mixture.mix_words(docs).groupBy("doc_id").agg(F.sum("taken").alias("n")).collect()
    got = Counter()
    for (doc_id, text, _, n_chars), times in want.items():
        assert n_chars == len(text)
        got[doc_id] += times * len(text.split())
    assert got == Counter({r.doc_id: r.n for r in words if r.n})


def test_alike_rows_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(mixture, "ALIKE_PARTS", 4)
    rows = spark.range(500).select(F.col("id").alias("row"), F.when(F.col("id") < 300, 1).cast("long").alias("doc_id"),
                                   F.when(F.col("id") % 2 == 0, "a").alias("source"), F.lit(9).cast("long").alias("hash"))
    got = mixture._numbered(rows).groupBy("doc_id", "source").agg(F.sort_array(F.collect_list("turn")).alias("t")).collect()
    assert sorted(len(r.t) for r in got) == [100, 100, 150, 150]
    assert all(r.t == list(range(1, len(r.t) + 1)) for r in got)
