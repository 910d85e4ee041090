"""One registered query per operator: production parameters over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelab.sources.tables import read_table

from . import (chat, decontaminate, exact_dedup, html_text, licenses, mixture, periodic_runs, reshard, secret_scan, topk,
               toxicity, whitening)
from .near_dedup import near_duplicates

#: Ids whose labels a model may learn from; the others are held out.
TRAINED = "pmod(crc32(cast(id as string)), 5) != 0"


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    return licenses.scan(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold copies of benchmark items, with alignment scores."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return decontaminate.contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = html_text.extract(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors, by integer inner product, of every fiftieth."""
    return topk.top_k(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), F.col("vec_id") % 50 == 0)


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents from six shards (dealt by text hash) to eight of near equal bytes.

    The digest columns are computed from the texts read back from the new shards."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    out = reshard.reshard(docs, F.pmod(F.xxhash64("text"), F.lit(6)), 8)
    return out.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "moved")


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 80 % of distinct two-word shingles."""
    found = near_duplicates(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), k=2, percent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 % of all words takes of each document."""
    return mixture.mix_words(read_table(spark, sf_dir, "documents", ["doc_id", "source", "text"]))


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.digest(secret_scan.scan(read_table(spark, sf_dir, "documents", ["doc_id", "text"])))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels with crc32(id) divisible by 5 are held out."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels", ["doc_id", "toxic"]), use=F.expr(TRAINED))
    held = F.coalesce(~F.expr(TRAINED.replace("id as", "doc_id as")), F.lit(False))
    return (toxicity.score(docs, model).withColumn("held_out", held)
            .select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one made of control strings, formatted and read back."""
    rows = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], rows.schema)
    return chat.read_back(chat.prefix_targets(rows.unionByName(extra)))


def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their first eight whitened components."""
    out = whitening.whiten(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy of its text that stays."""
    out = exact_dedup.copies(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the contract: with h = crc32(doc_id), every tenth h has its words from
    one on repeat with a period; other texts stay as they are.  Null ids and texts stay."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    n, g = F.size("w").cast("long"), F.floor(F.col("h") / 10)
    with_words = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    start = F.when(n > 0, F.pmod(g, n))
    period = 1 + F.floor((n - F.col("a")) / (3 + g % 8))
    at = with_words.withColumn("a", start).withColumn("p", F.when(F.col("a").isNotNull(), period))
    word = lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))
    loop = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " ")
    return at.select("doc_id", F.when(F.col("p").isNotNull(), loop).otherwise(F.col("text")).alias("text"))


def period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of periodic words of every document, digests of them and of the collapsed text."""
    found = periodic_runs.find_runs(looped(read_table(spark, sf_dir, "documents", ["doc_id", "text"])))
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    above = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | above(r, b), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(
        ",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                    F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))


#: name -> (query, DuckDB SQL or None)
QUERIES = {
    "op1_license_scan": (license_scan, licenses.duckdb_sql()),
    "op2_decontamination": (decontamination, None),
    "op3_html_extraction": (html_extraction, None),
    "op4_exact_top_k": (exact_top_k, """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q),
             lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""),
    "op5_sharding": (sharding, None),
    "op6_near_dedup": (near_dedup, None),
    "op7_source_mixture": (source_mixture, None),
    "op8_secret_scan": (secrets, None),
    "op9_toxicity": (toxicity_scores, None),
    "op10_chat_formatting": (chat_formatting, None),
    "op11_embedding_whitening": (embedding_whitening, None),
    "op12_exact_dedup": (exact_copies, """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, row_number() OVER w AS turn, first_value(doc_id) OVER w AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, turn = 1 AS kept, text_sha256 FROM r"""),
    "op13_periodic_runs": (period_runs, None),
}
