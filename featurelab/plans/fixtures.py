"""Stand-ins for the reference's inputs, derived by Spark from the driver tables.

Every fixture is a lazy DataFrame over the full tables, so its work grows with
the data.  The column rules are stated once here and mirrored in SQL by
``plans/sql.py`` for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelab.sources.tables import read_table

# ---------------------------------------------------------------- metrics ---
# Long metrics table: entity, variant, hparam_source, metric.


def metrics_long(spark: SparkSession, sf_dir: str, entity: str = "l_suppkey") -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem",
                    [entity, "l_returnflag", "l_linestatus", "l_linenumber",
                     "l_extendedprice", "l_discount", "l_tax"])
    return li.select(
        F.col(entity).alias("entity"),
        F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("variant"),
        F.when(F.col("l_tax") < 0.05, F.lit("default")).otherwise(F.lit("tuned")).alias("hparam_source"),
        F.col("l_linenumber").alias("fold"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("metric"),
    )


def metrics_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_long(spark, sf_dir, entity="l_partkey")


# Variant -> class for the difference target (first letter = return flag).
VARIANT_CLASSES = {"AF": "A", "AO": "A", "NF": "N", "NO": "N", "RF": "R", "RO": "R"}
CLASSES = ["A", "N", "R"]

# ------------------------------------------------------------ features ------
# Raw entity features: one row per (supplier, line number) = entity x fold.
# Name -> (SQL-like aggregate, Column aggregate).  Some columns are made
# constant, duplicate, sparse or extreme on purpose (cleaning tests).


def exact_sum(c: Column) -> Column:
    """Sum of 2-decimal money values in exact decimal arithmetic, as a double.

    Summed as whole cents in a long (fast, exact, order-independent), so a
    recomputed task (or another engine) gives the same bits.
    """
    return F.sum(F.round(c * 100.0).cast("long")).cast("double") / 100.0


def exact_mean(c: Column) -> Column:
    return F.try_divide(exact_sum(c), F.count(c).cast("double"))


def _raw_feature_columns() -> dict[str, Column]:
    qty, price, disc, tax = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    share_r = exact_mean(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0))
    return {
        "f__gen.general.nr_inst": F.count(F.lit(1)).cast("double"),
        "f__gen.general.nr_cust": F.countDistinct("o_custkey").cast("double"),
        "f__gen.line.quantity.mean": exact_mean(qty),
        "f__gen.line.quantity.sum": exact_sum(qty),
        "f__gen.line.quantity.sd": F.stddev_pop(qty),
        "f__gen.line.price.mean": exact_mean(price),
        "f__gen.line.price.sum": exact_sum(price),
        "f__gen.line.peak.max": F.max(price * qty) / 4.8,
        "f__gen.line.discount.mean": exact_mean(disc),
        "f__gen.line.tax.mean": exact_mean(tax),
        "f__gen.line.return.share": share_r,
        "f__gen.line.return.share.relative": share_r * 2.0,
        "f__gen.order.total.mean": exact_mean(F.col("o_totalprice")),
        "f__gen.order.urgent.share": exact_mean(F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0)),
        "f__gen.customer.balance.mean": exact_mean(F.col("c_acctbal")),
        "f__gen.customer.building.share": exact_mean(F.when(F.col("c_mktsegment") == "BUILDING", 1.0).otherwise(0.0)),
        "f__gen.const.flag.value": F.max(F.lit(1.0)),
        "f__gen.dup.quantity.mean": exact_mean(qty),
        "f__gen.sparse.bulk.mean": exact_mean(F.when((qty >= 50) & (disc >= 0.1), qty)),
        "f__gen.partial.bulk.mean": exact_mean(F.when(qty >= 49, qty)),
        "f__gen.debug.line.mean": exact_mean(F.col("l_linenumber").cast("double")),
        "misc_tax_max": F.max(tax),
    }


RAW_FEATURES = [
    "f__gen.general.nr_inst", "f__gen.general.nr_cust", "f__gen.line.quantity.mean",
    "f__gen.line.quantity.sum", "f__gen.line.quantity.sd", "f__gen.line.price.mean",
    "f__gen.line.price.sum", "f__gen.line.peak.max", "f__gen.line.discount.mean",
    "f__gen.line.tax.mean", "f__gen.line.return.share", "f__gen.line.return.share.relative",
    "f__gen.order.total.mean", "f__gen.order.urgent.share", "f__gen.customer.balance.mean",
    "f__gen.customer.building.share", "f__gen.const.flag.value", "f__gen.dup.quantity.mean",
    "f__gen.sparse.bulk.mean", "f__gen.partial.bulk.mean", "f__gen.debug.line.mean", "misc_tax_max",
]
COUNT_FEATURES = ["f__gen.general.nr_inst", "f__gen.general.nr_cust"]


def entity_features_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, fold, features...) from lineitem joined with orders and customer."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                     "l_discount", "l_tax", "l_returnflag"])
    od = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"])
    cu = read_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal", "c_mktsegment"])
    joined = li.join(od, li.l_orderkey == od.o_orderkey).join(cu, F.col("o_custkey") == F.col("c_custkey"))
    cols = _raw_feature_columns()
    assert list(cols) == RAW_FEATURES
    return joined.groupBy(F.col("l_suppkey").alias("entity"), F.col("l_linenumber").alias("fold")) \
                 .agg(*[e.alias(n) for n, e in cols.items()])


# ------------------------------------------------------- document features --

DOC_FEATURES = ["f_log_chars", "f_space", "f_newline", "f_digit", "f_upper", "f_dot"]


def _share(text: Column, n: Column, pattern: str) -> Column:
    kept = F.length(F.regexp_replace(text, pattern, ""))
    return (n - kept).cast("double") / F.greatest(n, F.lit(1)).cast("double")


def doc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents joined with labels: character shares over the whole text + targets."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    n = F.length("text")
    feats = docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("entity"),
        F.log(F.lit(1.0) + n.cast("double")).alias("f_log_chars"),
        _share(F.col("text"), n, " ").alias("f_space"),
        _share(F.col("text"), n, "\n").alias("f_newline"),
        _share(F.col("text"), n, "[0-9]").alias("f_digit"),
        _share(F.col("text"), n, "[A-Z]").alias("f_upper"),
        _share(F.col("text"), n, "[.]").alias("f_dot"),
        F.col("quality").cast("double").alias("quality"),
        F.col("toxic").cast("double").alias("toxic"),
    )
    return feats


# ----------------------------------------------------------- wide matrix ----
N_EMBED = 64
WIDE_FEATURES = [f"e{i:02d}" for i in range(N_EMBED)]


def wide_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    return emb.select(F.col("vec_id").alias("entity"),
                      *[F.col("embedding")[i].cast("double").alias(WIDE_FEATURES[i]) for i in range(N_EMBED)],
                      F.col("label").cast("int").alias("label"))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """wide_matrix plus a target with a known answer: y = 1 iff e00 + e01 > 0."""
    df = wide_matrix(spark, sf_dir)
    return df.withColumn("y", F.when(F.col("e00") + F.col("e01") > 0, 1.0).otherwise(0.0))


# --------------------------------------------------------------- profiles ---

def profile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["user_id", "event_type", "value", "ts"])
    return ev.select(F.col("user_id").alias("entity"), F.col("event_type").alias("category"),
                     F.col("value").alias("value"), F.hour("ts").cast("double").alias("hour"))
