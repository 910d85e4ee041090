"""Query catalogue: one entry per implemented operator.

``QUERIES[name] = (spark_fn, oracle_sql_or_None)``.  Every Spark query reads
the driver tables through the fixtures; every double output is rounded to six
decimals in both engines so that value hashes compare.

Sections, in order (later sections reuse the frames and SQL of earlier ones):
  C4, D2, D10, D11 ... long metrics table (lineitem per supplier / part)
  E1-E5 ............... targets pivoted from the metrics
  C1-C3, D1-D9 ........ entity features (lineitem x orders x customer), long-form
                        output where the column set depends on the data
  H, I1-I5, I12 ....... document features x labels, folds, filter selectors
  F1-F11 .............. scaling and collinearity on the cleaned features
  G, H3, H4 ........... crafted columns, slices, uninformative samples
  J9, J10, L .......... scores and analytics over the selector results
  B ................... profiles of events per user
  I6-I10, J, K ........ Spark ML fits on the planted embedding target
  I4 (nearest neighbour), I11, I13, I14/J13, J12, H2, F8, L1, L3, J6, J11,
  I12 over slices ..... compositions
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelab.functions.wide import q, round6, sql_round6, to_long
from featurelab.operators import cleaning as cl
from featurelab.operators import formatting as fm
from featurelab.operators import targets as tg
from featurelab.plans import fixtures as fx
from featurelab.plans import sql as S
from featurelab.session import cut_lineage

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def r6(df: DataFrame, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Round every double column to 6 decimals (the value-hash contract)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float") and f.name not in keys:
            out.append(round6(q(f.name)).alias(f.name))
        else:
            out.append(q(f.name))
    return df.select(*out)


def sql_r6(cols: list[str], keep: tuple[str, ...] = ()) -> str:
    return ", ".join(c if c in keep else f"{sql_round6(S.qi(c))} AS {S.qi(c)}" for c in cols)


VARIANTS = sorted(fx.VARIANT_CLASSES)

# ----------------------------------------------------------- C4, D10, D11 ---


def _c4(spark, sf_dir, entity="l_suppkey"):
    return fm.aggregate_metrics(fx.metrics_long(spark, sf_dir, entity), metrics=["metric"])


_C4_SQL = ("SELECT entity, variant, avg(metric) AS metric FROM ({m}) t "
           "WHERE hparam_source = 'default' GROUP BY entity, variant")


@register("c4_aggregate_metrics",
          "SELECT entity, variant, " + sql_round6("metric") + f" AS metric FROM ({_C4_SQL.format(m=S.metrics_long())}) x")
def q_c4(spark, sf_dir):
    return r6(_c4(spark, sf_dir))


_VARIANT_KEEP = ["AF", "NF", "NO", "RF"]
_LIST = ", ".join(f"'{v}'" for v in _VARIANT_KEEP)


def _clean_metrics_sql(entity: str) -> str:
    base = f"SELECT * FROM ({_C4_SQL.format(m=S.metrics_long(entity))}) a WHERE variant IN ({_LIST})"
    return (f"WITH m AS ({base}), ok AS (SELECT entity FROM m GROUP BY entity "
            f"HAVING count(DISTINCT variant) = {len(_VARIANT_KEEP)}) "
            "SELECT entity, variant, " + sql_round6("metric") + " AS metric FROM m WHERE entity IN (SELECT entity FROM ok)")


@register("d10_d11_clean_metrics", _clean_metrics_sql("l_partkey"))
def q_d10_d11(spark, sf_dir):
    c4 = _c4(spark, sf_dir, "l_partkey")
    return r6(cl.clean_metrics(c4, variants=_VARIANT_KEEP))


@register("d2_remove_entities",
          "SELECT entity, variant, " + sql_round6("metric") + " AS metric FROM "
          f"({_C4_SQL.format(m=S.metrics_long())}) x WHERE entity NOT IN (1, 2, 3, 5, 8)")
def q_d2(spark, sf_dir):
    return r6(cl.remove_entities(_c4(spark, sf_dir), "entity", [1, 2, 3, 5, 8]))


# ------------------------------------------------------------- E1 .. E5 -----

def _pivot(spark, sf_dir, entity="l_suppkey"):
    return tg.pivot_metric(_c4(spark, sf_dir, entity), "metric")


def _pivot_sql(entity="l_suppkey") -> str:
    cols = ", ".join(f"max(CASE WHEN variant = '{v}' THEN metric END) AS {v}" for v in VARIANTS)
    return (f"SELECT entity, {cols} FROM ({_C4_SQL.format(m=S.metrics_long(entity))}) c "
            "WHERE metric IS NOT NULL GROUP BY entity")


@register("e1_pivot_metric", f"SELECT entity, {sql_r6(VARIANTS)} FROM ({_pivot_sql()}) p")
def q_e1(spark, sf_dir):
    return r6(_pivot(spark, sf_dir))


def _abs_sql(entity="l_suppkey", n_bins=2) -> str:
    fr = ", ".join(str(i / n_bins) for i in range(n_bins + 1))
    edges = ", ".join(f"quantile_cont({v}, [{fr}]) AS q_{v}" for v in VARIANTS)
    # kept inner edges: edge i (1..n-1) is kept iff it exceeds its predecessor by > 1e-8
    # and the class counts kept inner edges <= value; the last edge is dropped when it
    # merges, which removes the last inner edge that is kept (list_slice below).
    parts = []
    for v in VARIANTS:
        kept = (f"list_filter(list_transform(range(2, {n_bins + 2}), lambda i: CASE WHEN q_{v}[i] - q_{v}[i - 1] > 1e-8 "
                f"THEN q_{v}[i] ELSE NULL END), lambda x: x IS NOT NULL)")
        inner = f"list_slice({kept}, 1, len({kept}) - 1)"
        parts.append(f"CASE WHEN {v} IS NULL THEN 0.0 ELSE CAST(len(list_filter({inner}, lambda e: {v} >= e)) AS DOUBLE) END AS {v}")
    return (f"WITH p AS ({_pivot_sql(entity)}), e AS (SELECT {edges} FROM p) "
            f"SELECT entity, {', '.join(parts)} FROM p, e")


@register("e2_abs_perf_classes", _abs_sql())
def q_e2(spark, sf_dir):
    # the pivot is read by several passes: edges, then classes
    return tg.abs_perf_classes(cut_lineage(_pivot(spark, sf_dir)))


@register("e2_abs_perf_classes_sparse", _abs_sql("l_partkey", 3))
def q_e2s(spark, sf_dir):
    return tg.abs_perf_classes(cut_lineage(_pivot(spark, sf_dir, "l_partkey")), n_bins=3)


def _rel_sql(entity="l_suppkey", n_bins=2) -> str:
    m = len(VARIANTS)
    inner = [1.0 + (m - 1) * i / n_bins for i in range(1, n_bins)]
    parts = []
    for j, v in enumerate(VARIANTS):
        beats = " + ".join(
            f"CASE WHEN coalesce({d}, '-inf'::DOUBLE) > coalesce({v}, '-inf'::DOUBLE) "
            f"{'OR coalesce(' + d + ", '-inf'::DOUBLE) = coalesce(" + v + ", '-inf'::DOUBLE)" if k > j else ''} "
            "THEN 1 ELSE 0 END"
            for k, d in enumerate(VARIANTS) if k != j)
        rank = f"(1 + {beats})"
        cls = " + ".join(f"CASE WHEN {rank} >= {e} THEN 1.0 ELSE 0.0 END" for e in inner) or "0.0"
        parts.append(f"CAST({cls} AS DOUBLE) AS {v}")
    return f"SELECT entity, {', '.join(parts)} FROM ({_pivot_sql(entity)}) p"


@register("e3_rel_perf_classes", _rel_sql())
def q_e3(spark, sf_dir):
    return tg.rel_perf_classes(_pivot(spark, sf_dir))


@register("e3_rel_perf_classes_sparse", _rel_sql("l_partkey", 3))
def q_e3s(spark, sf_dir):
    return tg.rel_perf_classes(_pivot(spark, sf_dir, "l_partkey"), n_bins=3)


def _diff_sql() -> str:
    means = " UNION ALL ".join(
        f"SELECT '{v}' AS variant, '{fx.VARIANT_CLASSES[v]}' AS cls, avg({v}) AS m FROM p" for v in VARIANTS)
    a, b = fx.CLASSES[0], fx.CLASSES[1]
    return (f"WITH p AS ({_pivot_sql()}), mm AS ({means}), "
            "best AS (SELECT cls, arg_max(variant, m) AS v FROM mm WHERE m IS NOT NULL GROUP BY cls), "
            f"names AS (SELECT (SELECT v FROM best WHERE cls = '{a}') AS va, (SELECT v FROM best WHERE cls = '{b}') AS vb), "
            "lp AS (SELECT entity, unnest([" + ", ".join(f"'{v}'" for v in VARIANTS) + "]) AS variant, unnest(["
            + ", ".join(VARIANTS) + "]) AS metric FROM p) "
            "SELECT x.entity, names.va || '__' || names.vb AS target, "
            "CASE WHEN x.metric - y.metric > 0 THEN 0.0 ELSE 1.0 END AS label "
            "FROM names, lp x JOIN lp y ON x.entity = y.entity WHERE x.variant = names.va AND y.variant = names.vb")


@register("e4_diff_target", _diff_sql())
def q_e4(spark, sf_dir):
    wide = _pivot(spark, sf_dir)
    out, name = tg.diff_target(wide, fx.CLASSES, fx.VARIANT_CLASSES)
    return out.select("entity", F.lit(name).alias("target"), q(name).alias("label"))


# ------------------------------------------------------------- C1 .. C3 -----

def _collapsed(spark, sf_dir):
    return fm.collapse_folds(fx.entity_features_raw(spark, sf_dir), "entity")


@register("c1_collapse_folds", f"SELECT entity, {sql_r6(fx.RAW_FEATURES)} FROM ({S.collapsed()}) c")
def q_c1(spark, sf_dir):
    return r6(_collapsed(spark, sf_dir))


@register("c1_collapse_folds_mean", f"SELECT entity, {sql_r6(fx.RAW_FEATURES)} FROM ({S.collapsed('avg')}) c")
def q_c1m(spark, sf_dir):
    return r6(fm.collapse_folds(fx.entity_features_raw(spark, sf_dir), "entity", agg_func="mean"))


def _formatted_cols(families=("customer",)) -> list[str]:
    return [c for c in fx.RAW_FEATURES
            if c.startswith("f__") and not any(c.startswith(f"f__gen.{f}") for f in families)]


def _formatted(spark, sf_dir):
    df = fm.round_counts(_collapsed(spark, sf_dir), fx.COUNT_FEATURES)
    return fm.filter_families(df, ["customer"], keys=["entity"])


def _formatted_cut(spark, sf_dir):
    """The formatted entity table, materialised once for the multi-pass cleaning steps."""
    return cut_lineage(_formatted(spark, sf_dir))


def _formatted_sql() -> str:
    cols = []
    for c in _formatted_cols():
        cols.append(f"round_even({S.qi(c)}, 0) AS {S.qi(c)}" if c in fx.COUNT_FEATURES else S.qi(c))
    return f"SELECT entity, {', '.join(cols)} FROM ({S.collapsed()}) c"


@register("c2_c3_format_features", f"SELECT entity, {sql_r6(_formatted_cols())} FROM ({_formatted_sql()}) f")
def q_c23(spark, sf_dir):
    return r6(_formatted(spark, sf_dir))


# ------------------------------------------------------------- D1 .. D9 -----

_FUNCS = ["sum"]
_KEYS = ["debug"]


def _after_d3_cols() -> list[str]:
    out = []
    for c in _formatted_cols():
        parts = c.split(".")
        if len(parts) > 3 and (parts[-1] == "relative" or parts[3] in _FUNCS):
            continue
        if any(k in c for k in _KEYS):
            continue
        out.append(c)
    return out


def _after_d3(spark, sf_dir):
    df = cl.remove_by_func(_formatted_cut(spark, sf_dir), _FUNCS, ["entity"])
    return cl.remove_by_key(df, _KEYS, ["entity"])


@register("d1_d3_drop_by_name", f"SELECT entity, {sql_r6(_after_d3_cols())} FROM ({_formatted_sql()}) f")
def q_d13(spark, sf_dir):
    return r6(_after_d3(spark, sf_dir))


def _long_out(df: DataFrame) -> DataFrame:
    feats = [c for c in df.columns if c != "entity"]
    return to_long(df, ["entity"], feats).select("entity", "feature", round6(F.col("value")).alias("value"))


def _d3_long_sql() -> str:
    return S.long_of(f"({_formatted_sql()})", _after_d3_cols(), pos=True)


_D4_KEEP = ("stats AS (SELECT feature, count(*) AS n, count(value) AS nn, min(value) AS lo, max(value) AS hi "
            "FROM {src} GROUP BY feature), "
            "d4 AS (SELECT * FROM {src} WHERE feature IN (SELECT feature FROM stats "
            "WHERE NOT (n - nn > n * 0.5 OR (nn = n AND lo = hi))))")


@register("d4_remove_unsuitable",
          f"WITH l0 AS ({_d3_long_sql()}), {_D4_KEEP.format(src='l0')} "
          "SELECT entity, feature, " + sql_round6("value") + " AS value FROM d4")
def q_d4(spark, sf_dir):
    return _long_out(cl.remove_unsuitable(_after_d3(spark, sf_dir), ["entity"]))


_T = 1e6
_D5 = ("cnt AS (SELECT feature, CAST(sum(CASE WHEN abs(value) > {t} THEN 1 ELSE 0 END) AS DOUBLE) AS c "
       "FROM {src} GROUP BY feature), "
       "med AS (SELECT coalesce(median(c), 'inf'::DOUBLE) AS m FROM cnt WHERE c >= 2), "
       "surv AS (SELECT feature FROM cnt, med WHERE c > 0 AND c <= m), "
       "bad AS (SELECT DISTINCT entity FROM {src} WHERE feature IN (SELECT feature FROM surv) AND abs(value) > {t}), "
       "d5 AS (SELECT * FROM {src} WHERE feature NOT IN (SELECT feature FROM cnt, med WHERE c > m) "
       "AND entity NOT IN (SELECT entity FROM bad))")


@register("d5_filter_outliers",
          f"WITH l0 AS ({_d3_long_sql()}), {_D4_KEEP.format(src='l0')}, {_D5.format(src='d4', t=_T)} "
          "SELECT entity, feature, " + sql_round6("value") + " AS value FROM d5")
def q_d5(spark, sf_dir):
    df = cl.remove_unsuitable(_after_d3(spark, sf_dir), ["entity"])
    return _long_out(cl.filter_outliers(df, ["entity"], _T))


_D6 = ("fill AS (SELECT feature, " + S.median("value") + " AS fv FROM {src} GROUP BY feature), "
       "d6 AS (SELECT s.entity, s.feature, coalesce(s.value, fill.fv) AS value, s.pos FROM {src} s "
       "JOIN fill ON s.feature = fill.feature)")
_D7 = ("st7 AS (SELECT feature, count(*) AS n, count(value) AS nn, min(value) AS lo, max(value) AS hi "
       "FROM {src} GROUP BY feature), "
       "d7 AS (SELECT * FROM {src} WHERE feature NOT IN (SELECT feature FROM st7 WHERE nn = n AND lo = hi))")
_D9 = ("dupc AS (SELECT b.feature FROM {src} a JOIN {src} b ON a.entity = b.entity AND a.pos < b.pos "
       "GROUP BY a.feature, b.feature "
       "HAVING sum(CASE WHEN a.value IS NOT DISTINCT FROM b.value THEN 0 ELSE 1 END) = 0), "
       "d9 AS (SELECT * FROM {src} WHERE feature NOT IN (SELECT feature FROM dupc))")


def _d8_sql(src: str) -> str:
    # duplicate rows by feature values (key ignored): smallest entity survives
    return (f"sig AS (SELECT entity, string_agg(coalesce(CAST(value AS VARCHAR), 'NULL'), '|' ORDER BY pos) AS s FROM {src} "
            "GROUP BY entity), "
            "keepr AS (SELECT min(entity) AS entity FROM sig GROUP BY s), "
            f"d8 AS (SELECT * FROM {src} WHERE entity IN (SELECT entity FROM keepr))")


@register("d6_fill_undefined",
          f"WITH l0 AS ({_d3_long_sql()}), {_D6.format(src='l0')} "
          "SELECT entity, feature, " + sql_round6("value") + " AS value FROM d6")
def q_d6(spark, sf_dir):
    return _long_out(cl.fill_undefined(_after_d3(spark, sf_dir), ["entity"]))


@register("d7_remove_constant",
          f"WITH l0 AS ({_d3_long_sql()}), {_D7.format(src='l0')} "
          "SELECT entity, feature, " + sql_round6("value") + " AS value FROM d7")
def q_d7(spark, sf_dir):
    return _long_out(cl.remove_constant(_after_d3(spark, sf_dir), ["entity"]))


@register("d9_duplicate_columns",
          f"WITH l0 AS ({_d3_long_sql()}), {_D9.format(src='l0')} "
          "SELECT entity, feature, " + sql_round6("value") + " AS value FROM d9")
def q_d9(spark, sf_dir):
    df = _after_d3(spark, sf_dir)
    feats = [c for c in df.columns if c != "entity"]
    return _long_out(df.drop(*cl.duplicate_columns(df, "entity", feats)))


def _clean_ctes() -> str:
    return (f"l0 AS ({_d3_long_sql()}), {_D4_KEEP.format(src='l0')}, {_D5.format(src='d4', t=_T)}, "
            f"{_D6.format(src='d5')}, {_D7.format(src='d6')}, {_d8_sql('d7')}, {_D9.format(src='d8')}")


@register("d_clean_features",
          f"WITH {_clean_ctes()} "
          "SELECT entity, feature, " + sql_round6("value") + " AS value FROM d9")
def q_clean(spark, sf_dir):
    df = _formatted(spark, sf_dir)
    return _long_out(cl.clean_features(df, "entity", funcs_to_exclude=_FUNCS, keys_to_exclude=_KEYS,
                                       value_threshold=_T))


def clean_features_frame(spark, sf_dir) -> DataFrame:
    """The cleaned wide features table (input of scaling and selection queries)."""
    return cl.clean_features(_formatted(spark, sf_dir), "entity", funcs_to_exclude=_FUNCS,
                             keys_to_exclude=_KEYS, value_threshold=_T)


# ----------------------------------------------------- H, I (selectors) -----
from featurelab.functions.keyed import poisson_cdf, sql_keyed_bucket  # noqa: E402
from featurelab.operators import sampling as sp  # noqa: E402
from featurelab.operators import selectors as sel  # noqa: E402

K_FOLDS = 3
SEED = 42
DOC_TARGETS = ["quality", "toxic"]


def doc_frame(spark, sf_dir) -> DataFrame:
    """Document features with folds, materialised once (regexes over whole texts are the
    expensive part; selectors and iterative fits then make several passes over it)."""
    return cut_lineage(sp.assign_folds(fx.doc_features(spark, sf_dir), "entity", K_FOLDS, SEED))


def _doc_sql() -> str:
    return f"SELECT *, {sql_keyed_bucket(SEED, K_FOLDS, 'entity')} AS fold FROM ({S.doc_features()}) d"


@register("h1_kfold_sizes",
          f"SELECT fold, count(*) AS n FROM ({_doc_sql()}) t GROUP BY fold")
def q_h1(spark, sf_dir):
    return doc_frame(spark, sf_dir).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@register("h1_kfold_exact_sizes", None)
def q_h1x(spark, sf_dir):
    df = sp.assign_folds(fx.doc_features(spark, sf_dir), "entity", K_FOLDS, SEED, exact=True)
    return df.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@register("h5_repeated_holdout",
          "SELECT r AS \"repeat\", count(*) FILTER (WHERE u < 0.3) AS n_test, count(*) AS n FROM "
          "(SELECT r, (CAST('0x' || substr(md5(concat_ws(':', '42', CAST(r AS VARCHAR), CAST(entity AS VARCHAR))), 1, 13) "
          "AS BIGINT) / 4503599627370496.0) AS u FROM (" + S.doc_features() + ") d, range(5) t(r)) x GROUP BY r")
def q_h5(spark, sf_dir):
    rh = sp.repeated_holdout(fx.doc_features(spark, sf_dir).select("entity"), "entity", 5, 0.3, SEED)
    return rh.groupBy("repeat").agg(F.count(F.when(F.col("is_test"), 1)).alias("n_test"),
                                    F.count(F.lit(1)).alias("n"))


# Cornish-Fisher expansion of the two-sided 5 % t quantile (df = nu), used by the
# oracle only; the Spark side computes exact p-values.
_Z = 1.959963984540054


def _t_crit_sql(nu: str) -> str:
    z = _Z
    g1 = (z ** 3 + z) / 4
    g2 = (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96
    g3 = (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384
    g4 = (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160
    return (f"({z!r} + {g1!r} / ({nu}) + {g2!r} / pow({nu}, 2) + {g3!r} / pow({nu}, 3) "
            f"+ {g4!r} / pow({nu}, 4))")


def _replicated_long_sql(feats: list[str], targets: list[str]) -> str:
    names = ", ".join(f"'{f}'" for f in feats)
    vals = ", ".join(feats)
    tn = ", ".join(f"'{t}'" for t in targets)
    tv = ", ".join(targets)
    folds = ", ".join(str(i) for i in range(K_FOLDS))
    return (f"r AS (SELECT *, unnest(list_filter([{folds}], lambda x: x <> fold)) AS train_fold FROM ({_doc_sql()}) d), "
            f"xl AS (SELECT entity, train_fold, unnest([{names}]) AS feature, unnest([{vals}]) AS value FROM r), "
            f"yl AS (SELECT entity, train_fold, unnest([{tn}]) AS target, unnest([{tv}]) AS y FROM r), "
            "xr AS (SELECT entity, train_fold, feature, rank() OVER (PARTITION BY train_fold, feature ORDER BY value) "
            "+ (count(*) OVER (PARTITION BY train_fold, feature, value) - 1) / 2.0 AS rx FROM xl), "
            "yr AS (SELECT entity, train_fold, target, rank() OVER (PARTITION BY train_fold, target ORDER BY y) "
            "+ (count(*) OVER (PARTITION BY train_fold, target, y) - 1) / 2.0 AS ry FROM yl)")


def _ranked_out_sql(src: str) -> str:
    return ("SELECT fold, target, feature, n, " + sql_round6("score") + " AS score, kept, "
            "CASE WHEN kept THEN CAST(row_number() OVER (PARTITION BY fold, target, kept "
            "ORDER BY abs(score) DESC NULLS LAST, feature) AS INTEGER) END AS rank FROM " + src)


def _spearman_sql() -> str:
    nu = "(n - 2)"
    t = _t_crit_sql(nu)
    return ("WITH " + _replicated_long_sql(fx.DOC_FEATURES, DOC_TARGETS) + ", "
            "st AS (SELECT x.train_fold AS fold, y.target, x.feature, count(*) AS n, "
            "CASE WHEN isnan(corr(rx, ry)) THEN NULL ELSE corr(rx, ry) END AS score "
            "FROM xr x JOIN yr y ON x.entity = y.entity AND x.train_fold = y.train_fold GROUP BY ALL), "
            f"k AS (SELECT fold, target, feature, n, score, coalesce(abs(score) >= 0.2 AND "
            f"abs(score) >= {t} / sqrt({nu} + pow({t}, 2)), false) AS kept FROM st) "
            + _ranked_out_sql("k"))


def _tidy(df: DataFrame) -> DataFrame:
    out = sel.selection(df)
    return out.select("fold", "target", "feature", "n", round6(F.col("score")).alias("score"), "kept", "rank")


@register("i2_spearman_selector", _spearman_sql())
def q_i2(spark, sf_dir):
    df = doc_frame(spark, sf_dir)
    return _tidy(sel.correlation_selector(df, "entity", fx.DOC_FEATURES, DOC_TARGETS, K_FOLDS))


def _pearson_sql() -> str:
    nu = "(n - 2)"
    t = _t_crit_sql(nu)
    names = ", ".join(f"'{f}'" for f in fx.DOC_FEATURES)
    vals = ", ".join(fx.DOC_FEATURES)
    folds = ", ".join(str(i) for i in range(K_FOLDS))
    return (f"WITH r AS (SELECT *, unnest(list_filter([{folds}], lambda x: x <> fold)) AS train_fold FROM ({_doc_sql()}) d), "
            f"xl AS (SELECT entity, train_fold, quality, toxic, unnest([{names}]) AS feature, unnest([{vals}]) AS value FROM r), "
            "st AS (SELECT train_fold AS fold, t.target, feature, count(*) AS n, "
            "corr(value, CASE WHEN t.target = 'quality' THEN quality ELSE toxic END) AS score "
            "FROM xl, (VALUES ('quality'), ('toxic')) t(target) GROUP BY ALL), "
            f"k AS (SELECT fold, target, feature, n, score, coalesce(abs(score) >= 0.2 AND "
            f"abs(score) >= {t} / sqrt({nu} + pow({t}, 2)), false) AS kept FROM st) "
            + _ranked_out_sql("k"))


@register("i2_pearson_selector", _pearson_sql())
def q_i2p(spark, sf_dir):
    df = doc_frame(spark, sf_dir)
    return _tidy(sel.correlation_selector(df, "entity", fx.DOC_FEATURES, DOC_TARGETS, K_FOLDS, method="pearson"))


def _class_long_sql() -> str:
    names = ", ".join(f"'{f}'" for f in fx.DOC_FEATURES)
    vals = ", ".join(fx.DOC_FEATURES)
    folds = ", ".join(str(i) for i in range(K_FOLDS))
    return (f"r AS (SELECT *, unnest(list_filter([{folds}], lambda x: x <> fold)) AS train_fold FROM ({_doc_sql()}) d), "
            f"xl AS (SELECT entity, train_fold, quality, toxic, unnest([{names}]) AS feature, unnest([{vals}]) AS value FROM r), "
            "cl AS (SELECT train_fold AS fold, t.target, feature, value, "
            "CASE WHEN t.target = 'quality' THEN quality ELSE toxic END AS cls "
            "FROM xl, (VALUES ('quality'), ('toxic')) t(target))")


def _chi2_sql() -> str:
    return ("WITH " + _class_long_sql() + ", "
            "pc AS (SELECT fold, target, feature, cls, count(*) AS cnt, sum(value) AS s1 FROM cl GROUP BY ALL), "
            "tt AS (SELECT fold, target, feature, sum(cnt) AS n, sum(s1) AS ftot, count(*) AS ncls FROM pc GROUP BY ALL), "
            "st AS (SELECT pc.fold, pc.target, pc.feature, tt.n, tt.ncls, "
            "sum(pow(s1 - ftot * cnt / tt.n, 2) / (ftot * cnt / tt.n)) AS score "
            "FROM pc JOIN tt USING (fold, target, feature) GROUP BY ALL), "
            "k AS (SELECT fold, target, feature, n, score, coalesce(ncls = 2 AND score >= 3.841458820694124, false) AS kept FROM st) "
            + _ranked_out_sql("k"))


@register("i3_chi2_selector", _chi2_sql())
def q_i3(spark, sf_dir):
    df = doc_frame(spark, sf_dir)
    return _tidy(sel.chi2_selector(df, "entity", fx.DOC_FEATURES, DOC_TARGETS, K_FOLDS))


def _fvalue_sql() -> str:
    nu = "(n - 2)"
    t = _t_crit_sql(nu)
    return ("WITH " + _class_long_sql() + ", "
            "pc AS (SELECT fold, target, feature, cls, count(*) AS cnt, sum(value) AS s1, sum(value * value) AS s2 "
            "FROM cl GROUP BY ALL), "
            "st0 AS (SELECT fold, target, feature, sum(cnt) AS n, count(*) AS ncls, sum(s1) AS t1, sum(s2) AS t2, "
            "sum(s1 * s1 / cnt) AS b FROM pc GROUP BY ALL), "
            "st AS (SELECT fold, target, feature, n, ncls, ((b - t1 * t1 / n) / (ncls - 1)) / "
            "(((t2 - t1 * t1 / n) - (b - t1 * t1 / n)) / (n - ncls)) AS score FROM st0), "
            "md AS (SELECT *, quantile_cont(score, 0.5) OVER (PARTITION BY fold, target) AS med FROM st), "
            f"k AS (SELECT fold, target, feature, n, score, coalesce(ncls = 2 AND score >= pow({t}, 2) "
            "AND abs(score) >= med, false) AS kept FROM md) " + _ranked_out_sql("k"))


@register("i5_f_value_selector", _fvalue_sql())
def q_i5(spark, sf_dir):
    df = doc_frame(spark, sf_dir)
    return _tidy(sel.f_value_selector(df, "entity", fx.DOC_FEATURES, DOC_TARGETS, K_FOLDS))


def _mi_sql(n_bins: int = 10) -> str:
    names = ", ".join(f"'{f}'" for f in fx.DOC_FEATURES)
    vals = ", ".join(fx.DOC_FEATURES)
    folds = ", ".join(str(i) for i in range(K_FOLDS))
    return (f"WITH d AS ({_doc_sql()}), "
            f"b AS (SELECT entity, fold, quality, toxic, unnest([{names}]) AS feature, unnest([{vals}]) AS value FROM d), "
            f"r AS (SELECT *, unnest(list_filter([{folds}], lambda x: x <> fold)) AS train_fold FROM b), "
            "cl0 AS (SELECT train_fold AS fold, t.target, feature, value, "
            "CASE WHEN t.target = 'quality' THEN quality ELSE toxic END AS cls "
            "FROM r, (VALUES ('quality'), ('toxic')) t(target)), "
            # bins of equal frequency: by the share of training values below
            "cl AS (SELECT fold, target, feature, cls, ((rank() OVER (PARTITION BY fold, target, feature ORDER BY value) - 1) "
            f"* {n_bins}) // count(*) OVER (PARTITION BY fold, target, feature) AS bin FROM cl0), "
            "j AS (SELECT fold, target, feature, bin, cls, count(*) AS c FROM cl GROUP BY ALL), "
            "jj AS (SELECT *, sum(c) OVER (PARTITION BY fold, target, feature) AS n, "
            "sum(c) OVER (PARTITION BY fold, target, feature, bin) AS cx, "
            "sum(c) OVER (PARTITION BY fold, target, feature, cls) AS cy FROM j), "
            "st AS (SELECT fold, target, feature, max(n) AS n, sum((c / n) * ln(c * n / (cx * cy))) AS score "
            "FROM jj GROUP BY ALL), "
            "md AS (SELECT *, quantile_cont(score, 0.9) OVER (PARTITION BY fold, target) AS thr FROM st), "
            "k AS (SELECT fold, target, feature, n, score, coalesce(score >= thr, false) AS kept FROM md) "
            + _ranked_out_sql("k"))


@register("i4_mutual_info_selector", _mi_sql())
def q_i4(spark, sf_dir):
    df = doc_frame(spark, sf_dir)
    return _tidy(sel.mutual_info_selector(df, "entity", fx.DOC_FEATURES, DOC_TARGETS, K_FOLDS))


@register("i1_base_selector",
          "SELECT fold, target, feature, n, 0.0 AS score, true AS kept, "
          "CAST(row_number() OVER (PARTITION BY fold, target ORDER BY feature) AS INTEGER) AS rank FROM "
          f"(SELECT f.fold, f.n_all - coalesce(c.nf, 0) AS n FROM (SELECT unnest(range({K_FOLDS})) AS fold, "
          f"(SELECT count(*) FROM ({S.doc_features()}) d0) AS n_all) f LEFT JOIN "
          f"(SELECT fold, count(*) AS nf FROM ({_doc_sql()}) d GROUP BY fold) c ON f.fold = c.fold) a, "
          "(VALUES ('quality'), ('toxic')) t(target), (SELECT unnest(["
          + ", ".join(f"'{f}'" for f in fx.DOC_FEATURES) + "]) AS feature) ff")
def q_i1(spark, sf_dir):
    df = doc_frame(spark, sf_dir)
    out = sel.selection(sel.base_selector(df, "entity", fx.DOC_FEATURES, DOC_TARGETS, K_FOLDS))
    return out.select("fold", "target", "feature", "n", "score", "kept", "rank")


@register("i12_empty_selections",
          "WITH s AS (" + _spearman_sql() + ") SELECT fold, target FROM s GROUP BY fold, target "
          "HAVING count(*) FILTER (WHERE kept) = 0")
def q_i12(spark, sf_dir):
    df = doc_frame(spark, sf_dir)
    return sel.empty_selections(sel.correlation_selector(df, "entity", fx.DOC_FEATURES, DOC_TARGETS, K_FOLDS))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents x labels -> text features -> spearman selection per fold and target."""
    return q_i2(spark, sf_dir)


# ------------------------------------------------------- F (scaling etc.) ---
from featurelab.operators import collinear as co  # noqa: E402
from featurelab.operators import scaling as sc  # noqa: E402


def cleaned(spark, sf_dir) -> DataFrame:
    return cut_lineage(clean_features_frame(spark, sf_dir))


def sql_percentile(x: str, p: float) -> str:
    """Spark's percentile: (hi - pos) * v[lo] + (pos - lo) * v[hi] over the sorted non-null values."""
    lst = f"list_sort(list({x}) FILTER (WHERE {x} IS NOT NULL))"
    pos = f"((count({x}) - 1) * {p})"
    return (f"CASE WHEN floor({pos}) = ceil({pos}) THEN ({lst})[CAST(floor({pos}) AS BIGINT) + 1] ELSE "
            f"(ceil({pos}) - {pos}) * ({lst})[CAST(floor({pos}) AS BIGINT) + 1] + "
            f"({pos} - floor({pos})) * ({lst})[CAST(ceil({pos}) AS BIGINT) + 1] END")


def _out_long(src: str) -> str:
    return "SELECT entity, feature, " + sql_round6("value") + f" AS value FROM {src}"


_STD = ("sst AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM {src} GROUP BY feature), "
        "{name} AS (SELECT x.entity, x.feature, (x.value - sst.m) / CASE WHEN sst.s = 0 THEN 1.0 ELSE sst.s END "
        "AS value, x.pos FROM {src} x JOIN sst ON x.feature = sst.feature)")


@register("f3_standard_scale", f"WITH {_clean_ctes()}, {_STD.format(src='d9', name='f3')} " + _out_long("f3"))
def q_f3(spark, sf_dir):
    return _long_out(sc.standard_scale(cleaned(spark, sf_dir), ["entity"]))


@register("f4_minmax_scale",
          f"WITH {_clean_ctes()}, mm AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM d9 GROUP BY feature), "
          "f4 AS (SELECT x.entity, x.feature, (x.value - mm.lo) / CASE WHEN mm.hi = mm.lo THEN 1.0 ELSE mm.hi - mm.lo END "
          "AS value FROM d9 x JOIN mm ON x.feature = mm.feature) " + _out_long("f4"))
def q_f4(spark, sf_dir):
    return _long_out(sc.minmax_scale(cleaned(spark, sf_dir), ["entity"]))


@register("f2_winsorise",
          f"WITH {_clean_ctes()}, qq AS (SELECT feature, {sql_percentile('value', 0.25)} AS q1, "
          f"{sql_percentile('value', 0.75)} AS q3 FROM d9 GROUP BY feature), "
          "f2 AS (SELECT x.entity, x.feature, CASE WHEN x.value IS NULL THEN NULL ELSE "
          "greatest(least(x.value, q3 + (q3 - q1)), q1 - (q3 - q1)) END AS value FROM d9 x JOIN qq ON x.feature = qq.feature) "
          + _out_long("f2"))
def q_f2(spark, sf_dir):
    return _long_out(sc.winsorise(cleaned(spark, sf_dir), ["entity"]))


def _power_sql(base: str | None = None, out: str | None = None) -> str:
    """The likelihood on ever finer grids around the best value, down to the fourth decimal.
    ``base`` defines the scaled columns f3, ``out`` selects from the result f5."""
    yj = ("CASE WHEN value >= 0 THEN (CASE WHEN abs(lam) < 1e-12 THEN ln(1 + value) ELSE (pow(value + 1.0, lam) - 1.0) / lam END) "
          "ELSE (CASE WHEN abs(lam - 2.0) < 1e-12 THEN -ln(1 - value) ELSE -(pow(1.0 - value, 2.0 - lam) - 1.0) / (2.0 - lam) END) END")
    ctes, before = [], None
    for name, step, reach in (("p1", 0.25, 64), ("p2", 0.01, 30), ("p3", 0.0005, 30), ("best", 0.0001, 10)):
        centre = "0.0" if before is None else "b.lam"
        frm = "(SELECT DISTINCT feature FROM f3) b" if before is None else f"{before} b"
        ctes.append(
            f"g_{name} AS (SELECT b.feature, round({centre} + i * {step}, 4) AS lam FROM {frm}, range(-{reach}, {reach + 1}) t(i)), "
            f"{name} AS (SELECT feature, arg_max(lam, ll) AS lam FROM (SELECT g.feature, g.lam, (-count(*) / 2.0) * ln(nullif(var_pop({yj.replace('lam', 'g.lam')}), 0)) "
            f"+ (g.lam - 1.0) * sum(sign(value) * ln(1 + abs(value))) AS ll FROM g_{name} g JOIN f3 x ON g.feature = x.feature "
            "WHERE x.value IS NOT NULL GROUP BY g.feature, g.lam) z WHERE ll IS NOT NULL GROUP BY feature)")
        before = name
    return (f"WITH {_clean_ctes()}, "
            f"{base or _STD.format(src='d9', name='f3')}, {', '.join(ctes)}, "
            f"t5 AS (SELECT x.entity, x.feature, x.pos, (SELECT {yj.replace('lam', 'b.lam').replace('value', 'x.value')} ) AS value "
            "FROM f3 x JOIN best b ON x.feature = b.feature), "
            f"{_STD.format(src='t5', name='f5').replace('sst', 'sst5')}" + (out or " " + _out_long("f5")))


@register("f5_power_transform", _power_sql())
def q_f5(spark, sf_dir):
    """standard then power (the scale chain orders ["standard", "power"]): the likelihood
    grid is well conditioned on unit-scale columns."""
    std = sc.standard_scale(cleaned(spark, sf_dir), ["entity"])
    return _long_out(sc.power_transform(std, ["entity"]))


def _quantile_sql(n: int) -> str:
    # Spark's percentile with its rule for equal neighbours, so that repeated references stay equal
    ref = ("list_transform(range({n}), lambda i: CASE WHEN floor(i / {m} * (len(o) - 1)) = ceil(i / {m} * (len(o) - 1)) "
           "OR o[CAST(floor(i / {m} * (len(o) - 1)) AS INTEGER) + 1] = o[CAST(ceil(i / {m} * (len(o) - 1)) AS INTEGER) + 1] "
           "THEN o[CAST(floor(i / {m} * (len(o) - 1)) AS INTEGER) + 1] "
           "ELSE (ceil(i / {m} * (len(o) - 1)) - i / {m} * (len(o) - 1)) * o[CAST(floor(i / {m} * (len(o) - 1)) AS INTEGER) + 1] "
           "+ (i / {m} * (len(o) - 1) - floor(i / {m} * (len(o) - 1))) * o[CAST(ceil(i / {m} * (len(o) - 1)) AS INTEGER) + 1] END)").format(n=n, m=float(n - 1))
    up, dn = "len(list_filter(r, lambda v: v < value))", "(len(list_filter(r, lambda v: v <= value)) - 1)"
    return (f"WITH {_clean_ctes()}, oo AS (SELECT feature, list_sort(list(value)) AS o FROM d9 WHERE value IS NOT NULL GROUP BY feature), rr AS (SELECT feature, {ref} AS r FROM oo), "
            f"m AS (SELECT x.*, r, {up} AS up, {dn} AS dn FROM d9 x LEFT JOIN rr ON x.feature = rr.feature), "
            "f6 AS (SELECT entity, feature, CASE WHEN value IS NULL THEN NULL WHEN value <= r[1] THEN 0.0 WHEN value >= r[len(r)] THEN 1.0 "
            f"WHEN dn >= up THEN (up + dn) / (2.0 * {n - 1}) ELSE (dn + (value - r[dn + 1]) / (r[dn + 2] - r[dn + 1])) / {float(n - 1)!r} END AS value FROM m) "
            + _out_long("f6"))


@register("f6_quantile_transform", _quantile_sql(100))
def q_f6(spark, sf_dir):
    return _long_out(sc.quantile_transform(cleaned(spark, sf_dir), ["entity"], 100))


@register("f7_scale_chain",
          f"WITH {_clean_ctes()}, {_STD.format(src='d9', name='f3')}, "
          + _D7.format(src='f3').replace("st7", "st7b").replace("d7 AS", "f7 AS") + " " + _out_long("f7"))
def q_f7(spark, sf_dir):
    df, _suffix = sc.scale_chain(cleaned(spark, sf_dir), ["entity"], ["standard"])
    return _long_out(df)


@register("f7_winsorise_standard_power", _power_sql(
    f"qq AS (SELECT feature, {sql_percentile('value', 0.25)} AS q1, {sql_percentile('value', 0.75)} AS q3 FROM d9 GROUP BY feature), "
    "w AS (SELECT x.entity, x.feature, x.pos, CASE WHEN x.value IS NULL THEN NULL ELSE greatest(least(x.value, q3 + (q3 - q1)), "
    "q1 - (q3 - q1)) END AS value FROM d9 x JOIN qq ON x.feature = qq.feature), " + _STD.format(src="w", name="f3"),
    ", " + _D7.format(src="f5").replace("st7", "st7b").replace("d7 AS", "f7 AS") + " " + _out_long("f7")))
def q_f7sp(spark, sf_dir):
    """F7 with outliers removed: winsorise, standard, power, then drop constants."""
    df, _suffix = sc.scale_chain(cleaned(spark, sf_dir), ["entity"], ["standard", "power"], remove_outliers=True)
    return _long_out(df)


def q_f7p(spark, sf_dir):
    """F7 on raw columns: winsorise, then power, whose lambdas lie far beyond any fixed grid."""
    df, _suffix = sc.scale_chain(cleaned(spark, sf_dir), ["entity"], ["power"], remove_outliers=True)
    return _long_out(df)


QUERIES["f7_winsorise_power"] = (q_f7p, None)


@register("f1_align_targets",
          f"WITH {_clean_ctes()}, t AS ({_abs_sql()}) "
          "SELECT count(DISTINCT entity) AS n_entities FROM d9 WHERE entity IN (SELECT entity FROM t)")
def q_f1(spark, sf_dir):
    feats, targets = sc.align(cleaned(spark, sf_dir), q_e2(spark, sf_dir), "entity")
    return feats.select(F.count(F.lit(1)).alias("n_entities"))


def _rank_corr_sql(src: str) -> str:
    return (f"rk AS (SELECT entity, feature, rank() OVER (PARTITION BY feature ORDER BY value) + "
            f"(count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS value FROM {src}), "
            "cp AS (SELECT a.feature AS a, b.feature AS b, corr(a.value, b.value) AS r FROM rk a JOIN rk b "
            "ON a.entity = b.entity AND a.feature < b.feature GROUP BY a.feature, b.feature)")


@register("f9_spearman_matrix",
          f"WITH {_clean_ctes()}, {_rank_corr_sql('d9')} SELECT a, b, " + sql_round6("r") + " AS r FROM cp")
def q_f9(spark, sf_dir):
    df = cleaned(spark, sf_dir)
    feats = [c for c in df.columns if c != "entity"]
    out = co.correlation_pairs(spark, df, feats, "spearman")
    return out.select("a", "b", round6(F.col("r")).alias("r"))


@register("f10_drop_collinear",
          f"WITH {_clean_ctes()}, {_rank_corr_sql('d9')}, "
          "dr AS (SELECT DISTINCT a AS feature FROM cp WHERE abs(r) >= 0.9) "
          "SELECT entity, feature, " + sql_round6("value") + " AS value FROM d9 WHERE feature NOT IN (SELECT feature FROM dr)")
def q_f10(spark, sf_dir):
    return _long_out(co.drop_collinear(cleaned(spark, sf_dir), ["entity"], "spearman", 0.9))


@register("f11_vif_elimination", None)
def q_f11(spark, sf_dir):
    return co.vif_frame(spark, cleaned(spark, sf_dir), ["entity"], value_threshold=10.0)


# ------------------------------------------------------------ G crafting ----
from featurelab.operators import crafting as cr  # noqa: E402


def _sql_u(tag_parts: list[str]) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws(':', {', '.join(tag_parts)})), 1, 13) AS BIGINT) / 4503599627370496.0)"


def _sql_normal(name: str | None = None, name_sql: str | None = None) -> str:
    """DuckDB twin of keyed_normal for a literal column name or a SQL expression giving it."""
    nm = name_sql if name_sql is not None else f"'{name}'"
    h = f"md5(concat_ws(':', '42', 'n', CAST(entity AS VARCHAR), {nm}))"
    u1 = f"(CAST('0x' || substr({h}, 1, 13) AS BIGINT) / 4503599627370496.0)"
    u2 = f"(CAST('0x' || substr({h}, 14, 13) AS BIGINT) / 4503599627370496.0)"
    return f"(sqrt(-2.0 * ln(1.0 - {u1})) * cos(2.0 * pi() * {u2}))"


def _g_long(df: DataFrame, prefix: tuple[str, ...]) -> DataFrame:
    crafted = [c for c in df.columns if c.startswith(prefix)]
    return to_long(df, ["entity"], crafted).select("entity", "feature", round6(F.col("value")).alias("value"))


def q_g(spark, sf_dir):
    base = cleaned(spark, sf_dir)
    scaled = sc.standard_scale(base, ["entity"])
    out, _suffix = cr.craft(scaled, base, "entity", random_percent=0.25, corrupted_percent=0.25,
                            second_order_percent=0.25)
    return _g_long(out, ("noise___", "corrupted___", "so___"))


QUERIES["g4_craft_uninformative"] = (q_g, None)


@register("g1_noise_normal",
          "SELECT entity, feature, " + sql_round6("value") + " AS value FROM (SELECT entity, "
          "unnest(['noise___normal_0', 'noise___normal_1', 'noise___normal_2']) AS feature, unnest(["
          + ", ".join(_sql_normal(f"noise___normal_{i}") for i in range(3)) + "]) AS value FROM ("
          + S.doc_features() + ") d) x")
def q_g1(spark, sf_dir):
    df = cr.add_noise(fx.doc_features(spark, sf_dir).select("entity"), "entity", 3, "normal", 42)
    return _g_long(df, ("noise___",))


@register("g1_noise_uniform",
          "SELECT entity, feature, " + sql_round6("value") + " AS value FROM (SELECT entity, "
          "unnest(['noise___uniform_0', 'noise___uniform_1']) AS feature, unnest(["
          + ", ".join(_sql_u(["'42'", "CAST(entity AS VARCHAR)", f"'noise___uniform_{i}'"]) for i in range(2))
          + "]) AS value FROM (" + S.doc_features() + ") d) x")
def q_g1u(spark, sf_dir):
    df = cr.add_noise(fx.doc_features(spark, sf_dir).select("entity"), "entity", 2, "uniform", 42)
    return _g_long(df, ("noise___",))


def _poisson_sql(lam: float, name_sql: str) -> str:
    """Number of cumulated probabilities that the uniform number reaches."""
    u = _sql_u(["'42'", "'p'", "CAST(entity AS VARCHAR)", name_sql])
    return "(" + " + ".join(f"CASE WHEN {u} >= {c!r} THEN 1 ELSE 0 END" for c in poisson_cdf(lam)) + ")"


@register("g1_noise_poisson",
          "SELECT entity, 'noise___poisson_' || CAST(i AS VARCHAR) AS feature, CAST("
          + _poisson_sql(1.0, "'noise___poisson_' || CAST(i AS VARCHAR)") + " AS DOUBLE) AS value FROM (" + S.doc_features() + ") d, range(3) t(i)")
def q_g1p(spark, sf_dir):
    d = fx.doc_features(spark, sf_dir).select("entity", *fx.DOC_FEATURES)
    return _g_long(cr.add_noise(d, "entity", 3, "poisson", 42), ("noise___",))


def _g23_sql() -> str:
    feats = fx.DOC_FEATURES
    corrupt = cr.pick_names(feats, 2, 42, "corrupt")
    pairs = cr.pick_pairs(feats, 2, 42)
    names = [f"corrupted___{n}" for n in corrupt] + [f"so___{a}_{b}" for a, b in pairs]
    vals = [f"(0.5 * {n} + 0.5 * {_sql_normal('corrupted___' + n)})" for n in corrupt] + \
           [f"({a} * {b})" for a, b in pairs]
    return ("SELECT entity, feature, " + sql_round6("value") + " AS value FROM (SELECT entity, unnest(["
            + ", ".join(f"'{n}'" for n in names) + "]) AS feature, unnest([" + ", ".join(vals) + "]) AS value FROM ("
            + S.doc_features() + ") d) x")


@register("g2_g3_corrupted_and_products", _g23_sql())
def q_g23(spark, sf_dir):
    d = fx.doc_features(spark, sf_dir).select("entity", *fx.DOC_FEATURES)
    out = cr.add_corrupted(d, d, "entity", cr.pick_names(fx.DOC_FEATURES, 2, 42, "corrupt"), 0.5, 42)
    out = cr.add_second_order(out, cr.pick_pairs(fx.DOC_FEATURES, 2, 42))
    return _g_long(out, ("corrupted___", "so___"))


@register("g5_shift_random",
          "SELECT entity, 'U ' || CAST(i AS VARCHAR) AS feature, "
          + sql_round6(_sql_normal(name_sql="'U ' || CAST(i AS VARCHAR)"))
          + " AS value FROM (" + S.doc_features() + ") d, range(100) t(i)")
def q_g5(spark, sf_dir):
    d = fx.doc_features(spark, sf_dir).select("entity", *fx.DOC_FEATURES)
    out = cr.shift_variants_long(d, "entity", "random", 100)
    return out.select("entity", "feature", round6(F.col("value")).alias("value"))


def _shift_sql(scenario: str) -> str:
    made_of = cr.shift_sources(len(fx.DOC_FEATURES), scenario, 100)
    x = [f"[{', '.join(fx.DOC_FEATURES)}][[{', '.join(str(m[at] + 1) for m in made_of)}][i + 1]]" for at in range(len(made_of[0]))]
    noise = _sql_normal(name_sql="'U ' || CAST(i AS VARCHAR)")
    value = f"{x[0]} + 0.5 * {noise}" if len(x) == 1 else f"{x[0]} * {x[1]}"
    return ("SELECT entity, 'U ' || CAST(i AS VARCHAR) AS feature, " + sql_round6(f"({value})")
            + " AS value FROM (" + S.doc_features() + ") d, range(100) t(i)")


def _shift(scenario: str):
    def run(spark, sf_dir):
        d = fx.doc_features(spark, sf_dir).select("entity", *fx.DOC_FEATURES)
        out = cr.shift_variants_long(d, "entity", scenario, 100)
        return out.select("entity", "feature", round6(F.col("value")).alias("value"))
    return run


for _s in ("corrupted", "second_order"):
    QUERIES[f"g5_shift_{_s}"] = (_shift(_s), _shift_sql(_s))


@register("h3_slices", None)
def q_h3(spark, sf_dir):
    feats = [c for c in cleaned(spark, sf_dir).columns if c != "entity"]
    return sp.slice_features(spark, feats, [3, 6], n_iter=3)


@register("h4_sample_uninformative", None)
def q_h4(spark, sf_dir):
    base = cleaned(spark, sf_dir)
    out, _ = cr.craft(sc.standard_scale(base, ["entity"]), base, "entity", random_percent=0.5)
    feats = [c for c in out.columns if c != "entity"]
    return sp.sample_uninformative(spark, feats, [0.1, 0.5, 1.0], n_iter=2)


# ------------------------------------------------- J9, J10, L (analytics) ---
from featurelab.operators import reporting as rp  # noqa: E402

_METHODS = [("spearman", "i2_spearman_selector"), ("pearson", "i2_pearson_selector"),
            ("chi2", "i3_chi2_selector"), ("f_value", "i5_f_value_selector"),
            ("mutual_info", "i4_mutual_info_selector")]


_SELECTOR_FNS = {
    "spearman": lambda d: sel.correlation_selector(d, "entity", fx.DOC_FEATURES, DOC_TARGETS, K_FOLDS),
    "pearson": lambda d: sel.correlation_selector(d, "entity", fx.DOC_FEATURES, DOC_TARGETS, K_FOLDS, "pearson"),
    "chi2": lambda d: sel.chi2_selector(d, "entity", fx.DOC_FEATURES, DOC_TARGETS, K_FOLDS),
    "f_value": lambda d: sel.f_value_selector(d, "entity", fx.DOC_FEATURES, DOC_TARGETS, K_FOLDS),
    "mutual_info": lambda d: sel.mutual_info_selector(d, "entity", fx.DOC_FEATURES, DOC_TARGETS, K_FOLDS),
}


def experiment_frame(spark, sf_dir) -> DataFrame:
    """Union of the selector results: (method, fold, target, feature, score, kept).

    The document features are extracted once and shared by the five selectors."""
    d = doc_frame(spark, sf_dir)
    out = None
    for m, _qn in _METHODS:
        df = _tidy(_SELECTOR_FNS[m](d)).select(F.lit(m).alias("method"), "fold", "target", "feature",
                                                "score", "kept")
        out = df if out is None else out.unionByName(df)
    return cut_lineage(out)


def _exp_sql() -> str:
    parts = [f"SELECT '{m}' AS method, fold, target, feature, score, kept FROM ({QUERIES[qn][1]}) s_{m}"
             for m, qn in _METHODS]
    return " UNION ALL ".join(parts)


def run_results(spark, sf_dir) -> DataFrame:
    e = experiment_frame(spark, sf_dir)
    return e.groupBy("method", "fold", "target").agg(
        F.count(F.when(F.col("kept"), 1)).alias("n_kept"),
        F.avg(F.when(F.col("kept"), F.abs("score"))).alias("mean_abs"))


def _runs_sql() -> str:
    return (f"runs AS (SELECT method, fold, target, count(*) FILTER (WHERE kept) AS n_kept, "
            f"avg(CASE WHEN kept THEN abs(score) END) AS mean_abs FROM ({_exp_sql()}) e GROUP BY ALL)")


@register("l2_importance_fraction",
          f"WITH e AS ({_exp_sql()}), r AS (SELECT *, row_number() OVER (PARTITION BY method, fold, target "
          "ORDER BY abs(score) DESC NULLS LAST, feature) AS rk FROM e) "
          "SELECT method, fold, target, " + sql_round6("fr") + " AS fraction FROM (SELECT method, fold, target, "
          "sum(CASE WHEN rk <= 5 THEN abs(score) ELSE 0.0 END) / sum(abs(score)) AS fr FROM r GROUP BY ALL) x")
def q_l2(spark, sf_dir):
    imp = experiment_frame(spark, sf_dir).withColumn("importance", F.abs("score"))
    out = rp.importance_fraction(imp, ["method", "fold", "target"], 5)
    return out.select("method", "fold", "target", round6(F.col("fraction")).alias("fraction"))


@register("l4_top_methods",
          f"WITH {_runs_sql()}, m AS (SELECT target, method, avg(n_kept) AS mean_score FROM runs GROUP BY ALL) "
          "SELECT target, method, " + sql_round6("mean_score") + " AS mean_score, place FROM (SELECT *, "
          "CAST(row_number() OVER (PARTITION BY target ORDER BY mean_score DESC, method) AS INTEGER) AS place FROM m) x "
          "WHERE place <= 3")
def q_l4(spark, sf_dir):
    out = rp.top_methods(run_results(spark, sf_dir), ["target"], "method", "n_kept", 3)
    return out.select("target", "method", round6(F.col("mean_score")).alias("mean_score"), "place")


@register("l5_top3_share",
          f"WITH {_runs_sql()}, t AS (SELECT *, row_number() OVER (PARTITION BY fold, target ORDER BY n_kept DESC, method) AS pl "
          "FROM runs) SELECT method, " + sql_round6("100.0 * count(*) / (SELECT count(*) FROM (SELECT DISTINCT fold, target FROM runs) c)")
          + " AS share FROM t WHERE pl <= 3 GROUP BY method")
def q_l5(spark, sf_dir):
    out = rp.top3_share(run_results(spark, sf_dir), ["fold", "target"], "method", "n_kept")
    return out.select("method", round6(F.col("share")).alias("share"))


@register("l6_centroids",
          f"WITH {_runs_sql()} SELECT method, " + sql_round6("avg(n_kept)") + " AS mean_n_kept, "
          + sql_round6("avg(mean_abs)") + " AS mean_mean_abs FROM runs GROUP BY method")
def q_l6(spark, sf_dir):
    out = rp.centroids(run_results(spark, sf_dir), "method", ["n_kept", "mean_abs"])
    return out.select("method", round6(F.col("mean_n_kept")).alias("mean_n_kept"),
                      round6(F.col("mean_mean_abs")).alias("mean_mean_abs"))


# Fixed display names and classes of the selection methods (report labels).
_LABELS = {"spearman": "Correlation", "pearson": "Correlation (linear)", "chi2": "Chi-square",
           "f_value": "F value", "mutual_info": "Mutual information"}
_MODEL_FREE = ["spearman", "pearson", "chi2", "f_value", "mutual_info"]


@register("l7_labels",
          f"WITH {_runs_sql()}, lab AS (SELECT DISTINCT method, method || ' (' || target || ')__fold' || CAST(fold AS VARCHAR) "
          "AS label FROM runs), b AS (SELECT label, trim(split_part(split_part(label, '__', 1), '(', 1)) AS base FROM lab) "
          "SELECT label, CASE base " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LABELS.items())
          + " ELSE base END AS name, CASE WHEN base IN (" + ", ".join(f"'{m}'" for m in _MODEL_FREE)
          + ") THEN 'model-free' ELSE 'model-based' END AS kind FROM b")
def q_l7(spark, sf_dir):
    runs = run_results(spark, sf_dir)
    lab = runs.select(F.concat("method", F.lit(" ("), "target", F.lit(")__fold"), F.col("fold").cast("string"))
                      .alias("label")).distinct()
    base = F.trim(F.substring_index(F.substring_index("label", "__", 1), "(", 1))
    return lab.select("label", rp.clean_label(F.col("label"), "__", _LABELS).alias("name"),
                      F.when(base.isin(_MODEL_FREE), "model-free").otherwise("model-based").alias("kind"))


@register("l8_jaccard_stability",
          f"WITH e AS ({_exp_sql()}), s AS (SELECT method, target, fold, feature FROM e WHERE kept), "
          "sz AS (SELECT method, target, fold, count(*) FILTER (WHERE kept) AS n FROM e GROUP BY ALL), "
          "pr AS (SELECT a.method, a.target, a.fold AS fa, b.fold AS fb, a.n AS na, b.n AS nb FROM sz a JOIN sz b "
          "ON a.method = b.method AND a.target = b.target AND a.fold < b.fold), "
          "it AS (SELECT x.method, x.target, x.fold AS fa, y.fold AS fb, count(*) AS i FROM s x JOIN s y "
          "ON x.method = y.method AND x.target = y.target AND x.feature = y.feature AND x.fold < y.fold GROUP BY ALL) "
          "SELECT pr.method, pr.target, " + sql_round6("avg(CASE WHEN na + nb - coalesce(i, 0) > 0 THEN "
          "coalesce(i, 0) / (na + nb - coalesce(i, 0)) ELSE 0.0 END)") + " AS jaccard FROM pr LEFT JOIN it "
          "ON pr.method = it.method AND pr.target = it.target AND pr.fa = it.fa AND pr.fb = it.fb GROUP BY pr.method, pr.target")
def q_l8(spark, sf_dir):
    e = experiment_frame(spark, sf_dir)
    out = rp.jaccard_stability(e.where("kept"), "fold", ["method", "target"], runs=e)
    return out.select("method", "target", round6(F.col("jaccard")).alias("jaccard"))


@register("l9_summaries",
          f"WITH {_runs_sql()} SELECT target, method, " + sql_round6("avg(n_kept)") + " AS mean, "
          + sql_round6("stddev_samp(n_kept)") + " AS sd, count(n_kept) AS n FROM runs GROUP BY ALL")
def q_l9(spark, sf_dir):
    out = rp.summaries(run_results(spark, sf_dir), ["target", "method"], "n_kept")
    return out.select("target", "method", round6(F.col("mean")).alias("mean"), round6(F.col("sd")).alias("sd"), "n")


def prediction_table(spark, sf_dir) -> DataFrame:
    """A rule 'classifier' per target on the document features: p = one feature, pred = p >= 0.01."""
    d = doc_frame(spark, sf_dir)
    rows = d.select("entity", "fold", F.explode(F.array(
        F.struct(F.lit("quality").alias("target"), F.col("quality").alias("y"), F.col("f_dot").alias("p")),
        F.struct(F.lit("toxic").alias("target"), F.col("toxic").alias("y"), F.col("f_upper").alias("p")))).alias("s"))
    return rows.select("entity", "fold", "s.target", "s.y", "s.p",
                       F.when(F.col("s.p") >= 0.01, 1.0).otherwise(0.0).alias("pred"))


def _pred_sql() -> str:
    return (f"pt AS (SELECT entity, fold, t.target, CASE WHEN t.target = 'quality' THEN quality ELSE toxic END AS y, "
            f"CASE WHEN t.target = 'quality' THEN f_dot ELSE f_upper END AS p FROM ({_doc_sql()}) d, "
            "(VALUES ('quality'), ('toxic')) t(target)), "
            "pr AS (SELECT *, CASE WHEN p >= 0.01 THEN 1.0 ELSE 0.0 END AS pred FROM pt), "
            "ba AS (SELECT fold, target, avg(rec) AS b_acc FROM (SELECT fold, target, y, "
            "avg(CASE WHEN pred = y THEN 1.0 ELSE 0.0 END) AS rec FROM pr GROUP BY ALL) r GROUP BY ALL), "
            "cls AS (SELECT DISTINCT fold, target, y AS cls FROM pr UNION SELECT DISTINCT fold, target, pred FROM pr), "
            "pc AS (SELECT c.fold, c.target, c.cls, sum(CASE WHEN y = c.cls AND pred = c.cls THEN 1 ELSE 0 END) AS tp, "
            "sum(CASE WHEN y = c.cls THEN 1 ELSE 0 END) AS sup, sum(CASE WHEN pred = c.cls THEN 1 ELSE 0 END) AS npred "
            "FROM pr JOIN cls c ON pr.fold = c.fold AND pr.target = c.target GROUP BY ALL), "
            "f1 AS (SELECT fold, target, sum(CASE WHEN sup + npred > 0 THEN 2.0 * tp / (sup + npred) ELSE 0.0 END * sup) "
            "/ sum(sup) AS f1 FROM pc GROUP BY ALL), "
            "rk AS (SELECT *, rank() OVER (PARTITION BY fold, target ORDER BY p) + "
            "(count(*) OVER (PARTITION BY fold, target, p) - 1) / 2.0 AS r FROM pr), "
            "auc AS (SELECT fold, target, (sum(CASE WHEN y = 1 THEN r ELSE 0.0 END) - "
            "sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) * (sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) + 1) / 2.0) / "
            "(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) * sum(CASE WHEN y <> 1 THEN 1 ELSE 0 END)) AS roc FROM rk GROUP BY ALL), "
            "sc AS (SELECT ba.fold, ba.target, b_acc, f1, roc FROM ba JOIN f1 USING (fold, target) JOIN auc USING (fold, target))")


@register("j9_scores",
          f"WITH {_pred_sql()} SELECT fold, target, " + ", ".join(f"{sql_round6(m)} AS {m}" for m in ("b_acc", "f1", "roc"))
          + " FROM sc")
def q_j9(spark, sf_dir):
    out = rp.score_table(prediction_table(spark, sf_dir), ["fold", "target"])
    return out.select("fold", "target", *[round6(F.col(m)).alias(m) for m in ("b_acc", "f1", "roc")])


@register("j10_fold_summary",
          f"WITH {_pred_sql()} SELECT target, "
          + ", ".join(f"{sql_round6(f'avg({m})')} AS test_{m}_mean, {sql_round6(f'stddev_samp({m})')} AS test_{m}_std"
                      for m in ("b_acc", "f1", "roc")) + ", count(*) AS samples FROM sc GROUP BY target")
def q_j10(spark, sf_dir):
    sc_ = rp.score_table(prediction_table(spark, sf_dir), ["fold", "target"])
    out = rp.fold_summary(sc_, ["target"], ["b_acc", "f1", "roc"])
    return r6(out, keys=("target",))


# ------------------------------------------------------------- B profiles ---
from featurelab.operators import profiling as pf  # noqa: E402

_NUM = ["value", "hour"]


def _events_sql() -> str:
    return ("SELECT user_id AS entity, event_type AS category, value, CAST(hour(ts) AS DOUBLE) AS hour, "
            "CAST(CAST(floor(hour(ts) / 6) AS INTEGER) AS VARCHAR) AS hour_bin FROM events")


def _events(spark, sf_dir):
    ev = fx.profile_events(spark, sf_dir)
    return ev.withColumn("hour_bin", pf.bin_numeric(F.col("hour"), 6.0))


@register("b1_general_profile",
          "SELECT entity, 3.0 AS \"f__profile.general.nr_attr\", 2.0 AS \"f__profile.general.nr_num\", "
          "1.0 AS \"f__profile.general.nr_cat\", CAST(count(*) AS DOUBLE) AS \"f__profile.general.nr_inst\", "
          "CAST((CASE WHEN count(DISTINCT value) = 2 THEN 1 ELSE 0 END) + (CASE WHEN count(DISTINCT hour) = 2 THEN 1 ELSE 0 END) "
          "+ (CASE WHEN count(DISTINCT hour_bin) = 2 THEN 1 ELSE 0 END) AS DOUBLE) AS \"f__profile.general.nr_bin\", "
          f"CAST(count(DISTINCT category) AS DOUBLE) AS \"f__profile.general.nr_class\" FROM ({_events_sql()}) e GROUP BY entity")
def q_b1(spark, sf_dir):
    return pf.general(_events(spark, sf_dir), "entity", _NUM, ["hour_bin"], "category")


def _stat_sql() -> str:
    cols = []
    for c in _NUM:
        m = f"avg({c})"
        sd = f"stddev_pop({c})"
        cols += [f"{m} AS \"mean.{c}\"", f"{sd} AS \"sd.{c}\"", f"min({c}) AS \"min.{c}\"", f"max({c}) AS \"max.{c}\"",
                 f"CASE WHEN var_pop({c}) = 0 THEN NULL ELSE (avg(pow({c}, 3)) - 3 * {m} * avg(pow({c}, 2)) + 2 * pow({m}, 3)) "
                 f"/ pow(var_pop({c}), 1.5) END AS \"skewness.{c}\"",
                 f"CASE WHEN var_pop({c}) = 0 THEN NULL ELSE (avg(pow({c}, 4)) - 4 * {m} * avg(pow({c}, 3)) + "
                 f"6 * pow({m}, 2) * avg(pow({c}, 2)) - 3 * pow({m}, 4)) / pow(var_pop({c}), 2) - 3 END AS \"kurtosis.{c}\"",
                 f"CASE WHEN {m} = 0 THEN NULL ELSE {sd} / {m} END AS \"cv.{c}\"",
                 f"{S.median(c)} AS \"median.{c}\"",
                 f"{sql_percentile(c, 0.75)} - {sql_percentile(c, 0.25)} AS \"iq_range.{c}\""]
    return f"SELECT entity, {', '.join(cols)} FROM ({_events_sql()}) e GROUP BY entity"


@register("b2_statistical_profile",
          "SELECT entity, " + ", ".join(
              f"{sql_round6(chr(34) + st + '.' + c + chr(34))} AS \"f__profile.statistical.{st}.{c}\""
              for c in _NUM for st in pf.STATS) + f" FROM ({_stat_sql()}) s")
def q_b2(spark, sf_dir):
    return r6(pf.statistical(_events(spark, sf_dir), "entity", _NUM))


@register("b4_summary_functions",
          "SELECT entity, " + ", ".join(
              f"{sql_round6(expr)} AS \"f__profile.statistical.{st}.{sm}\""
              for st in pf.STATS for sm, expr in (
                  ("mean", f"((\"{st}.value\" + \"{st}.hour\") / 2.0)"),
                  ("sd", f"sqrt((pow(\"{st}.value\" - (\"{st}.value\" + \"{st}.hour\") / 2.0, 2) + "
                         f"pow(\"{st}.hour\" - (\"{st}.value\" + \"{st}.hour\") / 2.0, 2)) / 2.0)"),
                  ("min", f"least(\"{st}.value\", \"{st}.hour\")"),
                  ("max", f"greatest(\"{st}.value\", \"{st}.hour\")")))
          + f" FROM ({_stat_sql()}) s")
def q_b4(spark, sf_dir):
    st = pf.statistical(_events(spark, sf_dir), "entity", _NUM)
    return r6(pf.summarise(st, "entity", _NUM))


def _more_sql() -> str:
    q1, q3 = sql_percentile("{c}", 0.25), sql_percentile("{c}", 0.75)
    quart = ", ".join(f"{S.median(c)} AS m_{c}, {q1.format(c=c)} AS q1_{c}, {q3.format(c=c)} AS q3_{c}" for c in _NUM)
    out = []
    for c in _NUM:
        out += [f"var_pop({c}) AS \"var.{c}\"", f"{S.median(f'abs({c} - m_{c})')} AS \"mad.{c}\"",
                f"avg(CASE WHEN {c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) OR {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c}) THEN 1.0 "
                f"WHEN {c} IS NOT NULL THEN 0.0 END) AS \"outlier_share.{c}\""]
    a, b = _NUM
    return (f"WITH e AS ({_events_sql()}), q AS (SELECT entity, {quart} FROM e GROUP BY entity) "
            f"SELECT e.entity, {', '.join(out)}, CASE WHEN stddev_pop({a}) = 0 OR stddev_pop({b}) = 0 THEN NULL "
            f"ELSE covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END AS \"cor.{a}.{b}\" "
            "FROM e JOIN q ON e.entity = q.entity GROUP BY e.entity")


_MORE = [f"{st}.{c}" for c in _NUM for st in ("var", "mad", "outlier_share")] + ["cor." + ".".join(_NUM)]


@register("b2_statistical_profile_more",
          "SELECT entity, " + ", ".join(f"{sql_round6(chr(34) + m + chr(34))} AS \"f__profile.statistical.{m}\"" for m in _MORE) + f" FROM ({_more_sql()}) s")
def q_b2m(spark, sf_dir):
    """B2: variance, median absolute deviation, outlier share and correlation of every entity."""
    out = pf.statistical_more(_events(spark, sf_dir), "entity", _NUM)
    return r6(out.select("entity", *[q(f"f__profile.statistical.{m}") for m in _MORE]))


_SUMMARIES = ("median", "range", "iq_range", "skewness", "kurtosis", "count", "quantiles", "histogram")
_SUMMED = ["mean", "cv"]


def _summaries_sql() -> str:
    lists = [f"list_filter([{', '.join(f'{chr(34)}{m}.{c}{chr(34)}' for c in _NUM)}], lambda v: v IS NOT NULL) AS l_{m}" for m in _SUMMED]
    stats, cols, names = [], [], []
    for m in _SUMMED:
        l, n = f"l_{m}", f"n_{m}"
        stats += [f"list_sort({l}) AS o_{m}", f"len({l}) AS n_{m}", f"list_avg({l}) AS a_{m}", f"list_max({l}) - list_min({l}) AS w_{m}",
                  f"list_avg(list_transform({l}, lambda v: pow(v - list_avg({l}), 2))) AS v_{m}"]
        at = lambda p: (f"(o_{m}[CAST(floor({p} * ({n} - 1)) AS INTEGER) + 1] + ({p} * ({n} - 1) - floor({p} * ({n} - 1))) * "  # noqa: E731
                        f"(o_{m}[CAST(ceil({p} * ({n} - 1)) AS INTEGER) + 1] - o_{m}[CAST(floor({p} * ({n} - 1)) AS INTEGER) + 1]))")
        moment = lambda k: f"list_avg(list_transform({l}, lambda v: pow(v - a_{m}, {k})))"
        share = lambda b: (f"len(list_filter({l}, lambda v: CASE WHEN w_{m} > 0 THEN least(floor((v - o_{m}[1]) / w_{m} * 10), 9) "  # noqa: E731
                           f"ELSE 0 END = {b})) / CAST(nullif({n}, 0) AS DOUBLE)")
        exprs = {"median": at(0.5), "range": f"w_{m}", "iq_range": f"{at(0.75)} - {at(0.25)}",
                 "skewness": f"CASE WHEN v_{m} > 0 THEN {moment(3)} / pow(v_{m}, 1.5) END", "kurtosis": f"CASE WHEN v_{m} > 0 THEN {moment(4)} / (v_{m} * v_{m}) - 3 END",
                 "count": f"CAST({n} AS DOUBLE)", **{f"quantiles.{i}": at(i / 4) for i in range(5)}, **{f"histogram.{b}": share(b) for b in range(10)}}
        for name, e in exprs.items():
            names.append(f"f__profile.statistical.{m}.{name}")
            cols.append(f"{e} AS c{len(names)}")
    return (f"WITH l AS (SELECT entity, {', '.join(lists)} FROM ({_stat_sql()}) s), t AS (SELECT entity, {', '.join(f'l_{m}' for m in _SUMMED)}, "
            f"{', '.join(stats)} FROM l), x AS (SELECT entity, {', '.join(cols)} FROM t) "
            "SELECT entity, " + ", ".join(f"{sql_round6(f'c{i + 1}')} AS \"{name}\"" for i, name in enumerate(names)) + " FROM x")


@register("b4_summary_functions_more", _summaries_sql())
def q_b4m(spark, sf_dir):
    """The eight summaries beside mean, deviation and extremes."""
    st = cut_lineage(pf.statistical(_events(spark, sf_dir), "entity", _NUM))
    return r6(cut_lineage(pf.summarise(st, "entity", _NUM, _SUMMED, _SUMMARIES)))


@register("b3_info_theory_profile",
          f"WITH e AS ({_events_sql()}), j AS (SELECT entity, hour_bin, category, count(*) AS c FROM e GROUP BY ALL), "
          "jn AS (SELECT *, sum(c) OVER (PARTITION BY entity) AS n FROM j), "
          "hc AS (SELECT entity, -sum((cc / n) * log2(cc / n)) AS h_class FROM (SELECT entity, category, sum(c) AS cc, max(n) AS n "
          "FROM jn GROUP BY ALL) x GROUP BY entity), "
          "ha AS (SELECT entity, -sum((ca / n) * log2(ca / n)) AS h_attr FROM (SELECT entity, hour_bin, sum(c) AS ca, max(n) AS n "
          "FROM jn GROUP BY ALL) x GROUP BY entity), "
          "hj AS (SELECT entity, -sum((c / n) * log2(c / n)) AS h_joint FROM jn GROUP BY entity) "
          "SELECT entity, " + sql_round6("h_class") + " AS \"f__profile.info-theory.class_ent\", "
          + sql_round6("h_attr") + " AS \"f__profile.info-theory.attr_ent.hour_bin\", "
          + sql_round6("h_joint") + " AS \"f__profile.info-theory.joint_ent.hour_bin\", "
          + sql_round6("h_class + h_attr - h_joint") + " AS \"f__profile.info-theory.mut_inf.hour_bin\", "
          + sql_round6("CASE WHEN h_class + h_attr - h_joint = 0 THEN NULL ELSE h_class / (h_class + h_attr - h_joint) END")
          + " AS \"f__profile.info-theory.eq_num_attr\", "
          + sql_round6("CASE WHEN h_class + h_attr - h_joint = 0 THEN NULL ELSE (h_attr - (h_class + h_attr - h_joint)) / (h_class + h_attr - h_joint) END")
          + " AS \"f__profile.info-theory.ns_ratio\" FROM hc JOIN ha USING (entity) JOIN hj USING (entity)")
def q_b3(spark, sf_dir):
    return r6(pf.info_theory(_events(spark, sf_dir), "entity", "hour_bin", "category"))


# ------------------------------------------- I6-I10, J1-J8, K (Spark ML) ----
from featurelab.operators import causal as ca  # noqa: E402
from featurelab.operators import learning as ln  # noqa: E402
from featurelab.operators import projection as pj  # noqa: E402

PLANTED_FEATS = fx.WIDE_FEATURES


def planted_frame(spark, sf_dir) -> DataFrame:
    return cut_lineage(sp.assign_folds(fx.planted(spark, sf_dir), "entity", K_FOLDS, SEED))


@register("i6_tree_importance_selector", None)
def q_i6(spark, sf_dir):
    return sel.selection(ln.model_selector(planted_frame(spark, sf_dir), PLANTED_FEATS, ["y"], K_FOLDS, "gbt_small"))


@register("i7_l1_logistic_selector", None)
def q_i7(spark, sf_dir):
    return sel.selection(ln.model_selector(planted_frame(spark, sf_dir), PLANTED_FEATS, ["y"], K_FOLDS, "l1_logreg"))


@register("i8_recursive_elimination", None)
def q_i8(spark, sf_dir):
    """I8 on the training rows of every fold."""
    return sel.selection(ln.recursive_selector(planted_frame(spark, sf_dir), PLANTED_FEATS, ["y"], K_FOLDS, "logreg", step=0.25))


@register("i9_double_ml_selector", None)
def q_i9(spark, sf_dir):
    return ca.double_ml_selector(planted_frame(spark, sf_dir), PLANTED_FEATS, ["y"], K_FOLDS)


@register("i10_counterfactual_selector", None)
def q_i10(spark, sf_dir):
    return ca.counterfactual_selector(planted_frame(spark, sf_dir), PLANTED_FEATS, ["y"], K_FOLDS)


def _cv(model: str):
    def run(spark, sf_dir):
        df = planted_frame(spark, sf_dir)
        scores = ln.cross_validate(df, lambda fold, t: PLANTED_FEATS, ["y"], K_FOLDS, model)
        return r6(rp.fold_summary(scores, ["target"], ["b_acc", "f1", "roc"]), keys=("target",))
    return run


for _m, _name in (("logreg", "j2_logreg_cv"), ("gbt", "j3_boosted_trees_cv"), ("mlp", "j4_perceptron_cv")):
    QUERIES[_name] = (_cv(_m), None)


@register("j1_cv_on_selection", None)
def q_j1(spark, sf_dir):
    """Fold-wise CV where each (fold, target) uses the columns its own training rows selected."""
    df = doc_frame(spark, sf_dir)
    selres = sel.selection(sel.f_value_selector(df, "entity", fx.DOC_FEATURES, DOC_TARGETS, K_FOLDS)).cache()
    cells = {(r["fold"], r["target"]): [] for r in selres.select("fold", "target").distinct().collect()}
    for r in selres.where("kept").orderBy("rank").select("fold", "target", "feature").collect():
        cells[(r["fold"], r["target"])].append(r["feature"])
    scores = ln.cross_validate(df, lambda f, t: cells.get((f, t), []), DOC_TARGETS, K_FOLDS, "logreg")
    return r6(scores, keys=("target",))


@register("j7_random_search", None)
def q_j7(spark, sf_dir):
    df = planted_frame(spark, sf_dir).where(F.col("fold") != 0)
    best, score = ln.random_search(df, PLANTED_FEATS, "y", "logreg", {"C": (0.01, 1.0)}, n_trials=3)
    return spark.createDataFrame([(str(best), float(score))], "params string, f1 double")


@register("k1_projection", None)
def q_k1(spark, sf_dir):
    df = planted_frame(spark, sf_dir)
    a, _b, _err = pj.fit_projection(df, PLANTED_FEATS, ["y"])
    return r6(pj.project(df, "entity", PLANTED_FEATS, a))


@register("k2_loadings", None)
def q_k2(spark, sf_dir):
    df = planted_frame(spark, sf_dir)
    a, _b, _err = pj.fit_projection(df, PLANTED_FEATS, ["y"])
    return pj.loadings(spark, PLANTED_FEATS, a)


# ------------------------------------------------ I4 nearest neighbours -----

def _sql_digamma(x: str) -> str:
    y = f"(CAST({x} AS DOUBLE) + 6.0)"
    shift = " + ".join(f"1.0 / (CAST({x} AS DOUBLE) + {k}.0)" for k in range(6))
    inv2 = f"(1.0 / ({y} * {y}))"
    return (f"(ln({y}) - 0.5 / {y} - {inv2} * (1.0 / 12 - {inv2} * (1.0 / 120 - {inv2} * (1.0 / 252 - {inv2} * "
            f"(1.0 / 240 - {inv2} / 132)))) - ({shift}))")


def _ksg_sql(kk: int = 3) -> str:
    w = "OVER (PARTITION BY fold, target, feature, cls ORDER BY value, CAST(entity AS VARCHAR))"
    lags = [f"value - lag(value, {i}) {w}" for i in range(1, kk + 1)]
    leads = [f"lead(value, {i}) {w} - value" for i in range(1, kk + 1)]
    return ("WITH " + _class_long_sql().replace("cl AS (SELECT train_fold AS fold,", "cl AS (SELECT entity, train_fold AS fold,") + ", "
            "c2 AS (SELECT *, count(*) OVER (PARTITION BY fold, target, feature, cls) AS n_c FROM cl "
            "WHERE value IS NOT NULL AND cls IS NOT NULL), "
            f"nb AS (SELECT *, least({kk}, n_c - 1) AS k_i, list_sort(list_filter([{', '.join(lags + leads)}], "
            "lambda d: d IS NOT NULL)) AS ds FROM c2 WHERE n_c > 1), "
            "pts AS (SELECT fold, target, feature, entity, value, n_c, k_i, ds[k_i] AS r FROM nb), "
            # bounds materialised first, so the join compares exactly x_j < x_i + r and x_j > x_i - r
            "bnd AS (SELECT *, value + r * (1.0 - 1e-12) AS up, value - r * (1.0 - 1e-12) AS lo FROM pts), "
            "mm AS (SELECT a.fold, a.target, a.feature, a.entity, count(*) AS m FROM bnd a JOIN pts b "
            "ON a.fold = b.fold AND a.target = b.target AND a.feature = b.feature AND "
            "((a.r > 0 AND b.value < a.up AND b.value > a.lo) OR (a.r = 0 AND b.value = a.value)) "
            "GROUP BY ALL), "
            f"st AS (SELECT fold, target, feature, count(*) AS n, avg({_sql_digamma('k_i')}) AS pk, "
            f"avg({_sql_digamma('n_c')}) AS pc, avg({_sql_digamma('m')}) AS pm FROM pts JOIN mm "
            "USING (fold, target, feature, entity) GROUP BY ALL), "
            f"sc AS (SELECT fold, target, feature, n, greatest(0.0, {_sql_digamma('n')} + pk - pc - pm) AS score FROM st), "
            "md AS (SELECT *, quantile_cont(score, 0.9) OVER (PARTITION BY fold, target) AS thr FROM sc), "
            "k AS (SELECT fold, target, feature, n, score, coalesce(score >= thr, false) AS kept FROM md) "
            + _ranked_out_sql("k"))


@register("i4_ksg_mutual_info_selector", _ksg_sql())
def q_i4k(spark, sf_dir):
    df = doc_frame(spark, sf_dir)
    return _tidy(sel.ksg_mutual_info_selector(df, "entity", fx.DOC_FEATURES, DOC_TARGETS, K_FOLDS))


# ---------------------------------------------- compositions of the above ---
import uuid  # noqa: E402

from featurelab.sources.store import read_stage, write_stage  # noqa: E402


@register("i11_multi_output",
          "WITH s AS (" + _spearman_sql() + "), w AS (SELECT fold, feature, "
          "max(CASE WHEN target = 'quality' AND kept THEN score END) AS \"quality__corr_spearman\", "
          "max(CASE WHEN target = 'toxic' AND kept THEN score END) AS \"toxic__corr_spearman\" FROM s GROUP BY ALL) "
          "SELECT * FROM w WHERE \"quality__corr_spearman\" IS NOT NULL OR \"toxic__corr_spearman\" IS NOT NULL")
def q_i11(spark, sf_dir):
    return sel.multi_output(q_i2(spark, sf_dir), "corr_spearman", DOC_TARGETS)


def _stage_root(spark) -> str:
    """A folder under the shared checkpoint location for stage tables."""
    from featurelab.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark)}/stages/{uuid.uuid4().hex}"


@register("i13_load_selection",
          "SELECT fold, target, feature, n, score, kept, rank FROM (" + _spearman_sql() + ") s WHERE target = 'quality'")
def q_i13(spark, sf_dir):
    """A2 + I13: the selection table is written partitioned by target, then read back for one
    target -- the partition filter prunes the other folders."""
    path = _stage_root(spark) + "/selection_corr"
    write_stage(q_i2(spark, sf_dir), path, partition_by=["target"])
    back = read_stage(spark, path).where(F.col("target") == "quality")
    return back.select("fold", "target", "feature", "n", "score", "kept", "rank")


@register("i14_j13_selected_features_with_target",
          f"WITH s AS ({_spearman_sql()}), d AS ({_doc_sql()}), "
          f"l AS (SELECT entity, quality, unnest([{', '.join(repr(f) for f in fx.DOC_FEATURES)}]) AS feature, "
          f"unnest([{', '.join(fx.DOC_FEATURES)}]) AS value FROM d) "
          "SELECT entity, feature, " + sql_round6("value") + " AS value, quality AS y FROM l "
          "WHERE feature IN (SELECT feature FROM s WHERE fold = 0 AND target = 'quality' AND kept)")
def q_i14(spark, sf_dir):
    """I14 + J13: the features table projected to the selection of (fold 0, quality),
    joined with that target column on the key."""
    d = doc_frame(spark, sf_dir)
    proj = sel.project_to_selection(d, q_i2(spark, sf_dir), "entity", 0, "quality")
    feats = [c for c in proj.columns if c != "entity"]
    out = to_long(proj, ["entity"], feats).join(d.select("entity", F.col("quality").alias("y")), "entity")
    return out.select("entity", "feature", round6(F.col("value")).alias("value"), "y")


@register("j12_selection_catalogue",
          f"WITH e AS ({_exp_sql()}), g AS (SELECT m.method, f.fold, t.target FROM "
          "(VALUES " + ", ".join(f"('{m}')" for m, _ in _METHODS + [("treatment_effect", None)]) + ") m(method), "
          f"(SELECT unnest(range({K_FOLDS})) AS fold) f, (VALUES ('quality'), ('toxic')) t(target)) "
          "SELECT g.method, g.fold, g.target, count(e.feature) FILTER (WHERE e.kept) AS n_selected FROM g LEFT JOIN e "
          "ON g.method = e.method AND g.fold = e.fold AND g.target = e.target GROUP BY ALL")
def q_j12(spark, sf_dir):
    """The (method x fold x target) grid left-joined with the selection table; a method
    without stored results shows 0 selected (absent -> empty)."""
    methods = [m for m, _ in _METHODS] + ["treatment_effect"]
    grid = spark.createDataFrame([(m, f, t) for m in methods for f in range(K_FOLDS) for t in DOC_TARGETS],
                                 "method string, fold int, target string")
    e = experiment_frame(spark, sf_dir)
    j = grid.join(e, ["method", "fold", "target"], "left")
    return j.groupBy("method", "fold", "target").agg(F.count(F.when(F.col("kept"), 1)).alias("n_selected"))


@register("h2_shuffle_split",
          "SELECT u < 0.3 AS is_test, count(*) AS n FROM (SELECT " + _sql_u(["'42'", "'0'", "CAST(entity AS VARCHAR)"])
          + " AS u FROM (" + S.doc_features() + ") d) x GROUP BY ALL")
def q_h2(spark, sf_dir):
    df = sp.shuffle_split(fx.doc_features(spark, sf_dir).select("entity"), "entity", 0.3, SEED)
    return df.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"))


@register("h2_shuffle_split_exact", None)
def q_h2x(spark, sf_dir):
    df = sp.shuffle_split(fx.doc_features(spark, sf_dir).select("entity"), "entity", 0.3, SEED, exact=True)
    return df.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"))


@register("f8_scale_targets",
          f"WITH t AS ({_abs_sql()}) SELECT entity, " + ", ".join(
              f"{sql_round6(f'({v} - avg({v}) OVER ()) / CASE WHEN stddev_pop({v}) OVER () = 0 THEN 1.0 ELSE stddev_pop({v}) OVER () END')} AS {v}"
              for v in VARIANTS) + " FROM t")
def q_f8(spark, sf_dir):
    """F8: the target matrix through the same scaler (off in the default chain)."""
    return r6(sc.standard_scale(q_e2(spark, sf_dir), ["entity"]))


@register("l1_linear_attribution",
          f"WITH s AS ({_pearson_sql()}), d AS ({_doc_sql()}), "
          f"l AS (SELECT entity, fold, unnest([{', '.join(repr(f) for f in fx.DOC_FEATURES)}]) AS feature, "
          f"unnest([{', '.join(fx.DOC_FEATURES)}]) AS value FROM d WHERE fold <> 0), "
          "m AS (SELECT feature, avg(value) AS mu FROM l GROUP BY feature), "
          "w AS (SELECT feature, score AS w FROM s WHERE fold = 0 AND target = 'quality') "
          "SELECT l.feature, " + sql_round6("avg(abs(w.w * (l.value - m.mu)))") + " AS attribution "
          "FROM l JOIN m ON l.feature = m.feature JOIN w ON l.feature = w.feature GROUP BY l.feature")
def q_l1(spark, sf_dir):
    """L1: exact mean abs attribution of a linear scorer (weights = the fold-0 pearson
    coefficients for quality) over that fold's training rows."""
    d = doc_frame(spark, sf_dir).where(F.col("fold") != 0)
    wts = {r["feature"]: r["score"] for r in q_i2p(spark, sf_dir)
           .where((F.col("fold") == 0) & (F.col("target") == "quality")).collect()}
    out = rp.linear_attribution(d, {f: wts[f] for f in fx.DOC_FEATURES})
    return out.select("feature", round6(F.col("attribution")).alias("attribution"))


@register("l3_experiment_frame", f"SELECT * FROM ({_exp_sql()}) e")
def q_l3(spark, sf_dir):
    return experiment_frame(spark, sf_dir)


@register("j6_grid_search", None)
def q_j6(spark, sf_dir):
    """ParamGridBuilder + CrossValidator on the training rows of fold 0 only."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    df = planted_frame(spark, sf_dir).where(F.col("fold") != 0)
    data = ln.assemble(df, PLANTED_FEATS, ["y"]).withColumnRenamed("y", "label")
    lr = ln.make_model("logreg", 1, len(PLANTED_FEATS))
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.001, 0.01, 0.1]).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(),
                        numFolds=3, seed=SEED, parallelism=2)
    model = cv.fit(data)
    return spark.createDataFrame([(float(g[lr.regParam]), float(m)) for g, m in zip(grid, model.avgMetrics)],
                                 "reg_param double, auc double")


@register("k4_projection_per_selection", None)
def q_k4(spark, sf_dir):
    """K4: the first 10 selected columns of a selection, projected with the target, coloured by
    the target class."""
    d = doc_frame(spark, sf_dir)
    s = q_i2(spark, sf_dir)
    names = [f for f in sel.selected_features(s, 0, "quality")][:10] or fx.DOC_FEATURES
    a, _b, _err = pj.fit_projection(d, names, ["quality"])
    return pj.project(d, "entity", names, a).join(d.select("entity", F.col("quality").alias("cls")), "entity")


@register("j8_meta_model_run", None)
def q_j8(spark, sf_dir):
    df = planted_frame(spark, sf_dir)
    return ln.meta_model_run(df, PLANTED_FEATS, ["y"], K_FOLDS, "logreg", {"C": (0.01, 1.0)}, n_trials=2)


@register("k2_reconstruction_r2", None)
def q_k2r(spark, sf_dir):
    df = planted_frame(spark, sf_dir)
    a, b, _err = pj.fit_projection(df, PLANTED_FEATS, ["y"])
    r2 = pj.reconstruction_r2(df, PLANTED_FEATS, ["y"], a, b)
    return spark.createDataFrame([(c, v) for c, v in r2.items()], "column string, r2 double")


# --------------------------------------------- I12 x H3: grid over slices ---
_SLICE_SIZES = [2, 4]
_SLICE_ITERS = 3


def _slices_sql() -> str:
    names = ", ".join(f"'{f}'" for f in fx.DOC_FEATURES)
    sizes = ", ".join(f"({s})" for s in _SLICE_SIZES)
    u = ("(CAST('0x' || substr(md5(concat_ws(':', '42', CAST(s.size AS VARCHAR), CAST(i.iter AS VARCHAR), "
         "f.feature)), 1, 13) AS BIGINT) / 4503599627370496.0)")
    return (f"sl AS (SELECT CAST(size AS VARCHAR) AS slice, iter, feature FROM (SELECT s.size, i.iter, f.feature, "
            f"row_number() OVER (PARTITION BY s.size, i.iter ORDER BY {u}, f.feature) AS rn "
            f"FROM (VALUES {sizes}) s(size), (SELECT unnest(range({_SLICE_ITERS})) AS iter) i, "
            f"(SELECT unnest([{names}]) AS feature) f) x WHERE rn <= size)")


@register("h3_slices_values",
          "WITH " + _slices_sql() + " SELECT slice, iter, feature FROM sl")
def q_h3v(spark, sf_dir):
    feats = [c for c in fx.doc_features(spark, sf_dir).columns if c in fx.DOC_FEATURES]
    return sp.slice_features(spark, feats, _SLICE_SIZES, n_iter=_SLICE_ITERS)


def _fvalue_grid_sql() -> str:
    nu = "(n - 2)"
    t = _t_crit_sql(nu)
    return ("WITH " + _class_long_sql() + ", " + _slices_sql() + ", "
            "pc AS (SELECT fold, target, feature, cls, count(*) AS cnt, sum(value) AS s1, sum(value * value) AS s2 "
            "FROM cl GROUP BY ALL), "
            "st0 AS (SELECT fold, target, feature, sum(cnt) AS n, count(*) AS ncls, sum(s1) AS t1, sum(s2) AS t2, "
            "sum(s1 * s1 / cnt) AS b FROM pc GROUP BY ALL), "
            "st AS (SELECT fold, target, feature, n, ncls, ((b - t1 * t1 / n) / (ncls - 1)) / "
            "(((t2 - t1 * t1 / n) - (b - t1 * t1 / n)) / (n - ncls)) AS score FROM st0), "
            f"po AS (SELECT *, coalesce(ncls = 2 AND score >= pow({t}, 2), false) AS p_ok FROM st), "
            "g AS (SELECT sl.slice, sl.iter, po.*, quantile_cont(score, 0.5) OVER (PARTITION BY sl.slice, sl.iter, fold, target) "
            "AS thr FROM po JOIN sl ON po.feature = sl.feature), "
            "k AS (SELECT slice, iter, fold, target, feature, score, coalesce(p_ok AND score >= thr, false) AS kept FROM g) "
            "SELECT slice, iter, fold, target, feature, " + sql_round6("score") + " AS score, kept, "
            "CASE WHEN kept THEN CAST(row_number() OVER (PARTITION BY slice, iter, fold, target, kept "
            "ORDER BY abs(score) DESC NULLS LAST, feature) AS INTEGER) END AS rank FROM k")


@register("i12_selection_grid_slices", _fvalue_grid_sql())
def q_i12g(spark, sf_dir):
    """F-value selection for every (slice, iter, fold, target): scores once, median rule per cell."""
    d = doc_frame(spark, sf_dir)
    res = sel.f_value_selector(d, "entity", fx.DOC_FEATURES, DOC_TARGETS, K_FOLDS)
    slices = F.broadcast(q_h3v(spark, sf_dir))   # names only: sizes x iterations x F rows
    out = sel.selection_over_slices(res, slices, relative=("median", 0.5), absolute_kept="p_ok")
    return out.select("slice", "iter", "fold", "target", "feature", round6(F.col("score")).alias("score"),
                      "kept", "rank")


_PCTS = [0.1, 0.5, 1.0]


@register("h4_uninformative_samples_values",
          "WITH f AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in fx.DOC_FEATURES + [f"noise___normal_{i}" for i in range(3)])
          + "]) AS feature), g AS (SELECT p.pct, i.iter, f.feature, contains(f.feature, '___') AS crafted FROM f, "
          "(SELECT unnest([" + ", ".join(repr(p) for p in _PCTS) + "]) AS pct) p, (SELECT unnest(range(2)) AS iter) i), "
          "r AS (SELECT *, row_number() OVER (PARTITION BY pct, iter, crafted ORDER BY "
          "(CAST('0x' || substr(md5(concat_ws(':', '42', CAST(pct AS VARCHAR), CAST(iter AS VARCHAR), feature)), 1, 13) "
          "AS BIGINT) / 4503599627370496.0), feature) AS rn FROM g) "
          "SELECT CAST(pct AS VARCHAR) AS slice, iter, feature FROM r WHERE NOT crafted OR rn <= CAST(floor(pct * 3) AS INTEGER)")
def q_h4v(spark, sf_dir):
    d = fx.doc_features(spark, sf_dir).select("entity", *fx.DOC_FEATURES)
    crafted = cr.add_noise(d, "entity", 3, "normal", SEED)
    feats = [c for c in crafted.columns if c != "entity"]
    return sp.sample_uninformative(spark, feats, _PCTS, n_iter=2, seed=SEED)


# ---------------------------------------------------------- B5 preparation --
_EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]   # fixed category list of the events table


@register("b5_one_hot_counts",
          "SELECT entity, " + ", ".join(f"CAST(count(*) FILTER (WHERE category = '{c}') AS DOUBLE) AS \"category={c}\""
                                        for c in _EVENT_TYPES) + f" FROM ({_events_sql()}) e GROUP BY entity")
def q_b5o(spark, sf_dir):
    return pf.one_hot_counts(_events(spark, sf_dir), "entity", "category", _EVENT_TYPES)


def _rescale_sql(method: str) -> str:
    if method == "standard":
        a, b = "avg(value)", "stddev_pop(value)"
    elif method == "minmax":
        a, b = "min(value)", "max(value) - min(value)"
    else:
        a, b = sql_percentile("value", 0.5), f"({sql_percentile('value', 0.75)}) - ({sql_percentile('value', 0.25)})"
    return (f"WITH e AS ({_events_sql()}), st AS (SELECT entity, {a} AS a, {b} AS b FROM e GROUP BY entity) "
            "SELECT e.entity, e.category, " + sql_round6("(e.value - st.a) / CASE WHEN st.b = 0 THEN 1.0 ELSE st.b END")
            + " AS value FROM e JOIN st ON e.entity = st.entity")


for _method in ("standard", "minmax", "robust"):
    def _mk(method):
        def run(spark, sf_dir):
            ev = _events(spark, sf_dir).select("entity", "category", "value")
            out = pf.rescale_per_entity(ev, "entity", ["value"], method)
            return out.select("entity", "category", round6(F.col("value")).alias("value"))
        return run
    QUERIES[f"b5_rescale_{_method}"] = (_mk(_method), _rescale_sql(_method))


@register("e2_abs_perf_classes_kmeans", None)
def q_e2k(spark, sf_dir):
    """E2 with strategy="kmeans" (opt-in): 3 classes per variant from 1-D Lloyd centres."""
    return tg.abs_perf_classes(cut_lineage(_pivot(spark, sf_dir)), n_bins=3, strategy="kmeans")


@register("f9_pearson_matrix",
          f"WITH {_clean_ctes()}, cp AS (SELECT a.feature AS a, b.feature AS b, corr(a.value, b.value) AS r "
          "FROM d9 a JOIN d9 b ON a.entity = b.entity AND a.feature < b.feature GROUP BY a.feature, b.feature) "
          "SELECT a, b, " + sql_round6("r") + " AS r FROM cp")
def q_f9p(spark, sf_dir):
    df = cleaned(spark, sf_dir)
    feats = [c for c in df.columns if c != "entity"]
    out = co.correlation_pairs(spark, df, feats, "pearson")
    return out.select("a", "b", round6(F.col("r")).alias("r"))


def _exact_folds_sql() -> str:
    u = _sql_u(["'42'", "CAST(entity AS VARCHAR)"])
    return (f"WITH d AS ({S.doc_features()}), n AS (SELECT count(*) AS n FROM d), "
            f"p AS (SELECT entity, row_number() OVER (ORDER BY {u}, entity) - 1 AS p FROM d), "
            f"c AS (SELECT n // {K_FOLDS} AS base, n % {K_FOLDS} AS extra FROM n) "
            "SELECT entity, CAST(CASE WHEN p < extra * (base + 1) THEN p // (base + 1) "
            "ELSE extra + (p - extra * (base + 1)) // greatest(base, 1) END AS INTEGER) AS fold FROM p, c")


@register("h1_kfold_exact_assignment", _exact_folds_sql())
def q_h1xa(spark, sf_dir):
    """H1 exact mode: first n mod k folds get one more row; positions in keyed-random order."""
    df = sp.assign_folds(fx.doc_features(spark, sf_dir).select("entity"), "entity", K_FOLDS, SEED, exact=True)
    return df.select("entity", "fold")


@register("h2_shuffle_split_exact_assignment",
          f"WITH d AS ({S.doc_features()}), p AS (SELECT entity, row_number() OVER (ORDER BY "
          + _sql_u(["'42'", "'0'", "CAST(entity AS VARCHAR)"]) + ", entity) AS p FROM d) "
          "SELECT entity, p <= CAST(ceil(0.3 * (SELECT count(*) FROM d)) AS BIGINT) AS is_test FROM p")
def q_h2xa(spark, sf_dir):
    df = sp.shuffle_split(fx.doc_features(spark, sf_dir).select("entity"), "entity", 0.3, SEED, exact=True)
    return df.select("entity", "is_test")


# queries of the learning stage, in a module of their own
from featurelab.plans import catalog_learning  # noqa: E402, F401
