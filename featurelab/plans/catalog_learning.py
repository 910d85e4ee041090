"""Queries of the learning stage: J5, J6, J9 with several classes, J11, L1, L3, F9 by concordance, A3, A4."""

from __future__ import annotations

from pyspark.sql import functions as F

from featurelab.functions.keyed import sql_keyed_bucket, sql_keyed_uniform
from featurelab.functions.wide import round6, sql_round6
from featurelab.operators import collinear as co
from featurelab.operators import crafting as cr
from featurelab.operators import experiment as ex
from featurelab.operators import importance as im
from featurelab.operators import ledger
from featurelab.operators import learning as ln
from featurelab.operators import reporting as rp
from featurelab.operators import sampling as sp
from featurelab.operators import selectors as sel
from featurelab.operators.neighbours import MAX_TRAIN_ROWS, fit_neighbours
from featurelab.plans import catalog as C
from featurelab.plans import fixtures as fx
from featurelab.plans import sql as S
from featurelab.sources.store import memoised_stage, read_stage, write_stage

WIDE = fx.WIDE_FEATURES


def _planted_sql() -> str:
    cols = ", ".join(WIDE)
    return (f"SELECT entity, {sql_keyed_bucket(C.SEED, C.K_FOLDS, 'entity')} AS fold, [{cols}] AS x, "
            f"CASE WHEN e00 + e01 > 0 THEN 1.0 ELSE 0.0 END AS y FROM ({S.wide_matrix()}) w")


# ------------------------------------------------------------------- J5 -----

_KNN_SQL = (
    f"WITH d AS ({_planted_sql()}), u AS (SELECT *, {sql_keyed_uniform(C.SEED, chr(39) + 'knn' + chr(39), 'entity')} AS u FROM d), "
    # the bound on training rows, per test fold
    f"tr AS (SELECT f.fold AS test_fold, u.* FROM u JOIN (SELECT unnest(range({C.K_FOLDS})) AS fold) f ON u.fold <> f.fold "
    f"QUALIFY row_number() OVER (PARTITION BY f.fold ORDER BY u.u, u.entity) <= {MAX_TRAIN_ROWS}), "
    "nn AS (SELECT t.entity, t.fold, t.y, tr.y AS label, list_sum(list_transform(list_zip(t.x, tr.x), lambda p: abs(p[1] - p[2]))) AS dist, "
    "tr.entity AS other FROM d t JOIN tr ON t.fold = tr.test_fold "
    "QUALIFY row_number() OVER (PARTITION BY t.entity ORDER BY dist, tr.entity) <= 6) "
    "SELECT entity, fold, y, CASE WHEN sum(label) > 3 THEN 1.0 ELSE 0.0 END AS pred, "
    + sql_round6("sum(label) / 6.0") + " AS p, sum(CAST(other AS BIGINT))::BIGINT AS neighbour_sum FROM nn GROUP BY entity, fold, y")


@C.register("j5_nearest_neighbours", _KNN_SQL)
def q_j5(spark, sf_dir):
    """Every row classified by its 6 nearest training rows (absolute differences over all 64 columns)."""
    df = C.planted_frame(spark, sf_dir)
    out = None
    for fold in range(C.K_FOLDS):
        model = fit_neighbours(df.where(F.col("fold") != fold), "entity", WIDE, "y", max_train_rows=MAX_TRAIN_ROWS, seed=C.SEED)
        test = model.predict(df.where(F.col("fold") == fold), ["entity", "fold", "y"])
        keys = F.array(*[F.lit(int(k)) for k in model.keys])
        at = F.transform("neighbours", lambda i: F.get(keys, i.cast("int")).cast("long"))
        part = test.select("entity", "fold", "y", F.col("prediction").alias("pred"), round6(F.get("probability", F.lit(1))).alias("p"),
                           F.aggregate(at, F.lit(0).cast("long"), lambda a, b: a + b).alias("neighbour_sum"))
        out = part if out is None else out.unionByName(part)
    return out


@C.register("j5_nearest_neighbours_cv", None)
def q_j5cv(spark, sf_dir):
    """J5 as a meta-model: cross-validated scores, as J2 to J4."""
    scores = ln.cross_validate(C.planted_frame(spark, sf_dir), lambda f, t: WIDE, ["y"], C.K_FOLDS, "knn")
    return C.r6(rp.fold_summary(scores, ["target"], ["b_acc", "f1", "roc"]), keys=("target",))


# ------------------------------------------------- J9 with three classes ----

_OVO = [0.0, 1.0, 2.0]


@C.register("j9_auc_one_against_one",
            f"WITH w AS ({S.wide_matrix()}), d AS (SELECT {sql_keyed_bucket(C.SEED, C.K_FOLDS, 'entity')} AS fold, CAST(label % 3 AS DOUBLE) AS y, "
            "[round(e00, 2), round(e01, 2), round(e02, 2)] AS s FROM w), "
            "dir AS (SELECT a.fold, a.y AS ya, b.y AS yb, avg(CASE WHEN a.s[CAST(a.y AS INTEGER) + 1] > b.s[CAST(a.y AS INTEGER) + 1] THEN 1.0 "
            "WHEN a.s[CAST(a.y AS INTEGER) + 1] = b.s[CAST(a.y AS INTEGER) + 1] THEN 0.5 ELSE 0.0 END) AS auc "
            "FROM d a JOIN d b ON a.fold = b.fold AND a.y <> b.y GROUP BY ALL), "
            "n AS (SELECT fold, y, count(*) AS n FROM d GROUP BY ALL) "
            "SELECT dir.fold, " + sql_round6("sum(auc * (x.n + z.n)) / sum(x.n + z.n)") + " AS roc FROM dir "
            "JOIN n x ON dir.fold = x.fold AND dir.ya = x.y JOIN n z ON dir.fold = z.fold AND dir.yb = z.y GROUP BY dir.fold")
def q_j9o(spark, sf_dir):
    """AUC one against one of three classes, scores with ties, against the count of all pairs."""
    df = C.sp.assign_folds(fx.wide_matrix(spark, sf_dir), "entity", C.K_FOLDS, C.SEED)
    pred = df.select("fold", (F.col("label") % 3).cast("double").alias("y"), F.array(*[F.round(f"e0{i}", 2) for i in range(3)]).alias("probs"))
    return rp.roc_auc_ovo(pred, ["fold"], _OVO).select("fold", round6(F.col("roc")).alias("roc"))


# ------------------------------------------------------------------ J11 -----

_CUTS = [0.005, 0.01, 0.02]


def _ledger_sql() -> str:
    return (f"WITH d AS ({C._doc_sql()}), pt AS (SELECT c.cut, t.target, fold, CASE WHEN t.target = 'quality' THEN quality ELSE toxic END AS y, "
            "CASE WHEN t.target = 'quality' THEN f_dot ELSE f_upper END AS p FROM d, (VALUES ('quality'), ('toxic')) t(target), "
            f"(VALUES {', '.join(f'(CAST({c} AS DOUBLE))' for c in _CUTS)}) c(cut)), "
            "pr AS (SELECT *, CASE WHEN p >= cut THEN 1.0 ELSE 0.0 END AS pred FROM pt), "
            "rec AS (SELECT cut, target, fold, y, avg(CASE WHEN pred = y THEN 1.0 ELSE 0.0 END) AS rec FROM pr GROUP BY ALL) "
            "SELECT cut, target, fold, " + sql_round6("avg(rec)") + " AS b_acc FROM rec GROUP BY cut, target, fold")


class _Stopped(RuntimeError):
    pass


@C.register("j11_grid_ledger", _ledger_sql())
def q_j11l(spark, sf_dir):
    """A grid of (rule, target) cells, stopped half way and started again.  Cells that were
    finished are not run a second time, and each cell's rows are there once."""
    path = C._stage_root(spark) + "/ledger"
    d = C.doc_frame(spark, sf_dir)
    cells = ledger.grid(spark, {"cut": _CUTS, "target": C.DOC_TARGETS})
    runs: list[dict] = []

    def run_cell(cell: dict, stop_after: int | None = None):
        if stop_after is not None and len(runs) >= stop_after:
            raise _Stopped
        runs.append(cell)
        p = F.col("f_dot") if cell["target"] == "quality" else F.col("f_upper")
        pred = d.select("fold", F.col(cell["target"]).alias("y"), F.when(p >= cell["cut"], 1.0).otherwise(0.0).alias("pred"))
        return rp.balanced_accuracy(pred, ["fold"])
    try:
        ledger.run_grid(spark, path, cells, lambda c: run_cell(c, 3), threads=1)
    except _Stopped:
        pass
    out = ledger.run_grid(spark, path, cells, run_cell)
    if len(runs) != len(_CUTS) * len(C.DOC_TARGETS):
        raise AssertionError(f"{len(runs)} cells were run")
    return out.select("cut", "target", "fold", round6(F.col("b_acc")).alias("b_acc"))


def meta_grid(spark, path: str, frames: dict, selections, axes: dict[str, list], k: int, seed: int = 42):
    """J11 with J12: fold scores of every cell of feature set x selector x target x model x slice size.

    ``frames`` maps a feature set to its table (entity, fold, features, targets);
    ``selections`` holds (selector, fold, target, feature, rank, kept).  A cell learns from the
    ``samples`` first features that its selector kept in each training fold (all if None)."""
    names = {(r[0], r[1], r[2]): r[3] for r in selections.where("kept").groupBy("selector", "fold", "target").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda s: s["feature"]).alias("f")).collect()}
    frames = {name: C.cut_lineage(df) for name, df in frames.items()}

    def run_cell(cell: dict):
        def feats(fold, target):
            return names.get((cell["selector"], fold, target), [])[:cell["samples"]]
        return ln.cross_validate(frames[cell["features"]], feats, [cell["target"]], k, cell["model"], seed).drop("target")
    return ledger.run_grid(spark, path, ledger.grid(spark, axes), run_cell)


@C.register("j11_grid_runner", None)
def q_j11(spark, sf_dir):
    """J11 with J9, J10 and J12: selectors x targets x meta-models x slice sizes on the document
    features, fold scores in a ledger, summarised per cell."""
    d = C.doc_frame(spark, sf_dir)
    kept = [sel.selection(sel.f_value_selector(d, "entity", fx.DOC_FEATURES, C.DOC_TARGETS, C.K_FOLDS)).withColumn("selector", F.lit("f_value")),
            sel.selection(sel.base_selector(d, "entity", fx.DOC_FEATURES, C.DOC_TARGETS, C.K_FOLDS)).withColumn("selector", F.lit("base"))]
    cols = ["selector", "fold", "target", "feature", "rank", "kept"]
    axes = {"features": ["raw"], "selector": ["f_value", "base"], "target": ["quality"], "model": ["logreg", "knn"], "samples": [3]}
    scores = meta_grid(spark, C._stage_root(spark) + "/results", {"raw": d}, kept[0].select(*cols).unionByName(kept[1].select(*cols)), axes, C.K_FOLDS)
    keys = ["features", "selector", "target", "model"]
    return C.r6(ledger.scores_summary(scores, [*keys, "samples"], ["b_acc", "f1", "roc"]), keys=tuple(keys))


# ------------------------------------------------------------------- L1 -----

#: A given linear rule: fixed weights, falling with the column's number.
_WEIGHTS = {f: 1.0 / (1 + i) for i, f in enumerate(WIDE)}
_REPEATS = 2


def _permutation_sql() -> str:
    w = "[" + ", ".join(repr(v) for v in _WEIGHTS.values()) + "]"
    names = ", ".join(f"'{f}'" for f in WIDE)

    def order(r: int, side: str) -> str:
        return f"row_number() OVER (ORDER BY {sql_keyed_uniform(C.SEED, repr(f'perm{r}{side}'), 'entity')}, entity)"
    parts = []
    for r in range(_REPEATS):
        parts.append(f"SELECT {r} AS r, a.y, a.x, b.x AS z, a.s FROM (SELECT *, {order(r, 'a')} AS pos FROM d) a "
                     f"JOIN (SELECT x, {order(r, 'b')} AS pos FROM d) b USING (pos)")
    return (f"WITH d AS (SELECT *, list_sum(list_transform(list_zip(x, {w}), lambda p: p[1] * p[2])) AS s FROM ({_planted_sql()}) q), "
            f"pr AS ({' UNION ALL '.join(parts)}), "
            f"each AS (SELECT r, y, s, unnest([{names}]) AS feature, unnest(list_transform(list_zip(x, z, {w}), lambda p: p[3] * (p[2] - p[1]))) AS delta FROM pr) "
            "SELECT feature, " + sql_round6("avg(CASE WHEN (s > 0) = (y = 1) THEN 1.0 ELSE 0.0 END) - "
                                            "avg(CASE WHEN (s + delta > 0) = (y = 1) THEN 1.0 ELSE 0.0 END)")
            + " AS importance FROM each GROUP BY feature")


@C.register("l1_permutation_importance", _permutation_sql())
def q_l1p(spark, sf_dir):
    """L1: loss of accuracy of a given linear rule when a column is permuted, mean of the repeats."""
    df = C.planted_frame(spark, sf_dir)
    out = im.summary(im.linear_permutation_importance(df, "entity", _WEIGHTS, 0.0, "y", _REPEATS, C.SEED))
    return out.select("feature", round6(F.col("importance")).alias("importance"))


# ------------------------------------------------------------------- J6 -----

@C.register("j6_grid_any_model", None)
def q_j6g(spark, sf_dir):
    """J6 on the neighbour model: every combination of two lists, scored by inner folds of the
    training rows of fold 0."""
    d = C.doc_frame(spark, sf_dir).where(F.col("fold") != 0)
    best, _score, table = ln.grid_search(d, fx.DOC_FEATURES, "toxic", "knn", {"n_neighbors": [3, 6], "p": [1, 2]}, score="b_acc")
    return C.r6(table.withColumn("best", F.col("params") == str(best)), keys=("params",))


# ------------------------------------------------------------------- L3 -----

def _only_fold(selector):
    return lambda df, feats, targets: selector(df, "entity", feats, targets, 1)


_L3_METHODS = {"f_value": _only_fold(sel.f_value_selector), "base": _only_fold(sel.base_selector)}
_L3_KEYS = ("frame", "method", "target", "model")


@C.register("l3_experiment_runs", None)
def q_l3r(spark, sf_dir):
    """L3: selectors x models x targets x repeated 70/30 splits of the documents."""
    d = fx.doc_features(spark, sf_dir).select("entity", *fx.DOC_FEATURES, *C.DOC_TARGETS)
    out = ex.run_experiment(spark, C._stage_root(spark) + "/experiment", {"raw": (d, fx.DOC_FEATURES)}, _L3_METHODS,
                            ["logreg", "knn"], C.DOC_TARGETS, repeats=2, seed=C.SEED)
    return C.r6(out.drop(ledger.CELL), keys=_L3_KEYS)


@C.register("l3_shift_runs", None)
def q_l3s(spark, sf_dir):
    """L3 with G5: the same grid over the documents with 100 added columns of each kind."""
    d = fx.doc_features(spark, sf_dir).select("entity", *fx.DOC_FEATURES, "toxic")
    frames, added = {}, [f"U {i}" for i in range(100)]
    for kind in ("random", "corrupted", "second_order"):
        more = cr.shift_variants(d.select("entity", *fx.DOC_FEATURES), "entity", kind, 100, C.SEED)
        frames[kind] = (more.join(d.select("entity", "toxic"), "entity"), [*fx.DOC_FEATURES, *added])
    out = ex.run_experiment(spark, C._stage_root(spark) + "/shift", frames, {"f_value": _L3_METHODS["f_value"]}, ["logreg"], ["toxic"],
                            repeats=1, seed=C.SEED)
    share = 100.0 * len(added) / F.col("n_features")
    return C.r6(out.drop(ledger.CELL).withColumn("added_share", share), keys=_L3_KEYS)


# --------------------------------------------------------------- A3, A4 -----

_STORED = ["f_log_chars", "f_digit", "f_dot"]


@C.register("a3_memoised_stage", f"SELECT entity, fold, {', '.join(f'{sql_round6(c)} AS {c}' for c in _STORED)} FROM ({C._doc_sql()}) d")
def q_a3(spark, sf_dir):
    """A3: a stage that exists is not computed again but read back; ``rewrite`` replaces it."""
    path, calls = C._stage_root(spark) + "/features", []

    def build(factor: float):
        def run():
            calls.append(factor)
            d = C.sp.assign_folds(fx.doc_features(spark, sf_dir), "entity", C.K_FOLDS, C.SEED)
            return d.select("entity", "fold", *[round6(F.col(c) * factor).alias(c) for c in _STORED])
        return run
    memoised_stage(spark, path, build(2.0))
    memoised_stage(spark, path, build(1.0), rewrite=True)
    out = memoised_stage(spark, path, build(3.0))
    if calls != [2.0, 1.0]:
        raise AssertionError(f"stages computed: {calls}")
    return out


@C.register("a4_stored_splits_and_slices",
            "WITH " + C._slices_sql() + f", d AS ({C._doc_sql()}), "
            f"l AS (SELECT entity, fold, unnest([{', '.join(repr(f) for f in fx.DOC_FEATURES)}]) AS feature, unnest([{', '.join(fx.DOC_FEATURES)}]) AS value FROM d), "
            "sp AS (SELECT unnest(range(" + str(C.K_FOLDS) + ")) AS split) "
            "SELECT slice, iter, CAST(split AS INTEGER) AS split, sl.feature, count(*) AS n, " + sql_round6("avg(value)") + " AS mean "
            "FROM sl JOIN l ON sl.feature = l.feature JOIN sp ON l.fold <> sp.split GROUP BY slice, iter, split, sl.feature")
def q_a4(spark, sf_dir):
    """A4: splits and slices are stored as tables, read back, and applied: mean of every column
    of every slice over the training rows of every split."""
    root = C._stage_root(spark)
    d = C.cut_lineage(fx.doc_features(spark, sf_dir).select("entity", *fx.DOC_FEATURES))
    write_stage(sp.assign_folds(d.select("entity"), "entity", C.K_FOLDS, C.SEED), root + "/splits", partition_by=["fold"])
    write_stage(sp.slice_features(spark, fx.DOC_FEATURES, C._SLICE_SIZES, n_iter=C._SLICE_ITERS), root + "/slices", partition_by=["slice", "iter"])
    splits = read_stage(spark, root + "/splits", schema="entity long, fold int")
    slices = read_stage(spark, root + "/slices", schema="feature string, slice string, iter int")
    # one row per fold and column: sums of a split's training rows are all sums without its own
    sums = d.join(splits, "entity").groupBy("fold").agg(*[F.struct(F.count(f).alias("n"), F.sum(f).alias("s")).alias(f) for f in fx.DOC_FEATURES])
    each = sums.select("fold", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), f"{f}.n", f"{f}.s") for f in fx.DOC_FEATURES])).alias("x"))
    of = each.select("fold", "x.feature", "x.n", "x.s").withColumn("split", F.explode(F.array(*[F.lit(i) for i in range(C.K_FOLDS)])))
    means = of.where("fold != split").groupBy("split", "feature").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("m"))
    return slices.join(means, "feature").select("slice", "iter", "split", "feature", "n", round6(F.col("m")).alias("mean"))


# ------------------------------------------------------------------- F9 -----

@C.register("f9_kendall_matrix",
            f"WITH d AS ({C._doc_sql()}), l AS (SELECT entity, unnest([{', '.join(repr(f) for f in fx.DOC_FEATURES)}]) AS feature, "
            f"unnest([{', '.join(fx.DOC_FEATURES)}]) AS v FROM d), "
            "p AS (SELECT x.entity, x.feature AS a, y.feature AS b, x.v AS u, y.v AS v FROM l x JOIN l y ON x.entity = y.entity AND x.feature < y.feature), "
            "c AS (SELECT i.a, i.b, sum(sign(i.u - j.u) * sign(i.v - j.v)) AS s, sum(abs(sign(i.u - j.u))) AS nu, sum(abs(sign(i.v - j.v))) AS nv "
            "FROM p i JOIN p j ON i.a = j.a AND i.b = j.b AND i.entity < j.entity GROUP BY ALL) "
            "SELECT a, b, " + sql_round6("s / sqrt(CAST(nu AS DOUBLE) * CAST(nv AS DOUBLE))") + " AS r FROM c")
def q_f9k(spark, sf_dir):
    """Kendall's tau-b of the document features, against the count of all pairs of rows."""
    out = co.correlation_pairs(spark, C.doc_frame(spark, sf_dir), fx.DOC_FEATURES, "kendall")
    return out.select("a", "b", round6(F.col("r")).alias("r"))
