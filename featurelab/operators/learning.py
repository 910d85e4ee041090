"""Model-based selectors and fold-wise cross-validation on Spark ML.

Data stay on the executors: per (fold, target) one assembled training frame is
fitted once and scored on its test fold; all scores come from the prediction
table by the aggregates of ``reporting`` (no per-score refit).  Independent
fits are issued from a bounded driver thread pool (``FIT_THREADS``), so the
cluster runs the jobs of several small fits at once.
"""


from __future__ import annotations

import itertools
import random
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelab.functions.wide import q
from featurelab.operators import reporting as rp
from featurelab.operators.neighbours import fit_neighbours
from featurelab.session import cut_lineage

FIT_THREADS = 4


def _in_pool(fn, items):
    items = list(items)
    if len(items) <= 1:
        return [fn(x) for x in items]
    with ThreadPoolExecutor(max_workers=min(FIT_THREADS, len(items))) as pool:
        return list(pool.map(fn, items))


def assemble(df: DataFrame, feats: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and the vector ``features``.  A null feature fails the fit: rows are never left
    out silently, impute first."""
    tmp = [f"_c{i}" for i in range(len(feats))]
    base = df.select(*[q(k) for k in keep], *[q(c).cast("double").alias(t) for c, t in zip(feats, tmp)])
    return VectorAssembler(inputCols=tmp, outputCol="features", handleInvalid="error").transform(base) \
        .select(*keep, "features")


def make_model(name: str, n_rows: int, n_features: int, n_classes: int = 2, seed: int = 42, params=None):
    """J2-J4 (+ I6/I7 settings) with the reference's hyper-parameters."""
    p = dict(params or {})
    if name == "logreg":          # J2: L2, C = 0.05
        c = p.pop("C", 0.05)
        return LogisticRegression(regParam=1.0 / (c * max(n_rows, 1)), elasticNetParam=0.0,
                                  standardization=False, maxIter=100, **p)
    if name == "l1_logreg":       # I7: L1, C = 0.15
        c = p.pop("C", 0.15)
        return LogisticRegression(regParam=1.0 / (c * max(n_rows, 1)), elasticNetParam=1.0,
                                  standardization=False, maxIter=100, **p)
    if name == "gbt":             # J3: 50 trees, depth 7, rate 0.1 (binary); forest when multiclass
        if n_classes > 2:
            return RandomForestClassifier(numTrees=p.pop("n_estimators", 50), maxDepth=p.pop("max_depth", 7), seed=seed)
        return GBTClassifier(maxIter=p.pop("n_estimators", 50), maxDepth=p.pop("max_depth", 7),
                             stepSize=p.pop("learning_rate", 0.1), seed=seed)
    if name == "gbt_small":       # I6: 5 trees, depth 3, rate 0.01
        if n_classes > 2:
            return RandomForestClassifier(numTrees=5, maxDepth=3, seed=seed)
        return GBTClassifier(maxIter=5, maxDepth=3, stepSize=0.01, seed=seed)
    if name == "mlp":             # J4: 25 hidden logistic units, L-BFGS, 100 iterations
        return MultilayerPerceptronClassifier(layers=[n_features, p.pop("hidden", 25), n_classes],
                                              solver="l-bfgs", maxIter=p.pop("max_iter", 100), seed=seed)
    raise ValueError(name)


def importances(model, name: str, n_features: int) -> list[float]:
    if name in ("logreg", "l1_logreg"):
        if model.numClasses > 2:     # a row of coefficients per class: sum of their sizes
            return [float(v) for v in abs(model.coefficientMatrix.toArray()).sum(axis=0)]
        return [float(v) for v in model.coefficients.toArray()]
    if name in ("gbt", "gbt_small"):
        return [float(v) for v in model.featureImportances.toArray()]
    if name == "mlp":  # sum of abs first-layer weights per input
        w = model.weights.toArray()
        h = model.getLayers()[1]
        first = w[: n_features * h].reshape(n_features, h)
        return [float(abs(r).sum()) for r in first]
    raise ValueError(name)


def model_selector(df: DataFrame, feats: list[str], targets: list[str], k: int, model: str = "gbt_small",
                   seed: int = 42) -> DataFrame:
    """I6 (tree importance) / I7 (L1 coefficients): keep features with abs(score) > 0."""
    spark = df.sparkSession
    rows = []
    for t in targets:
        data = assemble(df.where(q(t).isNotNull()), feats, ["fold", t]).withColumnRenamed(t, "label").cache()

        def fit_fold(fold, data=data, t=t):
            train = data.where(F.col("fold") != fold)
            n = train.count()
            ncls = train.select("label").distinct().count()
            if ncls < 2 or (model == "l1_logreg" and ncls > 2):
                return []
            m = make_model(model, n, len(feats), ncls, seed).fit(train)
            return [(fold, t, f, n, v, abs(v) > 0) for f, v in zip(feats, importances(m, model, len(feats)))]
        try:
            for part in _in_pool(fit_fold, range(k)):
                rows.extend(part)
        finally:
            data.unpersist()
    return spark.createDataFrame(rows, "fold int, target string, feature string, n long, score double, kept boolean")


def _eliminate(train: DataFrame, n_feats: int, model: str, step: float | int, seed: int) -> tuple[int, list[tuple[float | None, bool]]]:
    """Rows of ``train`` (label, features), and for each feature its importance in the last fit
    it took part in and whether it is among the half that stays."""
    arr = train.select("label", vector_to_array("features").alias("a")).cache()
    try:
        n, n_classes = arr.agg(F.count(F.lit(1)), F.countDistinct("label")).first()
        if n_classes < 2:
            return n, []
        alive, goal, score = list(range(n_feats)), max(1, n_feats // 2), [None] * n_feats
        while len(alive) > goal:
            cur = arr.select("label", array_to_vector(F.array(*[F.col("a")[i] for i in alive])).alias("features"))
            found = importances(make_model(model, n, len(alive), n_classes, seed).fit(cur), model, len(alive))
            score = [dict(zip(alive, found)).get(i, score[i]) for i in range(n_feats)]
            drop = step if isinstance(step, int) else max(1, int(len(alive) * step))
            weakest = sorted(alive, key=lambda i: (abs(score[i]), i))[:min(drop, len(alive) - goal)]
            alive = [i for i in alive if i not in weakest]
        return n, [(score[i], i in alive) for i in range(n_feats)]
    finally:
        arr.unpersist()


def recursive_elimination(df: DataFrame, feats: list[str], target: str, model: str = "logreg",
                          step: float | int = 1, seed: int = 42) -> list[str]:
    """I8 on all given rows: drop the weakest feature(s) per round down to half; the kept names."""
    data = assemble(df.where(q(target).isNotNull()), feats, [target]).withColumnRenamed(target, "label")
    _, found = _eliminate(data, len(feats), model, step, seed)
    return [f for f, (_, kept) in zip(feats, found) if kept]


def recursive_selector(df: DataFrame, feats: list[str], targets: list[str], k: int, model: str = "logreg",
                       step: float | int = 1, seed: int = 42) -> DataFrame:
    """I8 as a selector: (fold, target, feature, n, score, kept) from the training rows of every
    (fold, target).  ``step`` features (or that share of those left) go per round, the weakest
    first and the earlier column of equals, until half are left; score is the importance in
    the last round a feature took part in (null if there was no round).  A cell whose training
    rows hold one class only has no rows."""
    def fit(cell):
        fold, t = cell
        train = assemble(df.where(q(t).isNotNull() & (F.col("fold") != fold)), feats, [t]).withColumnRenamed(t, "label")
        n, found = _eliminate(train, len(feats), model, step, seed)
        return [(fold, t, f, n, score, kept) for f, (score, kept) in zip(feats, found)]
    parts = _in_pool(fit, [(fold, t) for t in targets for fold in range(k)])
    return df.sparkSession.createDataFrame([r for p in parts for r in p],
                                           "fold int, target string, feature string, n long, score double, kept boolean")


def target_classes(df: DataFrame, target: str) -> list[float]:
    """Values of a class target, ascending."""
    values = df.select(q(target).cast("double").alias("c")).where(F.col("c").isNotNull()).distinct()
    return [r[0] for r in values.orderBy("c").collect()]


def fit_cell(df: DataFrame, fold: int, target: str, feats: list[str], model: str, classes: list[float], seed: int = 42,
             params=None, cached: list | None = None):
    """Fit on the labelled rows outside ``fold`` and predict those inside: (predictions, fitted
    model), or None if the training rows hold one class only.

    Predictions hold entity, fold, target, y, pred and probs, the scores of ``classes``.  The
    training frame is added to ``cached``, if given; the caller releases it."""
    labelled = df.where(q(target).isNotNull())
    if model == "knn":
        p = dict(params or {})
        m = fit_neighbours(labelled.where(F.col("fold") != fold), "entity", feats, target, p.pop("n_neighbors", 6), p.pop("p", 1),
                           p.pop("max_train_rows", None), seed)
        if len(m.classes) < 2:
            return None
        out = m.predict(labelled.where(F.col("fold") == fold).withColumn("label", q(target).cast("double")), ["entity", "label"])
        known, probs = m.classes, F.col("probability")
    else:
        data = assemble(labelled, feats, ["entity", "fold", target]).withColumnRenamed(target, "label")
        train = data.where(F.col("fold") != fold)
        if cached is not None:
            cached.append(train.cache())         # iterative fits re-read it
        n, ncls = train.agg(F.count(F.lit(1)), F.countDistinct("label")).first()
        if ncls < 2:
            return None
        m = make_model(model, n, len(feats), ncls, seed, params).fit(train)
        out = m.transform(data.where(F.col("fold") == fold))
        # Spark ML numbers classes by their label 0, 1, ...
        known, probs = [float(i) for i in range(m.numClasses)], vector_to_array("probability")
    score = {c: F.get(probs, F.lit(i)) for i, c in enumerate(known)}
    return out.select(
        "entity", F.lit(fold).alias("fold"), F.lit(target).alias("target"), F.col("label").cast("double").alias("y"),
        F.col("prediction").alias("pred"), F.array(*[score.get(c, F.lit(0.0)) for c in classes]).alias("probs")), m


def cross_validate(df: DataFrame, feats_by_cell, targets: list[str], k: int, model: str,
                   seed: int = 42, params=None) -> DataFrame:
    """For every (fold, target) fit once on the other folds with that cell's columns,
    predict the fold, and score all metrics from one prediction table.

    ``feats_by_cell(fold, target) -> list[str]`` gives the selected columns; cells without
    columns, training rows or a second class are left out.  ``model`` is a name of
    ``make_model`` or "knn" (J5).
    """
    cells = [(fold, t, feats_by_cell(fold, t)) for t in targets for fold in range(k)]
    cells = [c for c in cells if c[2]]
    classes = {t: target_classes(df, t) for t in {c[1] for c in cells}}
    cached = []

    def run_cell(cell):
        fold, t, feats = cell
        return fit_cell(df, fold, t, feats, model, classes[t], seed, params, cached)

    try:
        parts: dict[str, DataFrame] = {}
        for (_, t, _), fitted in zip(cells, _in_pool(run_cell, cells)):
            if fitted is not None:
                out = fitted[0]
                parts[t] = out if t not in parts else parts[t].unionByName(out)
        tables = []
        for t, preds in parts.items():
            many = len(classes[t]) > 2
            # predicted once: the scores read them several times
            preds = cut_lineage(preds.withColumn("p", F.get("probs", F.lit(1))))
            tables.append(rp.score_table(preds, ["fold", "target"], classes[t] if many else None))
        if not tables:
            return df.sparkSession.createDataFrame([], "fold int, target string, b_acc double, f1 double, roc double")
        # stored before the training frames are released: one row per fold and target
        return cut_lineage(reduce(DataFrame.unionByName, tables))
    finally:
        for c in cached:
            c.unpersist()


def _trials(df: DataFrame, feats: list[str], target: str, model: str, trials: list[dict], k_inner: int, seed: int,
            score: str) -> list[float | None]:
    """Mean inner-CV ``score`` of every setting, on the given (training) rows only."""
    from featurelab.operators.sampling import assign_folds
    inner = cut_lineage(assign_folds(df.drop("fold"), "entity", k_inner, seed + 1))
    return [cross_validate(inner, lambda f, t: feats, [target], k_inner, model, seed, params).agg(F.avg(score)).first()[0]
            for params in trials]


def _best(trials: list[dict], scores: list[float | None]) -> tuple[dict, float]:
    """The first setting of the highest score."""
    found = [(s, -i) for i, s in enumerate(scores) if s is not None]
    if not found:
        return {}, float("-inf")
    s, i = max(found)
    return trials[-i], s


def random_search(df: DataFrame, feats: list[str], target: str, model: str, space: dict, n_trials: int,
                  k_inner: int = 3, seed: int = 42, score: str = "f1") -> tuple[dict, float]:
    """Seeded random search.  A rule is a range of integers or reals (low, high) or a list of
    categories, of which a trial draws one.  Returns the best setting and its score."""
    rnd, trials = random.Random(seed), []
    for _ in range(n_trials):
        params = {}
        for name, rule in space.items():
            if isinstance(rule, list):
                params[name] = rnd.choice(rule)
            elif isinstance(rule[0], int) and isinstance(rule[1], int):
                params[name] = rnd.randint(rule[0], rule[1])
            else:
                params[name] = rnd.uniform(rule[0], rule[1])
        trials.append(params)
    return _best(trials, _trials(df, feats, target, model, trials, k_inner, seed, score))


def grid_settings(lists: dict[str, list]) -> list[dict]:
    return [dict(zip(lists, values)) for values in itertools.product(*lists.values())]


def grid_search(df: DataFrame, feats: list[str], target: str, model: str, lists: dict[str, list],
                k_inner: int = 3, seed: int = 42, score: str = "f1") -> tuple[dict, float, DataFrame]:
    """J6 for any model of J2-J5: every combination of the parameter lists, each tried once.

    Returns the best setting (the first of equals), its score, and (params, score) of all."""
    trials = grid_settings(lists)
    scores = _trials(df, feats, target, model, trials, k_inner, seed, score)
    table = df.sparkSession.createDataFrame([(str(t), s) for t, s in zip(trials, scores)], "params string, score double")
    return *_best(trials, scores), table


def meta_model_run(df: DataFrame, feats: list[str], targets: list[str], k: int, model: str, space: dict,
                   n_trials: int = 3, seed: int = 42, search: str = "random") -> DataFrame:
    """For every target and outer fold, tune on that fold's training rows only (no leak) by
    ``search`` (random: J7, grid: J6, where ``space`` holds lists), refit with the best
    parameters, score the held-out fold; keep scores and parameters."""
    spark = df.sparkSession

    def run_cell(cell):
        t, fold = cell
        train = df.where(F.col("fold") != fold)
        if search == "grid":
            best, inner, _ = grid_search(train, feats, t, model, space, seed=seed)
        else:
            best, inner = random_search(train, feats, t, model, space, n_trials, seed=seed)
        sc = cross_validate(df, lambda f, tt: feats if f == fold else [], [t], k, model, seed, best)
        r = sc.where(F.col("fold") == fold).collect()
        if not r:
            return None
        return (t, fold, str(best), float(inner), r[0]["b_acc"], r[0]["f1"], r[0]["roc"])

    # outer cells are independent (tuning sees only the cell's training rows)
    rows = [r for r in _in_pool(run_cell, [(t, f) for t in targets for f in range(k)]) if r is not None]
    return spark.createDataFrame(rows, "target string, fold int, best_params string, inner_f1 double, "
                                       "b_acc double, f1 double, roc double")
