"""L3: selectors x models x targets x repeats on hold-out splits, the results in two ledgers.

Every (frame, method, repeat) cell first selects columns for all targets on the training
rows of that repeat's split (H5).  Every (frame, method, target, model, repeat) cell then fits
the selected columns on the training rows and is scored on the rows held out: the scores of
J9, the number of columns, and the share of the strongest columns in the importance of all
(L1, L2).  Both grids go on where a killed run stopped (J11).

A frame may hold added columns (G5); the same grid over several frames is the shift experiment.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelab.functions.wide import q
from featurelab.operators import importance as im
from featurelab.operators import ledger
from featurelab.operators import learning as ln
from featurelab.operators import reporting as rp
from featurelab.operators.sampling import shuffle_split
from featurelab.session import cut_lineage

#: Columns whose share in the importance of all is reported.
TOP = 5
#: Test fold of a split; its training rows have another.
TEST, TRAIN = 0, 1
Selector = Callable[[DataFrame, list[str], list[str]], DataFrame]
RUN_SCHEMA = "n_features int, n_selected int, importance_fraction double, b_acc double, f1 double, roc double"


def hold_out(df: DataFrame, key: str, repeat: int, test_size: float = 0.3, seed: int = 42) -> DataFrame:
    """``df`` with ``fold``: 0 in the rows held out in this repeat, 1 in its training rows.

    Selectors with one fold (k = 1) then learn from the training rows only."""
    split = shuffle_split(df, key, test_size, seed, repeat, out="_test")
    return split.withColumn("fold", F.when(F.col("_test"), TEST).otherwise(TRAIN)).drop("_test")


def _stored_splits(df: DataFrame, key: str, repeats: int, test_size: float, seed: int) -> list[DataFrame]:
    """``hold_out`` of every repeat.  The table is written once, with a column per repeat: no
    random number is drawn again by the many passes of the cells."""
    drawn = df
    for i in range(repeats):
        drawn = hold_out(drawn, key, i, test_size, seed).withColumnRenamed("fold", f"_fold{i}")
    stored = cut_lineage(drawn)
    return [stored.select(*[q(c) for c in df.columns if c != "fold"], F.col(f"_fold{i}").alias("fold")) for i in range(repeats)]


def _importance(fitted, model: str, test: DataFrame, feats: list[str], target: str, seed: int) -> DataFrame:
    """(feature, importance) on the rows held out: exact attributions of a two-class linear
    model, loss of accuracy by permutation of any other."""
    if model in ("logreg", "l1_logreg") and fitted.numClasses == 2:
        weights = dict(zip(feats, ln.importances(fitted, model, len(feats))))
        return rp.linear_attribution(test, weights).withColumnRenamed("attribution", "importance")

    def predict(frame: DataFrame) -> DataFrame:
        if model != "knn":
            return fitted.transform(frame)
        keep = [c for c in frame.columns if c != "features"]
        x = frame.select(*keep, vector_to_array("features").alias("_a"))
        # the pairs are dealt evenly already
        return fitted.predict(x.select(*keep, *[F.get("_a", F.lit(i)).alias(f) for i, f in enumerate(feats)]), keep, deal=False)

    def right(out: DataFrame):
        return F.avg(F.coalesce((F.col("prediction") == F.col("_y")).cast("double"), F.lit(0.0)))
    return im.summary(im.permutation_importance(test, "entity", feats, target, predict, right, 1, seed))


def run_experiment(spark: SparkSession, path: str, frames: dict[str, tuple[DataFrame, list[str]]], selectors: dict[str, Selector],
                   models: list[str], targets: list[str], repeats: int = 5, test_size: float = 0.3, seed: int = 42,
                   top: int = TOP) -> DataFrame:
    """One row per (frame, method, target, model, repeat): n_features, n_selected,
    importance_fraction of the ``top`` columns, b_acc, f1, roc.

    ``frames`` maps a name to (table with entity, columns and targets; names of the columns).
    A selector takes (table with fold, columns, targets) and returns the tidy selection
    (target, feature, score, kept) of fold 0.  ``models`` are names of ``learning`` or "knn".
    Cells whose selector kept nothing, or whose training rows hold one class only, are
    finished without a row.  importance_fraction is null if no column matters.  Only names of
    columns reach the driver."""
    frames = {name: (_stored_splits(df, "entity", repeats, test_size, seed), feats) for name, (df, feats) in frames.items()}
    classes = {t: ln.target_classes(next(iter(frames.values()))[0][0], t) for t in targets}
    axes = {"frame": list(frames), "method": list(selectors), "repeat": list(range(repeats))}

    def select(cell: dict) -> DataFrame:
        splits, feats = frames[cell["frame"]]
        found = selectors[cell["method"]](splits[cell["repeat"]], feats, targets)
        return found.where(F.col("fold") == TEST).select("target", "feature", "score", "kept")
    picks = ledger.run_grid(spark, f"{path}/selections", ledger.grid(spark, axes), select)
    kept = {(r[0], r[1], r[2], r[3]): set(r[4]) for r in picks.where("kept").groupBy(*axes, "target")
            .agg(F.collect_set("feature")).collect()}

    def run(cell: dict) -> DataFrame:
        splits, feats = frames[cell["frame"]]
        t, model = cell["target"], cell["model"]
        names = kept.get((cell["frame"], cell["method"], cell["repeat"], t), ())
        names = [f for f in feats if f in names]
        split, cached = splits[cell["repeat"]], []
        try:
            fitted = ln.fit_cell(split, TEST, t, names, model, classes[t], seed, None, cached) if names else None
            if fitted is None:
                return spark.createDataFrame([], RUN_SCHEMA)
            predicted = cut_lineage(fitted[0].withColumn("p", F.get("probs", F.lit(1))))
            scores = rp.score_table(predicted, ["fold"], classes[t] if len(classes[t]) > 2 else None)
            test = split.where((F.col("fold") == TEST) & F.col(t).isNotNull())
            weights = _importance(fitted[1], model, test, names, t, seed).withColumn("fold", F.lit(TEST))
            share = rp.importance_fraction(weights, ["fold"], top)
            return cut_lineage(scores.join(share, "fold", "left").select(
                F.lit(len(feats)).cast("int").alias("n_features"), F.lit(len(names)).cast("int").alias("n_selected"),
                F.col("fraction").cast("double").alias("importance_fraction"), "b_acc", "f1", "roc"))
        finally:
            for c in cached:
                c.unpersist()
    cells = ledger.grid(spark, {**axes, "target": targets, "model": models})
    return ledger.run_grid(spark, f"{path}/runs", cells, run)
