"""Training a pit classifier on governed metrics: split, scale, compare, tune, gate, predict."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order_statistics import with_rows_below
from ..functions.scalars import action_label
from ..operators import evaluation
from ..operators.metrics import with_all_metrics
from ..operators.target import with_target
from ..sources.commits import put_text, read_text
from ..staging import drop_since, stage, staged_so_far

FEATURES = (
    "gap_to_leader", "tyre_age", "pit_delta", "degradation_rate", "stint_age_squared",
    "race_progress", "pace_delta", "gap_closing_rate", "relative_pace_delta",
)
TRAIN_YEARS, TEST_YEARS = tuple(range(2018, 2024)), (2024,)
GRID = tuple(round(0.1 + 0.01 * i, 2) for i in range(80))


def training_frame(laps: DataFrame, label: str = "pit_next_5_laps") -> DataFrame:
    """Metrics and label on whole traces; filters come after, or windows would be cut."""
    frame = with_target(with_all_metrics(laps))
    others = [c for c in laps.columns if c not in FEATURES]  # a feed's own gap gives way to the metric
    return frame.select(*others, *[F.col(c).cast("double").alias(c) for c in FEATURES], F.col(label).cast("double").alias("y")).fillna(0.0, list(FEATURES))


def temporal_split(frame: DataFrame, train_years: Sequence[int] = TRAIN_YEARS, test_years: Sequence[int] = TEST_YEARS) -> tuple[DataFrame, DataFrame]:
    return frame.where(F.col("year").isin(list(train_years))), frame.where(F.col("year").isin(list(test_years)))


def fit_scaler(train: DataFrame, features: Sequence[str] = FEATURES) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature, from one aggregate; deviation 0 counts 1."""
    row = train.agg(*[F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in features]).first()
    return {c: (row[c][0] or 0.0, row[c][1] or 1.0) for c in features}


def base_rates(train: DataFrame, test: DataFrame) -> DataFrame:
    """(part, n, base_rate): how often the label is 1."""
    parts = train.select(F.lit("train").alias("part"), "y").union(test.select(F.lit("test"), "y"))
    return parts.groupBy("part").agg(F.count("*").alias("n"), F.avg("y").alias("base_rate"))


def scale(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scaler.items()})


def with_class_weight(train: DataFrame) -> DataFrame:
    """Rows of the positive class weigh n_negative / n_positive."""
    pos, neg = train.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    return train.withColumn("weight", F.when(F.col("y") == 1, neg / max(pos, 1)).otherwise(1.0))


def candidate_models(trees: int = 100, rounds: int = 200) -> dict[str, Pipeline]:
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    common = {"labelCol": "y", "weightCol": "weight"}
    models = {
        "logistic_regression": LogisticRegression(maxIter=1000, **common),
        "random_forest": RandomForestClassifier(numTrees=trees, maxDepth=10, seed=42, **common),
        "gradient_boosting": GBTClassifier(maxIter=rounds, maxDepth=6, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42, **common),
    }
    return {k: Pipeline(stages=[assemble, m]) for k, m in models.items()}


def split_on_years(
    laps: DataFrame, train_years: Sequence[int] = TRAIN_YEARS, test_years: Sequence[int] = TEST_YEARS
) -> tuple[dict[str, tuple[float, float]], DataFrame, DataFrame]:
    """(scaler, scaled train with class weights, scaled test). The frame with all its windows is computed once
    and staged: scaler, class weights and every later fit read it, and nothing is left cached."""
    frame = training_frame(laps).select("session_key", "driver_number", "lap_number", "year", *FEATURES, "y")
    train, test = temporal_split(stage(frame, "training"), train_years, test_years)
    scaler = fit_scaler(train)
    return scaler, with_class_weight(scale(train, scaler)), scale(test, scaler)


def fit(pipeline: Pipeline, train: DataFrame) -> PipelineModel:
    """The fitted pipeline without its training summaries. A summary holds the session, which goes to the tasks
    with the model, and can't once anything was observed in it."""
    model = pipeline.fit(train)
    for part in model.stages:
        if getattr(part, "hasSummary", False):
            part._java_obj.setSummary(train.sparkSession.sparkContext._jvm.scala.Option.empty())
    return model


def fit_on_years(laps: DataFrame, pipeline: Pipeline) -> tuple[PipelineModel, dict[str, tuple[float, float]], DataFrame, DataFrame]:
    """(model, scaler, scaled train, scaled test)."""
    scaler, train, test = split_on_years(laps)
    return fit(pipeline, train), scaler, train, test


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("p", vector_to_array("probability")[1])


def with_folds(df: DataFrame, k: int = 5, group: str | None = None) -> DataFrame:
    """Exact stratified folds: the rows of a label are shuffled by a hash and dealt in turn, so that its folds
    differ by a row at most. Places in the shuffle come from running totals over sorted ranges; no task sees all
    rows of a label. Or whole groups by hash."""
    if group is not None:
        return df.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(k)).cast("int"))
    keys = [c for c in ("session_key", "driver_number", "lap_number") if c in df.columns] or df.columns
    dealt = df.withColumns({"__h": F.xxhash64(F.lit(42), *keys), "__t": F.xxhash64(*df.columns), "__one": F.lit(1)})
    dealt = with_rows_below(dealt, ["__h", "__t"], ["y"], n="__one", name="__at")
    return dealt.withColumn("fold", (F.col("__at") % k).cast("int")).drop("__h", "__t", "__one", "__at")


def cross_validate(models: dict[str, Pipeline], train: DataFrame, k: int = 5, group: str | None = None) -> dict[str, float]:
    """Mean exact ROC-AUC over the folds."""
    folded = with_class_weight(with_folds(train, k, group)).persist()
    out = {}
    for name, pipeline in models.items():
        aucs = []
        for f in range(k):
            model = fit(pipeline, folded.where(F.col("fold") != f))
            value = evaluation.roc_auc(score(model, folded.where(F.col("fold") == f)).select("y", "p")).first()
            if value is not None and value[0] is not None:
                aucs.append(value[0])
        out[name] = sum(aucs) / len(aucs) if aucs else float("nan")
    folded.unpersist()
    return out


def tune_threshold(scored: DataFrame) -> tuple[float, float]:
    row = evaluation.best_threshold(evaluation.threshold_sweep(scored, GRID)).first()
    return row["threshold"], row["f1"]


def held_out_metrics(scored: DataFrame, threshold: float, train_size: int) -> dict:
    row = evaluation.threshold_sweep(scored, [threshold]).first()
    auc = evaluation.roc_auc(scored).first()
    return {
        "roc_auc": auc[0] if auc else None, "f1": row["f1"], "precision": row["precision"], "recall": row["recall"],
        "threshold": threshold, "train_size": train_size, "test_size": scored.count(),
    }


@dataclass(frozen=True)
class GateDecision:
    accepted: bool
    reason: str


def gate(scored: DataFrame, metrics: dict, features: Sequence[str] = FEATURES) -> GateDecision:
    """Refuses an artifact at the first failure: metrics out of range, features not finite,
    labels not 0 or 1, probabilities missing, not finite or outside [0, 1]."""
    for name in ("roc_auc", "f1", "precision", "recall", "threshold"):
        if not isinstance(metrics.get(name), int | float) or not 0 <= metrics[name] <= 1:
            return GateDecision(False, f"{name} is not in [0, 1]")
    for name in ("train_size", "test_size"):
        if not isinstance(metrics.get(name), int) or metrics[name] <= 0:
            return GateDecision(False, f"{name} is not positive")
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    bad_x = F.lit(False)
    for c in features:
        bad_x = bad_x | odd(c)
    row = scored.agg(
        F.count_if(bad_x), F.count_if(~F.coalesce(F.col("y").isin(0, 1), F.lit(False))), F.count_if(odd("p")), F.count_if((F.col("p") < 0) | (F.col("p") > 1))
    ).first()
    for n, what in zip(row, ("features that aren't finite", "labels other than 0 and 1", "probabilities missing or not finite", "probabilities outside [0, 1]"), strict=True):
        if n:
            return GateDecision(False, f"{n} rows with {what}")
    return GateDecision(True, "ok")


def train(
    laps: DataFrame,
    path: str,
    train_years: Sequence[int] = TRAIN_YEARS,
    test_years: Sequence[int] = TEST_YEARS,
    chosen: str = "gradient_boosting",
    models: dict[str, Pipeline] | None = None,
    folds: int = 5,
) -> dict:
    """Split, scale, cross-validate all models, fit the chosen one, tune its threshold, gate, save under path; the
    metrics that were saved. ValueError if a part has no rows or the gate refuses."""
    mark = staged_so_far()
    models = models or candidate_models()
    scaler, train_part, test = split_on_years(laps, train_years, test_years)
    size = train_part.count()
    if not size or test.isEmpty():
        raise ValueError("no laps to train on" if not size else "no laps to test on")
    scores = cross_validate(models, train_part, folds)
    model = fit(models[chosen], train_part)
    scored = stage(score(model, test).select(*test.columns, "p"), "scored")
    threshold, _ = tune_threshold(scored)
    told = held_out_metrics(scored, threshold, size) | {"model": chosen, "features": list(FEATURES), "cv_scores": scores}
    decision = gate(scored, told)
    if not decision.accepted:
        raise ValueError(f"artifact refused: {decision.reason}")
    save_artifacts(model, scaler, told, test, path)
    drop_since(laps.sparkSession, mark, keep_last=False)
    return told


def save_artifacts(model: PipelineModel, scaler: dict, metrics: dict, test: DataFrame, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    test.write.mode("overwrite").parquet(f"{path}/test.parquet")
    put_text(test.sparkSession, f"{path}/metrics.json", json.dumps(metrics))
    put_text(test.sparkSession, f"{path}/scaler.json", json.dumps(scaler))


def load_artifacts(spark: SparkSession, path: str) -> tuple[PipelineModel, dict, dict, DataFrame]:
    """(model, scaler, metrics, test); refuses what the gate refuses."""
    model = PipelineModel.load(f"{path}/model")
    metrics = json.loads(read_text(spark, f"{path}/metrics.json") or "{}")
    scaler = json.loads(read_text(spark, f"{path}/scaler.json") or "{}")
    test = spark.read.parquet(f"{path}/test.parquet")
    decision = gate(score(model, test), metrics)
    if not decision.accepted:
        raise ValueError(f"artifact refused: {decision.reason}")
    return model, scaler, metrics, test


def predict(model: PipelineModel, scaler: dict, row: dict, spark: SparkSession, features: Sequence[str] = FEATURES) -> float:
    missing = [c for c in features if c not in row]
    if missing:
        raise KeyError(f"missing features: {missing}")
    df = spark.createDataFrame([tuple(float(row[c]) for c in features)], ", ".join(f"{c} double" for c in features))
    return score(model, scale(df, scaler)).first()["p"]


def feature_importances(model: PipelineModel) -> list[tuple[str, float]]:
    """(feature, importance), largest first; the names are those that the model assembles."""
    names, last = model.stages[0].getInputCols(), model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    return sorted(zip(names, map(float, values), strict=True), key=lambda x: -x[1])


def policy_sweep(scored: DataFrame) -> DataFrame:
    """Quality at each threshold from 0.1 in steps of 0.05, with the share of laps flagged and the style of
    decision that the threshold stands for."""
    steps = [round(0.1 + 0.05 * i, 2) for i in range(18)]
    sweep = evaluation.threshold_sweep(scored, steps).join(F.broadcast(scored.agg(F.count("*").alias("__n"))))  # one row
    style = F.when(F.col("threshold") < 0.5, "coverage-first").when(F.col("threshold") < 0.7, "balanced").otherwise("intervention-first")
    flagged = F.coalesce(F.try_divide(F.col("tp") + F.col("fp"), F.col("__n")), F.lit(0.0))
    return sweep.withColumns({"flagged_share": flagged, "style": style}).drop("__n")


def race_state(scored: DataFrame, threshold: float) -> DataFrame:
    """Of each trace its last lap: session_key, driver_number, lap_number, p and the action to take."""
    last = scored.groupBy("session_key", "driver_number").agg(F.max(F.struct("lap_number", "p")).alias("x"))
    return last.select("session_key", "driver_number", "x.lap_number", "x.p", action_label(F.col("x.p"), threshold).alias("action"))


def review(scored: DataFrame, threshold: float) -> DataFrame:
    """What a model review shows, as (measure, value): base rate, Brier score, and counts and scores at the
    threshold."""
    one = evaluation.threshold_sweep(scored, [threshold]).join(F.broadcast(evaluation.brier(scored)))  # one row each
    one = one.join(F.broadcast(scored.agg(F.avg("y").alias("base_rate"), F.count("*").alias("laps"))))
    shown = ("laps", "base_rate", "brier", "tp", "fp", "fn", "precision", "recall", "f1")
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in shown])).alias("x")).select("x.*")


#: What release notes tell of an artifact's metrics; other keys are passed over.
TOLD = ("roc_auc", "f1", "precision", "recall", "threshold", "train_size", "test_size")


def release_notes(metrics: dict) -> str:
    values = {k: metrics[k] for k in TOLD if k in metrics}
    return "\n".join(f"- {k}: {v:.3f}" if isinstance(v, float) else f"- {k}: {v}" for k, v in values.items())
