"""The match model: group split, class-weighted random forest, predictions artifact."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.schema import PAIR, require_columns
from ..sources.tables import write_tsv, written


def model_features(df: DataFrame) -> list[str]:
    """Numeric columns but ids and label."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in (*PAIR, "label")]


def group_split(df: DataFrame, size: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows; a Source-1 id is wholly on one side, ceil(size * n) of them in validation."""
    if not 0 < size < 1:
        raise ValueError("validation size must be in (0, 1)")
    ids = df.select("source1_entity_id").distinct().withColumn("_h", F.xxhash64("source1_entity_id", F.lit(seed)))
    ids = ids.withColumn("_b", F.shiftright("_h", 48))  # 65,536 buckets of the hash, whose counts find the one that holds the cut
    counts = sorted(map(tuple, ids.groupBy("_b").count().collect()))
    left = -int(-(size * sum(c for _, c in counts)) // 1)
    cut = None
    for bucket, c in counts:
        cut = bucket
        if c >= left:
            break
        left -= c
    first = ids.where(F.col("_b") == cut).orderBy("_h", "source1_entity_id").limit(left)
    chosen = ids.where(F.col("_b") < cut).unionByName(first).select("source1_entity_id", F.lit(True).alias("_v"))
    marked = df.join(chosen, "source1_entity_id", "left")
    return marked.where("_v is null").drop("_v"), marked.where("_v").drop("_v")


@dataclass
class BaselineResult:
    model: PipelineModel
    features: list[str]
    training: DataFrame
    validation: DataFrame
    training_seconds: float = 0.0
    prediction_seconds: float = 0.0


def train_baseline(df: DataFrame, size: float = 0.2, seed: int = 42, trees: int = 100, depth: int | None = 12) -> BaselineResult:
    """Random forest with globally balanced class weights; nulls count as 0; `depth` None is Spark's limit of 30."""
    require_columns(df, ["source1_entity_id", "label"], "labelled pairs")
    features = model_features(df)
    df = written(df.na.fill(0, features).withColumn("label", F.col("label").cast("double")))  # features are made once, not for each pass of the fit
    training, validation = group_split(df, size, seed)
    counts = {r["label"]: r["count"] for r in training.groupBy("label").count().collect()}
    if len(counts) < 2:
        raise ValueError("training needs both labels")
    total = sum(counts.values())
    weight = F.when(F.col("label") == 1, total / (2 * counts[1.0])).otherwise(total / (2 * counts[0.0]))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="w", numTrees=trees, maxDepth=min(depth or 30, 30), minInstancesPerNode=2, seed=seed)
    began = time.monotonic()
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), forest]).fit(training.withColumn("w", weight))
    scored = model.transform(validation).withColumn("match_probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
    fitted = time.monotonic()
    scored = written(scored.withColumn("label", F.col("label").cast("int")))
    return BaselineResult(model, features, training, scored, fitted - began, time.monotonic() - fitted)


def diagnostics(result: BaselineResult) -> DataFrame:
    """Pair, entity and class counts, feature count, runtimes and probability statistics, one row."""
    side = lambda df, name: df.agg(F.count("*").alias(f"{name}_pairs"), F.count_distinct("source1_entity_id").alias(f"{name}_source1_entities"), F.count_if(F.col("label") == 1).alias(f"positive_{name}_pairs"), F.count_if(F.col("label") == 0).alias(f"negative_{name}_pairs"))
    p = "match_probability"
    stats = result.validation.agg(*[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in (("minimum", F.min(p)), ("maximum", F.max(p)), ("mean", F.avg(p)), ("median", F.percentile(p, 0.5)))])
    return side(result.training, "training").crossJoin(side(result.validation, "validation")).crossJoin(stats).withColumns({"feature_count": F.lit(len(result.features)), "training_runtime_seconds": F.lit(result.training_seconds), "prediction_runtime_seconds": F.lit(result.prediction_seconds)})  # one row each


def predictions_artifact(result: DataFrame, label: str = "label") -> DataFrame:
    """The artifact's columns; nulls, unknown sources, probabilities outside [0, 1] and labels other than 0 and 1 raise."""
    out = result.select(*PAIR, F.col("match_probability").cast("double").alias("match_probability"), F.col(label).cast("int").alias("ground_truth_label"))
    bad = {
        "null values": F.greatest(*[F.col(c).isNull().cast("int") for c in out.columns]) == 1,
        "sources other than S2 and S3": ~F.col("candidate_source").isin("S2", "S3"),
        "probabilities outside [0, 1]": ~F.col("match_probability").between(0, 1),
        "labels other than 0 and 1": ~F.col("ground_truth_label").isin(0, 1),
    }
    found = out.agg(*[F.count_if(c).alias(k) for k, c in bad.items()]).first().asDict()
    wrong = [k for k, n in found.items() if n]
    if wrong:
        raise ValueError(f"predictions have {', '.join(wrong)}")
    return out


def persist_predictions(result: DataFrame, path: str, label: str = "label") -> DataFrame:
    """Writes the validated artifact as TSV and returns it."""
    out = predictions_artifact(result, label)
    write_tsv(out, path)
    return out
