"""Schemas and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SOURCE = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
CANDIDATES = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "candidate_entity_id", "candidate_source", "source", "strategy")])
PREDICTIONS = T.StructType([*CANDIDATES.fields[:3], T.StructField("match_probability", T.DoubleType()), T.StructField("ground_truth_label", T.IntegerType())])
PAIR = ["source1_entity_id", "candidate_entity_id", "candidate_source"]


def require_columns(df: DataFrame, columns: list[str], label: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{label} is missing columns: {missing}")
