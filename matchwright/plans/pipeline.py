"""Compositions of the operators: training, audits and diagnostics over whole tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocking, diagnostics, evaluate, features, model, profile
from ..sources import tables


def all_records(s1: DataFrame, s2: DataFrame, s3: DataFrame) -> DataFrame:
    cols = ["entity_id", "business_name", "business_address", "country"]
    return s1.select(*cols).unionByName(s2.select(*cols)).unionByName(s3.select(*cols))


def train_and_tune(s1: DataFrame, s2: DataFrame, s3: DataFrame, truth: DataFrame, config: blocking.BlockingConfig = blocking.FULL, **forest) -> dict:
    """Candidates, features, labels, forest, artifact, threshold sweep."""
    pairs, _ = blocking.generate_candidates(s1, s2, s3, config)
    labelled = features.training_labels(features.pair_features(pairs, s1, s2, s3), truth)
    result = model.train_baseline(labelled, **forest)
    artifact = model.predictions_artifact(result.validation)
    sweep = evaluate.threshold_sweep(artifact)
    return {"result": result, "artifact": artifact, "sweep": sweep, "best": evaluate.best_thresholds(sweep)}


def error_analysis(artifact: DataFrame, s1: DataFrame, s2: DataFrame, s3: DataFrame, threshold: float = 0.45, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Error rows and their summary, written as TSV under `out` if given; features are computed for the artifact's pairs alone."""
    rows = diagnostics.error_rows(artifact, features.pair_features(artifact, s1, s2, s3), threshold)
    summary = diagnostics.error_summary(rows)
    if out:
        tables.write_tsv(rows, f"{out}/error_analysis.tsv")
        tables.write_tsv(summary, f"{out}/error_summary.tsv", one_file=True)
    return rows, summary


def recall_run(artifact: DataFrame, s1: DataFrame, s2: DataFrame, s3: DataFrame, truth: DataFrame, threshold: float = 0.45, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Recall analysis and summary of an artifact against the truth of its Source-1 ids, written as TSV under `out` if given."""
    ids = artifact.select("source1_entity_id").distinct()
    own_truth = truth.join(ids, "source1_entity_id", "left_semi")
    own = features.pair_features(artifact, s1, s2, s3)
    rows = diagnostics.recall_analysis(artifact, own_truth, own, all_records(s1, s2, s3))
    summary = diagnostics.recall_summary(rows, threshold)
    if out:
        tables.write_tsv(rows, f"{out}/candidate_recall_analysis.tsv")
        tables.write_tsv(summary, f"{out}/candidate_recall_summary.tsv", one_file=True)
    return rows, summary


def metric_table(spark: SparkSession, rows: list[tuple], *columns: str) -> DataFrame:
    """Figures of a report as texts, one row a metric."""
    text = lambda x: "N/A" if x is None else str(x)
    return spark.createDataFrame([tuple(map(text, r)) for r in rows], ", ".join(f"{c} string" for c in ("metric", *columns)))


def signed(base: float | None, other: float | None) -> str:
    return "N/A" if base is None or other is None else f"{other - base:+.6g}"


def percent(base: float | None, other: float | None) -> str:
    return "N/A" if not base or other is None else f"{(other - base) / abs(base) * 100:+.4f}%"


def timed_blocking(own: DataFrame, s2: DataFrame, s3: DataFrame, config: blocking.BlockingConfig) -> tuple[DataFrame, float]:
    """The candidates, written, and the seconds until they were."""
    began = time.monotonic()
    pairs = tables.written(blocking.generate_candidates(own, s2, s3, config)[0])
    return pairs, time.monotonic() - began


def recall_audit(artifact: DataFrame, s1: DataFrame, s2: DataFrame, s3: DataFrame, truth: DataFrame, config: blocking.BlockingConfig = blocking.FULL, bounded: DataFrame | None = None, out: str | None = None) -> dict:
    """Full blocking of the artifact's Source-1 ids: status of every true pair, figures, misses, and the comparison with a
    bounded run (metric, value), by default the artifact's own recall.  Writes TSVs under `out` if given.

    The runtime is that of generating and writing the candidates; memory is not traced, as it belongs to many executors.
    """
    spark = artifact.sparkSession
    ids = artifact.select("source1_entity_id").distinct()
    own = s1.join(ids.withColumnRenamed("source1_entity_id", "entity_id"), "entity_id", "left_semi")
    own_truth = truth.join(ids, "source1_entity_id", "left_semi")
    pairs, seconds = timed_blocking(own, s2, s3, config)
    status = evaluate.candidate_status(pairs, own_truth)
    stats = evaluate.recall_stats(pairs, own_truth, ids).withColumn("runtime_seconds", F.lit(seconds))
    row = stats.first()
    n, bounded_pairs = ids.count(), artifact.count()
    growth = row["total_candidate_pairs"] / bounded_pairs if bounded_pairs else None
    if bounded is None:
        bounded = diagnostics.recall_summary(evaluate.candidate_status(artifact, own_truth).withColumn("match_probability", F.lit(None).cast("double")))
    was = {r["metric"]: r["value"] for r in bounded.collect()}
    mode = blocking.blocking_mode(config)
    recall, average, median = round(row["candidate_recall"], 10), round(row["average_candidates_per_s1"], 4), round(row["median_candidates_per_s1"], 4)
    figures = [
        ("total_ground_truth_matches", row["total_ground_truth_matches"]), ("candidate_present_matches", row["candidate_present"]), ("candidate_missing_matches", row["candidate_missing"]), ("candidate_generation_recall", recall),
        ("average_candidates_per_source1", average), ("median_candidates_per_source1", median), ("maximum_candidates_per_source1", row["maximum_candidates_per_s1"]), ("candidate_reduction_ratio", growth and round(growth, 4)),
    ]
    window = "NONE (approximate_target_rows=None)" if config.target_window is None else str(config.target_window)
    summary = [("run_mode", mode), ("validation_source1_count", n), *figures, ("runtime_seconds", round(seconds, 2)), ("peak_memory_mb", None), ("target_row_truncation", window), ("train_source2_total_rows", s2.count()), ("train_source3_total_rows", s3.count())]
    was |= {"average_candidates_per_source1": round(bounded_pairs / n, 4) if n else None, "candidate_reduction_ratio": 1.0}
    against = [("run_mode", "BOUNDED(250000)", mode, None), ("validation_source1_count", n, n, "0")]
    against += [(k, "1.0 (reference)" if k == "candidate_reduction_ratio" else was.get(k), v, signed(was.get(k), v)) for k, v in figures]
    against.append(("runtime", None, f"{seconds:.2f}s", None))
    misses = diagnostics.miss_analysis(status, all_records(own, s2, s3))
    result = {
        "mode": mode, "candidates": pairs, "status": status, "stats": stats, "summary": metric_table(spark, summary, "value"), "comparison": metric_table(spark, against, "bounded_value", "full_value", "change"),
        "misses": misses, "miss_summary": diagnostics.miss_summary(status, misses),
    }
    if out:
        tables.write_tsv(status, f"{out}/full_validation_candidate_recall_analysis.tsv")
        tables.write_tsv(misses, f"{out}/remaining_candidate_misses_analysis.tsv")
        for name, table in (("full_validation_candidate_recall_summary", "summary"), ("bounded_vs_full_recall_comparison", "comparison"), ("remaining_candidate_misses_summary", "miss_summary")):
            tables.write_tsv(result[table], f"{out}/{name}.tsv", one_file=True)
    return result


def growth_experiment(audit: dict, s1: DataFrame, s2: DataFrame, s3: DataFrame, truth: DataFrame, config: blocking.BlockingConfig, base: blocking.BlockingConfig = blocking.FULL, out: str | None = None) -> dict:
    """A second run with other settings against an audit: recovered misses, and 15 figures side by side with their changes."""
    ids = audit["status"].select("source1_entity_id").distinct().unionByName(audit["candidates"].select("source1_entity_id")).distinct()
    own = s1.join(ids.withColumnRenamed("source1_entity_id", "entity_id"), "entity_id", "left_semi")
    pairs, seconds = timed_blocking(own, s2, s3, config)
    before, now = audit["stats"].first(), evaluate.recall_stats(pairs, truth.join(ids, "source1_entity_id", "left_semi"), ids).first()
    recovery = diagnostics.miss_recovery(audit["misses"], pairs)
    missing = recovery.agg(F.count("*"), F.count_if(F.col("new_status") == "CANDIDATE_PRESENT")).first()
    names = ("total_ground_truth_matches", "candidate_present", "candidate_missing", "candidate_recall", "total_candidate_pairs", "average_candidates_per_s1", "median_candidates_per_s1", "maximum_candidates_per_s1")
    figures = [("baseline_name_top_k", base.name_k, config.name_k), ("baseline_address_top_k", base.address_k, config.address_k), *[(k, before[k], now[k]) for k in names]]
    figures = [(k, round(a, 10), round(b, 10)) if k == "candidate_recall" else (k, a, b) for k, a, b in figures]
    rows = [(k, a, b, signed(a, b), percent(a, b)) for k, a, b in figures]
    rows.append(("candidate_set_growth_pct", "0.0%", percent(before["total_candidate_pairs"], now["total_candidate_pairs"]), None, None))
    rows += [(k, a, b, signed(a, b), percent(a, b)) for k, a, b in (("recovered_misses", 0, missing[1]), ("still_missing", missing[0], missing[0] - missing[1]), ("runtime_seconds", before["runtime_seconds"], seconds), ("peak_memory_mb", None, None))]
    compared = metric_table(s1.sparkSession, rows, "baseline", "experimental", "absolute_change", "percentage_change")
    if out:
        tables.write_tsv(compared, f"{out}/candidate_generation_step16_comparison.tsv", one_file=True)
        tables.write_tsv(recovery, f"{out}/candidate_miss_recovery_step16.tsv")
    return {"candidates": pairs, "recovery": recovery, "comparison": compared}


def inspect_folder(spark: SparkSession, train: str, test: str) -> dict[str, dict]:
    """Every TSV of the two folders, and the ground truth; a folder or ground truth that is not there raises."""
    files = [f for folder in (train, test) for f in tables.list_files(spark, folder) if f.lower().endswith(".tsv")]
    if not any(f.endswith("train_ground_truth.tsv") for f in files):
        raise FileNotFoundError(f"{train}/train_ground_truth.tsv")
    out = {f: profile.inspect_table(tables.read_tsv(spark, f), f.rsplit("/", 1)[-1]) for f in files}
    out["ground_truth"] = profile.inspect_truth(tables.read_tsv(spark, f"{train}/train_ground_truth.tsv"))
    return out


def analyze_folder(spark: SparkSession, train: str, path: str | None = None) -> dict[str, DataFrame]:
    """The tables of the dataset report over the training folder; the report is written to `path` if given."""
    loaded = tables.load_train(spark, train)
    truth, out = loaded.pop("ground_truth"), {}
    for k, df in enumerate(loaded.values(), 1):
        label = f"source {k}"
        out |= {f"{label}: records": profile.source_profile(df, f"S{k}-"), f"{label}: name lengths": profile.length_stats(df, "business_name"), f"{label}: address lengths": profile.length_stats(df, "business_address")}
        out |= {f"{label}: countries": profile.country_counts(df).orderBy(F.desc("records"), "country"), f"{label}: bad prefixes": profile.prefix_examples(df, f"S{k}-"), f"{label}: matched records": profile.matched_examples(df, truth)}
    out["countries by source"] = profile.country_overlap({f"S{k}": df for k, df in enumerate(loaded.values(), 1)}).orderBy("country")
    out |= {"ground truth": profile.truth_profile(truth), "matches of an entity": profile.truth_distribution(truth).orderBy("matches"), "ids without a prefix": profile.truth_violations(truth)}
    out |= {"match coverage": profile.match_coverage(truth), "differences of confirmed pairs": profile.noise_examples(truth, all_records(*loaded.values()))}
    if path:
        profile.write_report(spark, out, path)
    return out


def sample_evaluation(s1: DataFrame, s2: DataFrame, s3: DataFrame, n: int = 5000, config: blocking.BlockingConfig = blocking.BOUNDED) -> DataFrame:
    """Blocking of the first n Source-1 rows by id: pairs by target, candidates per row, and the reduction 1 - pairs / possible pairs."""
    sample = s1.orderBy("entity_id").limit(n)
    pairs, _ = blocking.generate_candidates(sample, s2, s3, config)
    per = sample.select(F.col("entity_id").alias("source1_entity_id")).join(pairs.groupBy("source1_entity_id").count(), "source1_entity_id", "left").na.fill(0, ["count"])
    sizes = s2.agg(F.count("*").alias("n2")).crossJoin(s3.agg(F.count("*").alias("n3")))
    out = per.agg(F.count("*").alias("sample_rows"), F.sum("count").alias("pairs"), F.avg("count").alias("average"), F.percentile("count", 0.5).alias("median"), F.max("count").alias("maximum")).crossJoin(sizes)
    return out.withColumn("reduction_ratio", 1 - F.try_divide(F.col("pairs").cast("double"), F.col("sample_rows") * (F.col("n2") + F.col("n3")))).drop("n2", "n3")
