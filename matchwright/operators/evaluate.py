"""Evaluation: truth, per-entity and macro metrics, threshold sweep, candidate recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import require_columns
from ..sources.tables import write_text, written

#: 0.10, 0.15, ... 0.95.
THRESHOLDS = tuple(round(0.05 * k, 2) for k in range(2, 20))


def split_ids(c: Column) -> Column:
    """The ids of a comma-joined text; a missing text has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")


def explode_truth(truth: DataFrame) -> DataFrame:
    """(source1_entity_id, true_entity_id, true_source), one row per listed id."""
    require_columns(truth, ["source1_entity_id", "matched_entity_ids"], "ground truth")
    rows = truth.select("source1_entity_id", F.explode(split_ids(F.col("matched_entity_ids"))).alias("true_entity_id"))
    return rows.withColumn("true_source", F.substring("true_entity_id", 1, 2))


def f_half(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(1.25 * p * r, 0.25 * p + r), F.lit(0.0))


def with_rates(df: DataFrame) -> DataFrame:
    """Adds precision, recall and f0_5 to tp, fp, fn: all 1 if nothing is true or predicted; recall 1 if nothing is true."""
    n_pred, n_true = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    empty = (n_pred == 0) & (n_true == 0)
    p = F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide(F.col("tp").cast("double"), n_pred), F.lit(0.0)))
    r = F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide(F.col("tp").cast("double"), n_true), F.lit(1.0)))
    return df.withColumns({"precision": p, "recall": r}).withColumn("f0_5", F.when(empty, 1.0).otherwise(f_half(F.col("precision"), F.col("recall"))))


def entity_metrics(predictions: DataFrame, truth: DataFrame, threshold: float = 0.5, ids: DataFrame | None = None) -> DataFrame:
    """Per Source-1 id of truth, predictions at or over the threshold, or `ids`: set counts, rates and sorted id lists."""
    require_columns(predictions, ["source1_entity_id", "candidate_entity_id", "match_probability"], "predictions")
    if not 0 <= threshold <= 1:
        raise ValueError(f"threshold must be in [0, 1], not {threshold}")
    marks = explode_truth(truth).select("source1_entity_id", F.col("true_entity_id").alias("id"), F.lit(1).alias("t"), F.lit(0).alias("p"))
    chosen = predictions.where(F.col("match_probability") >= threshold).select("source1_entity_id", F.col("candidate_entity_id").alias("id"), F.lit(0).alias("t"), F.lit(1).alias("p"))
    everyone = truth.select("source1_entity_id")
    if ids is not None:
        everyone = everyone.unionByName(ids.select("source1_entity_id"))
    bare = everyone.select("source1_entity_id", F.lit(None).cast("string").alias("id"), F.lit(0).alias("t"), F.lit(0).alias("p"))
    pairs = marks.unionByName(chosen).unionByName(bare).groupBy("source1_entity_id", "id").agg(F.max("t").alias("t"), F.max("p").alias("p"))
    t, p = F.col("t") == 1, F.col("p") == 1
    out = pairs.groupBy("source1_entity_id").agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"),
        F.array_sort(F.collect_list(F.when(t, F.col("id")))).alias("true_ids"), F.array_sort(F.collect_list(F.when(p, F.col("id")))).alias("predicted_ids"),
    )
    return with_rates(out)


def macro(per_entity: DataFrame, *by: str) -> DataFrame:
    """Unweighted means and totals; without any entity, zeros."""
    n_pred, n_true = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    return per_entity.groupBy(*by).agg(
        F.count("*").alias("entities"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f0_5")],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in ("tp", "fp", "fn")],
        F.count_if(n_true == 0).alias("zero_match_entities"), F.count_if(n_true == 1).alias("singleton_entities"), F.count_if((n_true == 0) & (n_pred == 0)).alias("correctly_empty"),
        F.coalesce(F.min("f0_5"), F.lit(0.0)).alias("min_f0_5"), F.coalesce(F.max("f0_5"), F.lit(0.0)).alias("max_f0_5"),
    )


def evaluate_predictions(predictions: DataFrame, truth: DataFrame, threshold: float = 0.5, ids: DataFrame | None = None) -> DataFrame:
    return macro(entity_metrics(predictions, truth, threshold, ids))


def pairs_of(df: DataFrame) -> Column:
    """How many pairs a row stands for."""
    return F.col("pairs") if "pairs" in df.columns else F.lit(1)


def tops(predictions: DataFrame, threshold: float) -> DataFrame:
    """Per Source-1 id the top probability and the number of predicted pairs."""
    hits = F.sum(F.when(F.col("match_probability") >= threshold, pairs_of(predictions)).otherwise(0))
    return predictions.groupBy("source1_entity_id").agg(F.max("match_probability").alias("_top"), hits.alias("_hits"))


def counted_metrics(predictions: DataFrame, totals: DataFrame, threshold: float = 0.5, *more: Column) -> DataFrame:
    """Per Source-1 id of `totals` (source1_entity_id, true_count) the counts and rates of `entity_metrics`.

    For predictions with one row a pair, or one for several like ones (`pairs`), whose label says whether they are true, of ids that are all in `totals`; no lists are made.
    `more` is computed from the chosen ones too.
    """
    if not 0 <= threshold <= 1:
        raise ValueError(f"threshold must be in [0, 1], not {threshold}")
    true, n = F.col("ground_truth_label") == 1, pairs_of(predictions)
    total = lambda c: F.sum(F.when(c, n).otherwise(0))
    each = predictions.where(F.col("match_probability") >= threshold).groupBy("source1_entity_id").agg(total(true).alias("tp"), total(~true).alias("fp"), *more)
    out = totals.join(each, "source1_entity_id", "left").na.fill(0, ["tp", "fp"]).withColumn("fn", F.col("true_count") - F.col("tp"))
    return with_rates(out)


def threshold_sweep(predictions: DataFrame, thresholds=THRESHOLDS, unique: bool = False) -> DataFrame:
    """Metrics of a predictions artifact at every threshold; its own label-1 rows are the truth.

    `unique`: every pair has one row, or one for several like ones (`pairs`), so that pairs need not be brought together.  Pairs are first counted by label and by how many thresholds they reach, so that only these counts meet every threshold.
    """
    values = [float(t) for t in thresholds]
    if not values:
        raise ValueError("at least one threshold is required")
    if not all(0 <= t <= 1 for t in values):
        raise ValueError("thresholds must be in [0, 1]")
    steps = sorted(set(values))
    grid = predictions.sparkSession.createDataFrame([(t, steps.index(t) + 1) for t in values], "threshold double, _k int")
    once = predictions if unique else predictions.groupBy("source1_entity_id", "candidate_entity_id").agg(F.max("match_probability").alias("match_probability"), F.max("ground_truth_label").alias("ground_truth_label"))
    reached = F.size(F.filter(F.array(*map(F.lit, steps)), lambda x: x <= F.col("match_probability")))
    reached = F.when(F.col("match_probability").isNotNull(), reached)
    counts = once.groupBy("source1_entity_id", (F.col("ground_truth_label") == 1).alias("_t"), reached.alias("_reached")).agg(F.sum(pairs_of(once)).alias("_n"))
    t, p = F.col("_t"), F.col("_reached") >= F.col("_k")
    total = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0))
    each = counts.crossJoin(F.broadcast(grid)).groupBy("threshold", "source1_entity_id").agg(total(t & p).alias("tp"), total(~t & p).alias("fp"), total(t & ~p).alias("fn"))
    return macro(with_rates(each), "threshold")


def best_thresholds(sweep: DataFrame) -> DataFrame:
    """The thresholds whose macro F0.5 is within 1e-12 of the best, and the smallest of them."""
    best = sweep.agg(F.max("macro_f0_5").alias("best"))
    tied = sweep.crossJoin(F.broadcast(best)).where(F.abs(F.col("macro_f0_5") - F.col("best")) <= 1e-12)  # one row
    return tied.agg(F.min("threshold").alias("selected_threshold"), F.count("*").alias("tied"), F.array_sort(F.collect_list("threshold")).alias("tied_thresholds"))


def write_threshold(best: DataFrame, path: str) -> None:
    """The selected threshold with two decimals, as one line of a file in any store that Spark writes."""
    write_text(best.sparkSession, path, f"{best.first()['selected_threshold']:.2f}\n")


def evaluate_persisted(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Metrics of an artifact whose own label-1 rows are the truth, with the scope of that and a warning."""
    warning = "Only persisted candidate pairs are judged: true matches that candidate generation missed, and entities without candidates, are not seen."
    return threshold_sweep(predictions, [threshold]).withColumns({"evaluation_scope": F.lit("persisted_candidate_pairs_only"), "warning": F.lit(warning)})


def artifact_scope(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Whether an artifact is bounded: fewer positives than its Source-1 ids have true matches."""
    ids = predictions.select("source1_entity_id").distinct()
    true = explode_truth(truth).join(ids, "source1_entity_id", "left_semi").agg(F.count("*").alias("true_matches"))
    own = predictions.agg(F.sum("ground_truth_label").cast("bigint").alias("positives"), F.count("*").alias("pairs"))
    return own.crossJoin(true).withColumn("bounded", F.coalesce(F.col("positives"), F.lit(0)) < F.col("true_matches"))  # one row each


def scope_of_counts(counts: DataFrame) -> DataFrame:
    """`artifact_scope` of all candidates with their labels from the counts of `blocking.counted`, without pairs."""
    each = counts.groupBy("source1_entity_id").agg(*[F.sum(c).alias(c) for c in ("final_candidate_count", "found_count", "true_count")]).where("final_candidate_count > 0")
    row = each.agg(F.sum("found_count").alias("positives"), F.coalesce(F.sum("final_candidate_count"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("true_count"), F.lit(0)).alias("true_matches"))
    return row.withColumn("bounded", F.coalesce(F.col("positives"), F.lit(0)) < F.col("true_matches"))


def candidate_status(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Every true pair with CANDIDATE_PRESENT or CANDIDATE_MISSING."""
    seen = candidates.select("source1_entity_id", F.col("candidate_entity_id").alias("true_entity_id"), F.lit(1).alias("_s")).distinct()
    rows = explode_truth(truth).join(seen, ["source1_entity_id", "true_entity_id"], "left")
    return rows.withColumn("candidate_status", F.when(F.col("_s").isNotNull(), "CANDIDATE_PRESENT").otherwise("CANDIDATE_MISSING")).drop("_s")


def status_of_pairs(pairs: DataFrame) -> DataFrame:
    """`candidate_status` from the pairs of `blocking.true_pairs`."""
    return pairs.select("source1_entity_id", F.col("candidate_entity_id").alias("true_entity_id"), F.substring("candidate_entity_id", 1, 2).alias("true_source"), F.when(F.col("_present"), "CANDIDATE_PRESENT").otherwise("CANDIDATE_MISSING").alias("candidate_status"))


def candidate_recall(candidates: DataFrame, truth: DataFrame, empty: float = 1.0) -> DataFrame:
    """True and recovered pairs and recall for S2, S3 and overall; `empty` is the recall where there is nothing to find."""
    present = F.col("candidate_status") == "CANDIDATE_PRESENT"
    row = candidate_status(candidates, truth).agg(*[f for s in ("S2", "S3") for f in (F.count_if(F.col("true_source") == s).alias(f"true_{s}"), F.count_if((F.col("true_source") == s) & present).alias(f"found_{s}"))], F.count("*").alias("true_all"), F.count_if(present).alias("found_all"))
    return recall_table(row, empty)


def recall_table(row: DataFrame, empty: float) -> DataFrame:
    """The three rows of `candidate_recall` from one row of counts."""
    out = row.select(F.expr("stack(3, 'S2', true_S2, found_S2, 'S3', true_S3, found_S3, 'ALL', true_all, found_all) as (target, true_matches, recovered)"))
    return out.withColumns({"recall": F.coalesce(F.try_divide(F.col("recovered").cast("double"), F.col("true_matches")), F.lit(empty)), "missed": F.col("true_matches") - F.col("recovered")})


def recall_of_counts(counts: DataFrame, empty: float = 1.0) -> DataFrame:
    """`candidate_recall` from the counts of `blocking.counted`, without pairs."""
    total = lambda c, s=None: F.coalesce(F.sum(c if s is None else F.when(F.col("candidate_source") == s, F.col(c))), F.lit(0))
    row = counts.agg(*[total(f"{c}_count", s).alias(f"{c}_{s or 'all'}") for s in ("S2", "S3", None) for c in ("true", "found")])
    return recall_table(row, empty)


def missed_pairs(candidates: DataFrame, truth: DataFrame, most: int = 20) -> DataFrame:
    """The first `most` true pairs, in order of their ids, that no candidate covers."""
    rows = candidate_status(candidates, truth).where("candidate_status = 'CANDIDATE_MISSING'")
    return rows.select("source1_entity_id", "true_entity_id", "true_source").orderBy("source1_entity_id", "true_entity_id").limit(most)


def recall_stats(candidates: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: present, missing, recall (0 when there is none), pairs, and candidates per Source-1 id (zeros included)."""
    counts = ids.select("source1_entity_id").distinct().join(candidates.groupBy("source1_entity_id").count(), "source1_entity_id", "left").na.fill(0, ["count"])
    present = F.count_if(F.col("candidate_status") == "CANDIDATE_PRESENT")
    status = candidate_status(candidates, truth).agg(F.count("*").alias("total_ground_truth_matches"), present.alias("candidate_present"))
    return stats_row(status, counts)


def stats_row(status: DataFrame, counts: DataFrame) -> DataFrame:
    """The row of `recall_stats` from the true and present pairs and the candidates (`count`) of each Source-1 id."""
    per = counts.agg(F.sum("count").alias("total_candidate_pairs"), F.bround(F.avg("count"), 4).alias("average_candidates_per_s1"), F.percentile("count", 0.5).alias("median_candidates_per_s1"), F.max("count").alias("maximum_candidates_per_s1"))
    status = status.withColumns({"candidate_missing": F.col("total_ground_truth_matches") - F.col("candidate_present"), "candidate_recall": F.coalesce(F.try_divide(F.col("candidate_present").cast("double"), F.col("total_ground_truth_matches")), F.lit(0.0))})
    return status.crossJoin(per)  # one row each


def stats_of_counts(counts: DataFrame) -> DataFrame:
    """`recall_stats` of all Source-1 ids from the counts of `blocking.counted`, without pairs."""
    counts = written(counts)  # read twice
    status = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("true_count", "total_ground_truth_matches"), ("found_count", "candidate_present"))])
    return stats_row(status, counts.groupBy("source1_entity_id").agg(F.sum("final_candidate_count").alias("count")))
