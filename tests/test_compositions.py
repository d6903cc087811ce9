"""Chained runs with their outputs, reading and writing, and the properties of the top-k join, on small made-up tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from matchwright.operators import blocking, diagnostics, evaluate, model, preprocess, profile
from matchwright.plans import pipeline
from matchwright.sources import tables

STEMS = "alpine bakery copper dental eagle forest garden harbor island jasper kitchen lumber".split()


@pytest.fixture(scope="module")
def business(spark):
    """Three sources, the truth, and ids of every kind: exact, near and missing matches."""
    rng = random.Random(3)
    rows, truth = {1: [], 2: [], 3: []}, []
    for i in range(40):
        name = " ".join(rng.sample(STEMS, 2)) + (" ltd" if i % 3 else " limited")
        address = f"{rng.randint(1, 99)} {rng.choice(STEMS)} street"
        country = "us" if i % 4 else "fr"
        rows[1].append((f"S1-{i}", name, address if i % 7 else "", country))
        ids = []
        if i % 5:
            ids.append(f"S2-{i}")
            rows[2].append((f"S2-{i}", name.upper() if i % 2 else name[:-2] + "x", address, country))
        if i % 6 == 0:
            ids.append(f"S3-{i}")
            rows[3].append((f"S3-{i}", "wholly other words", "nowhere", "zz"))
        truth.append((f"S1-{i}", ",".join(ids)))
    rows[3] += [(f"S3-{100 + i}", " ".join(rng.sample(STEMS, 3)), "12 elm road", "us") for i in range(15)]
    make = lambda r: spark.createDataFrame(r, "entity_id string, business_name string, business_address string, country string")
    return {**{k: make(r) for k, r in rows.items()}, "truth": spark.createDataFrame(truth, "source1_entity_id string, matched_entity_ids string"), "rows": rows}


def artifact_of(spark, business, config=blocking.BlockingConfig(name_k=2, address_k=0, target_window=None)):
    pairs, _ = blocking.generate_candidates(business[1], business[2], business[3], config)
    true = evaluate.explode_truth(business["truth"]).select("source1_entity_id", F.col("true_entity_id").alias("candidate_entity_id"), F.lit(1).alias("l"))
    labelled = pairs.join(true, ["source1_entity_id", "candidate_entity_id"], "left").withColumn("label", F.coalesce("l", F.lit(0)))
    return model.predictions_artifact(labelled.withColumn("match_probability", F.when(F.col("label") == 1, 0.9).otherwise(0.2)))


@pytest.mark.parametrize("grams", [2_000_000, 400])
def test_topk_matches_brute_force(spark, business, monkeypatch, grams):
    """All pairs by hand, for one block of queries and for many."""
    monkeypatch.setattr(blocking, "BROADCAST_GRAMS", grams)
    monkeypatch.setattr(blocking, "CELLS", 64)
    monkeypatch.setattr(blocking, "KEEP", 5)
    gram = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    s1, targets = blocking.prepared(business[1], "S1"), blocking.stacked(business[2], business[3])
    left, right = s1.collect(), targets.collect()
    want = set()
    for a, source in itertools.product(left, ("S2", "S3")):
        near = []
        for b in right:
            x, y = gram(a.name), gram(b.name)
            if b.candidate_source == source and a.country == b.country != "" and x & y:
                near.append((-len(x & y) / len(x | y), b.entity_id))
        want |= {(a.entity_id, i, source, round(-s, 9)) for s, i in sorted(near)[:3]}
    got = [(r[0], r[1], r[2], round(r[3], 9)) for r in blocking.similarity_topk(s1, targets, "name", 3).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60
    assert blocking.similarity_topk(s1, targets, "name", 0).count() == 0
    assert blocking.similarity_topk(s1.where("false"), targets, "name", 3).count() == 0


def test_targets_must_have_rows_and_prefixes(spark, business):
    with pytest.raises(ValueError, match="no rows"):
        blocking.stacked(business[2].limit(0), business[3])
    with pytest.raises(ValueError, match="start with S3"):
        blocking.stacked(business[2], business[2])


def test_presets_and_modes():
    assert (blocking.BOUNDED.target_window, blocking.FULL.target_window) == (250_000, None)
    assert blocking.blocking_mode(blocking.FULL) == "FULL" and blocking.blocking_mode(blocking.BOUNDED) == "BOUNDED(250000)"


def test_audit_and_growth(spark, business, tmp_path):
    artifact = artifact_of(spark, business)
    config = blocking.BlockingConfig(name_k=1, address_k=1, target_window=None)
    audit = pipeline.recall_audit(artifact, business[1], business[2], business[3], business["truth"], config, out=str(tmp_path))
    value = {r.metric: r.value for r in audit["summary"].collect()}
    seen = {(r.source1_entity_id, r.candidate_entity_id) for r in audit["candidates"].collect()}
    ids = {r.source1_entity_id for r in artifact.collect()}
    true = [(r.source1_entity_id, t) for r in business["truth"].collect() if r.source1_entity_id in ids for t in r.matched_entity_ids.split(",") if t]
    found = sum(p in seen for p in true)
    assert len(value) == 15 and value["run_mode"] == "FULL" and value["validation_source1_count"] == str(len(ids)) and value["peak_memory_mb"] == "N/A"
    assert (value["total_ground_truth_matches"], value["candidate_present_matches"], value["candidate_missing_matches"]) == (str(len(true)), str(found), str(len(true) - found))
    assert float(value["runtime_seconds"]) > 0 and value["candidate_reduction_ratio"] == str(round(len(seen) / artifact.count(), 4))
    change = {r.metric: r for r in audit["comparison"].collect()}
    own = sum(p in {(r.source1_entity_id, r.candidate_entity_id) for r in artifact.collect()} for p in true)
    assert len(change) == 11 and change["candidate_present_matches"].change == f"{found - own:+.6g}" and change["median_candidates_per_source1"].change == "N/A"
    assert {r.metric: r.value for r in audit["miss_summary"].collect()}["candidate_missing"] == str(len(true) - found)
    lines = (tmp_path / "full_validation_candidate_recall_summary.tsv").read_text().splitlines()
    assert lines[0] == "metric\tvalue" and len(lines) == 16 and spark.read.csv(f"{tmp_path}/full_validation_candidate_recall_analysis.tsv", sep="\t", header=True).count() == len(true)

    grown = pipeline.growth_experiment(audit, business[1], business[2], business[3], business["truth"], blocking.BlockingConfig(name_k=6, address_k=6, target_window=None), config, out=str(tmp_path))
    rows = {r.metric: r for r in grown["comparison"].collect()}
    more = {(r.source1_entity_id, r.candidate_entity_id) for r in grown["candidates"].collect()}
    assert len(rows) == 15 and rows["baseline_name_top_k"].absolute_change == "+5" and rows["baseline_name_top_k"].percentage_change == "+500.0000%"
    assert int(rows["recovered_misses"].experimental) == sum(p in more for p in true) - found and rows["candidate_set_growth_pct"].baseline == "0.0%"
    assert rows["total_candidate_pairs"].percentage_change == f"{(len(more) - len(seen)) / len(seen) * 100:+.4f}%" and rows["peak_memory_mb"].absolute_change == "N/A"
    assert grown["recovery"].count() == len(true) - found


def test_recall_run_and_error_analysis(spark, business, tmp_path):
    artifact = artifact_of(spark, business)
    rows, summary = pipeline.recall_run(artifact, business[1], business[2], business[3], business["truth"], out=str(tmp_path))
    value = {r.metric: r.value for r in summary.collect()}
    assert value["total_ground_truth_matches"] == rows.count() and value["candidate_present_matches"] == artifact.where("ground_truth_label = 1").count() == value["candidate_present_above_threshold"]
    assert (tmp_path / "candidate_recall_summary.tsv").read_text().startswith("metric\tvalue\n")
    errors, counts = pipeline.error_analysis(artifact, business[1], business[2], business[3], out=str(tmp_path))
    counted = {r.error_type: r["count"] for r in counts.collect()}
    assert counted["true_positive"] == errors.count() == artifact.where("ground_truth_label = 1").count() and counted["false_positive"] == 0 and errors.columns == diagnostics.ERROR_COLUMNS


def test_displayed_changes(spark):
    rows = [("a", 1.0, 13.5), ("b", 0.0, 2.0), ("c", 3.0, 3.0), ("d", 100.0, 1234667.0), ("e", 4.0, 3.0), ("f", None, 1.0), ("g", 1.0, 1.25e-05 + 1), ("h", 8.0, 100008.0)]
    got = {r.metric: (r.absolute_change, r.percentage_change) for r in diagnostics.displayed(diagnostics.comparison(spark.createDataFrame([r[:2] for r in rows], "metric string, value double"), spark.createDataFrame([(r[0], r[2]) for r in rows], "metric string, value double"))).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: "N/A" if a is None else f"{b - a:+.6g}" for k, a, b in rows}
    assert got["a"][1] == "+1250.0000%" and got["b"][1] == got["f"][1] == "N/A" and got["e"][1] == "-25.0000%"


def test_evaluation_bounds(spark):
    none = spark.createDataFrame([], "source1_entity_id string, candidate_entity_id string, match_probability double")
    truth = spark.createDataFrame([], "source1_entity_id string, matched_entity_ids string")
    row = evaluate.evaluate_predictions(none, truth).first()
    assert (row.entities, row.macro_precision, row.macro_recall, row.macro_f0_5, row.total_tp, row.min_f0_5) == (0, 0.0, 0.0, 0.0, 0, 0.0)
    for bad in (-0.1, 1.1):
        with pytest.raises(ValueError):
            evaluate.evaluate_predictions(none, truth, bad)
        with pytest.raises(ValueError):
            evaluate.threshold_sweep(none.withColumn("ground_truth_label", F.lit(0)), [bad])


def test_persisted_evaluation_and_threshold_file(spark, business, tmp_path):
    artifact = artifact_of(spark, business)
    row = evaluate.evaluate_persisted(artifact).first()
    assert row.evaluation_scope == "persisted_candidate_pairs_only" and row.warning and row.total_fn == 0
    evaluate.write_threshold(evaluate.best_thresholds(evaluate.threshold_sweep(artifact)), f"{tmp_path}/deep/selected_threshold.txt")
    assert (tmp_path / "deep/selected_threshold.txt").read_text() == "0.25\n"
    model.persist_predictions(artifact.withColumnRenamed("ground_truth_label", "label"), f"{tmp_path}/predictions.tsv")
    back = tables.read_predictions(spark, f"{tmp_path}/predictions.tsv")
    assert sorted(back.collect()) == sorted(artifact.collect())
    with pytest.raises(ValueError, match="probabilities"):
        model.persist_predictions(artifact.withColumnRenamed("ground_truth_label", "label").withColumn("match_probability", F.lit(1.5)), f"{tmp_path}/bad.tsv")


def test_missed_pairs_are_the_first(spark, business):
    none = artifact_of(spark, business).limit(0)
    got = [(r.source1_entity_id, r.true_entity_id) for r in evaluate.missed_pairs(none, business["truth"], 7).collect()]
    true = sorted((r.source1_entity_id, t) for r in business["truth"].collect() for t in r.matched_entity_ids.split(",") if t)
    assert got == true[:7]


def test_group_split_counts(spark):
    df = spark.createDataFrame([(f"S1-{i % 103}", i) for i in range(500)], "source1_entity_id string, x int")
    for size in (0.01, 0.2, 0.5, 0.99):
        train, held = model.group_split(df, size)
        a, b = ({r.source1_entity_id for r in x.collect()} for x in (train, held))
        assert not a & b and len(a | b) == 103 and len(b) == -int(-(size * 103) // 1) and train.count() + held.count() == 500


def test_forest_and_diagnostics(spark):
    rng = random.Random(1)
    rows = [(f"S1-{i % 50}", f"S2-{i}", "S2", rng.random() * 0.4 + 0.6 * (i % 3 == 0), i % 3 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "source1_entity_id string, candidate_entity_id string, candidate_source string, x double, y boolean").withColumn("label", F.col("y").cast("int")).drop("y")
    result = model.train_baseline(df, trees=5, depth=3)
    row = model.diagnostics(result).first()
    assert row.training_pairs + row.validation_pairs == 300 and row.training_runtime_seconds > 0 and row.prediction_runtime_seconds > 0 and row.feature_count == 1
    assert 0 <= row.minimum <= row.median <= row.maximum <= 1


def test_preprocess_and_char_similarity(spark):
    from difflib import SequenceMatcher

    from matchwright.functions.similarity import with_char_similarity

    out = preprocess.preprocess(spark.createDataFrame([("1", "A  B Ltd.", None)], "entity_id string, business_name string, country string")).first()
    assert (out.business_name_normalized, out.name_tokens, out.name_token_count, out.name_length, out.has_name, out.missing_address, out.address_tokens) == ("a b limited", ["a", "b", "limited"], 3, 11, True, True, [])
    long = "abcde " * 60
    pairs = [("", ""), ("a", ""), (long, long[3:]), (long[:150], long + "z"), ("abc", "bca"), ("x" * 250, "x" * 200 + "y")]
    got = {(r.a, r.b): r.s for r in with_char_similarity(spark.createDataFrame(pairs, "a string, b string"), "a", "b", "s").collect()}
    assert got == {(a, b): 1.0 if a == b else SequenceMatcher(None, a, b).ratio() for a, b in pairs}


def test_inspection_and_report(spark, business, tmp_path):
    for folder, split in (("train", "train"), ("test", "test")):
        for k in (1, 2, 3):
            tables.write_tsv(business[k], f"{tmp_path}/{folder}/{split}_source{k}.tsv", one_file=True)
    tables.write_tsv(business["truth"].unionByName(spark.createDataFrame([("X-1", "S9-1,S2-1")], business["truth"].schema)), f"{tmp_path}/train/train_ground_truth.tsv", one_file=True)
    found = pipeline.inspect_folder(spark, f"{tmp_path}/train", f"{tmp_path}/test")
    assert len(found) == 8
    one = found[next(k for k in found if k.endswith("train_source3.tsv"))]
    assert one["rows"] == len(business["rows"][3]) and one["prefix"] == "S3-" and one["bad_prefixes"] == 0 and one["repeated_ids"] == 0 and one["empty"]["business_name"] == 0
    assert {(r.country, r.records) for r in one["countries"].collect()} == {(c, sum(r[3] == c for r in business["rows"][3])) for c in {r[3] for r in business["rows"][3]}}
    assert {(r.kind, r.id) for r in found["ground_truth"]["violations"].collect()} == {("source1", "X-1"), ("matched", "S9-1")}
    assert profile.repeated_ids(business[1].unionByName(business[1].limit(1))).count() == 1
    sections = pipeline.analyze_folder(spark, f"{tmp_path}/train", f"{tmp_path}/out/report.txt")
    text = (tmp_path / "out/report.txt").read_text()
    assert len(text.split("\n== ")) == len(sections) and f"rows: {len(business['rows'][1])}," in text
    assert tables.load_test(spark, f"{tmp_path}/test")["source2"].count() == len(business["rows"][2])
    ids = spark.createDataFrame([("S1-3",)], "entity_id string")
    assert [r.source1_entity_id for r in tables.truth_for(business["truth"], ids).collect()] == ["S1-3"]
    with pytest.raises(FileNotFoundError):
        pipeline.inspect_folder(spark, f"{tmp_path}/test", f"{tmp_path}/test")
    with pytest.raises(FileNotFoundError):
        tables.list_files(spark, f"{tmp_path}/nothing")


def test_records_by_ids_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "entity_id string, n int, v string")
    ids = df.select("entity_id").where("entity_id = 'a'")
    assert [tables.records_by_ids(df, ids, keep, "n").first().v for keep in ("first", "last")] == ["y", "x"]


def test_train_and_tune(spark, business):
    out = pipeline.train_and_tune(business[1], business[2], business[3], business["truth"], blocking.BlockingConfig(name_k=3, address_k=3, target_window=None), trees=5, depth=3)
    assert out["sweep"].count() == 18 and 0.1 <= out["best"].first().selected_threshold <= 0.95
    assert out["artifact"].count() == out["result"].validation.count() > 0 and "name_tfidf_similarity" in out["result"].features
