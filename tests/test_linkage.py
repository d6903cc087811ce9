"""Literal cases of the linkage operators."""

import hashlib
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from matchwright.functions import similarity
from matchwright.functions import text as tx
from matchwright.functions.similarity import char_similarity
from matchwright.operators import blocking as bl
from matchwright.operators import diagnostics as dg
from matchwright.operators import evaluate as ev
from matchwright.operators import features as ft
from matchwright.operators import grouped as gr
from matchwright.operators import model as md
from matchwright.operators import profile as pf
from matchwright.plans import catalog
from matchwright.sources import tables as tb
from matchwright.sources.schema import require_columns
from matchwright.sources.tables import read_tsv, records_by_ids, write_tsv

COLS = "entity_id string, business_name string, business_address string, country string"


def frames(spark):
    s1 = spark.createDataFrame([("S1-1", "Heron Co.", "4 Mill St", "US"), ("S1-2", "", "", "US")], COLS)
    s2 = spark.createDataFrame([("S2-1", "Heron Company", "4 Mill Street", "US"), ("S2-2", "Quartz Works", "77 Pine Road", "US"), ("S2-3", "Heron Company", "4 Mill Street", "Chile")], COLS)
    s3 = spark.createDataFrame([("S3-1", "Heron Co", "4 Mill St", "US")], COLS)
    return s1, s2, s3


def one(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.v for r in df.withColumn("v", f(F.col("x"))).orderBy("i").collect()]


def test_normalisation(spark):
    assert one(spark, ["Q* Tools Inc", "Pvt. Lumen & Sons Ltd.", None], tx.normalized_name) == ["q tools incorporated", "private lumen sons limited", ""]
    assert one(spark, ["7 BAY ST, OSLO, NO", "Flat 3, 8 3/4 Quay Rd"], tx.normalized_address) == ["7 bay street oslo number", "flat 3 8 3 4 quay road"]
    hindi = "दिल्ली बाज़ार"
    assert one(spark, [hindi, "a_b Straße"], lambda c: tx.normalized(c, "scalar")) == [hindi, "a b strasse"]
    assert one(spark, ["a_b", "  France "], tx.normalized) == ["a_b", "france"]
    with pytest.raises(ValueError):
        tx.normalized(F.lit(""), "other")


def test_grams(spark):
    assert one(spark, ["", "ab", "abc", "abcabc"], lambda c: F.array_join(tx.grams(c), "|")) == ["", "", "abc", "abc|bca|cab"]


def test_exact_blocking_and_statistics(spark):
    pairs, stats = bl.generate_candidates(*frames(spark), bl.BlockingConfig(name_k=0, address_k=0))
    got = {(r.source1_entity_id, r.candidate_entity_id, r.strategy) for r in pairs.collect()}
    assert got == {("S1-1", "S2-1", "exact_name"), ("S1-1", "S3-1", "exact_name")}
    counts = {(r.source1_entity_id, r.candidate_source): r.final_candidate_count for r in stats.collect()}
    assert counts == {("S1-1", "S2"): 1, ("S1-1", "S3"): 1, ("S1-2", "S2"): 0, ("S1-2", "S3"): 0}


def test_topk_grows_with_k_and_keeps_to_it(spark):
    s1 = spark.createDataFrame([("S1-1", "ridge supply house", "x", "US")], COLS)
    s2 = spark.createDataFrame([(f"S2-{i:02d}", f"ridge supply {i}", "y", "US") for i in range(20)], COLS)
    s3 = spark.createDataFrame([("S3-1", "zzz", "q", "CL")], COLS)
    left, targets = bl.prepared(s1, "S1"), bl.stacked(s2, s3)
    sizes = [bl.similarity_topk(left, targets, "name", k).count() for k in (0, 3, 10, 30)]
    assert sizes == [0, 3, 10, 20]
    few = bl.similarity_topk(left, targets, "name", 10, bl.BlockingConfig(target_window=4)).collect()
    assert sorted(r.candidate_entity_id for r in few) == ["S2-00", "S2-01", "S2-02", "S2-03"]


def test_wrong_prefix_and_columns(spark):
    s1, s2, s3 = frames(spark)
    with pytest.raises(ValueError, match="S2"):
        bl.generate_candidates(s1, s3, s3)
    with pytest.raises(ValueError, match="country"):
        require_columns(s1.drop("country"), ["country"], "S1")


def test_features_and_labels(spark):
    s1, s2, s3 = frames(spark)
    pairs = spark.createDataFrame([("S1-1", "S2-1", "S2"), ("S1-1", "S2-2", "S2"), ("S1-2", "S3-1", "S3")], "source1_entity_id string, candidate_entity_id string, candidate_source string")
    rows = {(r.source1_entity_id, r.candidate_entity_id): r for r in ft.pair_features(pairs, s1, s2, s3).collect()}
    a = rows["S1-1", "S2-1"]
    assert (a.name_exact_match, a.address_exact_match, a.country_exact_match, a.name_token_jaccard, a.shared_digit_count) == (1, 1, 1, 1.0, 1)
    assert abs(a.name_tfidf_similarity - 1) < 1e-9 and a.name_char_similarity == 1.0
    assert rows["S1-2", "S3-1"].name_missing_s1 == 1 and len(a) == 3 + 29
    truth = spark.createDataFrame([("S1-1", "S2-1,S3-1"), ("S1-2", None)], "source1_entity_id string, matched_entity_ids string")
    assert {(r.candidate_entity_id, r.label) for r in ft.training_labels(pairs, truth).collect()} == {("S2-1", 1), ("S2-2", 0), ("S3-1", 0)}
    unknown = spark.createDataFrame([("S1-9", "S2-1", "S2")], pairs.schema)
    with pytest.raises(ValueError):
        ft.pair_features(unknown, s1, s2, s3)


@pytest.mark.parametrize(("predicted", "true", "f"), [(["S2-1"], "S2-1", 1), ([], "", 1), (["S2-1"], "", 0), ([], "S2-1", 0), (["S2-1"], "S2-1,S3-1", 1.25 * 0.5 / (0.25 + 0.5))])
def test_entity_metrics(spark, predicted, true, f):
    preds = spark.createDataFrame([("S1-1", p, 0.9) for p in predicted], "source1_entity_id string, candidate_entity_id string, match_probability double")
    truth = spark.createDataFrame([("S1-1", true)], "source1_entity_id string, matched_entity_ids string")
    assert abs(ev.entity_metrics(preds, truth).first().f0_5 - f) < 1e-12


def test_sweep_returns_all_ties(spark):
    preds = spark.createDataFrame([("S1-1", "S2-1", "S2", 0.95, 1)], "source1_entity_id string, candidate_entity_id string, candidate_source string, match_probability double, ground_truth_label int")
    best = ev.best_thresholds(ev.threshold_sweep(preds, [0.1, 0.5, 0.9])).first()
    assert best.tied_thresholds == [0.1, 0.5, 0.9] and best.selected_threshold == 0.1
    with pytest.raises(ValueError):
        ev.threshold_sweep(preds, [])


def test_recall_of_nothing(spark):
    truth = spark.createDataFrame([("S1-1", "")], "source1_entity_id string, matched_entity_ids string")
    none = spark.createDataFrame([], "source1_entity_id string, candidate_entity_id string")
    assert {r.recall for r in ev.candidate_recall(none, truth).collect()} == {1.0}
    assert ev.recall_stats(none, truth, truth).first().candidate_recall == 0.0


CASES = [
    (("a", "a", "x", "x", "us", "fr", 1, 1), "country_mismatch"), (("", "a", "", "x", "us", "us", 0, 0), "missing_both_fields_s1"), (("a", "", "x", "", "us", "us", 0, 0), "missing_both_fields_target"),
    (("", "a", "x", "y", "us", "us", 0, 0.2), "missing_name_and_weak_address"), (("", "a", "x", "x", "us", "us", 0, 1), "missing_name_field"), (("a", "b", "", "x", "us", "us", 0.2, 0), "missing_address_and_weak_name"),
    (("a", "a", "", "x", "us", "us", 1, 0), "missing_address_field"), (("a", "a", "x", "x", "us", "us", 1, 1), "unexpected_miss_both_exact"), (("a", "b", "x", "y", "us", "us", 0.1, 0.1), "both_name_and_address_weak"),
    (("a", "b", "1 x", "2 x", "us", "us", 0.9, 0.1), "address_digit_variation"), (("a", "b", "x y", "z w", "us", "us", 0.9, 0.1), "address_token_order_or_variation"), (("a", "b", "x y", "y x", "us", "us", 0.9, 0.1), "address_similarity_below_top_k_threshold"),
    (("a b", "b a", "x", "y", "us", "us", 0.1, 0.9), "name_token_order_variation"), (("a b c d", "a x y z", "x", "y", "us", "us", 0.1, 0.9), "name_abbreviation_or_suffix_variation"), (("a", "b", "x", "y", "us", "us", 0.1, 0.9), "name_variation_no_shared_tokens"),
    (("a", "b", "x", "y", "us", "us", 0.8, 0.6), "address_variation_near_threshold"), (("a", "b", "x", "y", "us", "us", 0.6, 0.8), "name_variation_near_threshold"), (("a", "b", "x", "y", "us", "us", 0.8, 0.8), "near_match_outside_top_k"),
    (("a", "b", "x", "y", "us", "us", 0.6, 0.6), "moderate_similarity_below_retrieval_threshold"),
]


def test_every_miss_category(spark):
    df = spark.createDataFrame([(i, *map(str, c[:6]), float(c[6]), float(c[7])) for i, (c, _) in enumerate(CASES)], "i int, n1 string, n2 string, a1 string, a2 string, c1 string, c2 string, ns double, sa double")
    got = df.select("i", dg.miss_category(*[F.col(c) for c in df.columns[1:]]).alias("m")).orderBy("i").collect()
    assert [r.m.reason for r in got] == [reason for _, reason in CASES]


def test_similarities(spark):
    pairs = [("", ""), ("", "a"), ("tide", "diet"), ("diet", "tide")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    assert [r.s for r in df.withColumn("s", char_similarity(F.col("a"), F.col("b"))).orderBy("i").collect()] == [1.0, 0.0, 0.25, 0.5]
    df = spark.createDataFrame([(0, "123 456 oak st", "123 789 oak st"), (1, "oak", "elm"), (2, "1", "oak")], "i int, a string, b string")
    assert [r.s for r in df.withColumn("s", dg.digit_similarity(F.col("a"), F.col("b"))).orderBy("i").collect()] == [1 / 3, 1.0, 0.0]


def test_tsv_round_trip_and_records_by_ids(spark, tmp_path):
    s1 = spark.createDataFrame([("S1-1", 'A "b"\tc', "NA", "NA"), ("S1-1", "later", "", ""), ("S1-2", "", "x", "US")], COLS)
    write_tsv(s1, str(tmp_path / "t"))
    back = read_tsv(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, s1.collect()))
    assert records_by_ids(s1, spark.createDataFrame([("S1-1",)], "entity_id string")).first().business_name == 'A "b"\tc'


def test_group_split_is_disjoint_and_forest_is_bounded(spark):
    rows = [(f"S1-{i}", f"S2-{i}-{j}", "S2", float(j == 0) + 0.01 * i, int(j == 0)) for i in range(12) for j in range(3)]
    df = spark.createDataFrame(rows, "source1_entity_id string, candidate_entity_id string, candidate_source string, x double, label int")
    result = md.train_baseline(df, trees=5, depth=None)
    a, b = ({r[0] for r in d.select("source1_entity_id").collect()} for d in (result.training, result.validation))
    assert not a & b and len(b) == 3 and result.features == ["x"]
    assert all(0 <= r.match_probability <= 1 for r in md.predictions_artifact(result.validation).collect())
    with pytest.raises(ValueError):
        md.group_split(df, 1.0)


def test_profile(spark):
    truth = spark.createDataFrame([("S1-1", "S2-1,S3-1"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string")
    assert tuple(pf.match_coverage(truth).first()) == (1, 1, 1, 1)
    assert {tuple(r) for r in pf.truth_distribution(truth).collect()} == {(2, 1), (0, 1)}
    assert pf.format_counter({"": 1200, "a": 3}) == "[empty]: 1,200\na: 3"


def test_queries_look_past_the_small_limits(spark, tmp_path):
    """Rows beyond the first 150 targets, the first 100 by id and the first 50 of Source 1 count in the queries with the operators' own limits."""
    rows = [(i, hashlib.md5(str(i // 3).encode()).hexdigest() * 2, "en") for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog.QUERIES["sample_evaluation"](spark, str(tmp_path)).first().sample_rows == 200
    near = catalog.QUERIES["bounded_similarity_full"](spark, str(tmp_path)).where("source1_entity_id = 'S1-597'").collect()
    assert {"S2-598", "S3-599"} <= {r.candidate_entity_id for r in near}
    ids = spark.range(0, 600, 3).where("pmod(xxhash64('S1-' || id), 10) = 0")
    hit = {r.id + 1 for r in ids.collect()}
    others = [i for i in range(1, 600, 3) if i not in hit][:5]
    got = {r.entity_id for r in catalog.QUERIES["diagnostic_target_full"](spark, str(tmp_path)).collect()}
    assert got == {f"S2-{i}" for i in (*hit, *others)} and max(hit) > 450


def test_topk_of_copies_and_rare_grams(spark, monkeypatch):
    """Equal texts are compared once and come back whole, ties by id; grams that share columns and bits are counted exactly."""
    for name, value in {"OWN": 2, "SHARED": 3, "BITS": 64, "RARE": 64, "TILE": 8, "GATHER": 16, "BROADCAST_QUERIES": 3}.items():
        monkeypatch.setattr(bl, name, value)
    seen = []
    monkeypatch.setattr(bl, "by_country", lambda rows, f=bl.by_country: seen.append(rows.num_rows) or f(rows))
    text = [hashlib.md5(str(i).encode()).hexdigest() + " common words" for i in range(12)]
    s1 = spark.createDataFrame([(f"S1-{i}", text[i % 4], "x", "US") for i in range(12)], COLS)
    s2 = spark.createDataFrame([(f"S2-{i:02d}", text[i % 12][: 45 - i // 24], "y", "US") for i in range(48)], COLS)
    s3 = spark.createDataFrame([(f"S3-{i:02d}", text[i % 3], "y", "US" if i else "CL") for i in range(9)], COLS)
    left, targets = bl.prepared(s1, "S1"), bl.stacked(s2, s3)
    gram = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    want, rows = set(), targets.collect()
    for a in left.collect():
        for source in ("S2", "S3"):
            near = [(-len(gram(a.name) & gram(b.name)) / len(gram(a.name) | gram(b.name)), b.entity_id) for b in rows if (b.candidate_source, b.country) == (source, a.country) and gram(a.name) & gram(b.name)]
            want |= {(a.entity_id, i, source, round(-s, 9)) for s, i in sorted(near)[:5]}
    got = [(r[0], r[1], r[2], round(r[3], 9)) for r in bl.similarity_topk(left, targets, "name", 5).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(seen) == 4


def many(spark):
    """Records with equal names, equal addresses, both and neither, and empty fields, in two countries."""
    rows = [(f"S{1 + i % 3}-{i}", ["Heron Mill", "Heron Mills", "Quartz Works", ""][i % 4], [f"{i % 5} Pine Road", "9 Oak Lane", "", "77 Bay Street"][i // 4 % 4], ["US", "Chile"][i % 7 == 0]) for i in range(120)]
    df = spark.createDataFrame(rows, COLS)
    return [df.where(F.col("entity_id").startswith(f"S{k}-")) for k in (1, 2, 3)]


def test_candidates_without_shuffling_exact_pairs(spark, monkeypatch):
    """Groups dealt out in pieces, and counts without the pairs, equal the union of the strategies, row for row."""
    monkeypatch.setattr(bl, "PIECE", 7)
    s = many(spark)
    config = bl.BlockingConfig(name_k=3, address_k=2, target_window=None)
    pairs, stats = bl.generate_candidates(*s, config)
    left, targets = bl.prepared(s[0], "S1"), bl.stacked(*s[1:])
    frames = bl.strategy_frames(left, targets, config)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(pairs) == key(bl.combined(frames).select(*pairs.columns))
    counts = {(r.source1_entity_id, r.candidate_source): r for r in stats.collect()}
    assert len(counts) == 2 * s[0].count() == stats.count()
    for name, f in [*zip(bl.STRATEGIES, frames, strict=True), ("final_candidate", pairs)]:
        own = {(r.source1_entity_id, r.candidate_source): r["count"] for r in f.groupBy("source1_entity_id", "candidate_source").count().collect()}
        assert {k: r[f"{name}_count"] for k, r in counts.items()} == {k: own.get(k, 0) for k in counts}
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")  # exact pairs go straight to the result


def test_repeated_ids_keep_one_row_a_pair(spark):
    s1, s2, s3 = frames(spark)
    pairs, _ = bl.generate_candidates(s1, s2.unionByName(s2), s3, bl.BlockingConfig(name_k=0, address_k=0))
    assert sorted((r.source1_entity_id, r.candidate_entity_id) for r in pairs.collect()) == [("S1-1", "S2-1"), ("S1-1", "S3-1")]


def test_candidate_records_equal_resolved_pairs(spark):
    """Features of pairs that carry their records equal those of pairs joined with them, also when ids repeat."""
    s, config = many(spark), bl.BlockingConfig(name_k=2, address_k=2, target_window=None)
    key = lambda df: sorted(map(str, df.collect()))
    for sources in (s, [s[0], s[1].unionByName(s[1].limit(2)), s[2]]):
        got = ft.candidate_records(*sources, config).select(*bl.PAIR, *[c.alias(n) for n, c in ft.plain_features(ready=True).items()])
        old = ft.resolved(bl.generate_candidates(*sources, config)[0].select(*bl.PAIR), *ft.records(*sources), check=False)
        assert key(got) == key(old.select(*bl.PAIR, *[c.alias(n) for n, c in ft.plain_features().items()]))


def test_growth_of_topk_needs_one_run(spark, tmp_path, monkeypatch):
    calls, old = [], bl.similarity_topk
    monkeypatch.setattr(bl, "similarity_topk", lambda *a, **b: calls.append(a[3]) or old(*a, **b))
    rows = [(i, f"heron mill and quartz works number {i % 11} by the old pine road near the bay {i % 13}", "en", "x", 60) for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    row = catalog.QUERIES["topk_growth"](spark, str(tmp_path)).first()
    assert calls == [10]
    parts = catalog._parts(spark, str(tmp_path))
    assert (row.pairs_k5, row.pairs_k10) == tuple(old(*parts, "name", k).count() for k in (5, 10))


def test_threshold_sweep_counts_before_it_meets_the_thresholds(spark):
    """Unsorted thresholds, probabilities on them, 0, 1 and missing, and repeated pairs, against a loop; pairs are not multiplied by thresholds."""
    rows = [("a", "x", 0.5, 1), ("a", "y", 0.3, 0), ("a", "y", 0.7, 0), ("a", "z", None, 1), ("b", "x", 1.0, 0), ("b", "y", 0.0, 1), ("c", "x", None, 0), ("c", "y", 0.69, 1)]
    df = spark.createDataFrame(rows, "source1_entity_id string, candidate_entity_id string, match_probability double, ground_truth_label int")
    best = {}
    for s, c, p, t in rows:
        q, u = best.get((s, c), (None, 0))
        best[s, c] = (max((x for x in (p, q) if x is not None), default=None), max(t, u))
    sweep = ev.threshold_sweep(df, [0.7, 0.0, 0.5, 1.0])
    got = {r.threshold: (r.entities, r.total_tp, r.total_fp, r.total_fn) for r in sweep.collect()}
    known = [(p, t) for p, t in best.values() if p is not None]
    assert got == {x: (3, sum(t and p >= x for p, t in known), sum(not t and p >= x for p, t in known), sum(t and p < x for p, t in known)) for x in (0.7, 0.0, 0.5, 1.0)}
    plan = sweep._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Join Cross") :].count("Aggregate [") == 2  # once by pair, once by label and thresholds reached


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Documents with groups of equal tails, of equal names, of equal addresses and of several of these, in two languages and none."""
    folder = str(tmp_path_factory.mktemp("copies"))
    word = ["heron mill and quartz works on the old pine road near ", "lumen tools by the bay street in the north of the city ", "tern and sons, makers of oak boats since the last war "]
    rows = [(i, f"{word[i % 3]}{i % 5:06d}{word[i // 4 % 3]}{'x' * (i % 2)}{' and so on ' * (i % 6)}{word[i % 2] * 2}", ["en", "fr", None][i // 7 % 3]) for i in range(150)] + [(150, None, "en"), (151, "", "en"), (152, "-", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    return folder


def rounded(df):
    return sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.collect())


def without_pairs_of_truth(monkeypatch):
    def fail(*_):
        raise AssertionError("the pairs of the truth are made")

    monkeypatch.setattr(tb, "projected_truth", fail)


def test_recall_is_counted_by_classes_of_the_truth(spark, copies, monkeypatch):
    truth = tb.projected_truth(spark, copies)
    want = rounded(ev.candidate_recall(catalog._candidates(spark, copies), truth))
    without_pairs_of_truth(monkeypatch)
    assert rounded(catalog.QUERIES["candidate_recall"](spark, copies)) == want


@pytest.mark.parametrize("end", ["plain words " * 60, "e\u0301\u1100\u1161\u11a8 " * 200, "--- ..  " * 99, "\ufb03 \u0130\u0301" * 130, "\u0301" * 700])
def test_tail_of_the_normalised_text(spark, end):
    texts = ["Ünder the bay, " * 9 + end + tail for tail in ("", "#" * 300, "\u1161\u11a8", "x" * 81)]
    assert one(spark, texts, lambda c: tb.normalized_tail(c, 10)) == one(spark, texts, lambda c: F.right(tx.normalized(c), F.lit(10)))


def test_recall_stats_are_counted_by_classes_of_the_truth(spark, copies, monkeypatch):
    truth = tb.projected_truth(spark, copies)
    want = rounded(ev.recall_stats(catalog._candidates(spark, copies), truth, truth).select(*sorted(ev.recall_stats(truth.selectExpr("source1_entity_id", "'' as candidate_entity_id"), truth, truth).columns)))
    without_pairs_of_truth(monkeypatch)
    got = catalog.QUERIES["recall_by_s1_counts"](spark, copies)
    assert rounded(got.select(*sorted(got.columns))) == want


@pytest.mark.parametrize("query", ["comparison_texts", "run_comparison"])
def test_comparison_of_two_runs_needs_one_similarity_run_of_a_field(spark, copies, monkeypatch, query):
    truth = tb.projected_truth(spark, copies)
    few, many = (dg.stats_table(ev.recall_stats(catalog._candidates(spark, copies, bl.BlockingConfig(name_k=k, address_k=k, target_window=None)), truth, truth)) for k in (2, 4))
    want = dg.comparison(few, many)
    want = rounded(want if query == "run_comparison" else dg.displayed(want).select("metric", "percentage_change"))
    calls, old = [], bl.similarity_topk
    monkeypatch.setattr(bl, "similarity_topk", lambda *a, **b: calls.append(a[2:4]) or old(*a, **b))
    without_pairs_of_truth(monkeypatch)
    assert rounded(catalog.QUERIES[query](spark, copies)) == want
    assert calls == [("name", 4), ("address", 4)]


def by_pairs(spark, d, query):
    """What the query returns from the pairs of the truth."""
    truth, old = tb.projected_truth(spark, d), catalog._predictions
    if query == "training_labels":
        return ft.training_labels(catalog._candidates(spark, d).select(*bl.PAIR), truth)
    if query == "candidate_status":
        return ev.candidate_status(catalog._candidates(spark, d), truth)
    if query == "artifact_scope":
        return ev.artifact_scope(old(spark, d), truth)
    if query == "entity_metrics":
        return ev.entity_metrics(old(spark, d), truth, 0.5).withColumns({c: F.array_join(c, ",") for c in ("true_ids", "predicted_ids")})
    if query == "macro_metrics":
        return ev.evaluate_predictions(old(spark, d), truth, 0.5)
    if query == "persisted_metrics":
        return ev.threshold_sweep(old(spark, d), [0.5])
    return ev.best_thresholds(ev.threshold_sweep(old(spark, d))).select("selected_threshold", "tied")


@pytest.mark.parametrize("query", ["training_labels", "candidate_status", "artifact_scope", "entity_metrics", "macro_metrics", "persisted_metrics", "selected_threshold"])
def test_labels_come_from_classes_of_the_truth(spark, copies, monkeypatch, query):
    monkeypatch.setattr(bl, "PIECE", 7)
    want = by_pairs(spark, copies, query)
    columns, want = want.columns, rounded(want)
    without_pairs_of_truth(monkeypatch)
    got = catalog.QUERIES[query](spark, copies)
    assert rounded(got.select(*columns)) == want


def test_candidate_lists_are_made_by_groups(spark, copies, monkeypatch):
    """a list is made once for equal texts, from the ids of groups, also where a group is dealt out; no pairs are made."""
    general = {(r[0], r[1]) for r in bl.candidate_lists(bl.combined(bl.strategy_frames(*catalog._parts(spark, copies), bl.FULL))).select("source1_entity_id", F.array_join("candidate_entity_ids", ",")).collect()}
    monkeypatch.setattr(bl, "PIECE", 7)
    monkeypatch.setattr(bl, "recorded", lambda *a: pytest.fail("pairs are made"))
    got = [tuple(r) for r in catalog.QUERIES["candidate_lists"](spark, copies).collect()]
    assert len(got) == len(general) and set(got) == general


def test_ratios_equal_difflib():
    """many pairs at once give what difflib gives one by one, with ties, long texts and other scripts."""
    rng = random.Random(9)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    pairs = [(text(letters, n), text(letters, n)) for letters, n in (("ab", 12), ("ab ", 60), ("abcdefgh é", 90), ("a", 199), ("ab\0\1", 9), ("aéł中", 30), ("abc", 260)) for _ in range(150)]
    pairs += [("x" * 1200 + "ab", "ab"), ("ab", "x" * 300 + "ab"), ("", ""), ("a", "")]
    got = similarity.ratios(*map(list, zip(*pairs, strict=True)))
    assert got.tolist() == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_feature_flags_do_not_resolve_pairs_again(spark, copies, monkeypatch):
    """the features come from the records that candidates carry, and no pair of texts is given to difflib alone."""
    want = ft.pair_features(catalog._candidates(spark, copies), *tb.sources(spark, copies), include_tfidf=False, check=False)
    columns, want = want.columns, rounded(want)
    monkeypatch.setattr(ft, "resolved", lambda *a, **b: pytest.fail("pairs are resolved again"))
    got = catalog.QUERIES["feature_flags"](spark, copies)
    assert got.columns == columns and rounded(got) == want


@pytest.mark.parametrize("query", ["error_summary", "threshold_sweep", "selected_threshold", "persisted_metrics", "macro_metrics", "entity_metrics"])
def test_scores_are_counted_by_groups(spark, copies, monkeypatch, query):
    """Exact pairs are counted by groups of equal texts, dealt out in parts; neither they nor pairs of the truth are made."""
    predictions = catalog._predictions(spark, copies)
    if query == "error_summary":
        want = dg.error_summary(dg.error_rows(predictions, catalog._injected(catalog._plain(spark, copies)), check=False))
    else:
        want = ev.threshold_sweep(predictions) if query == "threshold_sweep" else by_pairs(spark, copies, query)
    columns, want = want.columns, rounded(want)
    for name, value in {"ROWS": 7, "CELLS": 20, "DENSE": 1 / 4}.items():
        monkeypatch.setattr(gr, name, value)
    without_pairs_of_truth(monkeypatch)
    monkeypatch.setattr(ft, "recorded", lambda *a: pytest.fail("pairs are made"))
    assert rounded(catalog.QUERIES[query](spark, copies).select(*columns)) == want


def test_recovered_misses_are_compared_by_classes(spark, tmp_path, monkeypatch):
    """every miss and its reason without bringing pairs of the truth together, classes dealt out in parts, with fields of one side missing."""
    rng = random.Random(3)
    field = lambda words, n: "".join(f"{w} " for w in rng.sample(words, rng.randint(0, 4))).ljust(n)[:n]
    rows = [(i, field(["heron", "mill", "oak", "tern_a", "quay"], 60) + field(["7", "bay", "street", "12", "pine", "road"], 80) + "the same end of all texts " * 3, ["en", "fr"][i % 2]) for i in range(120)]
    rows += [(120 + i, "", "en") for i in range(3)] + [(123 + i, "-" * 140 + "the same end of all texts " * 3, "en") for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    want = dg.miss_recovery(catalog._misses(spark, d), catalog._candidates(spark, d, bl.BlockingConfig(name_k=2, address_k=2, target_window=None)))
    columns, want = want.columns, rounded(want)
    for name, value in {"ROWS": 7, "CELLS": 20, "DENSE": 1 / 4}.items():
        monkeypatch.setattr(gr, name, value)
    without_pairs_of_truth(monkeypatch)
    got = catalog.QUERIES["miss_recovery"](spark, d)
    assert got.columns == columns and rounded(got) == want
    assert len({r.previous_reason for r in got.collect()}) > 8 and {r.new_status for r in got.collect()} == {"CANDIDATE_PRESENT", "CANDIDATE_MISSING"}


@pytest.mark.parametrize("query", ["strength_flags", "pair_features"])
def test_pairs_compare_hashes_of_tokens(spark, copies, query):
    """a pair's tokens are not united, and it carries none of them; what one record decides is made before the join."""
    plan = catalog.QUERIES[query](spark, copies)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_union" not in plan and plan.count("array_intersect") <= 9
    rows = ft.candidate_records(*tb.sources(spark, copies), bl.BlockingConfig(name_k=0, address_k=0, target_window=None))
    assert not [f.name for f in rows.schema if f.dataType.typeName() == "array"]


def test_error_rows_have_their_top_from_counts(spark, copies, monkeypatch):
    """F8: each pair has its Source-1 row's top probability from the counts by groups; pairs are not brought together, and none of the truth are made."""
    plain = catalog._plain(spark, copies)
    want = dg.error_rows(catalog._predictions(spark, copies, plain), catalog._injected(plain), check=False).drop("name_tfidf_similarity")
    columns, want = want.columns, rounded(want)
    without_pairs_of_truth(monkeypatch)
    got = catalog.QUERIES["error_rows"](spark, copies)
    assert got.columns == columns and rounded(got) == want
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
