"""The stages of the pipeline one by one, each on its own input, against brute force; odd rows, clashing names, empty tables."""

import gc
import itertools
import random
import re
import time
from collections import Counter

import pytest
import xxhash

import corpus_pipeline as cp
from matchwright.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, key string, id long"
STEMS = {"en": "the and ing ther tion of to in er on".split(), "de": "der die und sch ung eit lich en ge ver".split()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(61)
    word = lambda lang: "".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(2, 4)))
    text = lambda lang, n: [word(lang) for _ in range(n)]
    items = [text("en", 20) for _ in range(3)]
    rows = []

    def add(words, lang, source=None):
        rows.append((len(rows), " ".join(words), lang, source or f"src{rng.randint(0, 3)}", 0, "x", "k", 7))

    for i in range(150):
        add(text("en" if i % 2 else "de", rng.randint(30, 120)), "en" if i % 2 else "de")
    for i in range(6):  # copies of one base, in its middle, and exact copies
        base = rows[10][1].split()
        for at in rng.sample(range(len(base)), min(i, 2)):
            base[at] = word("de")
        add(base, "de")
    add(rows[20][1].split(), "de")
    for item in items:
        add([*text("en", 20), *item[:10], "zz", *item[11:], *text("en", 20)], "en")
    add(text("en", 5000), "en", "src1")
    odd = [(None, " ".join(text("en", 40)), "en", None, None, None, None, None), (900, None, "en", "src1", 0, "x", "k", 1), (901, "", None, None, 0, "x", "k", 1), (902, "12 34 !!", "de", "src2", 0, "x", "k", 1)]
    odd += [(903, "Съешь же ещё этих мягких французских булок да выпей чаю " * 5, "en", "src2", 0, "x", "k", 1), (904, " ".join(text("en", 60) + text("de", 60)), "en", "src0", 0, "x", "k", 1), rows[3]]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows + odd, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


@pytest.fixture(scope="module")
def steps(spark, folder):
    """The input and the result of every stage, each written and read again."""
    path, _ = folder
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        target = f"{path}/out-{name}"
        stage(spark, docs, path).write.parquet(target)
        result = spark.read.parquet(target)
        out[name] = (docs.collect(), result.collect(), docs.columns, result.columns)
        docs = result
    return out


def test_stages_keep_columns_and_rows(steps):
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]
    for name in list(steps)[:-1]:
        before, after, cols, kept = steps[name]
        assert cols == kept and not Counter(map(tuple, after)) - Counter(map(tuple, before))


def test_language_stage(steps):
    before, after, _, _ = steps["language_id"]
    gone = Counter(map(tuple, before)) - Counter(map(tuple, after))
    assert {r[0] for r in gone} == {900, 901, 902, 903, 904}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def test_near_duplicate_stage(steps):
    before, after, _, _ = steps["near_duplicates"]
    rows = {r.doc_id: r for r in before if r.doc_id is not None}
    sets, prints = {}, {}
    for i, r in rows.items():
        s = shingles(r.text)
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        sets[i], prints[i] = set(s), sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    group = {i: i for i in rows}
    near = [(a, b) for a, b in itertools.combinations(rows, 2) if (prints[a] ^ prints[b]).bit_count() <= 3 or sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in near:
            group[a] = group[b] = min(group[a], group[b])
    want = {i for i in rows if group[i] == i}
    assert len(want) < len(rows) and sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(want) and sum(r.doc_id is None for r in after) == 1


def test_decontamination_stage(steps, folder):
    before, after, _, _ = steps["decontamination"]

    def hit(text):
        x = re.findall(r"\w+", (text or "").lower())
        return any(sum(x[p + j] == y[q + j] for j in range(13)) >= 11 for y in folder[1] for p in range(len(x) - 12) for q in range(len(y) - 12))

    want = Counter(tuple(r) for r in before if not hit(r.text))
    assert Counter(map(tuple, after)) == want and sum(want.values()) == len(before) - 3


def test_mixing_stage(spark, steps):
    before, after, _, _ = steps["mixing"]
    count = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows)
    budget = count(before) * 900 // 1000
    _, leaves = mixing.plan(spark.createDataFrame(before, SCHEMA), None, 0.9, 1)
    assert sum(r.budget for r in leaves.collect()) == budget and budget * 0.9 < count(after) <= budget


def test_sharding_stage_and_run(spark, steps, folder):
    before, after, _, cols = steps["sharding"]
    counts = Counter(r.shard for r in after)
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after) and max(counts.values()) - min(counts.get(s, 0) for s in range(24)) <= 1
    assert all(sorted(r.slot for r in after if r.shard == s) == list(range(n)) for s, n in counts.items())
    again = cp.run(spark, folder[0])
    assert again.columns == cols and Counter((r.doc_id, r.size) for r in again.collect()) == Counter((r.doc_id, r.size) for r in after)


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    assert all(stage(spark, docs, folder[0]).count() == 0 for _, stage in cp.STAGES)


def test_written_steps_give_back_the_drivers_memory(spark):
    """F pipeline: what the JVM's malloc keeps after it was freed, and the garbage of a large heap, goes after every written step."""
    from matchwright.llm import common

    def anonymous():
        pid = spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()
        with open(f"/proc/{pid}/smaps_rollup") as f:
            return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read()).group(1)) / 1024

    jvm = spark.sparkContext._jvm
    kept, freed = [], []
    for k in range(6000):  # 360 MB in the C heap; every 50th buffer stays, so that malloc keeps the others when they are freed
        (freed if k % 50 else kept).append(jvm.java.nio.ByteBuffer.allocateDirect(60_000))
    full = anonymous()
    del freed
    gc.collect()
    time.sleep(2)
    for _ in range(2):
        jvm.java.lang.System.gc()
        time.sleep(2)
    assert common.stored(spark.range(3), "relief").count() == 3
    assert anonymous() < full - 200 and len(kept) == 120
