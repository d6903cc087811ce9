"""The training-data operators against brute force, round trips and held-out accuracy, with odd rows."""

import base64
import glob
import gzip
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from matchwright.llm import common, hilbert, langid, lattice, line_crf, mixing, simhash, spaced_seeds, suffix_merge, textbytes, token_order, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string"


def words(rng, n, stem="abcdefgh"):
    return " ".join("".join(rng.choice(stem) for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    passage = words(rng, 120)
    base = words(rng, 200)
    out = [None, "", " \n\t ", "a", "É é ÉÀ ß", "the the the the " * 40, "x" * 3000, passage, base, base, base + " tail"]
    out += [words(rng, 60, "xyz") + " " + passage + "\n" + words(rng, 60, "mno") for _ in range(4)]
    out += [words(rng, rng.randint(1, 150)) + "\n" + words(rng, 20) for _ in range(20)] + ["line one two\nline one two\n" * 15, words(rng, 6000)]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None)[i % 3], 0, 1, "k") for i, t in enumerate(out)]
    return [*rows, rows[8], (None, "no id at all", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_xxh64_and_word_hashes():
    rng = random.Random(1)
    strings = [bytes(rng.randrange(256) for _ in range(n)) for n in [*range(70), 200, 1000]]
    buf = np.frombuffer(b"".join(strings), np.uint8)
    lens = np.array([len(s) for s in strings])
    assert textbytes.xxh64(buf, np.cumsum(lens) - lens, lens).tolist() == [xxhash.xxh64_intdigest(s, 42) for s in strings]


def test_simhash_classes(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    prints = []
    for r in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    group = list(range(len(rows)))
    for _ in rows:
        for i, j in itertools.combinations(range(len(rows)), 2):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                group[i] = group[j] = min(group[i], group[j])
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    want = Counter((r[0], p, least[g]) for r, p, g in zip(rows, prints, group, strict=True))
    assert Counter((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in got) == want


def test_trie_links_on_dense_balls():
    rng = np.random.default_rng(3)
    v = [0, 2**64 - 1]
    for _ in range(6):
        c = int(rng.integers(0, 2**63))
        v += [c] + [c ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 48, (60, 2))]
    v = np.unique(np.array(v, np.uint64))
    root = simhash.trie_links(v, 16, 3)
    want = np.arange(len(v))
    for _ in range(len(v)):
        for i, j in itertools.combinations(range(len(v)), 2):
            if int(v[i]) >> 48 == int(v[j]) >> 48 and (int(v[i]) ^ int(v[j])).bit_count() <= 3:
                want[i] = want[j] = min(want[i], want[j])
        if np.array_equal(want, root):
            break
    assert np.array_equal(want, root)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r.node, r.root) for r in common.components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    assert common.components(edges.limit(0)).count() == 0


def test_clear_deletes_what_was_stored(spark):
    out = common.stored(spark.range(3), "clear-test")
    (path,) = {f.rsplit("/", 1)[0] for f in out.inputFiles()}
    assert out.count() == 3 and common.clear(spark) >= 1 and not glob.glob(path.removeprefix("file:").replace("//", "/") + "/*") and common.clear(spark) == 0


def test_first_of_class_is_exact(spark):
    key = lambda i: xxhash.xxh64_intdigest(str(i)) - (1 << 63)
    rows = [(i, "hot" if i % 10 else f"rare{i % 3}", key(i)) for i in range(3000)] + [(7, "hot", key(7))] * 50 + [(5000, "clump", key(5000))] * 400
    rows += [(6000 + i, "ties", 4) for i in range(100)]
    got = sorted(tuple(r) for r in common.first_of_class(spark.createDataFrame(rows, "_id long, _class string, _key long"), "_class", 20, "test").select("_id", "_class", "_key").collect())
    expected = set()
    for c in {r[1] for r in rows}:
        expected |= set(sorted((r for r in rows if r[1] == c), key=lambda r: (r[2], r[0]))[:20])
    assert got == sorted(expected)
    assert common.first_of_class(spark.createDataFrame([], "_id long, _class string, _key long"), "_class", 20, "test").isEmpty()


def test_repeated_training_rows_count_once(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en")] * 300 + [(2, "der hund und die katze", "de"), (3, None, "de"), (4, "le chat", None), (None, "x", "en")], "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang_pred) for r in langid.predictions(docs, langid.train(docs)).where("doc_id <= 2").collect()}
    assert got == {(1, "en"), (2, "de")}


def test_deduplicated_keeps_one_row(docs):
    kept = simhash.deduplicated(docs).collect()
    ids = [r.doc_id for r in kept]
    assert len(ids) == len(set(ids)) and {8, 7, None} <= set(ids) and 9 not in ids and set(kept[0].asDict()) == set(docs.columns)


def test_deduplicated_odd_rows(spark):
    """Clashing names, an id with several texts, ids of another type, empty and null texts."""
    rows = [(1, "a b c d e f", 0, "x"), (1, "g h i j k l", 1, "y"), (2, "a b c d e f", 2, "z"), (3, None, 3, None), (4, "", 4, ""), (None, "q", 5, "q"), (5, "g h i j k l", 6, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, md5 string")
    out = simhash.deduplicated(docs)
    least = min((0, 1), key=lambda i: hashlib.md5(rows[i][1].encode()).digest())
    want = {rows[least][2], rows[3][2], 5, 2 if least else 6}
    assert out.columns == docs.columns and {r.id for r in out.collect()} == want
    with pytest.raises(TypeError):
        simhash.deduplicated(docs.select(F.col("md5").alias("doc_id"), "text"))


def test_similar_edges_match_brute_force(spark):
    rng = random.Random(9)
    rows, n = [(0, None), (1, ""), (2, " "), (None, "x y")], 3
    for size in (3, 40, 200, 200, 300):
        base = words(rng, size).split()
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(size)] = words(rng, 1, "xyz")
            rows.append((n := n + 1, " ".join(w).upper()))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} if t and t.strip() else set() for i, t in rows if i is not None}
    want = {(i, j) for i, j in itertools.combinations(sorted(sets), 2) if sets[i] & sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.a, r.b) for r in similar_edges(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert similar_edges(docs.limit(0)).count() == 0 and simhash.deduplicated(docs.limit(0)).count() == 0
    kept = {r.doc_id for r in simhash.deduplicated(docs).collect()}
    assert None in kept and not any(i in kept and j in kept for i, j in want)


def similar_edges(docs):
    """Edges of `similar` between all distinct texts, each labelled with its own id."""
    nodes = simhash.sketches(docs, 5, 42, "doc_id", "text").where("size > 0").withColumn("label", F.col("id"))
    return simhash.similar(nodes, simhash.keyed_texts(docs, "doc_id", "text"))


def groups(ids, edges):
    """The least id of each id's component."""
    least = {i: i for i in ids}
    for _ in ids:
        before = dict(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    return least


@pytest.mark.parametrize("block", [256, 24])
def test_large_groups_match_brute_force(spark, monkeypatch, block):
    """Copies that are mostly linked by their base alone, the base in the middle of the ids, and the same again from another base."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(17)
    texts = {}
    for start in (0, 1000):
        base = [f"w{start}x{k}" for k in range(300)]
        for n in range(250):
            w = list(base)
            if n != 125:
                for at in rng.sample(range(10, 290, 20), 5):
                    w[at] = f"n{start}x{n}x{at}"
            texts[start + n] = w
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in texts.items()}
    near = [(i, j) for i, j in itertools.combinations(texts, 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = [(r.a, r.b) for r in similar_edges(docs).collect()]
    assert set(got) <= set(near) and groups(texts, got) == groups(texts, near)


def test_links_of_removed_rows_are_followed(spark):
    """A and B have one fingerprint, B and C are 0.8 similar, A and C are not: one group, as are C's own copies with D."""
    rng = random.Random(23)
    often, x, y, z = words(rng, 13, "abc") + " ", words(rng, 6, "def"), words(rng, 90, "ghi"), words(rng, 8, "jkl")
    texts = {1: often * 150 + x, 2: often * 150 + y, 3: often * 2 + y, 4: often * 2 + y + " " + z, 5: words(rng, 90, "mno"), 6: often * 150 + y}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    near = [(i, j) for i, j in itertools.combinations(texts, 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert (2, 3) in near and (1, 2) not in near and (1, 3) not in near
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    prints = {r.doc_id: r.fingerprint % 2**64 for r in simhash.fingerprints(docs, 5).collect()}
    close = [(i, j) for i, j in itertools.combinations(texts, 2) if (prints[i] ^ prints[j]).bit_count() <= 3]
    assert (1, 2) in close and (1, 3) not in close
    assert {r.doc_id for r in simhash.deduplicated(docs).collect()} == set(groups(texts, near + close).values()) == {1, 5}


def test_base_counts(docs, rows):
    got = line_crf.quality(docs, line_crf.prior()).collect()
    want = Counter()
    for r in rows:
        w, text = WORD.findall(r[1] or ""), r[1] or ""
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want[r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)] += 1
    assert Counter(tuple(r)[:6] for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(0)
    field = line_crf.Field(rng.normal(size=len(line_crf.FEATURES)), rng.normal(size=2), rng.normal(size=(2, 2)))
    first = np.array([0, 1, 1, 5, 12])
    x = rng.normal(size=(12, len(line_crf.FEATURES)))
    got = line_crf.viterbi(field, x, first)
    for a, b in zip(first, first[1:], strict=False):
        if b > a:
            score = lambda y, a=a: field.begin[y[0]] + sum(field.trans[p, q] for p, q in zip(y, y[1:], strict=False)) + sum(s * (x[a + i] @ field.emit) for i, s in enumerate(y))
            assert tuple(got[a:b]) == max(itertools.product((0, 1), repeat=b - a), key=score)


def test_line_field_gradient():
    """Forward-backward against all labellings, and the gradient against differences."""
    rng = np.random.default_rng(1)
    k = len(line_crf.FEATURES)
    first, x = np.array([0, 1, 1, 4, 6]), rng.normal(size=(6, k))
    steps, theta = line_crf.chains(first), rng.normal(size=k + 6)
    content, begin, trans = x @ theta[:k], theta[k : k + 2], theta[k + 2 :].reshape(2, 2)
    p1, start, pairs, z = np.zeros(6), np.zeros(2), np.zeros((2, 2)), 0.0
    for a, b in ((0, 1), (1, 4), (4, 6)):
        ways = list(itertools.product((0, 1), repeat=b - a))
        w = np.exp([begin[y[0]] + sum(trans[p, q] for p, q in zip(y, y[1:], strict=False)) + sum(s * content[a + i] for i, s in enumerate(y)) for y in ways])
        z += np.log(w.sum())
        for y, part in zip(ways, w / w.sum(), strict=True):
            p1[a:b] += part * np.array(y)
            start[y[0]] += part
            for p, q in zip(y, y[1:], strict=False):
                pairs[p, q] += part
    got = line_crf.posteriors(content, begin, trans, steps)
    assert all(np.allclose(g, w) for g, w in zip(got, (p1, start, pairs, z), strict=True))
    wanted = line_crf.posteriors(rng.normal(size=6), rng.normal(size=2), rng.normal(size=(2, 2)), steps)[:3]
    _, grad = line_crf.likelihood(theta, x, steps, wanted)
    for i in range(len(theta)):
        e = np.zeros(len(theta))
        e[i] = 1e-5
        up, down = (line_crf.likelihood(theta + d, x, steps, wanted)[0] for d in (e, -e))
        assert abs((up - down) / 2e-5 - grad[i]) < 1e-6


def test_planted_boilerplate_lines(spark):
    """Lines of boilerplate within good texts are labelled as such, clean first lines of poor texts as content; labels are known for whole documents only."""
    rng = random.Random(12)
    good, bad, planted = [], [], {}
    for i in range(120):
        lines = [words(rng, 14).capitalize() + "." for _ in range(9)]
        if i % 3 == 0:
            planted[i] = rng.sample(range(9), 3)
            for at in planted[i]:
                lines[at] = rng.choice(["All rights reserved. Copyright login | cookies | privacy", "### " + " | ".join(words(rng, 6).split()), "SUBSCRIBE NOW!! CLICK HERE!! " + words(rng, 3).upper() + "!!"])
        good.append("\n".join(lines))
    for i in range(60):
        lines = [" | ".join(words(rng, 9).split()) if i % 2 else " ".join(w.upper() + "!!" for w in words(rng, 9).split()) for _ in range(7)]
        bad.append("\n".join([words(rng, 14).capitalize() + ".", *lines]))
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(180)], "doc_id long, quality int")
    field = line_crf.train(docs, labels, max_lines=4, max_windows=2)
    got = {}
    for r in sorted(line_crf.line_labels(docs, field).collect(), key=lambda r: (r.doc_id, r.start_byte)):
        got.setdefault(r.doc_id, []).append(r.content)
    wrong = {i: (planted.get(i), got[i]) for i in range(120) if got[i] != [at not in planted.get(i, ()) for at in range(9)]}
    assert not wrong, (len(wrong), list(wrong.items())[:4], field)
    assert all(got[i] == [True] + [False] * 7 for i in range(120, 180))
    assert {r.doc_id for r in line_crf.quality(docs, field).where("kept").collect()} == set(range(120))
    assert line_crf.line_labels(docs.limit(0), field).count() == 0


def test_line_field_learns(spark):
    rng = random.Random(2)
    good = ["\n".join(words(rng, 12).capitalize() + "." for _ in range(8)) for _ in range(30)]
    bad = ["\n".join(" ".join(w.upper() + "!!" for w in words(rng, 12).split()) for _ in range(8)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(60)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in line_crf.quality(docs, line_crf.train(docs, labels)).collect()}
    assert got == {i: i < 30 for i in range(60)}
    assert line_crf.train(docs, labels.limit(0)).emit.tolist() == list(line_crf.PRIOR)


def test_language_id(spark):
    rng = random.Random(4)
    data = [(i, words(rng, 40, "aeioubcdf" if i % 2 else "stuvwxyz"), "de" if i % 2 else "en") for i in range(200)] + [(900, None, "en"), (901, "123 !!", "de"), (902, "ЖЖ", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.train(docs.where(~langid.held_out()))
    got = {r.doc_id: r for r in langid.predictions(docs, model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].lang_score <= 1 for i, _, lang in data[:200])
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred in ("de", "en") and not got[901].lang_accepted
    assert {r.lang_pred for r in langid.predictions(docs, langid.train(docs.limit(0))).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.predictions(docs.withColumnRenamed("lang", "lang_pred"), model)


def test_language_rejection_and_logits(spark):
    """Held-out texts are accepted, other scripts, noise and halves of two languages are not; scores against a loop over subwords."""
    rng = random.Random(40)
    stems = {"en": "the and ing ther tion of to in er on".split(), "de": "der die und sch ung eit lich en ge ver".split(), "es": "que los ado cion mente de la el ar os".split()}
    make = lambda lang, n: " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    data = [(i, make(lang, rng.randint(8, 120)), lang) for i, lang in enumerate(["en", "de", "es"] * 200)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.train(docs.where(~langid.held_out()))
    held = langid.predictions(docs.where(langid.held_out()), model).collect()
    assert sum(r.lang_accepted and r.lang_pred == r.lang for r in held) >= 0.99 * len(held) > 100
    odd = ["Съешь же ещё этих мягких французских булок " * n for n in (1, 20)] + ["".join(rng.choice("bcfhjkmpqvwxz ") for _ in range(n)) for n in (60, 900)] + [make(a, 60) + " " + make(b, 60) for a, b in (("en", "de"), ("es", "en"), ("de", "es"))] + ["我能吞下玻璃而不伤身体", None, "", "12 34"]
    got = langid.predictions(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).collect()
    assert not any(r.lang_accepted for r in got) and len(got) == len(odd)

    def probability(text):
        x = langid.folded(np.frombuffer(text.encode(), np.uint8)).tolist()
        rows = []
        for k, n in enumerate(langid.LENGTHS):
            for i in range(len(x) - n + 1):
                w = sum(x[i + j] << 8 * j for j in range(n))
                rows.append((((w ^ w >> 15) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - (langid.BUCKETS.bit_length() - 1)) + k * langid.BUCKETS)
        z = (model.table[rows].astype(float).mean(axis=0) + model.bias) / model.temperature
        return np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    texts = {r[0]: r[1] for r in data}
    for r in held[:40]:
        p = probability(texts[r.doc_id])
        assert abs(p.max() - r.lang_score) < 1e-6 and model.langs[int(p.argmax())] == r.lang_pred


def test_warc_round_trip(spark):
    odd = "x" * 900 + "\r\n\r\nWARC/1.1\r\n" * 3 + "é" * 1000
    rows = [(1, "u", "a" * 5000), (2, "u", "a" * 5000), (3, None, None), (4, "u\r\nX: y", ""), (5, "u", odd), (None, "n", "zzz"), (6, "u", "WARC/1.1\r\n"), (6, "u", "WARC/1.1\r\n")]
    path = common.fresh(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path, chunk=777)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    to = {2: 1, 4: 3}
    want = Counter((i, len((t or "").encode()), sha(t), "revisit" if i in to else "response", to.get(i)) for i, _, t in rows)
    assert Counter(map(tuple, warc.read_warc(spark, path).collect())) == want


def test_warc_members(spark):
    """An archive is valid gzip, each record a member that can be read alone, each chunk within its bound."""
    rows = [(1, "u", "a" * 5000 + "é" * 900), (2, "v", "b"), (3, "w", None)]
    path = common.fresh(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, chunk=777)
    (file,) = glob.glob(path.removeprefix("file:") + "/part-*")
    raw = open(file, "rb").read()
    records = [gzip.decompress(x) for x in raw.split(warc.EMPTY)[:-1]]
    assert gzip.decompress(raw) == b"".join(records) and len(records) == 11
    assert all(r.startswith(b"WARC/1.1\r\n") and r.endswith(warc.END) and len(r) < 777 + 700 for r in records)
    got = warc.record_chunks(spark, path).collect()
    assert sorted((r.page, r.chunk, r.size) for r in got) == sorted([("1", k, min(777, 6800 - 777 * (k - 1))) for k in range(1, 10)] + [("2", 0, 1), ("3", 0, 0)])
    assert warc.read_warc(spark, path).count() == 3


@pytest.mark.parametrize("n", [3500, 5000, 70000])
def test_warc_long_headers(spark, n):
    """A URL longer than what the reader first looks at, in a whole record, in segments, and in a record that a revisit refers to."""
    rows = [(1, "http://x/" + "a" * n, "short"), (2, "é" * n, "b" * 3000), (3, "v", "b" * 3000), (4, "w", "end")]
    path = common.fresh(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path, chunk=777)
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = Counter((i, len(t), sha(t), "revisit" if i == 3 else "response", 2 if i == 3 else None) for i, _, t in rows)
    assert Counter(map(tuple, warc.read_warc(spark, path).collect())) == want


def test_warc_without_header_end_raises(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(warc.member(b"WARC/1.1\r\nWARC-Type: response\r\n" + b"x" * 9000))
    with pytest.raises(Exception, match="without the end of a header"):
        warc.record_chunks(spark, str(tmp_path)).collect()


def test_mixing(spark, docs):
    got = mixing.mixed(docs, share=0.5).collect()
    total = sum(len(WORD.findall(r.text or "")) for r in docs.collect())
    assert 0 < sum(r.n_tokens for r in got) <= total / 2
    assert mixing.mixed(docs, share=1.0, max_epochs=1).where("n_tokens > 0").count() == sum(bool(WORD.search(r.text or "")) for r in docs.collect())
    assert mixing.mixed(docs.limit(0)).count() == 0 and set(mixing.mixed_once(docs).columns) == set(docs.columns)


def test_mixed_once_matches_brute_force(spark):
    """The rows of each leaf are the prefix of its seeded order that its budget covers; clashing names, nulls and repeated rows."""
    rng = random.Random(77)
    rows = [(i if i % 17 else None, words(rng, rng.randint(0, 40)) if i % 11 else None, ("en", "de", None)[i % 3], f"src{i % 4}", i, "c") for i in range(300)]
    rows += rows[30:40]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, full long, _cut string")
    _, leaves = mixing.plan(docs, None, 0.6, 1)
    budgets = {tuple(r[k] for k in mixing.LEVELS): r.budget for r in leaves.collect()}
    assert sum(budgets.values()) == sum(len(WORD.findall(r[1] or "")) for r in rows) * 600 // 1000
    by_leaf = {}
    for r in rows:
        source = r[3]
        leaf = (f"domain{int(hashlib.md5(source.encode()).hexdigest()[0], 16) % 3}", r[2] or "none", source)
        by_leaf.setdefault(leaf, {}).setdefault(hashlib.md5(f"{mixing.SEED}:1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), []).append(r)
    want, full = Counter(), {tuple(r[k] for k in mixing.LEVELS): r.full for r in leaves.collect()}
    for leaf, keys in by_leaf.items():
        left = budgets[leaf]
        for k in sorted(keys):
            left -= sum(len(WORD.findall(r[1] or "")) for r in keys[k])
            if full[leaf] or left >= 0:
                want.update(keys[k])
    got = mixing.mixed_once(docs, 0.6)
    assert got.columns == docs.columns and Counter(map(tuple, got.collect())) == want
    assert mixing.mixed_once(docs.limit(0)).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("domain0", "en", "a", 10), ("domain0", "en", "b", 100), ("domain1", "en", "c", 100)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in mixing.allocate(leaves, 120, 0, 1, {"domain": {}}).collect()}
    assert got == {"a": 10, "b": 50, "c": 60}
    got = {r.source: r.budget for r in mixing.allocate(leaves, 190, 0, 1, {"domain": {"domain1": 9}}).collect()}
    assert got == {"a": 10, "b": 80, "c": 100}


def test_lattice_scores(spark, docs, rows):
    """Fit and score of the whole texts against a recursion over all segmentations, word by word."""
    vocabulary = [b"\xe2\x96\x81a", b"ab", b"a", b"b", b"bc", b"c", b"the", b"\xe2\x96\x81the", b"ef"]
    lat = lattice.Lattice(vocabulary)
    z = sum(1 / (r + 2.7) for r in range(len(vocabulary)))
    start = {bytes([b]): lattice.BYTE_MASS / 256 for b in range(256)}
    for r, p in enumerate(vocabulary):
        start[p] = start.get(p, 0) + (1 - lattice.BYTE_MASS) / (r + 2.7) / z
    start = {p: x * (1 - lattice.END_START) for p, x in start.items()}

    def tables(prob, s):
        """Sums over the segmentations of each prefix and suffix of s, scaled by 1 / 0.01 a byte against underflow."""
        front, back = [1.0] + [0.0] * len(s), [0.0] * len(s) + [1.0]
        for j in range(1, len(s) + 1):
            front[j] = sum(front[j - k] * prob[s[j - k : j]] * 100**k for k in range(1, min(j, 6) + 1) if s[j - k : j] in prob)
        for i in range(len(s) - 1, -1, -1):
            back[i] = sum(back[i + k] * prob[s[i : i + k]] * 100**k for k in range(1, min(len(s) - i, 6) + 1) if s[i : i + k] in prob)
        return front, back

    buf = np.frombuffer(b"abcxa", np.uint8)
    a, b = np.array([0, 0, 3]), np.array([3, 5, 5])
    word = lambda w: "▁".encode() + w
    want = [np.log(tables(start, word(bytes(buf[i:j])))[0][-1]) - (j - i + 3) * np.log(100) for i, j in zip(a, b, strict=True)]
    assert np.allclose(lat.marginals(buf, a, b), want)
    low = lambda t: [w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    short = [r for r in rows if not r[1] or max(map(len, r[1].split() or [""])) < 100]
    docs = docs.where("doc_id is null or text is null or text not like 'xxxxxxxxxx%'")
    assert docs.count() == len(short)
    training = docs.where("doc_id % 2 = 0")
    c = Counter(w for r in short if r[0] is not None and r[0] % 2 == 0 for w in low(r[1]))
    c_end = sum(r[0] is not None and r[0] % 2 == 0 for r in short)
    prob, end = start, lattice.END_START
    for _ in range(2):
        found = Counter()
        for w, times in c.items():
            s = word(w)
            front, back = tables(prob, s)
            for i in range(len(s)):
                for j in range(i + 1, min(len(s), i + 6) + 1):
                    if s[i:j] in prob:
                        found[s[i:j]] += times * front[i] * prob[s[i:j]] * 100 ** (j - i) * back[j] / front[-1]
        size = len(start) + 1
        total = sum(found.values()) + c_end + size
        prob, end = {p: (found[p] + size * start[p]) / total for p in start}, (c_end + size * lattice.END_START) / total
    marginal = lambda w: np.log10(tables(prob, word(w))[0][-1]) - 2 * (len(w) + 3)
    n, v = sum(c.values()) + c_end, len(c) + 1
    base = lambda k: np.log10((k + 1) / (n + v + 1))
    want = sorted((-1 if r[0] is None else r[0], round(sum(base(c[w]) for w in low(r[1])) + base(c_end), 4), round(sum(map(marginal, low(r[1]))) + np.log10(end), 4), len(low(r[1])) + 1, sum(c[w] > 0 for w in low(r[1])) + 1) for r in short)
    for head in (3, 100_000):
        got = sorted((-1 if r.doc_id is None else r.doc_id, round(r.base_score, 4), round(r.score, 4), r.n_tokens, r.n_known) for r in lattice.scores(docs, training, lat, rounds=2, head=head).collect())
        assert len(got) == len(want) and all(g[0] == w[0] and np.allclose(g[1:], w[1:], atol=2e-4) for g, w in zip(got, want, strict=True))
    assert lattice.scores(docs, docs.limit(0), lat).where("n_known > 0 or base_score <> 0 or score >= 0").count() == 0


def test_tokens_in_training_order(spark, docs, rows):
    ranks = token_order.load_ranks()
    tokens = token_order.Tokens(ranks)
    texts = [r[1] or "" for r in rows] + ["a  b   c", "  x\n\n y 12a!! é é  z", "it's we'll \t q  r"]
    ids, n = tokens.ids(*textbytes.text_buffer(pa.array(texts)))
    want = [[*tokens.encode(t), token_order.EOT] for t in texts]
    assert ids.tolist() == sum(want, []) and n.tolist() == [len(x) for x in want]
    path = common.fresh(spark, "shards-test")
    got = token_order.sequences(token_order.write_shards(docs, path, ranks, 64, 16), path, 64, 16).collect()
    assert sorted(r.slot for r in got) == sorted(r.sequence for r in got) == list(range(len(got)))
    assert sum(r.n_tokens for r in got) == sum(len(x) for x in want[: len(rows)])
    resumed = list(token_order.read_slots(path, 10, len(got), 64, 16))
    assert [zlib.crc32(np.ascontiguousarray(x)) for x in resumed] == [r.crc32 for r in sorted(got, key=lambda r: r.slot)][10:]
    for n in (1, 2, 3, 1000, 4097):
        f = token_order.feistel(np.arange(n), n, 7)
        assert sorted(f) == list(range(n)) and (token_order.feistel(f, n, 7, back=True) == np.arange(n)).all()


def test_training_order_ignores_splits(spark, docs, rows, tmp_path):
    """The same shards from the same files, however they are split, and the stream of ids in the order of files and rows."""
    path, ranks = str(tmp_path / "in"), token_order.load_ranks()
    docs.repartition(3).write.option("parquet.block.size", 4096).parquet(path)
    got = []
    for size in ("1g", "6k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            out = common.fresh(spark, "shards-test")
            read = spark.read.parquet(path)
            got.append((read.rdd.getNumPartitions(), sorted(map(tuple, token_order.sequences(token_order.write_shards(read, out, ranks, 64, 16), out, 64, 16).collect()))))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got[0][1] == got[1][1] and got[0][0] < got[1][0]
    tokens, ordered = token_order.Tokens(ranks), []
    for f in sorted(glob.glob(path + "/*.parquet")):
        ordered += [r.text or "" for r in spark.read.parquet(f).coalesce(1).collect()]
    stream = sum(([*tokens.encode(t), token_order.EOT] for t in ordered), [])
    slots = list(token_order.read_slots(out, 0, len(got[0][1]), 64, 16))
    joined = np.concatenate([slots[r[0]] for r in sorted(got[0][1], key=lambda r: r[3])]).tolist()
    assert joined[: len(stream)] == stream and set(joined[len(stream) :]) <= {token_order.PAD} and len(joined) - len(stream) < 64
    empty = common.fresh(spark, "shards-test")
    assert token_order.write_shards(docs.limit(0), empty, ranks, 64, 16).count() == 0


def test_hilbert(docs, rows):
    table, points = hilbert.automaton(3), {}
    for p in itertools.product(range(8), repeat=3):
        state = h = 0
        for i in (2, 1, 0):
            v = table[state * 8 + sum((p[k] >> i & 1) << (2 - k) for k in range(3))]
            state, h = v >> 3, h << 3 | v & 7
        points[h] = p
    assert len(points) == 512 and all(sum(abs(a - b) for a, b in zip(points[i], points[i + 1], strict=True)) == 1 for i in range(511))
    out = hilbert.hilbert_shards(docs, 5).collect()
    counts = Counter(r.shard for r in out)
    assert len(out) == len(rows) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in counts.items())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    files = hilbert.manifest(hilbert.hilbert_shards(docs, 5))
    assert hilbert.prunable(files, size_code=(0, 255)).count() == 5 and hilbert.hilbert_shards(docs.limit(0)).count() == 0


def test_spaced_seeds(spark):
    rng = random.Random(8)
    item = words(rng, 30).split()
    texts = {0: item[:], 1: item[:5], 2: item[8:22], 9: []}
    texts[3] = [w if i not in (10, 15) else "zz" for i, w in enumerate(item[:20])]
    texts[4] = [w if i % 4 else "zz" for i, w in enumerate(item)]
    docs = spark.createDataFrame([(i, words(rng, 40, "qrs") + " " + " ".join(t).upper() + ", " + words(rng, 40, "qrs"), 1) for i, t in texts.items()] + [(5, None, 1), (6, "", 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "too short")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in spaced_seeds.matches(docs, bench).collect()} == {(0, 7), (2, 7), (3, 7)}
    for block in (1, 1000):
        out = spaced_seeds.decontaminated(docs, bench, block=block, bits=1 << 16)
        assert {r.doc_id for r in out.collect()} == {1, 4, 5, 6, 9} and out.columns == docs.columns
        assert spaced_seeds.decontaminated(docs, bench.limit(0), block=block).count() == 8
    assert spaced_seeds.matches(docs, bench.limit(0)).count() == 0
    for a, b in itertools.combinations(range(spaced_seeds.WINDOW), 2):
        assert any(a % spaced_seeds.GROUPS not in m and b % spaced_seeds.GROUPS not in m for m in spaced_seeds.masks())


def test_spaced_seeds_match_brute_force(spark):
    """All windows of all texts against all windows of all items, by both ways; repeated rows, a hot passage and a very long text."""
    rng = random.Random(55)
    items = [words(rng, n).split() for n in (13, 20, 40, 12, 30)]
    items.append(items[1][:])
    rows = [(1, None), (2, ""), (3, " ".join(words(rng, 9000).split() + items[2] + words(rng, 3000).split()))]
    for i in range(60):
        w = list(rng.choice(items))
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "zz"
        cut = rng.randrange(0, max(1, len(w) - 12))
        rows.append((10 + i, words(rng, rng.randint(0, 9)) + " " + "\u201c" + "\u2014 ".join(w[cut:]).upper() + "\u00a0" + words(rng, rng.randint(0, 30))))
    rows += [rows[10], rows[10], (None, rows[12][1])]
    want = Counter()
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    for i, t in rows:
        x = split(t)
        for k, y in enumerate(items):
            for d in range(-len(y), len(x)):
                good = [p for p in range(max(0, d), min(len(x), len(y) + d) - 12) if sum(x[p + j] == y[p + j - d] for j in range(13)) >= 11]
                if good:
                    places = {p + j for p in good for j in range(13)}
                    want[i, k, good[0], good[-1] + 13, len(places), sum(x[p] == y[p - d] for p in places)] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(y)) for k, y in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    for block in (1, 10_000):
        assert Counter(map(tuple, spaced_seeds.matches(docs, bench, block=block, bits=1 << 16).collect())) == want
    assert len(want) > 30


def test_word_bytes_of_other_scripts():
    for text in ("ÀÉß Ωμέγα ΑΒΓ ЖЁЯ Ђ «quote» a–b “c”…d x×y 3º 你好、世界。 end", "é", "A", "Ω"):
        got = bytes(spaced_seeds.normal(np.frombuffer(text.encode(), np.uint8))).decode("utf-8", "replace")
        assert re.findall(r"\S+", got) == re.findall(r"\w+", text.lower().replace("µ", "µ"))


def test_repeats_removed(docs, rows):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    want = Counter()
    for r, t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[r[0], len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    assert Counter(map(tuple, suffix_merge.repeats_removed(docs).collect())) == want


def test_passages_of_words(spark, docs, rows):
    """Passages of 51 words, spaced otherwise or not, at every place; 50 words are none."""
    rng = random.Random(31)
    p, q = words(rng, 51), words(rng, 50)
    texts = [(100 + i, t) for i, t in enumerate([words(rng, 30) + " " + p, p.replace(" ", "  \n") + " " + words(rng, 9), "z " + q, q + " y", p[: len(p) // 2], words(rng, 70), "a b c d e " * 40])]
    texts += [(r[0], r[1]) for r in rows]
    split = [WORD.findall(t or "") for _, t in texts]
    seen = Counter(tuple(w[i : i + 51]) for w in split for i in range(len(w) - 50))
    want = Counter()
    for (i, _), w in zip(texts, split, strict=True):
        want[i, len({k + j for k in range(len(w) - 50) if seen[tuple(w[k : k + 51])] > 1 for j in range(51)})] += 1
    got = Counter(map(tuple, suffix_merge.passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()))
    assert got == want and want[100, 51] and want[101, 51] and want[102, 0]


def test_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(6)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(0, 30))) for _ in range(5)]
    blobs = [suffix_merge.pack_run(r, np.zeros(len(r)), np.zeros(len(r)), np.zeros(len(r))) for r in runs]
    got = list(suffix_merge.merged([suffix_merge.unpack_run(b) for b in blobs]))
    assert [g[1] for g in got] == sorted(sum(runs, []))
    assert all(g[0] == suffix_merge.common(last[1], g[1], 0) for last, g in zip(got, got[1:], strict=False))
