"""Operator 2: SimHash near-duplicates, found by a self-join of binary tries.

A fingerprint sums up the XXH64 hashes of a text's word shingles, bit by bit.  Two distinct fingerprints within k bits
agree on at least one of k+1 blocks, so each distinct fingerprint goes to k+1 buckets (block number and its bits), and
the fingerprints of a bucket form a binary trie below that block.  The join walks pairs of trie nodes of equal depth
from (root, root) down: equal bits keep the errors of a pair, unlike bits add one, and a pair over the budget is
pruned with all that stands below.  A pair of nodes whose leaves are all in one component already is pruned too, so a
dense ball of fingerprints costs a spanning forest and not all its pairs.  Only distinct fingerprints are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, in_batches, partitions, stored, table, unite
from .textbytes import lower_table, mix, pieces, spans, text_buffer, word_table, xxh64

#: Node pairs that a step of the trie walk expands at once.
WALK = 1 << 17
#: Bands of least hashes and hashes of a band, for links by similarity; texts of a bucket up to which its pairs are listed.
BANDS, BAND_ROWS, SMALL = 25, 5, 16
#: Texts that a task compares at once, where a bucket has more than `SMALL`.
BLOCK = 256


def shingle_hashes(buf: np.ndarray, offs: np.ndarray, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the shingles of the texts buf[offs[i]:offs[i+1]], text by text, and how many each text has."""
    sep = word_table()
    low = lower_table()[buf]
    starts, ends, first = spans(low, offs, sep)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offs) - 1, np.int64)
    lens = ends - starts
    at = np.concatenate([[0], np.cumsum(lens + 1)])  # each word and one space
    joined = np.full(at[-1], 32, np.uint8)
    joined[np.arange(lens.sum()) + np.repeat(np.arange(len(lens)), lens)] = low[~sep[low]]
    counts = np.diff(first)
    per = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    begin = np.repeat(first[:-1], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    end = np.minimum(begin + shingle, np.repeat(first[1:], per))
    return xxh64(joined, at[begin], at[end] - 1 - at[begin], seed), per


def majority(h: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Fingerprints of texts from their shingles' hashes; zero for a text without a word."""
    out = np.zeros(len(per), np.uint64)
    full = np.flatnonzero(per)
    if len(full):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(per) - per)[full], axis=0, dtype=np.int64)
        out[full] = np.packbits(ones * 2 > per[full][:, None], axis=1, bitorder="little").reshape(-1).view("<u8")
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint bigint) of every row; texts are lower-cased in A-Z, a null text counts as empty."""
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))

    def run(batches):
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            parts = [majority(*shingle_hashes(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], shingle, seed)) for a, b in pieces(offs)]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], [id_col, "fingerprint"])

    return in_batches(rows, run, T.StructType([T.StructField(id_col, rows.schema[0].dataType), T.StructField("fingerprint", T.LongType())]))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def trie_links(v: np.ndarray, depth: int, budget: int) -> np.ndarray:
    """Components of the sorted distinct values v, linked when they agree in the first `depth` bits and differ in `budget` bits at most."""
    n = len(v)
    root = np.arange(n)
    if n < 2:
        return root
    ones: dict[int, np.ndarray] = {}

    def split(lo: np.ndarray, hi: np.ndarray, d: int) -> np.ndarray:
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum((v >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)])
        return hi - (ones[d][hi] - ones[d][lo])

    cuts = np.flatnonzero(np.diff(v >> np.uint64(64 - depth)) if depth else np.zeros(n - 1)) + 1
    lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [n]])
    many = hi - lo > 1
    stack = [(depth, lo[many], hi[many], lo[many], hi[many], np.zeros(many.sum(), np.int64))]
    change = np.concatenate([[0], np.cumsum(np.diff(root) != 0)])
    while stack:
        d, al, ah, bl, bh, err = stack.pop()
        if len(al) > WALK:
            half = len(al) // 2
            stack += [(d, *(x[half:] for x in (al, ah, bl, bh, err))), (d, *(x[:half] for x in (al, ah, bl, bh, err)))]
            continue
        same = (change[ah - 1] == change[al]) & (change[bh - 1] == change[bl]) & (root[al] == root[bl])
        al, ah, bl, bh, err = (x[~same] for x in (al, ah, bl, bh, err))
        leaf = (ah - al == 1) & (bh - bl == 1) & (al != bl)
        if leaf.any():
            x, y = al[leaf], bl[leaf]
            near = popcount(v[x] ^ v[y]) <= budget
            if near.any():
                root = unite(root, x[near], y[near])
                change = np.concatenate([[0], np.cumsum(np.diff(root) != 0)])
            al, ah, bl, bh, err = (x[~leaf] for x in (al, ah, bl, bh, err))
        if not len(al) or d > 63:
            continue
        am, bm, own = split(al, ah, d), split(bl, bh, d), al == bl
        pairs = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1), (am[~own], ah[~own], bl[~own], bm[~own], err[~own] + 1)]
        al, ah, bl, bh, err = (np.concatenate(x) for x in zip(*pairs, strict=True))
        keep = (ah > al) & (bh > bl) & (err <= budget) & ((al != bl) | (ah - al > 1))
        if keep.any():
            stack.append((d + 1, *(x[keep] for x in (al, ah, bl, bh, err))))
    return root


def links(prints: DataFrame, budget: int = 3) -> DataFrame:
    """Edges (a, b) that span the components of the distinct fingerprints (column fingerprint), linked within `budget` bits.

    A task holds the distinct fingerprints of its buckets, 8 bytes each: a bucket has those that agree in a block of 16
    bits, about 1 in 65,536 of all.
    """
    blocks = budget + 1
    width = 64 // blocks
    rotated = [F.when(F.lit(k == 0), F.col("fingerprint")).otherwise(F.shiftleft("fingerprint", width * k).bitwiseOR(F.shiftrightunsigned("fingerprint", 64 - width * k))) for k in range(blocks)]
    rows = prints.select("fingerprint").distinct().select(F.posexplode(F.array(*rotated)).alias("turn", "v")).withColumn("block", F.shiftrightunsigned("v", 64 - width))

    def run(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        turn, v = (np.concatenate(x) for x in zip(*got, strict=True))
        for k in np.unique(turn):
            part = np.sort(v[turn == k].view(np.uint64))
            root = trie_links(part, width, budget)
            moved = np.flatnonzero(root != np.arange(len(root)))
            back, away = np.uint64(width * int(k)), np.uint64(64 - width * int(k))
            ends = [((x >> back) | (x << away) if k else x).view(np.int64) for x in (part[moved], part[root[moved]])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["a", "b"])

    return in_batches(rows.repartition("turn", "block").select("turn", "v"), run, "a long, b long")


def classes(prints: DataFrame, budget: int, id_col: str) -> DataFrame:
    """`prints` (id, fingerprint, any other columns) with component_id: the least id reachable over fingerprints within `budget` bits."""
    least = prints.groupBy("fingerprint").agg(F.min(id_col).alias("least"))
    found = components(links(prints, budget))
    named = least.join(found, least["fingerprint"] == found["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(ids, "root").select("fingerprint", "component_id"), "fingerprint")


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row: the least id reachable over fingerprints within `budget` bits.

    Null or empty texts have fingerprint zero and are linked like any other; repeated rows come back as often as they
    came; a component whose ids are all null has a null component_id; other columns of `docs` are not read.
    """
    prints = stored(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints", few=True)
    return classes(prints, budget, id_col).select(id_col, "fingerprint", "component_id")


def band_keys(h: np.ndarray, per: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """Keys of the bands of each text with shingles (one row a text): the least of its hashes under `rows` orders a band."""
    first = (np.cumsum(per) - per)[per > 0]
    rng = np.random.default_rng(2)
    out = np.empty((len(first), bands), np.uint64)
    for k in range(bands):
        key = np.full(len(first), k, np.uint64)
        for add, times in rng.integers(0, 1 << 63, (rows, 2), dtype=np.uint64):
            key = mix(key ^ np.minimum.reduceat((h ^ add) * (times | np.uint64(1)), first))
        out[:, k] = key
    return out


def spanning_links(ids: np.ndarray, labels: np.ndarray, h: np.ndarray, per: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Ends of edges that unite what pairs of `similarity` or more unite, if texts of equal label are united already.

    One text after another is held against all texts of other components that have not had their turn, those with the
    most edges first: a text that links many others settles them early.  Only pairs within a component are left out.
    """
    n = len(ids)
    words, code = np.unique(h, return_inverse=True)
    both = np.unique(np.repeat(np.arange(n), per) * len(words) + code)
    text, code = np.divmod(both, max(1, len(words)))
    size = np.bincount(text, minlength=n)
    first = np.searchsorted(text, np.arange(n))
    comp = np.unique(labels, return_inverse=True)[1]
    waits, degree, mark = size > 0, np.zeros(n, np.int64), np.zeros(len(words), bool)
    a, b = [], []
    while waits.any() and (comp[waits] != comp[np.argmax(waits)]).any():
        c = np.argmax(np.where(waits, degree, -1))
        waits[c] = False
        other = np.flatnonzero(waits & (comp != comp[c]) & (np.minimum(size, size[c]) >= similarity * np.maximum(size, size[c])))
        if not len(other):
            continue
        own = code[first[c] : first[c] + size[c]]
        mark[own] = True
        at = np.cumsum(size[other]) - size[other]
        place = np.arange(size[other].sum()) + np.repeat(first[other] - at, size[other])
        shared = np.add.reduceat(mark[code[place]], at, dtype=np.int64)
        mark[own] = False
        hit = other[shared >= similarity * (size[other] + size[c] - shared)]
        degree[hit] += 1
        degree[c] += len(hit)
        comp[np.isin(comp, comp[hit])] = comp[c]
        a.append(np.minimum(ids[hit], ids[c]))
        b.append(np.maximum(ids[hit], ids[c]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links_in_blocks(blocks: DataFrame, texts: DataFrame, similarity: float, shingle: int, seed: int) -> DataFrame:
    """Edges (a, b) of `spanning_links` in each block (bucket, block) of `blocks` (bucket, block, id, label)."""

    def run(batches):
        def edges(rows):
            buf, offs = text_buffer(rows.column(4))
            got = [shingle_hashes(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], shingle, seed) for a, b in pieces(offs)]
            h, per = (np.concatenate(x) for x in zip(*got, strict=True))
            ends = spanning_links(rows.column(2).to_numpy(), rows.column(3).to_numpy(), h, per, similarity)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["a", "b"])

        held, last = [], None
        for batch in batches:
            bucket, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(bucket) != 0) | (np.diff(block) != 0)) + 1).tolist(), len(bucket)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if held and (bucket[i], block[i]) != last:
                    yield edges(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(batch.slice(i, j - i))
                last = (bucket[i], block[i])
        if held:
            yield edges(pa.Table.from_batches(held).combine_chunks())

    rows = blocks.join(texts, "id").select("bucket", "block", "id", "label", "text")
    return in_batches(rows.repartition("bucket", "block").sortWithinPartitions("bucket", "block"), run, "a long, b long")


def relabelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """`rows` (bucket, id, label, ..., n) with the labels that the edges (label_a, label_b) leave, of buckets that still have several."""
    found = components(edges.select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))).select(F.col("node").alias("label"), "root")
    now = rows.join(found, "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root")
    several = now.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    return stored(now.join(several, "bucket"), "unsettled")


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id bigint, md5, text) of every row with an id; a null text counts as empty."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.unhex(F.md5(text)).alias("md5"), text.alias("text")).where("id is not null")


def sketches(docs: DataFrame, shingle: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(id, md5, fingerprint, size, bands) of every row with an id, from one pass over its shingles: size counts distinct shingles, texts without a word have no bands."""
    rows = keyed_texts(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            buf, offs = text_buffer(batch.column(2))
            for a, b in pieces(offs):
                h, per = shingle_hashes(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], shingle, seed)
                keys = band_keys(h, per) if len(h) else np.zeros((0, BANDS), np.uint64)
                ends = np.concatenate([[0], np.cumsum((per > 0) * keys.shape[1])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(majority(h, per).view(np.int64)), pa.array(distinct(h, per)), lists], ["id", "md5", "fingerprint", "size", "bands"])

    return in_batches(rows, run, "id long, md5 binary, fingerprint long, size long, bands array<bigint>")


def distinct(h: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Number of distinct hashes of each text."""
    text = np.repeat(np.arange(len(per)), per)
    order = np.lexsort((h, text))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (np.diff(h[order]) != 0) | (np.diff(text[order]) != 0)
    return np.bincount(text[order][fresh], minlength=len(per))


def similar(nodes: DataFrame, texts: DataFrame, similarity: float = 0.8, shingle: int = 5, seed: int = 42) -> DataFrame:
    """Edges (a, b, label_a, label_b) between `nodes` (id, md5, label, size, bands) whose sets of shingles have a Jaccard similarity of `similarity` or more.

    Two texts that are 0.8 similar in shingles differ in about ten bits of 64, too many for a trie to prune, so these
    links come from bands of least hashes; a pair of 0.8 shares one of the 25 bands with probability 0.9999.  Every edge
    is checked by the exact similarity of the whole texts, which `texts` (id, md5, text) has; only those of nodes that share a
    band are moved.  Texts of equal label are united already and not compared.  Buckets of up to `SMALL` texts give all
    edges.  Larger ones give edges that unite exactly what all their edges would: first in blocks of about `BLOCK` texts,
    then, in buckets that are not one component by then, with the text of the most edges added to each block, and last,
    block against block, whatever is still apart.  Texts without a word have no edges; ids and labels are integers, one
    row each.
    """
    banded = nodes.select("id", "label", "size", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket", "n")
    met = stored(banded.join(shared, "bucket"), "buckets")
    few = met.where(F.col("n") <= SMALL)
    one, two = (few.select("bucket", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "label", "size")]) for x in "ab")
    like = (F.col("id_a") < F.col("id_b")) & (F.col("label_a") != F.col("label_b")) & (F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b"))
    pairs = stored(one.join(two, "bucket").where(like).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "label_a", "label_b").distinct(), "pairs")
    many = met.where(F.col("n") > SMALL).select("bucket", "id", "label", "n")
    named = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(many.select("id")).distinct().join(nodes.select("id", "md5"), "id")
    texts = stored(texts.join(named, ["id", "md5"], "left_semi").dropDuplicates(["id", "md5"]).select("id", "text"), "paired-texts")

    def checked(batches):
        for batch in batches:
            (one, ones), (two, twos) = (text_buffer(batch.column(k)) for k in (4, 5))
            ok = np.zeros(batch.num_rows, bool)
            for a, b in pieces(ones + twos):
                (x, xs), (y, ys) = (shingle_hashes(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], shingle, seed) for buf, offs in ((one, ones), (two, twos)))
                xs, ys = (np.concatenate([[0], np.cumsum(per)]) for per in (xs, ys))
                for i in range(b - a):
                    p, q = np.unique(x[xs[i] : xs[i + 1]]), np.unique(y[ys[i] : ys[i + 1]])
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    ok[a + i] = both >= similarity * (len(p) + len(q) - both)
            yield batch.select(["a", "b", "label_a", "label_b"]).filter(pa.array(ok))

    sides = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    names = "a", "b", "label_a", "label_b"
    edges = stored(in_batches(sides.select(*names, "text_a", "text_b"), checked, "a long, b long, label_a long, label_b long"), "checked")
    if many.isEmpty():
        return edges
    labels = many.select("id", "label").distinct()

    def compared(blocks: DataFrame) -> DataFrame:
        got = links_in_blocks(blocks, texts, similarity, shingle, seed).distinct()
        for x in "ab":
            got = got.join(labels.select(F.col("id").alias(x), F.col("label").alias(f"label_{x}")), x)
        return stored(got.select(*names), "compared")

    block = F.pmod(F.xxhash64("id", "bucket"), F.ceil(F.col("n") / BLOCK))
    edges = edges.unionByName(compared(many.withColumn("block", block)))
    wide = many.where(F.col("n") > BLOCK)
    if wide.isEmpty():
        return edges.distinct()
    wide = relabelled(wide, edges)
    if wide.isEmpty():
        return edges.distinct()
    degree = edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    hubs = wide.join(degree, "id").groupBy("bucket").agg(F.max(F.struct("degree", "id", "label")).alias("hub")).select("bucket", "hub.id", "hub.label")
    blocks = wide.withColumn("block", block).select("bucket", "block", "id", "label")
    added = blocks.select("bucket", "block").distinct().join(hubs, "bucket").select("bucket", "block", "id", "label")
    edges = edges.unionByName(compared(blocks.unionByName(added).distinct()))
    wide = relabelled(wide.withColumnRenamed("label", "was").join(labels, "id").drop("was"), edges)
    if wide.isEmpty():
        return edges.distinct()
    # ranges of (bucket, label, id), so that no bucket has to fit one task; a part is a run of at most BLOCK rows of a range
    key = ["bucket", "label", "id"]
    cut = wide.repartitionByRange(partitions(wide.sparkSession), *key).sortWithinPartitions(*key)
    cut = stored(cut.withColumn("part", F.floor(F.monotonically_increasing_id() / BLOCK)), "parts")
    parts = cut.groupBy("bucket", "part").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    left, right = (parts.select("bucket", *[F.col(c).alias(f"{c}_{x}") for c in ("part", "lo", "hi")]) for x in "ab")
    both = left.join(right, "bucket").where("part_a <= part_b and lo_a <> hi_b").withColumn("block", F.xxhash64("part_a", "part_b"))
    sides = both.select("bucket", "block", F.explode(F.array_distinct(F.array("part_a", "part_b"))).alias("part"))
    return edges.unionByName(compared(sides.join(cut, ["bucket", "part"]).select("bucket", "block", "id", "label"))).distinct()


def deduplicated(docs: DataFrame, shingle: int = 5, budget: int = 3, similarity: float = 0.8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group, the row of the least id: groups are the components over both kinds of links,
    of fingerprints within `budget` bits and of texts of `similarity` or more.

    Each distinct text is a node of the similarity search, labelled with its SimHash class, so a link that a later row of
    a class has is followed too.  Texts are hashed once; all that is shuffled of them are sketches, and the texts of nodes
    that share a band.  Ids are integers (others raise).  Null and empty texts are one group; rows with a null id cannot
    be named and stay; an id with several texts counts, and comes back, as one row of the least MD5; an empty table stays
    empty; all columns are kept, and may have any names.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be of an integer type")
    prints = sketches(docs, shingle, seed, id_col, text_col)
    prints = stored(prints.groupBy("id").agg(F.min(F.struct("md5", "fingerprint", "size", "bands")).alias("x")).select("id", "x.*"), "sketches")
    named = stored(classes(prints, budget, "id").withColumnRenamed("component_id", "label"), "classes")
    first = named.where("size > 0").groupBy("md5").agg(F.min("id").alias("first")).select("first")
    nodes = stored(named.join(first, F.col("id") == F.col("first")).select("id", "md5", "label", "size", "bands"), "nodes")
    edges = similar(nodes, keyed_texts(docs, id_col, text_col), similarity, shingle, seed)
    moved = components(edges.select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))).where("node <> root").select(F.col("node").alias("id"))
    kept = named.where("id = label").select("id", "md5").join(moved, "id", "left_anti")
    kept = kept.toDF("id", "md5")  # columns of its own, apart from those of docs
    md5 = F.unhex(F.md5(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
    rows = docs.join(kept, (docs[id_col] == kept["id"]) & (md5 == kept["md5"]), "left_semi").dropDuplicates([id_col])
    return rows.unionByName(docs.where(docs[id_col].isNull()))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of `documents`: 3-word shingles, XXH64 with seed 42, links within 3 bits."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
