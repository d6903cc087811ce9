"""Operator 9: benchmark decontamination by spaced seeds.

Words are runs of letters and digits, in lower case (ASCII, Latin-1, Greek, Cyrillic); spaces and punctuation of Latin-1,
the General Punctuation block and CJK separate words too.  The 13 positions of a window fall into four interleaved groups;
each of the six fixed masks keeps two groups and ignores the other two, so a window with at most two substituted words
agrees with its original under at least one mask, wherever they are.  Hashes of the masked windows of the benchmark are
joined with those of the training texts; every hit fixes an item, a text and a diagonal, on which all words are then
compared.  A text is contaminated where a window of 13 words equals the item's in at least 11 words (0.85).

The windows of the benchmark are counted first.  Up to `block` of them (about 100 bytes each) are sent to the workers,
which join and verify where a text is read, so nothing is shuffled.  Beyond that both sides become rows (hash, words of
the window): a bit table of fixed size drops most training windows, the rest meet the benchmark's in a sort-merge join,
and the words of each pair are compared.  Both ways give the same rows: a window that differs in two words at most is
always a hit itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, stored, table
from .textbytes import byte_values, hash_of, mix, pieces, prefix_hash, spans, text_buffer

WINDOW, GROUPS, SUBSTITUTIONS = 13, 4, 2
#: Windows of the benchmark that are held at once (about 100 bytes each).
BLOCK = 400_000
#: Bits of the table that stands for a larger benchmark (a power of two).
BITS = 1 << 27


def masks() -> list[tuple[int, int]]:
    """The kept groups of each mask: all pairs of the groups k % GROUPS."""
    return [(a, b) for a in range(GROUPS) for b in range(a + 1, GROUPS)]


def normal(buf: np.ndarray) -> np.ndarray:
    """Bytes in lower case; what is neither letter nor digit as spaces.  Lengths stay the same."""
    t = np.arange(256, dtype=np.uint8)
    keep = np.zeros(256, bool)
    keep[48:58] = keep[65:91] = keep[97:123] = keep[128:] = True
    t[65:91] += 32
    t[~keep] = 32
    out = t[buf]
    if len(buf) < 2 or not (buf >= 0x80).any():
        return out
    lead, tail = buf[:-1], buf[1:]
    up = lambda low, high, first: (lead == first) & (tail >= low) & (tail <= high)
    for first, low, high, move, other in ((0xC3, 0x80, 0x9E, 0x20, 0), (0xCE, 0x91, 0x9F, 0x20, 0), (0xCE, 0xA0, 0xA9, -0x20, 0xCF), (0xD0, 0x90, 0x9F, 0x20, 0), (0xD0, 0xA0, 0xAF, -0x20, 0xD1), (0xD0, 0x80, 0x8F, 0x10, 0xD1)):
        at = np.flatnonzero(up(low, high, first))
        out[at + 1] = out[at + 1].astype(np.int16) + move
        if other:
            out[at] = other
    letters = np.isin(tail, (0xAA, 0xB5, 0xBA))  # of the block C2: feminine and masculine ordinals, micro
    for at in (np.flatnonzero((lead == 0xC2) & ~letters), np.flatnonzero(up(0x97, 0x97, 0xC3) | up(0xB7, 0xB7, 0xC3))):
        out[at], out[at + 1] = 32, 32
    for at in (np.flatnonzero(up(0x80, 0x81, 0xE2)), np.flatnonzero(up(0x80, 0x80, 0xE3))):
        for k in range(3):
            out[np.minimum(at + k, len(out) - 1)] = 32
    return out


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words; per text, the index of its first word."""
    low, sep = normal(buf), np.zeros(256, bool)
    sep[32] = True
    starts, ends, first = spans(low, offs, sep)
    return hash_of(prefix_hash(low, byte_values()), starts, ends), first


def masked(words: np.ndarray) -> list[np.ndarray]:
    """For each mask, the hashes of the windows that start at each word."""
    n = max(0, len(words) - WINDOW + 1)
    odd = mix(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)
    part = [np.zeros(n, np.uint64) for _ in range(GROUPS)]
    for k in range(WINDOW):
        part[k % GROUPS] += words[k : k + n] * odd[k]
    return [mix(part[a] + part[b] * np.uint64(3)) ^ np.uint64(i) for i, (a, b) in enumerate(masks())]


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """Whether the window at each word stays in its text."""
    ok = np.zeros(n, bool)
    size = np.maximum(np.diff(first) - WINDOW + 1, 0)
    at = np.repeat(first[:-1], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    ok[at] = True
    return ok


class Seeds:
    """The masked windows of some benchmark items, sorted by hash, behind a bit table."""

    def __init__(self, ids: list, texts: list[str | None]):
        col = pa.array(texts, pa.string())
        self.ids = ids
        self.words, self.first = word_hashes(*text_buffer(col))
        at = np.flatnonzero(inside(self.first, len(self.words)))
        hashes = [h[at] for h in masked(self.words)] if len(at) else []
        order = np.argsort(np.concatenate(hashes)) if hashes else np.zeros(0, np.int64)
        self.hash = np.concatenate(hashes)[order] if hashes else np.zeros(0, np.uint64)
        self.at = np.tile(at, len(hashes))[order] if hashes else np.zeros(0, np.int64)
        self.bits = np.uint64(64 - max(16, (16 * max(1, len(self.hash))).bit_length()))
        self.seen = np.zeros(1 << (64 - int(self.bits)), bool)
        self.seen[self.hash >> self.bits] = True

    def hits(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (text, item, diagonal) of all seed hits; the diagonal is a text's word index less the item's."""
        if len(words) < WINDOW or not len(self.hash):
            return np.zeros((0, 3), np.int64)
        ok, found = inside(first, len(words)), []
        for h in masked(words):
            x = np.flatnonzero(self.seen[h >> self.bits] & ok[: len(h)])
            lo, hi = np.searchsorted(self.hash, h[x], "left"), np.searchsorted(self.hash, h[x], "right")
            n = hi - lo
            x, k = np.repeat(x, n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item = np.searchsorted(self.first, self.at[k], "right") - 1
            text = np.searchsorted(first, x, "right") - 1
            found.append(np.stack([text, item, x - first[text] - self.at[k] + self.first[item]], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def verified(self, words: np.ndarray, first: np.ndarray) -> list[tuple]:
        """(text, item, start, end, matched): runs of text words within windows that equal an item's but for two words."""
        out = []
        for text, item, diagonal in self.hits(words, first).tolist():
            mine, yours = words[first[text] : first[text + 1]], self.words[self.first[item] : self.first[item + 1]]
            a, b = max(0, -diagonal), min(len(yours), len(mine) - diagonal)
            same = np.concatenate([[0], np.cumsum(mine[a + diagonal : b + diagonal] == yours[a:b])])
            good = np.flatnonzero(same[WINDOW:] - same[:-WINDOW] >= WINDOW - SUBSTITUTIONS)
            if len(good):
                covered = np.zeros(b - a + 1, np.int64)
                np.add.at(covered, good, 1)
                np.add.at(covered, good + WINDOW, -1)
                covered = np.cumsum(covered)[:-1] > 0
                start, end = int(good[0]) + a + diagonal, int(good[-1]) + WINDOW + a + diagonal
                out.append((text, item, start, end, int(covered.sum()), int((covered & (np.diff(same) == 1)).sum())))
        return out


def windows_of(benchmark: DataFrame, text_col: str) -> int:
    """How many words, so windows at most, the benchmark has."""
    return benchmark.agg(F.coalesce(F.sum(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x00-\x20]+"))), F.lit(0))).first()[0]


def seeds_of(benchmark: DataFrame, id_col: str, text_col: str) -> Seeds:
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).orderBy("i").collect()
    return Seeds([r.i for r in rows], [r.t for r in rows])


def window_rows(texts: DataFrame, key: str, bits: np.ndarray | None = None) -> DataFrame:
    """(hash, key, at, words) of all masked windows of `texts` (key, text); only those in the bit table if there is one."""
    schema = T.StructType([T.StructField("hash", T.LongType()), T.StructField(key, texts.schema[key].dataType), T.StructField("at", T.LongType()), T.StructField("words", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            for a, b in pieces(offs):
                words, first = word_hashes(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                if len(words) < WINDOW:
                    continue
                ok = inside(first, len(words))
                for h in masked(words):
                    x = np.flatnonzero(ok[: len(h)] & (in_bits(bits, h) if bits is not None else True))
                    text = np.searchsorted(first, x, "right") - 1
                    own = words[x[:, None] + np.arange(WINDOW)].view(np.int64).reshape(-1)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * WINDOW, pa.int32()), pa.array(own))
                    yield pa.RecordBatch.from_arrays([pa.array(h[x].view(np.int64)), batch.column(0).take(pa.array(a + text)), pa.array(x - first[text]), lists], names=[f.name for f in schema])

    return in_batches(texts.select(key, "text"), run, schema)


def in_bits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - (len(bits) * 64).bit_length() + 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bit_table(hashes: DataFrame, size: int) -> np.ndarray:
    """A table of `size` bits with those of the first bits of all hashes set; the driver gets its words, size / 64 at most."""
    at = F.shiftrightunsigned("hash", 64 - size.bit_length() + 1)
    words = hashes.select(at.alias("x")).select(F.shiftright("x", 6).alias("w"), F.expr("shiftleft(1L, cast(x & 63 as int))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return out


def joined_windows(texts: DataFrame, key: str, benchmark: DataFrame, item_id: str, item_text: str, bits: int) -> DataFrame:
    """(key, item, at, diagonal, same): the windows of `texts` (key, text) that equal an item's but for two words, by a shuffled join."""
    items = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text"))
    seeds = stored(window_rows(items, "item").withColumnsRenamed({"at": "item_at", "words": "item_words"}), "seeds")
    met = window_rows(texts, key, bit_table(seeds, bits)).join(seeds, "hash")
    met = met.withColumn("same", F.expr("zip_with(words, item_words, (p, q) -> p = q)")).where(F.expr(f"size(filter(same, z -> z)) >= {WINDOW - SUBSTITUTIONS}"))
    return met.select(key, "item", "at", (F.col("at") - F.col("item_at")).alias("diagonal"), "same").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """(id, item, start_word, end_word, covered_words, equal_words): the contaminated passages, one row for each alignment.

    Texts and items that are null or shorter than 13 words match nothing; repeated rows give repeated matches; an empty
    benchmark gives no rows; very long texts are taken whole; other columns are not read.
    """
    item_kind = benchmark.schema[item_id].dataType
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_id, item_kind), *[T.StructField(c, T.LongType()) for c in ("start_word", "end_word", "covered_words", "equal_words")]])
    if windows_of(benchmark, item_text) > block:
        rows = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id")).alias("key"), F.col(text_col).cast("string").alias("text"))
        met = joined_windows(rows, "key", benchmark, item_id, item_text, bits)
        places = met.select("key", "item", "diagonal", "at", F.posexplode("same").alias("k", "same")).select("key", "item", "diagonal", (F.col("at") + F.col("k")).alias("place"), "same").distinct()
        found = places.groupBy("key", "item", "diagonal").agg(F.min("place").alias("start_word"), (F.max("place") + 1).alias("end_word"), F.count("*").alias("covered_words"), F.count_if("same").alias("equal_words"))
        return found.select(F.col("key.id").alias(id_col), F.col("item").alias(item_id), "start_word", "end_word", "covered_words", "equal_words")
    seeds = seeds_of(benchmark, item_id, item_text)

    def run(batches):
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            for a, b in pieces(offs):
                words, first = word_hashes(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                got = seeds.verified(words, first)
                if got:
                    text, item, *rest = zip(*got, strict=True)
                    ids = pa.array([seeds.ids[i] for i in item])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([a + t for t in text])), ids, *(pa.array(x, pa.int64()) for x in rest)], names=[f.name for f in schema])

    return in_batches(docs.select(F.col(id_col), F.col(text_col).cast("string")), run, schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """The rows of `docs` without a contaminated passage, with all their columns, whatever their names.

    Null, empty and short texts stay; repeated rows stay or go together; an empty benchmark leaves all rows; items that
    are null or shorter than 13 words match nothing; very long texts are taken whole.
    """
    if windows_of(benchmark, item_text) > block:
        text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
        texts = docs.select(F.md5(text).alias("key"), text.alias("text"))
        bad = stored(joined_windows(texts, "key", benchmark, item_id, item_text, bits).select("key").distinct(), "contaminated")
        return docs.join(bad, F.md5(text) == bad["key"], "left_anti")
    seeds, at = seeds_of(benchmark, item_id, item_text), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            buf, offs = text_buffer(batch.column(at))
            clean = np.ones(batch.num_rows, bool)
            for a, b in pieces(offs):
                words, first = word_hashes(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                clean[[a + x[0] for x in seeds.verified(words, first)]] = False
            yield batch.filter(pa.array(clean))

    return in_batches(docs, run, docs.schema)


def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated pairs of `documents` and `benchmark` items: one row per pair, with the most equal words of an alignment."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("equal_words").alias("equal_words"), F.max("covered_words").alias("covered_words"), F.min("start_word").alias("start_word"), F.count("*").alias("alignments"))
