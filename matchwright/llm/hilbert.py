"""Operator 8: shards along a Hilbert curve over quantised metadata (DataFrame functions only).

Language, source and size are quantised to `BITS` bits each; the Hilbert index of such a cell keeps neighbours in all
three dimensions close, so runs of the sorted index make shards whose ranges of codes are narrow in every dimension and
can be skipped by `prunable`.  The index comes from a finite automaton (state and digit give index digit and next
state).  Rows are dealt by sampled ranges of (index, text hash, id), which no single cell, source or group of copies can
overfill, since the id is part of the range key; ranks are positions within a range plus the counts of earlier ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, stored, table

BITS, DIMS = 8, ("lang_code", "source_code", "size_code")


def automaton(n: int) -> list[int]:
    """For each state (entry corner, direction) and digit of one bit per dimension: next state * 2**n + index digit."""
    full = (1 << n) - 1

    def turn(x: int, k: int) -> int:
        k %= n
        return ((x << k) | (x >> (n - k))) & full

    def entry(w: int) -> int:
        x = 2 * ((w - 1) // 2) if w else 0
        return x ^ (x >> 1)

    def direction(w: int) -> int:
        trailing = lambda x: ((~x & (x + 1)).bit_length() - 1) if x >= 0 else 0
        return 0 if w == 0 else trailing(w - 1 if w % 2 == 0 else w) % n

    out = []
    for state in range((full + 1) * n):
        e, d = divmod(state, n)
        for digit in range(full + 1):
            t, w = turn(digit ^ e, -(d + 1)), 0
            for k in range(n):  # inverse Gray code
                w ^= t >> k
            e2, d2 = e ^ turn(entry(w), d + 1), (d + direction(w) + 1) % n
            out.append((e2 * n + d2) * (full + 1) + w)
    return out


def hilbert_index(codes: list[str], bits: int) -> Column:
    """Index of the cell whose coordinates are the named integer columns of `bits` bits."""
    n = len(codes)
    cells = ",".join(map(str, automaton(n)))
    digit = " | ".join(f"shiftleft(shiftright({c}, i) & 1, {n - 1 - k})" for k, c in enumerate(codes))
    step = f"element_at(array({cells}), acc.s * {1 << n} + ({digit}) + 1)"
    return F.expr(
        f"aggregate(sequence({bits - 1}, 0, -1), named_struct('s', 0, 'h', 0L), (acc, i) -> "
        f"transform(array({step}), x -> named_struct('s', shiftright(x, {n}), 'h', shiftleft(acc.h, {n}) | cast(x & {(1 << n) - 1} as bigint)))[0], acc -> acc.h)"
    )


def size_code(size: Column) -> Column:
    """Quantises a positive integer by its bit length and the next two bits; monotone, 8 bits."""
    length = F.length(F.bin(size)) - 1
    return (length * 4 + F.expr("cast(shiftright(shiftleft(size, 2), length(bin(size)) - 1) & 3 as int)")).cast("int")


def name_code(name: Column, bits: int = BITS) -> Column:
    """The first bits of a name's MD5; null counts as a name of its own.  Readers code the value they look for alike."""
    return F.conv(F.substring(F.md5(F.coalesce(name.cast("string"), F.lit("\0null"))), 1, 2), 16, 10).cast("int")


def hilbert_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, codes, hilbert, shard, slot) of every row: counts of shards differ by one at most.

    Size is the UTF-8 length plus 8 (null text: 8, CRC 0); null languages and sources have codes of their own; equal
    rows get neighbouring slots; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col], (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), name_code(docs["lang"]).alias(DIMS[0]), name_code(docs["source"]).alias(DIMS[1]))
    rows = rows.withColumn(DIMS[2], size_code(F.col("size"))).withColumn("hilbert", hilbert_index(list(DIMS), BITS))
    key = ["hilbert", "text_crc32", id_col]
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), *key).sortWithinPartitions(*key)
    dealt = stored(dealt.withColumn("at", F.monotonically_increasing_id()), "hilbert").withColumns({"part": F.shiftright("at", 33), "row": F.col("at").bitwiseAND((1 << 33) - 1)})
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    ranked = dealt.join(counts, "part").withColumn("rank", F.col("base") + F.col("row"))
    ranked = ranked.withColumn("shard", F.expr(f"cast(rank * {shards} div n as int)"))
    return ranked.select(id_col, "size", "text_crc32", *DIMS, "hilbert", "shard", F.expr(f"rank - (shard * n + {shards - 1}) div {shards}").alias("slot"))


def manifest(sharded: DataFrame) -> DataFrame:
    """Per shard, the least and greatest code of each dimension and the row count."""
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *[f(c).alias(f"{n}_{c}") for c in DIMS for n, f in (("min", F.min), ("max", F.max))])


def prunable(files: DataFrame, **ranges: tuple[int, int]) -> DataFrame:
    """The shards of a manifest that can hold rows within all given code ranges."""
    for c, (low, high) in ranges.items():
        files = files.where((F.col(f"max_{c}") >= low) & (F.col(f"min_{c}") <= high))
    return files


def op8_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` in 24 shards of equal counts along the Hilbert curve."""
    out = hilbert_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert", *DIMS)
