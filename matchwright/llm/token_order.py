"""Operator 7: token sequences materialised in training order.

Texts become token ids of a public byte-level BPE, each followed by the end-of-text id.  In the order of the input's
files and rows, however they are split between tasks, they form one stream, of which each `LENGTH` ids are a sequence;
the last one is padded with `PAD`.  Tasks know their place in the stream from the token counts of the splits before
them; sequences that several splits share are put together where they are written.  A keyed Feistel network
on an even number of bits, walked along its cycle until it falls below the number of sequences, is a bijection from
sequence numbers to slots, so each sequence knows its place in training without a sort or a table.  Slots are dealt in
ranges; a range is one shard, a file of little-endian 16-bit ids with a fixed stride, so slot s is found by arithmetic
and a reader resumes anywhere (`read_slots`).  Shards are written under a temporary name and renamed, so a task that
runs again writes the same file again.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, in_batches, partitions, stored, table
from .textbytes import byte_values, hash_of, pieces, prefix_hash, text_buffer

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
EOT, PAD = 50256, 65535
LENGTH, PER_SHARD, KEY, ROUNDS = 1024, 4096, 7, 6
#: Shards of a range that is written together, at most.
PER_TASK = 8
#: Bytes of text tokenised at once, sequences in a packed row, and distinct chunks whose ids a worker remembers.
PIECE, PACK, REMEMBER = 4 << 20, 512, 400_000


def feistel(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A keyed bijection of 0..n-1 (or its inverse): a balanced Feistel network with cycle walking."""
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for r in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            start = right if not back else left
            f = (start + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            f = (f ^ (f >> np.uint64(32))) & mask
            left, right = (right ^ f, left) if back else (right, left ^ f)
        return (left << half) | right

    out = once(x.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Tokens:
    """Token ids of whole texts.  Texts are cut before spaces that follow a letter, digit or sign, where the tokenizer's
    pattern never joins, and every distinct chunk is tokenised once."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.encode = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[int, bytes] = {}
        self.values = byte_values()

    def ids(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text followed by EOT; ids per text."""
        n = len(offs) - 1
        ok = np.zeros(len(buf), bool)
        if len(buf) > 1:
            sign = (buf > 0x20) & (buf < 0x7F)
            sign[1:] |= (buf[1:] >= 0x80) & (buf[:-1] == 0xC3)
            ok[1:] = (buf[1:] == 0x20) & sign[:-1]
        ok[offs[:-1][offs[1:] > offs[:-1]]] = True
        starts = np.flatnonzero(ok)
        ends = np.concatenate([starts[1:], [len(buf)]]) if len(starts) else starts
        keys = hash_of(prefix_hash(buf, self.values), starts, ends)
        uniq, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        raw, known = bytes(buf), self.known
        if len(known) > REMEMBER:
            known.clear()
        got = []
        for key, a, b in zip(uniq.tolist(), starts[at].tolist(), ends[at].tolist(), strict=True):
            ids = known.get(key)
            if ids is None:
                ids = known[key] = np.array(self.encode(raw[a:b].decode("utf-8", "replace")), "<u2").tobytes()
            got.append(ids)
        got.append(np.array([EOT], "<u2").tobytes())
        flat, size = np.frombuffer(b"".join(got), "<u2"), np.array([len(x) // 2 for x in got])
        first = np.cumsum(size) - size
        ends_at = np.searchsorted(starts, offs[1:])
        order = np.insert(inverse, ends_at, len(got) - 1)
        lens = size[order]
        out = flat[np.repeat(first[order] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())]
        total = np.concatenate([[0], np.cumsum(lens)])
        return out, np.diff(np.concatenate([[0], total[ends_at + np.arange(n) + 1]]))


def pressed(ids: np.ndarray) -> bytes:
    """16-bit ids, compressed as they stand: common words repeat whole runs of ids."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(ids.astype("<u2").tobytes())


def unpressed(blob: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<u2")


def placed_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """(file, row, text): where each text stands in the input; a table that is no Parquet file has its partitions in place of files."""
    text = F.col(text_col).cast("string").alias("text")
    try:
        rows = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), text)
        rows.schema  # noqa: B018  resolves the columns
        return rows
    except AnalysisException:
        return docs.select(F.lpad(F.spark_partition_id().cast("string"), 10, "0").alias("file"), F.monotonically_increasing_id().alias("row"), text)


def packed(docs: DataFrame, ranks: dict[bytes, int], length: int = LENGTH, text_col: str = "text") -> DataFrame:
    """(file, split, first, n, ids): runs of n token ids, from the token number `first` of a split of a file on; a split is named by its first row."""

    def run(batches):
        tokens, rest, held, first, now, split, last = Tokens(ranks), [], 0, 0, None, 0, -1

        def out():
            nonlocal rest, held, first
            ids = np.concatenate(rest) if rest else np.zeros(0, "<u2")
            for k in range(0, len(ids), PACK * length):
                block = ids[k : k + PACK * length]
                yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([split], pa.int64()), pa.array([first], pa.int64()), pa.array([len(block)], pa.int64()), pa.array([pressed(block)], pa.binary())], ["file", "split", "first", "n", "ids"])
                first += len(block)
            rest, held = [], 0

        for batch in batches:
            buf, offs = text_buffer(batch.column(2))
            files, rows = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            codes = files.indices.to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(rows) < 0)) + 1).tolist(), len(rows)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                name = files.dictionary[int(codes[i])].as_py()
                if name != now or rows[i] < last:  # another split begins
                    yield from out()
                    now, split, first = name, int(rows[i]), 0
                last = rows[j - 1]
                for a, b in pieces(offs[i : j + 1], PIECE):
                    ids, _ = tokens.ids(buf[offs[i + a] : offs[i + b]], offs[i + a : i + b + 1] - offs[i + a])
                    rest.append(ids)
                    held += len(ids)
                    if held >= PACK * length:
                        yield from out()
        yield from out()

    return in_batches(placed_texts(docs, text_col), run, "file string, split long, first long, n long, ids binary")


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_shards(docs: DataFrame, path: str, ranks: dict[bytes, int], length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, text_col: str = "text") -> DataFrame:
    """Writes all texts as shards under `path`; the manifest (shard, first_slot, n, crc32, sequences in all) is returned.

    Null and empty texts are one end-of-text id; an empty table writes nothing; repeated rows are written as often as
    they come; other columns are not read.  Sequences are numbered along the input's files and rows, whatever its splits.
    """
    packs = stored(packed(docs, ranks, length, text_col), "token-packs")
    splits = stored(packs.groupBy("file", "split").agg(F.sum("n").alias("own")), "token-splits")  # of known size, so that Spark broadcasts it if small and need not shuffle the packs first
    files = splits.groupBy("file").agg(F.sum("own").alias("whole"))  # a row a file
    files = files.select("file", (F.sum("whole").over(Window.orderBy("file")) - F.col("whole")).alias("before"))
    base = (F.sum("own").over(Window.partitionBy("file").orderBy("split")) - F.col("own") + F.col("before")).alias("base")
    bases = stored(splits.join(files, "file").select("file", "split", base), "token-bases")
    tokens = splits.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0]
    total, shards = -(-tokens // length), -(-tokens // (length * per_shard))
    placed = packs.join(bases, ["file", "split"]).select((F.col("base") + F.col("first")).alias("first"), "ids")

    def deal(batches):
        held: dict[int, list] = {}
        count = 0

        def flush():
            for shard, rows in sorted(held.items()):
                where = [np.concatenate([r[k] for r in rows]) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in where[:2]), pa.array([pressed(where[2])], pa.binary())], ["shard", "starts", "sizes", "ids"])
            held.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                begin, ids = batch.column(0)[i].as_py(), unpressed(batch.column(1)[i].as_py())
                number = np.arange(begin // length, -(-(begin + len(ids)) // length))
                edge = np.concatenate([[begin], number[1:] * length, [begin + len(ids)]])
                slot, size = feistel(number, total, key), np.diff(edge)
                start = (slot % per_shard) * length + edge[:-1] % length  # of the part, in ids of its shard
                order = np.argsort(slot // per_shard, kind="stable")
                shard, at = np.unique((slot // per_shard)[order], return_index=True)
                for s, rows in zip(shard.tolist(), np.split(order, at[1:]), strict=True):
                    take = np.repeat(edge[rows] - begin - np.cumsum(size[rows]) + size[rows], size[rows]) + np.arange(size[rows].sum())
                    held.setdefault(s, []).append((start[rows], size[rows], ids[take]))
                count += len(ids)
                if count * 2 > 64 << 20:
                    yield from flush()
                    count = 0
        yield from flush()

    dealt = in_batches(placed, deal, "shard long, starts binary, sizes binary, ids binary")

    def write(batches):
        filesystem, top = opened(path)

        def close(shard, starts, sizes, ids):
            starts, sizes, ids = np.concatenate(starts), np.concatenate(sizes), np.concatenate(ids)
            n = min(per_shard, total - shard * per_shard)
            flat, filled = np.full(n * length, PAD, "<u2"), np.bincount(starts // length, sizes, n)
            flat[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] = ids
            wanted = np.full(n, length)
            last = int(feistel(np.array([total - 1]), total, key)[0])
            if last // per_shard == shard:
                wanted[last % per_shard] = tokens - (total - 1) * length
            if not np.array_equal(filled, wanted):
                raise ValueError(f"shard {shard} misses sequences")
            name, mine = f"{top}/shard-{shard:08d}.bin", f"{top}/.shard-{shard:08d}.{TaskContext.get().taskAttemptId()}"
            with filesystem.open_output_stream(mine) as f:
                f.write(flat.tobytes())
            filesystem.move(mine, name)
            return shard, shard * per_shard, n, zlib.crc32(flat), total

        now, held, done = None, ([], [], []), []
        for batch in batches:
            for i in range(batch.num_rows):
                shard = batch.column(0)[i].as_py()
                if shard != now and now is not None:
                    done.append(close(now, *held))
                    held = ([], [], [])
                now = shard
                for k in (0, 1):
                    held[k].append(np.frombuffer(batch.column(k + 1)[i].as_py(), np.int64))
                held[2].append(unpressed(batch.column(3)[i].as_py()))
        if now is not None:
            done.append(close(now, *held))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*done, strict=True) if done else [()] * 5)], ["shard", "first_slot", "n", "crc32", "total"])

    filesystem, top = opened(path)
    filesystem.create_dir(top, recursive=True)
    at_once = max(1, min(PER_TASK, shards // partitions(docs.sparkSession)))  # shards of a range: what a task writes does not grow with the input
    ranges = dealt.repartition(max(partitions(docs.sparkSession), -(-shards // at_once)), F.floor(F.col("shard") / at_once)).sortWithinPartitions("shard")
    return stored(in_batches(ranges, write, "shard long, first_slot long, n long, crc32 long, total long"), "shard-manifest")


def read_slots(path: str, begin: int, end: int, length: int = LENGTH, per_shard: int = PER_SHARD):
    """Sequences of the slots begin..end-1 in training order, read by offset; any slot can be the first."""
    filesystem, top = opened(path)
    while begin < end:
        shard, row = divmod(begin, per_shard)
        n = min(end - begin, per_shard - row)
        with filesystem.open_input_file(f"{top}/shard-{shard:08d}.bin") as f:
            f.seek(row * length * 2)
            got = np.frombuffer(f.read(n * length * 2), "<u2").reshape(-1, length)
        yield from got
        begin += n


def sequences(manifest: DataFrame, path: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """(slot, shard, row, sequence, n_tokens, crc32) of all sequences, from the shards as they are on disk; a changed shard raises."""

    def run(batches):
        filesystem, top = opened(path)
        for batch in batches:
            for i in range(batch.num_rows):
                shard, first, n, crc, total = (batch.column(k)[i].as_py() for k in range(5))
                with filesystem.open_input_stream(f"{top}/shard-{shard:08d}.bin") as f:
                    raw = f.read()
                if zlib.crc32(raw) != crc or len(raw) != n * length * 2:
                    raise ValueError(f"shard {shard} is not as it was written")
                ids = np.frombuffer(raw, "<u2").reshape(n, length)
                slot = first + np.arange(n)
                cols = [slot, np.full(n, shard), slot - first, feistel(slot, total, key, back=True), (ids != PAD).sum(axis=1), np.array([zlib.crc32(x) for x in ids])]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["slot", "shard", "row", "sequence", "n_tokens", "crc32"])

    return in_batches(manifest.repartition("shard"), run, "slot long, shard long, row long, sequence long, n_tokens long, crc32 long")


def op7_token_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` as token shards in training order, read back slot by slot."""
    path = fresh(spark, "token-shards")
    return sequences(write_shards(table(spark, sf_dir, "documents"), path, load_ranks()), path)
