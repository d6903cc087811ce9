"""Operator 10: removal of repeated 400-byte strings by a distributed, common-prefix-aware merge sort of suffixes.

Which suffixes are sorted.  Every 400-byte window has one anchor, the least k-gram among its first `WINDOW` positions.
That is a function of the window's bytes, so equal windows have their anchors at equal offsets; one anchor serves a run
of up to `WINDOW` neighbouring windows, so about one suffix in a hundred bytes is sorted instead of all.  A window can
only be repeated if the 201 bytes from its anchor on are: anchors whose hash of those is unique are left out first (the
approximation of distinguishing prefixes of distributed string sorting), and the rest are sorted in full.

The sort.  Each task sorts its suffixes (400 bytes from the anchor on, then the bytes before the anchor, backwards) and
cuts the run at splitters from a regular sample of all runs; runs travel front-coded, each entry with the length of the
prefix it shares with the one before.  A reducer merges its runs with a loser tree that keeps these lengths: two entries
are compared from their common known prefix on, or not at all if the lengths differ.  The lengths of the merged order
give the groups of suffixes that share 201 bytes, and within a group the windows of all entries are compared.

Skew.  Equal entries of a run travel as one, so a passage of a third of all texts is one entry for each run.  Splitters
may cut through a group; the windows of such groups are compared once more across reducers, by hash.  Texts that occur
twice or more are removed whole and take part once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, partitions, stored, table
from .textbytes import byte_values, hash_of, pieces, prefix_hash, spans, text_buffer, word_table

LENGTH, WINDOW, GRAM = 400, 200, 16
#: Words of a passage, and bytes of a word's code, for repeats by words.
PASSAGE, CODE = 51, 4
#: Bytes of entries that a task sorts as one run, and that a reducer compares at once (single groups may be larger).
RUN, COMPARE = 48 << 20, 4 << 20
#: Sampled suffixes for each range of the order.
SAMPLE = 24


def anchors(buf: np.ndarray, offs: np.ndarray, length: int, window: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first window, last window, hash of the bytes that all its windows hold from the anchor on), positions in `buf`."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    n = len(buf)
    if n < length:
        return none
    prefix = prefix_hash(buf, byte_values())
    at = np.arange(n - GRAM + 1)
    bits = np.uint64(n.bit_length())
    m = (hash_of(prefix, at, at + GRAM) >> bits << bits) | at.astype(np.uint64)  # ties go to the left
    span = 1
    while span * 2 <= window:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < window:
        m = np.minimum(m[: span - window], m[window - span :])
    count = np.maximum(np.diff(offs) - length + 1, 0)
    s = np.repeat(offs[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    if not len(s):
        return none
    a = (m[s] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1])
    first, last, a = s[cut], s[np.concatenate([cut[1:], [len(s)]]) - 1], a[cut]
    return np.searchsorted(offs, a, "right") - 1, a, first, last, hash_of(prefix, a, a + length - window + 1)


def anchor_rows(docs: DataFrame, length: int, window: int) -> DataFrame:
    """(md5, id, keys, at) of each row (md5, id, text) that has a window; at packs anchor, windows before it and the last window's offset."""

    def run(batches):
        for batch in batches:
            buf, offs = text_buffer(batch.column(2))
            rows, keys, packs = [], [], []
            for a, b in pieces(offs):
                text, at, first, last, key = anchors(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], length, window)
                if not len(text):
                    continue
                cut = np.concatenate([[0], np.flatnonzero(np.diff(text)) + 1])
                packed = (at - (offs[a + text] - offs[a])) << 16 | (at - first) << 8 | (at - last)
                rows += (a + text[cut]).tolist()
                keys += np.split(key.view(np.int64), cut[1:])
                packs += np.split(packed, cut[1:])
            index = pa.array(rows, pa.int64())
            lists = []
            for x in (keys, packs):
                ends = np.concatenate([[0], np.cumsum([len(v) for v in x])]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), *lists], ["md5", "id", "keys", "at"])

    return in_batches(docs, run, f"md5 binary, id {docs.schema['id'].dataType.simpleString()}, keys array<bigint>, at array<bigint>")


def entry(text: bytes, at: int, length: int) -> bytes:
    """The sorted string of an anchor: `length` bytes from it on (0xFF, which UTF-8 never has, after the end), then the bytes of its windows before it, backwards."""
    a = at >> 16
    right = text[a : a + length]
    return right + b"\xff" * (length - len(right)) + text[a - (at >> 8 & 255) : a][::-1]


def common(a: bytes, b: bytes, i: int) -> int:
    """Length of the common prefix of two strings that are known to share i bytes."""
    n = min(len(a), len(b))
    if a[i:n] == b[i:n]:
        return n
    w = 32
    while a[i : i + w] == b[i : i + w]:
        i += w
    while w > 1:
        w //= 2
        if a[i : i + w] == b[i : i + w]:
            i += w
    return i


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Shared prefix lengths, rest lengths and rests of sorted strings."""
    lcp, rest, last = [], [], b""
    for s in strings:
        k = common(last, s, 0)
        lcp.append(k)
        rest.append(s[k:])
        last = s
    return np.array(lcp, np.uint16), np.array([len(r) for r in rest], np.uint16), b"".join(rest)


def pack_run(strings: list[bytes], text: np.ndarray, at: np.ndarray, multi: np.ndarray) -> bytes:
    import zstandard

    lcp, rest, data = front_coded(strings)
    head = np.array([len(strings), len(data)], np.int64)
    raw = b"".join([head.tobytes(), lcp.tobytes(), rest.tobytes(), text.astype(np.int64).tobytes(), at.astype(np.int64).tobytes(), multi.astype(np.uint8).tobytes(), data])
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpack_run(blob: bytes):
    """(shared prefix with the entry before, string, text, at, multi) of a run's entries, in order."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, _ = np.frombuffer(raw, np.int64, 2)
    p, cols = 16, []
    for kind in (np.uint16, np.uint16, np.int64, np.int64, np.uint8):
        cols.append(np.frombuffer(raw, kind, n, p).tolist())
        p += int(n) * np.dtype(kind).itemsize
    last = b""
    for lcp, rest, text, at, multi in zip(*cols, strict=True):
        last = last[:lcp] + raw[p : p + rest]
        p += rest
        yield lcp, last, text, at, multi


def merged(runs: list):
    """Merges sorted front-coded runs by a loser tree; yields (prefix shared with the entry yielded before, string, text, at, multi).

    The tree holds, for each run's first entry, the length h of the prefix it shares with the last winner.  The entry
    with the greater h is the smaller one, without a look at the strings; only for equal h are bytes compared, from h on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (k - len(runs))
    h = [0] * k

    def beats(a: int, b: int) -> bool:
        x, y = heads[a], heads[b]
        if y is None:
            return True
        if x is None:
            return False
        if h[a] != h[b]:
            return h[a] > h[b]
        s, t = x[1], y[1]
        n = common(s, t, h[a])
        if s[n : n + 1] <= t[n : n + 1]:
            h[b] = n
            return True
        h[a] = n
        return False

    tree, up = [0] * (2 * k), list(range(k))
    winners = up
    level = k
    while level > 1:
        level //= 2
        up = []
        for i in range(level):
            a, b = winners[2 * i], winners[2 * i + 1]
            win = beats(a, b)
            tree[level + i] = b if win else a
            up.append(a if win else b)
        winners = up
    top = winners[0]
    while heads[top] is not None:
        _, s, text, at, multi = heads[top]
        yield h[top], s, text, at, multi
        heads[top] = now = next(runs[top], None)
        if now is not None:
            h[top] = now[0]
        node = (k + top) // 2
        while node:
            if beats(tree[node], top):
                tree[node], top = top, tree[node]
            node //= 2


def repeated_windows(entries: list[tuple], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, entry, window number, repeated) of all windows of the entries (string, multi, last), compared by their bytes.

    The string is turned round again: bytes before the anchor, then `length` bytes from it on; window j starts at byte j.
    """
    lefts = [len(x) - length for x, _, _ in entries]
    flat = np.frombuffer(b"".join(x[:length - 1 : -1] + x[:length] for x, _, _ in entries), np.uint8)
    sizes = np.array([len(x) for x, _, _ in entries])
    base = np.cumsum(sizes) - sizes
    count = np.array([left - last + 1 for left, (_, _, last) in zip(lefts, entries, strict=True)])
    of = np.repeat(np.arange(len(entries)), count)
    j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    prefix = prefix_hash(flat, byte_values())
    h = hash_of(prefix, base[of] + j, base[of] + j + length)
    _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
    multi = np.array([m for _, m, _ in entries], bool)
    return h, of, j, (times[inverse] > 1) | multi[of]


def sorted_runs(texts: DataFrame, splitters: list[bytes], spread: int, length: int) -> DataFrame:
    """(kind, dest, run, blob): front-coded runs for each range, and the windows that are repeated within a run."""

    def run(batches):
        task = TaskContext.get().partitionId()
        held: dict[bytes, list] = {}
        size, number = 0, 0

        def flush():
            nonlocal size, number
            strings = sorted(held)
            cut, done = [0], []
            for s in splitters:
                cut.append(int(np.searchsorted(np.array(strings, object), s, "left")) if strings else 0)
            cut.append(len(strings))
            kinds, dests, blobs = [], [], []
            for d, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                if b > a:
                    own = [held[s] for s in strings[a:b]]
                    kinds.append(0)
                    dests.append(d)
                    blobs.append(pack_run(strings[a:b], np.array([m[0][0] for m in own]), np.array([m[0][1] for m in own]), np.array([len(m) > 1 for m in own])))
                    done += [m for ms in own if len(ms) > 1 for m in ms[1:]]
            if done:  # the first member of an entry goes on with it; the others are settled here
                done = np.array(done, np.int64)
                to = done[:, 0] % spread
                order = np.argsort(to, kind="stable")
                parts, at = np.unique(to[order], return_index=True)
                for d, rows in zip(parts.tolist(), np.split(done[order], at[1:]), strict=True):
                    kinds.append(1)
                    dests.append(d)
                    blobs.append(rows.tobytes())
            held.clear()
            size, number = 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(dests, pa.int32()), pa.array([task << 20 | number] * len(kinds), pa.int64()), pa.array(blobs, pa.binary())], ["kind", "dest", "run", "blob"])

        for batch in batches:
            for i in range(batch.num_rows):
                no, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer()
                text = text.to_pybytes() if text is not None else b""
                for at in batch.column(2)[i].values.to_numpy().tolist():
                    s = entry(text, at, length)
                    members = held.setdefault(s, [])
                    if (no, at) not in members[-1:] and (no, at) not in members[:1]:
                        members.append((no, at))
                        size += len(s) if len(members) == 1 else 32
                if size > RUN:
                    yield flush()
        yield flush()

    return in_batches(texts.select("no", F.col("text").cast("binary"), "at"), run, "kind int, dest int, run long, blob binary")


def sampled(texts: DataFrame, every: int, length: int) -> list[bytes]:
    """One entry in `every`, by the hash of its text number and anchor."""

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                no = batch.column(0)[i].as_py()
                at = batch.column(2)[i].values.to_numpy()
                pick = at[((at.astype(np.uint64) + np.uint64(no % 2**63)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(every) == 0]
                if len(pick):
                    text = batch.column(1)[i].as_buffer().to_pybytes()
                    out += [entry(text, int(x), length) for x in pick]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["s"])

    return sorted(bytes(r.s) for r in in_batches(texts.select("no", F.col("text").cast("binary"), "at"), run, "s binary").toLocalIterator())


def merge_runs(runs: DataFrame, splitters: list[bytes], spread: int, length: int, window: int) -> DataFrame:
    """(kind, no, first, last, dest, blob): repeated windows of texts (kind 0), and windows to compare across ranges (kind 1)."""
    shared = length - window + 1

    def run(batches):
        state: dict = {"dest": None, "runs": []}

        def intervals(rows):
            rows = np.array(rows, np.int64).reshape(-1, 3)
            n = len(rows)
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)

        def settle(entries, opened):
            """entries: [string, members (text, at), multi]; opened: whether the entry's group goes on in another range."""
            h, of, j, again = repeated_windows([(s, m or len(ms) > 1, ms[0][1] & 255) for s, ms, m in entries], length)
            edge = np.flatnonzero(again[1:] != again[:-1]) + 1
            cut = np.unique(np.concatenate([[0], edge, np.flatnonzero(np.diff(of)) + 1]))
            out = []
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(h)], strict=True):
                if again[a]:
                    for no, at in entries[of[a]][1]:
                        lo = (at >> 16) - (at >> 8 & 255)
                        out.append((no, lo + j[a], lo + j[b - 1]))
            yield intervals(out)
            if opened.any():
                on = np.flatnonzero(opened[of])
                lo = np.array([(ms[0][1] >> 16) - (ms[0][1] >> 8 & 255) for _, ms, _ in entries])
                no = np.array([ms[0][0] for _, ms, _ in entries])
                rows = np.stack([h[on].view(np.int64), np.where(again[on], -1, no[of[on]]), lo[of[on]] + j[on]], axis=1)
                rows = rows[np.unique(rows[:, :2], axis=0, return_index=True)[1]] if len(rows) else rows
                to = rows[:, 0] % spread
                order = np.argsort(to, kind="stable")
                parts, at = np.unique(to[order], return_index=True)
                for d, part in zip(parts.tolist(), np.split(rows[order], at[1:]), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.array([d], pa.int32()), pa.array([part.tobytes()], pa.binary())], names)

        def merge(dest, blobs):
            low = splitters[dest - 1][:shared] if dest else None
            high = splitters[dest][:shared] if dest < len(splitters) else None
            entries, opened, size, group, last = [], [], 0, [], b""

            def close():
                nonlocal entries, opened, size
                is_open = group[0][0][:shared] in (low, high)
                if len(group) > 1 or is_open or group[0][2] or len(group[0][1]) > 1:
                    entries += group
                    opened += [is_open] * len(group)
                    size += sum(len(g[0]) for g in group)

            for lcp, s, text, at, multi in merged([unpack_run(b) for b in blobs]):
                if group and lcp == len(s) == len(last):
                    if (text, at) not in group[-1][1]:
                        group[-1][1].append((text, at))
                    group[-1][2] |= bool(multi)
                    continue
                if group and lcp < shared:
                    close()
                    group = []
                    if size > COMPARE:
                        yield from settle(entries, np.array(opened))
                        entries, opened, size = [], [], 0
                group.append([s, [(text, at)], bool(multi)])
                last = s
            if group:
                close()
            if entries:
                yield from settle(entries, np.array(opened))

        for batch in batches:
            for i in range(batch.num_rows):
                kind, dest, blob = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                if kind == 1:
                    rows = np.frombuffer(blob, np.int64).reshape(-1, 2)
                    a = rows[:, 1] >> 16
                    yield intervals(np.stack([rows[:, 0], a - (rows[:, 1] >> 8 & 255), a - (rows[:, 1] & 255)], axis=1))
                    continue
                if dest != state["dest"] and state["runs"]:
                    yield from merge(state["dest"], state["runs"])
                    state["runs"] = []
                state["dest"] = dest
                state["runs"].append(blob)
        if state["runs"]:
            yield from merge(state["dest"], state["runs"])

    names = ["kind", "no", "first", "last", "dest", "blob"]
    dealt = runs.repartition(partitions(runs.sparkSession), "dest").sortWithinPartitions("kind", "dest", "run").select("kind", "dest", "blob")
    return in_batches(dealt, run, "kind int, no long, first long, last long, dest int, blob binary")


def across(found: DataFrame) -> DataFrame:
    """(no, first, last): windows of groups that splitters cut, if another range has the same bytes."""

    def run(batches):
        now, held = None, []

        def out():
            rows = np.concatenate(held)
            _, inverse, times = np.unique(rows[:, 0], return_inverse=True, return_counts=True)
            rows = rows[(times[inverse] > 1) & (rows[:, 1] >= 0)]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in (1, 2, 2)], ["no", "first", "last"])

        for batch in batches:
            for i in range(batch.num_rows):
                dest = batch.column(0)[i].as_py()
                if dest != now and held:
                    yield out()
                    held = []
                now = dest
                held.append(np.frombuffer(batch.column(1)[i].as_py(), np.int64).reshape(-1, 3))
        if held:
            yield out()

    dealt = found.where("kind = 1").select("dest", "blob").repartition("dest").sortWithinPartitions("dest")
    return in_batches(dealt, run, "no long, first long, last long")


def stripped(texts: DataFrame, length: int) -> DataFrame:
    """(no, n_removed, n_spans, kept_sha256) of texts (no, text, first array, last array of repeated windows)."""

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_buffer().to_pybytes()
                first, last = (batch.column(k)[i].values.to_numpy() for k in (2, 3))
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, last + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((batch.column(0)[i].as_py(), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["no", "n_removed", "n_spans", "kept_sha256"])

    return in_batches(texts, run, "no long, n_removed long, n_spans long, kept_sha256 string")


def repeats_removed(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row, repeated strings of `length` bytes removed.

    Null texts are empty and, like all texts under `length` bytes, keep what they have; equal texts of that size or more are
    removed whole; repeated rows come back as often as they came; ids may be null; other columns are not read.
    `window` (of 255 at most, and under `length` less the 16 bytes of a gram) sets how many windows share an anchor.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.unhex(F.md5(text)).alias("md5"), F.col(id_col).alias("id"), text.alias("text"))
    slim = stored(rows.select("id", "md5", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "suffix-rows", few=True)
    groups = stored(slim.groupBy("md5").agg(F.count("*").alias("n"), F.min("id").alias("rep")), "suffix-texts")

    long_rows = rows.where(F.octet_length("text") >= length)
    once = groups.select(F.col("md5").alias("g_md5"), "rep", "n")
    found = anchor_rows(long_rows, length, window).join(once, (F.col("md5") == F.col("g_md5")) & F.col("id").eqNullSafe(F.col("rep"))).dropDuplicates(["md5", "id"])
    found = stored(found.select(F.monotonically_increasing_id().alias("no"), "md5", "id", "n", "keys", "at"), "suffix-anchors")
    twice = found.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    twice = stored(twice, "suffix-keys")  # a side that is a plain exchange lets AQE split the key of a common passage
    left = found.select("no", F.explode(F.arrays_zip("keys", "at")).alias("x")).select("no", F.col("x.keys").alias("key"), F.col("x.at").alias("at"))
    left = left.join(twice, "key").groupBy("no").agg(F.array_sort(F.collect_list("at")).alias("at"))
    chosen = stored(found.select("no", "md5", "id").join(left, "no"), "suffix-chosen")
    chosen = chosen.select("no", F.col("md5").alias("c_md5"), F.col("id").alias("c_id"), "at")
    texts = stored(long_rows.join(chosen, (F.col("md5") == F.col("c_md5")) & F.col("id").eqNullSafe(F.col("c_id"))).select("no", "text", "at"), "suffix-strings")

    spread = partitions(spark)
    total = texts.agg(F.coalesce(F.sum(F.size("at")), F.lit(0))).first()[0]
    sample = sampled(texts, max(1, total // (SAMPLE * spread)), length)
    splitters = sorted({sample[i * len(sample) // spread] for i in range(1, spread)}) if sample else []
    merged_rows = stored(merge_runs(sorted_runs(texts, splitters, spread, length), splitters, spread, length, window), "suffix-merged")
    windows = merged_rows.where("kind = 0").select("no", "first", "last").unionByName(across(merged_rows))
    windows = windows.groupBy("no").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))
    alone = found.where("n = 1").select("no", "md5")  # copies go whole
    cut = stripped(texts.select("no", "text").join(windows.join(alone, "no"), "no").select("no", F.col("text").cast("binary"), "first", "last"), length)
    cut = cut.dropDuplicates(["no"]).join(alone, "no").drop("no")
    # a text of many copies is a hot key only here, in a join of two stored tables, which AQE can split
    marked = stored(slim.join(groups.where("n > 1").select("md5", F.lit(True).alias("copied")), "md5", "left"), "suffix-marked")
    whole = F.col("copied") & (F.col("n_bytes") >= length)
    copies = marked.where("copied").select(
        "id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(0).cast("bigint").alias("n_removed"), F.when(whole, 1).otherwise(0).cast("bigint").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("sha")).alias("kept_sha256"),
    )
    singles = marked.where("copied is null").drop("copied").join(cut, "md5", "left")
    singles = singles.select("id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("bigint")).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
    return copies.unionByName(singles).withColumnRenamed("id", id_col)


def word_codes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): each word of a row's text as `CODE` ASCII characters, a hash of its bytes; a null text is empty."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))

    def run(batches):
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            for a, b in pieces(offs):
                part = buf[offs[a] : offs[b]]
                starts, ends, first = spans(part, offs[a : b + 1] - offs[a], word_table())
                codes = (hash_of(prefix_hash(part, byte_values()), starts, ends) & np.uint64(0x7F7F7F7F)).astype("<u4")
                texts = pa.Array.from_buffers(pa.string(), b - a, [None, pa.py_buffer((first * CODE).astype(np.int32)), pa.py_buffer(codes.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), texts], [id_col, "text"])

    return in_batches(rows, run, T.StructType([T.StructField(id_col, rows.schema[0].dataType), T.StructField("text", T.StringType())]))


def passages(docs: DataFrame, words: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, passage_words) of every row: how many of its words stand in a passage of `words` words that also starts anywhere else.

    The same merge sort over word codes instead of bytes, so spaces and line breaks between words do not matter.  Null
    and empty texts have none; repeated rows come back as often as they came.
    """
    coded = stored(word_codes(docs, id_col, text_col), "word-codes", few=True)
    return repeats_removed(coded, words * CODE, min(WINDOW, words * CODE * 3 // 4), id_col).select(id_col, F.expr(f"n_removed div {CODE}").alias("passage_words"))


def op10_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 400-byte strings of all `documents`, and the words of each in passages of over 50 words that repeat.

    Rows that repeat a doc_id share the greatest passage_words of its rows.
    """
    docs = table(spark, sf_dir, "documents")
    found = passages(docs).groupBy(F.col("doc_id").alias("id")).agg(F.max("passage_words").alias("passage_words"))
    return stored(repeats_removed(docs), "suffix-bytes").join(found, F.col("doc_id").eqNullSafe(F.col("id"))).drop("id")
