"""Operator 6: language-model scores from subword lattices.

A text is a sequence of pieces: each word, with the vocabulary's word mark before it, is cut into pieces, and one end
piece closes the text.  The forward recursion sums, in log space, over all segmentations of a word; pieces do not cross
words, so the marginal probability of a text is the product over its words and the end.

The vocabulary of a public tokenizer gives the pieces in the order of its scores, no probabilities.  A piece of rank r
starts in proportion to 1 / (r + 2.7) (Zipf-Mandelbrot), 256 byte pieces share `BYTE_MASS`, so every word has a lattice,
and `EM` rounds of expectation maximisation over the lattices of all training words (forward-backward, expected counts
weighted by exact word counts) fit the probabilities; the start keeps a weight of one count a piece, so none becomes zero.

Word counts are exact over all training texts, for the fit and for the base score.  Tokens among the `HEAD` most frequent
words (a table of fixed size on every worker) are counted where their text is read; all others travel as (row, word,
number) rows and meet their counts in one sort-merge join, so the word table is never gathered anywhere.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, stored, table
from .langid import held_out
from .textbytes import PIECE, byte_values, hash_of, lower_table, pieces, prefix_hash, spans, text_buffer, word_table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_MASS, END_START, EM, HEAD = 0.01, 0.002, 2, 100_000
#: Key of the end token in the count table.
END = -1
#: Distinct words, and bytes of them, that a worker keeps before it hands their counts on.
HOLD, HOLD_BYTES = 1 << 18, 8 << 20


class Lattice:
    """Log probabilities (natural) of a vocabulary's pieces by the hash of their bytes, and of the end; sums over segmentations."""

    def __init__(self, pieces_in_order: list[bytes]):
        distinct = list(dict.fromkeys(p for p in pieces_in_order if p))
        rank = 1 / (np.arange(len(distinct)) + 2.7)
        prob = {p: (1 - BYTE_MASS) * x for p, x in zip(distinct, (rank / rank.sum()).tolist(), strict=True)}
        for b in range(256):
            prob[bytes([b])] = prob.get(bytes([b]), 0.0) + BYTE_MASS / 256
        self.longest = max(map(len, prob))
        buf = np.frombuffer(b"".join(prob), np.uint8)
        ends = np.cumsum([len(p) for p in prob])
        h = hash_of(prefix_hash(buf, byte_values()), np.concatenate([[0], ends[:-1]]), ends)
        order = np.argsort(h)
        self.hash, self.start = h[order], np.append(np.array(list(prob.values()))[order] * (1 - END_START), END_START)
        self.logp = np.log(self.start)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hash >> np.uint64(44)] = True

    def refit(self, counts: np.ndarray) -> None:
        """Probabilities from expected counts (pieces in the order of `hash`, then the end), with the start as pseudo-counts."""
        counts = counts + len(counts) * self.start
        self.logp = np.log(counts / counts.sum())

    def arcs(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Words of one length at a time: (their indices, width, arcs (i, j, words, pieces) of the lattice by rising j)."""
        mark = np.frombuffer("▁".encode(), np.uint8)
        lens = ends - starts
        order = np.argsort(lens, kind="stable")
        sizes, at = np.unique(lens[order], return_index=True)
        values = byte_values()
        for size, a, b in zip(sizes.tolist(), at.tolist(), [*at[1:].tolist(), len(order)], strict=True):
            step = max(1, (1 << 18) // (size + 3))
            for k in range(a, b, step):
                idx = order[k : min(b, k + step)]
                n, width = len(idx), size + len(mark)
                flat = np.empty((n, width), np.uint8)
                flat[:, : len(mark)] = mark
                flat[:, len(mark) :] = buf[starts[idx][:, None] + np.arange(size)]
                prefix, base, found = prefix_hash(flat.ravel(), values), np.arange(n) * width, []
                for j in range(1, width + 1):
                    for i in range(max(0, j - self.longest), j):
                        h = hash_of(prefix, base + i, base + j)
                        hit = np.flatnonzero(self.seen[h >> np.uint64(44)])
                        if len(hit):
                            p = np.minimum(np.searchsorted(self.hash, h[hit]), len(self.hash) - 1)
                            real = self.hash[p] == h[hit]
                            if real.any():
                                found.append((i, j, hit[real], p[real]))
                yield idx, width, found

    def forward(self, n: int, width: int, found: list) -> np.ndarray:
        alpha = np.full((width + 1, n), -np.inf)
        alpha[0] = 0
        for i, j, hit, p in found:
            alpha[j, hit] = np.logaddexp(alpha[j, hit], alpha[i, hit] + self.logp[p])
        return alpha

    def marginals(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural log of the probability of the words buf[start:end], each with the vocabulary's word mark before it."""
        out = np.zeros(len(starts))
        for idx, width, found in self.arcs(buf, starts, ends):
            out[idx] = self.forward(len(idx), width, found)[width]
        return out

    def expected(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces over all segmentations of the words, each of which occurs so many times."""
        out = np.zeros(len(self.hash))
        for idx, width, found in self.arcs(buf, starts, ends):
            alpha, beta = self.forward(len(idx), width, found), np.full((width + 1, len(idx)), -np.inf)
            beta[width], whole = 0, alpha[width]
            which, shares = [], []
            for i, j, hit, p in reversed(found):
                from_here = self.logp[p] + beta[j, hit]
                beta[i, hit] = np.logaddexp(beta[i, hit], from_here)
                which.append(p)
                shares.append(np.exp(alpha[i, hit] + from_here - whole[hit]) * times[idx[hit]])
            out += np.bincount(np.concatenate(which), np.concatenate(shares), len(out))
        return out


def vocabulary(path: str = VOCABULARY) -> Lattice:
    """The pieces of a SentencePiece model, best score first; control, unknown and byte pieces are left out."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return Lattice([sp.id_to_piece(i).encode() for i in sorted(ids, key=lambda i: (-sp.get_score(i), i))])


def words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes, starts, ends, first word of each text, and hashes of the words."""
    low = lower_table()[buf]
    starts, ends, first = spans(low, offs, word_table())
    return low, starts, ends, first, hash_of(prefix_hash(low, byte_values()), starts, ends).view(np.int64)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word bigint, form binary, c): exact counts of all words (with their 64-bit hash) and of the end token, one for each row."""

    def run(batches):
        keys, counts, forms, rows = [], [], [], 0

        def merged():
            k, at, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            return k, np.bincount(inverse, np.concatenate(counts)).astype(np.int64), pa.concat_arrays(forms).take(pa.array(at))

        for batch in batches:
            buf, offs = text_buffer(batch.column(0))
            rows += batch.num_rows
            for a, b in pieces(offs):
                low, starts, ends, _, h = words_of(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                k, at, n = np.unique(h, return_index=True, return_counts=True)
                keys.append(k)
                counts.append(n)
                forms.append(cut_out(low, starts[at], ends[at]))
                if sum(map(len, keys)) > 2 * HOLD or sum(x.nbytes for x in forms) > 2 * HOLD_BYTES:
                    k, n, form = merged()
                    keys, counts, forms = [k], [n], [form]
                    if len(k) > HOLD or form.nbytes > HOLD_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(k), form, pa.array(n)], ["word", "form", "c"])
                        keys, counts, forms = [], [], []
        keys.append(np.array([END]))
        counts.append(np.array([rows]))
        forms.append(pa.array([b""], pa.binary()))
        k, n, form = merged()
        full = pa.array(n > 0)
        yield pa.RecordBatch.from_arrays([pa.array(k).filter(full), form.filter(full), pa.array(n).filter(full)], ["word", "form", "c"])

    return in_batches(docs.select(F.col(text_col).cast("string")), run, "word long, form binary, c long").groupBy("word", "form").agg(F.sum("c").alias("c"))


def cut_out(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings buf[start:end] as an Arrow array."""
    lens = ends - starts
    offs = np.concatenate([[0], np.cumsum(lens)])
    data = buf[np.arange(offs[-1]) + np.repeat(starts - offs[:-1], lens)]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data.tobytes())])


def fitted(lattice: Lattice, counts: DataFrame, rounds: int = EM) -> Lattice:
    """The lattice after `rounds` of expectation maximisation over all words of `counts` (word, form, c); the driver gets a number for each piece."""
    lattice = copy.copy(lattice)
    ends = counts.where(F.col("word") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    for _ in range(rounds if ends else 0):

        def run(batches, lattice=lattice):
            out, forms, times, size = np.zeros(len(lattice.hash)), [], [], 0

            def settle():
                buf, offs = text_buffer(pa.concat_arrays(forms))
                return lattice.expected(buf, offs[:-1], offs[1:], np.concatenate(times))

            for batch in batches:
                forms.append(batch.column(0))
                times.append(batch.column(1).to_numpy())
                size += batch.nbytes
                if size > PIECE:
                    out += settle()
                    forms, times, size = [], [], 0
            if forms:
                out += settle()
            used = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(out[used])], ["piece", "n"])

        got = in_batches(counts.where(F.col("word") != END).select("form", "c"), run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(len(lattice.hash) + 1)
        total[got["piece"].to_numpy()] = got["n"].to_numpy()
        total[-1] = ends
        lattice = copy.copy(lattice)
        lattice.refit(total)
    return lattice


def scores(docs: DataFrame, training: DataFrame, lattice: Lattice, rounds: int = EM, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, n_tokens, n_known, train_tokens, base_score, score (both log10).

    The score is the marginal probability of the whole text under the fitted lattice.  Null and empty texts are the end
    token alone; without training rows every count is zero, the base score is the sum of log10(1), and the score that of
    the start; repeated rows come back as often as they came; other columns are not read.
    """
    counts = stored(word_counts(training, text_col), "word-counts")
    lattice = fitted(lattice, counts, rounds)
    total = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    v, n = int(total["v"]), int(total["n"])
    # as many rows as `head` allows, whatever the corpus: what the driver gathers and sends has a bound
    top = counts.where(F.col("word") != END).select("word", "c").orderBy(F.desc("c"), "word").limit(head).toArrow()
    known, c_known = top["word"].to_numpy(), top["c"].to_numpy()
    order = np.argsort(known)
    known, c_known = known[order], c_known[order]
    ends = counts.where(F.col("word") == END).first()
    c_end = int(ends["c"]) if ends else 0
    all_base, log_end = n + v + 1, lattice.logp[-1] / np.log(10)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = rows.schema[0].dataType
    numbers = ("n_tokens", "n_known", "number", "word")
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField(id_col, kind), *[T.StructField(x, T.LongType()) for x in numbers], *[T.StructField(x, T.DoubleType()) for x in ("base_score", "score")]])

    def run(batches):
        at = TaskContext.get().partitionId() << 36
        cache_key, cached = known, np.full(len(known), np.nan)
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            for a, b in pieces(offs):
                low, starts, stops, first, h = words_of(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                m = b - a
                text = np.repeat(np.arange(m), np.diff(first))
                uniq, where, inverse = np.unique(h, return_index=True, return_inverse=True)
                spot = np.minimum(np.searchsorted(cache_key, uniq), max(0, len(cache_key) - 1))
                frequent = cache_key[spot] == uniq if len(cache_key) else np.zeros(len(uniq), bool)
                marginal = np.full(len(uniq), np.nan)
                marginal[frequent] = cached[spot[frequent]]
                new = np.flatnonzero(np.isnan(marginal))
                marginal[new] = lattice.marginals(low, starts[where[new]], stops[where[new]])
                cached[spot[frequent]] = marginal[frequent]
                c = np.zeros(len(uniq))
                c[frequent] = c_known[spot[frequent]]
                base = np.log10((c + 1) / all_base)
                on = frequent[inverse]
                own = {
                    "n_tokens": np.diff(first) + 1, "n_known": np.bincount(text[on], minlength=m) + (c_end > 0),
                    "base_score": np.bincount(text[on], base[inverse[on]], m) + np.log10((c_end + 1) / all_base), "score": np.bincount(text, marginal[inverse], m) / np.log(10) + log_end,
                }
                rare = np.flatnonzero(~on)
                pair, number = np.unique(text[rare] * len(uniq) + inverse[rare], return_counts=True)
                t, u = np.divmod(pair, max(1, len(uniq)))
                z = np.zeros(len(pair))
                ids = batch.column(0).slice(a, m)
                both = lambda x, y: pa.array(np.concatenate([x, y]))
                key = at + np.arange(m)
                spread = (key * 0x5851F42D4C957F2D).astype(np.int64) if m else key  # a row's own sums need no word
                yield pa.RecordBatch.from_arrays(
                    [
                        both(key, key[t]), pa.concat_arrays([ids, pa.nulls(len(t), ids.type)]), both(own["n_tokens"].astype(np.int64), np.zeros(len(t), np.int64)), both(own["n_known"].astype(np.int64), np.zeros(len(t), np.int64)),
                        both(np.zeros(m, np.int64), number.astype(np.int64)), both(spread, uniq[u]), both(own["base_score"], z), both(own["score"], z),
                    ],
                    names=[f.name for f in schema],
                )
                at += m

    parts = in_batches(rows, run, schema).join(counts.select("word", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    many = F.col("number") > 0
    return parts.groupBy("row").agg(
        F.max(id_col).alias(id_col),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("number")).otherwise(0)).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        F.sum(F.col("base_score") + F.when(many, F.col("number") * F.log10((F.col("c") + 1) / F.lit(float(all_base)))).otherwise(0.0)).alias("base_score"),
        F.sum("score").alias("score"),
    ).drop("row")


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all `documents`, learned from six of seven."""
    docs = table(spark, sf_dir, "documents")
    out = scores(docs, docs.where(~held_out(parts=7)), vocabulary())
    return out.select("doc_id", held_out(parts=7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
