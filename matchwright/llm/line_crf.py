"""Operator 1: quality rules by line labelling with a linear-chain conditional random field.

The lines of a text that hold a word form a chain with the states boilerplate (0) and content (1).  Emissions are a
linear function of `FEATURES` values of a line; Viterbi decoding takes the best labelling, and a text is kept if the
share of its words in content lines reaches `share` and it does not fail the base rules.

Labels are known for documents, not for lines, so the states of training lines are hidden.  The field is fitted on the
driver by expectation maximisation from the weights `PRIOR`: forward-backward posteriors of all lines are held to the
documents' labels only by a bound on the mean content share of either class (`CONTENT`; one offset a class, as in
posterior regularisation), then the conditional likelihood of these posteriors is raised by gradient steps (Adam, with a
ridge towards `PRIOR`).  A clean line of a poor document can thus stay content, and a licence line of a good one
boilerplate.  The sample is at most `per_class` labelled documents of either quality; chains are cut into windows of
`max_lines` lines, of which a document gives `max_windows` at most, evenly spaced.  Without labelled documents of both
classes `PRIOR` serves as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import first_of_class, in_batches, table
from .textbytes import byte_values, hash_of, mix, pieces, prefix_hash, spans, sums, text_buffer, word_table

FEATURES = ("bias", "log_words", "word_length", "symbols", "capitals", "exclamations", "echoes", "repeats", "twin_line", "digits", "sentence_end", "short", "cues", "bars")
#: Words that licence lines, notices and navigation are made of.
CUES = ("all rights reserved copyright license licensed licence licenced cookies cookie privacy terms subscribe newsletter login logout sign share click menu sitemap http https www").split()
#: Emission weights for content when nothing can be learned.
PRIOR = (2.0, 0.5, 0.0, -6.0, -4.0, -4.0, -6.0, -4.0, -2.0, -2.0, 1.0, -0.5, -6.0, -6.0)
#: Scores of staying in or leaving a state when nothing can be learned.
PRIOR_TRANS = ((0.5, 0.0), (0.0, 0.5))
PER_CLASS, MAX_LINES, MAX_WINDOWS, ROUNDS, STEPS = 800, 128, 8, 8, 30
#: Ridge of emissions, and of the chain: documents differ more from one another than lines within them, which must not glue a whole chain together.
RIDGE, CHAIN_RIDGE = 1e-3, 1e-1
#: Mean content share of lines, at most in documents of quality 0, at least in those of quality 1.
CONTENT = (0.15, 0.85)
MIN_WORDS, MAX_REPEAT, SHARE = 50, 50, 0.5


_CACHE: dict[str, np.ndarray] = {}


@dataclass
class Lines:
    """Base counts per text, and its lines with a word: first line of each text, byte spans, words, features."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    words: np.ndarray
    features: np.ndarray


def flags(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


def doubles(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a hash occurs twice or more, and whether an earlier one equals it."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.concatenate([[False], s[1:] == s[:-1]]) if len(h) else np.zeros(0, bool)
    twice, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order] = same
    twice[order] = same | np.concatenate([same[1:], [False]]) if len(h) else same
    return twice, later


def cue_hashes() -> np.ndarray:
    """Sorted hashes of the cue words in lower, title and upper case, alone or before a full stop or comma."""
    if "cues" not in _CACHE:
        forms = [f(w) + end for w in CUES for f in (str.lower, str.title, str.upper) for end in ("", ".", ",")]
        buf = np.frombuffer("".join(forms).encode(), np.uint8)
        ends = np.cumsum([len(w) for w in forms])
        _CACHE["cues"] = np.unique(hash_of(prefix_hash(buf, byte_values()), np.concatenate([[0], ends[:-1]]), ends))
    return _CACHE["cues"]


def read_lines(buf: np.ndarray, offs: np.ndarray) -> Lines:
    """All that the base rules and the field need of a run of texts."""
    n = len(offs) - 1
    starts, ends, first = spans(buf, offs, word_table())
    n_words = np.diff(first)
    total = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    points, symbols = total((buf & 0xC0) != 0x80), total(flags(b"#*$%&|<>")[buf])
    word_chars = points[ends] - points[starts] if len(starts) else np.zeros(0, np.int64)
    prefix = prefix_hash(buf, byte_values())
    wh = hash_of(prefix, starts, ends)
    text_of = np.repeat(np.arange(n), n_words)
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    repeat = np.zeros(len(wh), bool)
    if len(wh) >= 3:
        tri = mix(wh[:-2] * np.uint64(3) + mix(wh[1:-1] * np.uint64(5) + mix(wh[2:])))
        at = np.flatnonzero(text_of[:-2] == text_of[2:])
        twice, _ = doubles(tri[at] ^ salt[text_of[at]])
        for k in range(3):
            repeat[at[twice] + k] = True
    ls, le, _ = spans(buf, offs, flags(b"\n"))
    w0, w1 = np.searchsorted(starts, ls), np.searchsorted(starts, le)
    ls, le, w0, w1 = (x[w1 > w0] for x in (ls, le, w0, w1))
    lf = np.searchsorted(ls, offs)
    line_text = np.repeat(np.arange(n), np.diff(lf))
    twin, later = doubles(hash_of(prefix, ls, le) ^ salt[line_text])
    words = w1 - w0
    echo = np.concatenate([[False], (wh[1:] == wh[:-1]) & (text_of[1:] == text_of[:-1])]) if len(wh) else np.zeros(0, bool)
    upper, lower = total(flags(bytes(range(65, 91)))[buf]), total(flags(bytes(range(97, 123)))[buf])
    bangs, digits = total(flags(b"!")[buf]), total(flags(b"0123456789")[buf])
    tw = lambda mask: total(mask)[w1] - total(mask)[w0]
    of = lambda t: t[le] - t[ls]
    chars = (total_chars := np.concatenate([[0], np.cumsum(word_chars)]))[w1] - total_chars[w0]
    cues = cue_hashes()
    cue = cues[np.minimum(np.searchsorted(cues, wh), len(cues) - 1)] == wh
    bar = (ends - starts == 1) & flags(b"|<>*#/-_=~+")[buf[starts]] if len(starts) else np.zeros(0, bool)
    last = buf[ends[w1 - 1] - 1] if len(w1) else np.zeros(0, np.uint8)
    feats = np.stack(
        [
            np.ones(len(ls)), np.log1p(words) / 5, np.minimum(chars / words, 30) / 10, np.minimum(of(symbols) / words, 3) / 3, of(upper) / np.maximum(of(upper) + of(lower), 1),
            np.minimum(of(bangs) / words, 2) / 2, tw(echo) / words, tw(repeat) / words, twin.astype(float), np.minimum(of(digits) / np.maximum(chars, 1), 1), flags(b".!?")[last].astype(float), (words < 4).astype(float), tw(cue) / words, tw(bar) / words,
        ],
        axis=1,
    ) if len(ls) else np.zeros((0, len(FEATURES)))
    by_text = lambda v: sums(v.astype(np.int64), first)
    return Lines(n_words, by_text(word_chars), symbols[offs[1:]] - symbols[offs[:-1]], sums(later.astype(np.int64), lf), by_text(repeat), lf, ls, le, words, feats)


@dataclass
class Field:
    """Emission weights for content (boilerplate: zero), scores of the first state and of transitions from row to column."""

    emit: np.ndarray
    begin: np.ndarray
    trans: np.ndarray


def chains(first: np.ndarray) -> list[np.ndarray]:
    """For each step t, the line index of the t-th line of every chain that has one, longest chains first."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    sizes, begin = n[order], first[:-1][order]
    return [begin[: np.searchsorted(-sizes, -t, "left")] + t for t in range(int(sizes[0]) if len(sizes) else 0)]


def viterbi(field: Field, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best labelling of each chain; ties go to content."""
    label = np.zeros(len(features), np.int8)
    steps = chains(first)
    if not steps:
        return label
    content = features @ field.emit
    back = np.zeros((len(features), 2), np.int8)
    score = np.stack([np.full(len(steps[0]), field.begin[0]), field.begin[1] + content[steps[0]]], axis=1)
    final = [score]
    for at in steps[1:]:
        come = score[: len(at), :, None] + field.trans  # from, to
        pick = (come[:, 1] >= come[:, 0]).astype(np.int8)
        back[at] = pick
        score = np.where(pick == 1, come[:, 1], come[:, 0])
        score[:, 1] += content[at]
        final.append(score)
    state = np.zeros(0, np.int8)
    for t in range(len(steps) - 1, -1, -1):
        ends = (final[t][len(state) :, 1] >= final[t][len(state) :, 0]).astype(np.int8)
        state = np.concatenate([back[steps[t + 1], state] if len(state) else state, ends])
        label[steps[t]] = state
    return label


def posteriors(content: np.ndarray, begin: np.ndarray, trans: np.ndarray, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Forward-backward: content probability of each line, expected first states and transitions, log of the partition sums."""
    own = np.stack([np.zeros(len(content)), content], axis=1)
    alpha, beta, pairs = np.zeros_like(own), np.zeros_like(own), np.zeros((2, 2))
    links = [(a[: len(b)], b) for a, b in zip(steps, steps[1:], strict=False)]
    alpha[steps[0]] = begin + own[steps[0]]
    for a, b in links:
        alpha[b] = np.logaddexp(alpha[a, 0, None] + trans[0], alpha[a, 1, None] + trans[1]) + own[b]
    for a, b in reversed(links):
        to = own[b] + beta[b]
        beta[a] = np.logaddexp(trans[:, 0] + to[:, 0, None], trans[:, 1] + to[:, 1, None])
    post = alpha + beta
    z = np.logaddexp(post[:, 0], post[:, 1])
    p1 = np.exp(post[:, 1] - z)
    for a, b in links:
        pairs += np.exp(alpha[a][:, :, None] + trans + (own[b] + beta[b])[:, None, :] - z[b][:, None, None]).sum(axis=0)
    heads = steps[0]
    return p1, np.array([(1 - p1[heads]).sum(), p1[heads].sum()]), pairs, float(z[heads].sum())


def likelihood(theta: np.ndarray, features: np.ndarray, steps: list[np.ndarray], wanted: tuple) -> tuple[float, np.ndarray]:
    """Expected log likelihood a line under the posteriors `wanted` (lines, first states, transitions), less the ridge, and its gradient."""
    k, n = len(FEATURES), len(features)
    emit, begin, trans = theta[:k], theta[k : k + 2], theta[k + 2 :].reshape(2, 2)
    content = features @ emit
    p1, start, pairs, z = posteriors(content, begin, trans, steps)
    q1, q_start, q_pairs = wanted
    off, ridge = theta - start_weights(), np.concatenate([np.full(k, RIDGE), np.full(6, CHAIN_RIDGE)])
    value = (q1 @ content + q_start @ begin + (q_pairs * trans).sum() - z) / n - off @ (ridge * off) / 2
    return value, np.concatenate([features.T @ (q1 - p1), q_start - start, (q_pairs - pairs).ravel()]) / n - ridge * off


def start_weights() -> np.ndarray:
    return np.concatenate([np.array(PRIOR), np.zeros(2), np.array(PRIOR_TRANS).ravel()])


def held_to_labels(theta: np.ndarray, features: np.ndarray, steps: list[np.ndarray], label: np.ndarray) -> tuple:
    """Posteriors of lines, first states and transitions, with an offset a class where its content share misses `CONTENT`."""
    k = len(FEATURES)
    content, off = features @ theta[:k], np.zeros(2)
    low, high = np.array([-30.0, 0.0]), np.array([0.0, 30.0])
    for it in range(14):
        q1, start, pairs, _ = posteriors(content + off[label], theta[k : k + 2], theta[k + 2 :].reshape(2, 2), steps)
        if it == 13:
            break
        share = np.array([q1[label == c].mean() for c in (0, 1)])
        if it == 0:
            free = np.array([share[0] <= CONTENT[0], share[1] >= CONTENT[1]])
            if free.all():
                break
        else:
            over = share > CONTENT
            high, low = np.where(over, off, high), np.where(over, low, off)
        off = np.where(free, 0.0, (low + high) / 2)
    return q1, start, pairs


def fit(features: np.ndarray, first: np.ndarray, label: np.ndarray) -> Field:
    """Expectation maximisation with hidden line states; `label` has the document's quality for each line."""
    k, steps, theta = len(FEATURES), chains(first), start_weights()
    for _ in range(ROUNDS):
        wanted = held_to_labels(theta, features, steps, label)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for it in range(1, STEPS + 1):
            _, grad = likelihood(theta, features, steps, wanted)
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + 0.2 * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
    return Field(theta[:k], theta[k : k + 2], theta[k + 2 :].reshape(2, 2))


def prior() -> Field:
    return Field(np.array(PRIOR), np.zeros(2), np.array(PRIOR_TRANS))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_lines: int = MAX_LINES, max_windows: int = MAX_WINDOWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """The field learned from labelled documents (null ids, labels and texts are left out; an id labelled twice counts as its least label, one with several texts as the least text)."""
    key = F.xxhash64(F.col("_id").cast("string"))
    ids = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)").groupBy("_id").agg(F.min("_label").alias("_label"))
    ids = first_of_class(ids.withColumn("_key", key), "_label", per_class, "crf-sample")
    sample = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(ids, "_id")
    sample = sample.groupBy("_key", "_label", "_id").agg(F.min("_text").alias("_text"))

    def run(batches):
        for batch in batches:
            buf, offs = text_buffer(batch.column(2))
            got = []
            for i in range(len(offs) - 1):
                x = read_lines(buf[offs[i] : offs[i + 1]], offs[i : i + 2] - offs[i]).features.astype(np.float32)
                windows = -(-len(x) // max_lines)
                chosen = sorted({w * windows // max_windows for w in range(max_windows)}) if windows > max_windows else range(windows)
                got.append(b"".join(x[w * max_lines : (w + 1) * max_lines].tobytes() for w in chosen))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.binary())], ["key", "label", "features"])

    rows = in_batches(sample.select("_key", "_label", "_text"), run, "key long, label int, features binary").collect()
    rows = sorted((r.key, r.label, bytes(r.features)) for r in rows)
    texts = [(label, np.frombuffer(x, np.float32).reshape(-1, len(FEATURES))) for _, label, x in rows if x]
    chains_of = [(label, x[a : a + max_lines]) for label, x in texts for a in range(0, len(x), max_lines)]
    if {label for label, _ in chains_of} != {0, 1}:
        return prior()
    first = np.concatenate([[0], np.cumsum([len(x) for _, x in chains_of])])
    return fit(np.concatenate([x for _, x in chains_of]).astype(np.float64), first, np.concatenate([np.full(len(x), label) for label, x in chains_of]))


def quality(docs: DataFrame, field: Field, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share.

    Null and empty texts have no words, fail the base rules and have content share 0; repeated rows come back as often
    as they came; other columns are not read.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = T.StructType([T.StructField(id_col, rows.schema[0].dataType), *[T.StructField(c, T.LongType()) for c in counts], T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("content_share", T.DoubleType())])

    def run(batches):
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            for a, b in pieces(offs):
                x = read_lines(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                good = sums(x.words * (viterbi(field, x.features, x.first) == 1), x.first) / np.maximum(x.n_words, 1)
                failed = (x.n_words < MIN_WORDS) | (100 * x.n_repeat_words > MAX_REPEAT * x.n_words)
                cols = [getattr(x, c).astype(np.int64) for c in counts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c) for c in (*cols, failed, ~failed & (good >= share), good))], names=[f.name for f in schema])

    return in_batches(rows, run, schema)


def line_labels(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_byte, end_byte, n_words, content): every line with a word of every text, with its label.

    Null, empty and blank texts have no rows; repeated rows come back as often as they came; an empty table gives none;
    other columns are not read.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    schema = T.StructType([T.StructField(id_col, rows.schema[0].dataType), *[T.StructField(c, T.LongType()) for c in ("start_byte", "end_byte", "n_words")], T.StructField("content", T.BooleanType())])

    def run(batches):
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            for a, b in pieces(offs):
                x = read_lines(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                of = np.repeat(np.arange(a, b), np.diff(x.first))
                base = offs[of] - offs[a]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(x.start - base), pa.array(x.end - base), pa.array(x.words.astype(np.int64)), pa.array(viterbi(field, x.features, x.first) == 1)], names=[f.name for f in schema])

    return in_batches(rows, run, schema)


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and content share of every text of `documents`, with a field learned from `labels`."""
    docs = table(spark, sf_dir, "documents")
    return quality(docs, train(docs, table(spark, sf_dir, "labels")))
