"""Operator 3: language identification by averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its hashed 3- and 4-byte subwords (letters folded to lower case, other
characters to one space), followed by a linear layer.  Training is stochastic gradient descent in numpy on the driver,
over a bounded sample: at most `per_lang` documents of a language, chosen by a hash of their ids, of which executors
send only bucket counts.  Since both layers are linear, the trained model is one table of logits per bucket; a
prediction is an average of table rows over the whole text.  A temperature is fitted on a fifth of the sample,
and on pairs of its texts in two languages, which should come out as one half each.

Rejection is calibrated on that fifth, language by language, and asks for two things.  The calibrated probability must
reach the threshold that still accepts `accept` of the language, between `LEAST` and `MOST`: texts of several languages fail
here.  And the text's subwords must be usual ones of the language: their mean log frequency may fall short of the
language's mean by what the held-out documents show, plus three standard errors for the text's length: other languages,
other scripts and noise, which a softmax over known languages has to call one of them, fail here.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import first_of_class, in_batches, table
from .textbytes import pieces, text_buffer

#: Buckets per subword length (a power of two); the last bucket of the table is for positions without a subword.
BUCKETS = 1 << 14
LENGTHS = (3, 4)
DIM, EPOCHS, RATE, SEED = 16, 12, 4.0, 3
#: Documents of each language that training reads at most.
PER_LANG = 400
#: Languages that are learned at most, the most frequent ones.
LANGS = 256
#: Bounds of the least probability of an accepted text, and shortfall in mean log frequency (natural) that is always granted.
LEAST, MOST, GRANTED = 0.5, 0.8, 0.7


def folded(buf: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 letters in lower case and ASCII other than letters as space."""
    t = np.arange(256, dtype=np.uint8)
    t[:128] = 32
    t[97:123] = t[65:91] = np.arange(97, 123)
    out = t[buf]
    if len(buf) > 1:
        upper = (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97) & (buf[:-1] == 0xC3)
        out[1:][upper] += 0x20
    return out


def subwords(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """For each length, the bucket at each byte position; positions whose subword leaves the text have the last bucket."""
    x = np.concatenate([folded(buf), np.zeros(4, np.uint8)]).astype(np.uint32)
    n, out = len(buf), []
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    word = x[:n].copy()
    for k in range(1, max(LENGTHS)):
        word |= x[k : n + k] << np.uint32(8 * k)
        if k + 1 in LENGTHS:
            h = ((word ^ (word >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> shift
            h = h.astype(np.int32) + LENGTHS.index(k + 1) * BUCKETS
            tail = offs[1:, None] - np.arange(1, k + 1)
            h[tail[tail >= offs[:-1, None]]] = BUCKETS * len(LENGTHS)
            out.append(h)
    return out


def has_letter(column, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether a text has a letter of any script; texts without an ASCII letter are looked at one by one."""
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True
    total = np.concatenate([[0], np.cumsum(letter[buf])])
    out = total[offs[1:]] > total[offs[:-1]]
    for i in np.flatnonzero(~out & (offs[1:] > offs[:-1])):
        out[i] = any(c.isalpha() for c in bytes(buf[offs[i] : offs[i + 1]]).decode("utf-8", "replace"))
    return out


@dataclass
class Model:
    """Logits per bucket (last row: zeros) and language, offsets, temperature; per language the least probability, the
    log frequencies of the buckets (last row: zeros), the least mean of them, and their deviation at a position."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: np.ndarray
    usual: np.ndarray
    floor: np.ndarray
    spread: np.ndarray


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], accept: float) -> Model:
    """Trains on (language, buckets, counts) rows; every fifth row of a language calibrates."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        none = np.zeros((BUCKETS * len(LENGTHS) + 1, 0), np.float32)
        return Model([], none, np.zeros(0), 1.0, np.zeros(0), none, np.zeros(0), np.zeros(0))
    rng = np.random.Generator(np.random.PCG64(SEED))
    emb = rng.normal(0, 0.1, (BUCKETS * len(LENGTHS), DIM))
    out, bias = rng.normal(0, 0.1, (len(langs), DIM)), np.zeros(len(langs))
    seen: dict[str, int] = {}
    train, held = [], []
    for lang, idx, counts in rows:
        seen[lang] = seen.get(lang, 0) + 1
        (held if seen[lang] % 5 == 0 else train).append((langs.index(lang), idx, counts / max(1, counts.sum())))
    steps, at = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            y, idx, w = train[i]
            rate = RATE * (1 - at / steps)
            at += 1
            x = w @ emb[idx]
            g = softmax(out @ x + bias)
            g[y] -= 1
            back = out.T @ g
            out -= rate * np.outer(g, x)
            bias -= 0.1 * rate * g
            emb[idx] -= (rate * w[:, None]) * back
    logits = np.concatenate([emb @ out.T, np.zeros((1, len(langs)))]).astype(np.float32)
    held = held or train
    raw = np.array([w @ logits[idx].astype(np.float64) + bias for _, idx, w in held])
    ys = np.array([y for y, _, _ in held])
    grid = np.geomspace(0.1, 10, 41)
    target = np.eye(len(langs))[ys]
    half = np.array([(i, j) for i, j in zip(range(len(ys)), rng.permutation(len(ys)).tolist(), strict=True) if ys[i] != ys[j]], np.int64).reshape(-1, 2)
    both = np.concatenate([raw, raw[half].mean(axis=1)]), np.concatenate([target, target[half].mean(axis=1)])
    loss = [-(both[1] * np.log(np.maximum(softmax(both[0] / t), 1e-12))).sum(axis=1).mean() for t in grid]
    best = float(grid[int(np.argmin(loss))])
    sure = softmax(raw / best)[np.arange(len(ys)), ys]
    seen_in = np.full((BUCKETS * len(LENGTHS), len(langs)), 0.5)
    for lang, idx, counts in rows:
        seen_in[idx, langs.index(lang)] += counts
    usual = np.concatenate([np.log(seen_in / seen_in.sum(axis=0)), np.zeros((1, len(langs)))]).astype(np.float32)
    threshold, floor, spread = np.full(len(langs), LEAST), np.full(len(langs), -np.inf), np.ones(len(langs))
    for j in range(len(langs)):
        own = [(idx, w) for y, idx, w in held if y == j]
        if own:
            least = lambda x: np.sort(x)[int((1 - accept) * len(x))]
            means = np.array([w @ usual[idx, j] for idx, w in own])
            threshold[j] = min(max(LEAST, least(sure[ys == j])), MOST)
            floor[j] = min(np.median(means) - GRANTED, least(means))
            spread[j] = np.sqrt(np.mean([w @ (usual[idx, j] - m) ** 2 for (idx, w), m in zip(own, means, strict=True)]))
    return Model(langs, logits, bias, best, threshold, usual, floor, spread)


def train(docs: DataFrame, per_lang: int = PER_LANG, langs: int = LANGS, accept: float = 0.995, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Model of the `langs` most frequent languages of `docs` (rows with null text, language or id are not used), from `per_lang` rows each at most.

    Rows of one id count as one in a language, with the least of their texts.
    """
    key = F.xxhash64(F.col(id_col).cast("string"))
    ids = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), key.alias("_key"))
    ids = first_of_class(ids, "_lang", per_lang, "langid-sample", langs)
    sample = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(ids, "_id")
    sample = sample.groupBy("_key", "_lang", "_id").agg(F.min("_text").alias("_text"))

    def run(batches):
        for batch in batches:
            buf, offs = text_buffer(batch.column(2))
            got = []
            for i in range(len(offs) - 1):
                idx, n = np.unique(np.concatenate(subwords(buf[offs[i] : offs[i + 1]], offs[i : i + 2] - offs[i])), return_counts=True)
                real = idx < BUCKETS * len(LENGTHS)
                got.append((idx[real].astype(np.int32).tobytes(), n[real].astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.binary()) for x in (zip(*got, strict=True) if got else ((), ())))], ["key", "lang", "idx", "n"])

    rows = in_batches(sample.select("_key", "_lang", "_text"), run, "key long, lang string, idx binary, n binary").collect()
    rows = sorted(((r.key, r.lang, bytes(r.idx), bytes(r.n)) for r in rows), key=lambda r: r)
    return fit([(lang, np.frombuffer(i, np.int32), np.frombuffer(n, np.int32)) for _, lang, i, n in rows if i], accept)


def probabilities(model: Model, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Calibrated probabilities (texts x languages) of a run of texts."""
    n, k = len(offs) - 1, len(model.langs)
    sums, count = np.zeros((n, k)), np.zeros(n)
    full = np.flatnonzero(offs[1:] > offs[:-1])
    if len(full):
        for length, h in zip(LENGTHS, subwords(buf, offs), strict=True):
            for j in range(k):
                sums[full, j] += np.add.reduceat(np.ascontiguousarray(model.table[:, j])[h], offs[:-1][full], dtype=np.float64)
            count += np.maximum(offs[1:] - offs[:-1] - length + 1, 0)
    return softmax((sums / np.maximum(count, 1)[:, None] + model.bias) / model.temperature)


def accepted(model: Model, p: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether the most probable language of each text is accepted (see the module)."""
    n, top = len(offs) - 1, p.argmax(axis=1)
    sums, count = np.zeros(n), np.zeros(n)
    full = np.flatnonzero(offs[1:] > offs[:-1])
    if len(full):
        lang = np.repeat(top, np.diff(offs))
        for length, h in zip(LENGTHS, subwords(buf, offs), strict=True):
            sums[full] += np.add.reduceat(model.usual[h, lang], offs[:-1][full], dtype=np.float64)
            count += np.maximum(offs[1:] - offs[:-1] - length + 1, 0)
    enough = np.maximum(count, 1)
    # neighbouring subwords overlap, so a text has about a sixth as many independent ones
    usual = sums / enough >= model.floor[top] - 3 * model.spread[top] / np.sqrt(np.maximum(enough / 6, 1))
    return usual & (p[np.arange(n), top] >= model.threshold[top])


def predictions(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "lang_") -> DataFrame:
    """`docs` with `pred`, `score` and `accepted`, each with `prefix` before it, after its own columns (a clash of names raises).

    Texts that are null or hold no letter are `und` with score 0 and not accepted; so are all texts if the model knows
    no language.  Whole texts count, whatever their length.
    """
    names = [f"{prefix}{x}" for x in ("pred", "score", "accepted")]
    clash = set(names) & set(docs.columns)
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, names, (T.StringType(), T.DoubleType(), T.BooleanType()))])

    def run(batches):
        for batch in batches:
            buf, offs = text_buffer(batch.column(at))
            lang, score, ok = np.full(len(offs) - 1, "und", object), np.zeros(len(offs) - 1), np.zeros(len(offs) - 1, bool)
            if model.langs:
                letters = has_letter(batch.column(at), buf, offs)
                for a, b in pieces(offs):
                    p = probabilities(model, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                    top = p.argmax(axis=1)
                    lang[a:b] = np.where(letters[a:b], np.array(model.langs, object)[top], "und")
                    score[a:b] = np.where(letters[a:b], p[np.arange(b - a), top], 0.0)
                    ok[a:b] = letters[a:b] & accepted(model, p, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(ok)], names=[f.name for f in schema])

    return in_batches(docs, run, schema)


def held_out(id_col: str = "doc_id", parts: int = 4):
    """True for ids whose CRC-32 (of the id as text) leaves 2; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == 2, F.lit(False))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text of `documents`, learned from three of four documents."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    out = predictions(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))
