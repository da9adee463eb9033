"""Language ID: multinomial logistic regression on TF-IDF of character n-grams.

Letters are lower-cased, everything else is a gap; the 1-, 2- and 3-grams of code points are hashed into a fixed number of slots. A slot's value
is its share of a text's grams times its inverse document frequency. The weights are trained by follow-the-regularised-leader with an
elastic net (most stay exactly zero), one row at a time, on a sample of labelled rows that is bounded in rows (`SAMPLE`) and in bytes (`SAMPLE_BYTES`),
chosen by a hash of doc_id. Its texts, whole, are counted where they lie; the driver gets a text's slots and counts, whatever its length at most 8 bytes for
each of the 1 << BITS slots. A fifth of the sample is kept out of training and sets the temperature that divides the scores. Prediction is linear in the
grams, so whole texts are scored at array speed with memory bounded by a slice of a batch.

Rows with crc32(doc_id as text) mod 4 = 2 are held out: never learned from. A null doc_id is neither held out nor learned from. Text that is null
or has no letter is `und` with score 0. Without a labelled row everything is `und`; with one language all else is that language. Repeated rows
are predicted each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, ship, trimmed
from .units import slices

SAMPLE, BITS, GRAMS = 3000, 17, 3
#: Bytes of counts that the sample may take, counted as if no gram came twice in a text that has fewer grams than there are slots.
SAMPLE_BYTES = 256 << 20
#: Bytes of text scored at a time (or one longer text).
PART = 250_000
#: Odd multipliers that mix the code points of a gram.
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all grams (rows of `GRAMS` columns; 1 << bits where a gram would leave its text), each text's first row, and whether
    it has a letter. Every text begins and ends with a gap."""
    joined = np.frombuffer("".join(f" {t.lower()} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t.lower()) + 2 for t in texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    letter = _is_letter()[joined]
    code = np.where(letter, joined, np.uint32(32))
    keep = letter | np.concatenate([[True], letter[:-1]])
    keep[first] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    starts, ends = at[first], at[first + sizes]
    code = code[keep]
    out = np.empty((len(code), GRAMS), np.int32)
    mixed = np.zeros(len(code), np.uint32)
    for n in range(GRAMS):
        part = np.zeros(len(code), np.uint32)
        part[: max(0, len(code) - n)] = code[n:]
        mixed = (mixed ^ part) * _MIX[n]
        mixed ^= mixed >> np.uint32(15)
        out[:, n] = (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits)
        for back in range(1, n + 1):
            last = ends - back
            out[last[last >= starts], n] = 1 << bits
    return out, starts, np.add.reduceat(letter, first) > 0 if len(texts) else np.zeros(0, bool)


class Model:
    """languages, and table[slot] = idf * weights of each language, with a last row of zeros."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, bits: int):
        self.languages, self.table, self.bias, self.temperature, self.bits = languages, table, bias, temperature, bits

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not texts:
            return [], []
        slots, starts, lettered = grams(texts, self.bits)
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        total = np.zeros((len(texts), len(self.languages)))
        for n in range(GRAMS):
            for j in range(len(self.languages)):
                total[:, j] += np.add.reduceat(self.table[:, j][slots[:, n]], starts)
        count = np.add.reduceat((slots < 1 << self.bits).sum(1), starts)
        p = _softmax((SCALE * total / count[:, None] + self.bias) / self.temperature)
        best = p.argmax(1)
        names = [self.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
        return names, [float(x) if ok else 0.0 for x, ok in zip(p[np.arange(len(best)), best], lettered, strict=True)]


#: Shares of a text's grams are small numbers; this brings them near 1.
SCALE = 50.0


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def counts(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray] | None:
    """The slots of a text's grams and how often each comes; None for a text without a letter."""
    slots, _, lettered = grams([text], bits)
    if not lettered[0]:
        return None
    found, n = np.unique(slots[slots < 1 << bits], return_counts=True)
    return found, n.astype(np.int32)


def train(counted: list[tuple[np.ndarray, np.ndarray]], labels: list[str], bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 3) -> Model:
    languages = sorted(set(labels))
    size = 1 << bits
    rows = [(found, n / n.sum(dtype=np.int64), languages.index(label)) for (found, n), label in zip(counted, labels, strict=True)]
    table = np.zeros((size + 1, len(languages)))
    if not rows or len(languages) < 2:
        return Model(languages if rows else [], table, np.zeros(len(languages)), 1.0, bits)
    kept = [r for i, r in enumerate(rows) if i % 5 == 4]
    taught = [r for i, r in enumerate(rows) if i % 5 != 4]
    df = np.bincount(np.concatenate([r[0] for r in taught]), minlength=size)
    idf = np.log((1 + len(taught)) / (1 + df)) + 1
    z, n = np.zeros((size + 1, len(languages))), np.zeros((size + 1, len(languages)))  # the last row is the bias

    def weights(slots: np.ndarray) -> np.ndarray:
        zs, ns = z[slots], n[slots]
        return np.where(np.abs(zs) <= l1, 0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for found, share, label in taught:
            slots = np.append(found, size)
            x = np.append(SCALE * share * idf[found], 1.0)
            w = weights(slots)
            p = _softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / alpha
            z[slots] += g - sigma * w
            n[slots] += g * g
    every = weights(np.arange(size + 1))
    table[:size] = every[:size] * idf[:, None]
    bias = every[size]
    logits = np.array([SCALE * (share @ table[found]) + bias for found, share, _ in kept or taught])
    truth = np.array([r[2] for r in kept or taught])
    ts = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in ts]
    best = np.flatnonzero(np.array(loss) <= min(loss) + 1e-4)
    return Model(languages, table.astype(np.float32), bias, float(ts[best[np.abs(np.log(ts[best])).argmin()]]), bits)


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Trains on at most `sample` rows of `docs` that have a doc_id, a lang and a text and aren't held out: all, or those whose hash of doc_id is below
    the threshold that some nine tenths of `sample` rows, or counts of `sample_bytes`, meet, so no task sends more than its share of them to the driver."""
    rows = (
        pick(docs, doc_id="long", text="string", lang="string")
        .filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~_held_out())
        .withColumn("h", F.xxhash64("doc_id"))
    )
    size = 8 * F.least(GRAMS * (F.char_length("text").cast("long") + 2), F.lit(1 << BITS).cast("long"))
    total, size = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if total > sample or size > sample_bytes:
        rows = rows.filter(F.pmod("h", F.lit(1 << 40)) < int((1 << 40) * 0.9 * min(sample / total, sample_bytes / size))).limit(sample)

    def run(batches):
        for batch in batches:
            for h, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if got := counts(text):
                    yield pa.RecordBatch.from_pydict({"h": [h], "lang": [lang], "crc": [zlib.crc32(text.encode("utf-8", "surrogatepass"))], "slots": [got[0].tobytes()], "n": [got[1].tobytes()]})

    ship(docs.sparkSession)
    got = rows.select("h", "lang", "text").mapInArrow(lambda b: trimmed(run(b)), "h long, lang string, crc long, slots binary, n binary").collect()
    got.sort(key=lambda r: (r.h, r.lang, r.crc))
    return train([(np.frombuffer(r.slots, np.int32), np.frombuffer(r.n, np.int32)) for r in got], [r.lang for r in got])


def predicted(docs: DataFrame, model: Model, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; `extra` names columns that stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist()
            for a, b in slices(sizes, PART):
                rows = batch.slice(a, b - a)
                names, scores = shared.value.predict([x or "" for x in rows.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*rows.schema.names[1:], "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    base = pick(docs, text="string", doc_id="long", **{k: kinds[k] for k in extra})
    base = base.select("text", "doc_id", _held_out().alias("held_out"), *extra)
    return base.mapInArrow(lambda b: trimmed(run(b)), "doc_id long, held_out boolean, " + "".join(f"`{k}` {kinds[k]}, " for k in extra) + "lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of `docs` whose text has letters and whose language is predicted with a score of at least `least`."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    plain = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))

    def run(batches):
        for batch in batches:
            for a, b in slices(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist(), PART):
                rows = batch.slice(a, b - a)
                names, scores = shared.value.predict([x or "" for x in rows.column(at).to_pylist()])
                yield rows.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return plain.mapInArrow(lambda b: trimmed(run(b)), plain.schema).toDF(*docs.columns)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predicted(docs, fitted(docs))
