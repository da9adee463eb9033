"""Document quality by a linear-chain conditional random field over lines.

Every line of a text gets a good or bad label with a probability. A line's features are shares and counts of its characters and words (letters, capitals, digits, marks,
repeated words, lengths and so on) in bins; a label's weight is the sum of the weights of the line's own bins, of the bins of the line before and of the line
after it, and of a weight for each pair of neighbouring labels. Forward and backward sums over the whole text give each line's marginal; their mean, weighted by the lines' lengths, is the text's
share of good lines, which a calibration (fitted on texts kept out of training) turns into the score.

Only texts are labelled, so lines are labelled in turns: first each line has its text's label and weights without transitions are fitted; then the lines of bad
texts that these call good, but for the worst of each text, are taken as good, and the whole field is fitted by the exact gradient of its likelihood. Learning
uses at most `SAMPLE` labelled texts, whose bins take at most `SAMPLE_BYTES`, those with the smallest hashes of doc_id (of texts that share one, the smallest); their
lines are reduced to bins by the executors, and only bins go to the driver. Scoring covers every line of every text, in pieces of `PART` code points at a time.

Rows with crc32(doc_id as text) mod 5 = 0 are held out: never learned from. A null doc_id is neither held out nor learned from; null labels aren't either. A doc_id that has both labels
is learned from twice. Null or empty text is one empty line and gets the score that such a text's features have. Lines weigh their number of code points; where all are
empty, all weigh alike. Without labels of both kinds every score is the share of good labels (0.5 without any). Repeated rows are scored each. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, ship, written
from .units import slices

SAMPLE, LEAST = 3000, 0.3
#: Bytes of bins that the sample may take (one for each feature of a line).
SAMPLE_BYTES = 32 << 20
#: Code points looked at at a time; a longer line is looked at in pieces.
PART = 250_000
#: Words among which repetitions are counted.
NEAR = 64
#: Lines of a text that are fitted in one chain; longer texts are fitted as several chains.
CHAIN = 256

_SHARES = (1e-9, 0.01, 0.03, 0.07, 0.15, 0.3, 0.6, 0.999)
#: The features and the edges of their bins.
FEATURES = {
    "length": (1, 10, 30, 80, 200, 500, 2000), "words": (1, 2, 4, 8, 16, 32, 128), "word_length": (0.5, 2, 3, 4, 5, 7, 10, 15), "letters": _SHARES, "capitals": _SHARES,
    "digits": _SHARES, "stops": _SHARES, "marks": _SHARES, "doubled_marks": _SHARES, "bare_words": _SHARES, "marked_words": _SHARES, "capital_words": _SHARES,
    "same_as_last": (1e-9, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.8), "different_near": (1e-9, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9), "same_line": (0.5,),
}
WIDE = max(map(len, FEATURES.values())) + 1
_STOPS = ".,;:?!'\"()-"
_SUMS = 14
_LETTER, _CAPITAL, _DIGIT, _BLANK, _STOP = 1, 2, 4, 8, 16
_kinds: np.ndarray | None = None


def _kind_table() -> np.ndarray:
    global _kinds
    if _kinds is None:
        found = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            found[i] = _LETTER * c.isalpha() + _CAPITAL * c.isupper() + _DIGIT * c.isdigit() + _BLANK * (c in " \t\n\x0b\x0c\r") + _STOP * (c in _STOPS)
        _kinds = found
    return _kinds


def _sums(pieces: list[str]) -> np.ndarray:
    """Whole-number sums of each piece (none empty): characters and words of each kind."""
    joined = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    kind = _kind_table()[joined]
    letter, capital, digit, blank, stop = ((kind & x) > 0 for x in (_LETTER, _CAPITAL, _DIGIT, _BLANK, _STOP))
    mark = ~(letter | digit | blank | stop)
    begins = np.zeros(len(joined), bool)
    begins[starts] = True
    again = np.zeros(len(joined), bool)
    again[1:] = (joined[1:] == joined[:-1]) & ~begins[1:]
    total = lambda x: np.add.reduceat(x, starts, dtype=np.int64)
    out = np.zeros((len(pieces), _SUMS), np.int64)
    for i, x in enumerate((letter, capital, digit, stop, mark, again & (mark | stop), ~blank)):
        out[:, i + 1] = total(x)
    out[:, 0] = sizes
    # words: runs of characters that aren't blank, within a piece
    full = ~blank
    first = np.flatnonzero(full & (begins | np.concatenate([[True], blank[:-1]])))
    if not len(first):
        return out
    piece = np.searchsorted(starts, first, "right") - 1
    run = np.repeat(first, np.diff(np.append(first, len(joined))))
    place = np.arange(first[0], len(joined)) - run
    code = np.where(blank, 0, joined).astype(np.uint64)[first[0] :]
    mixed = code * (np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4E))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    at = first - first[0]
    name = np.add.reduceat(np.where(code > 0, mixed, np.uint64(0)), at)
    per = lambda x: np.add.reduceat(x[first[0] :], at, dtype=np.int64)
    words = lambda x: np.bincount(piece, x, len(pieces)).astype(np.int64)
    out[:, 8] = words(np.ones(len(first)))
    out[:, 9] = words(per(letter) == 0)
    out[:, 10] = words((per(letter) > 0) & (per(mark) > 0))
    out[:, 11] = words(capital[first])
    last = np.zeros(len(first), bool)
    last[1:] = (name[1:] == name[:-1]) & (piece[1:] == piece[:-1])
    out[:, 12] = words(last)
    nth = np.arange(len(first)) - np.searchsorted(piece, np.arange(len(pieces)))[piece]
    seen = np.stack([piece.astype(np.uint64), (nth // NEAR).astype(np.uint64), name], 1)
    order = np.lexsort(seen.T)
    new = np.ones(len(first), bool)
    new[1:] = (seen[order[1:]] != seen[order[:-1]]).any(1)
    out[:, 13] = words(new[np.argsort(order)])
    return out


def bins(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bins of all lines of all texts (a row a line, a column a feature), the lines' lengths, and each text's first row."""
    lines = [t.split("\n") for t in texts]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lines])[:-1]]).astype(np.int64) if texts else np.zeros(0, np.int64)
    count = sum(map(len, lines))
    sums, same = np.zeros((count, _SUMS), np.int64), np.zeros(count, bool)
    pieces, of, held = [], [], 0

    def add():
        nonlocal held
        if pieces:
            np.add.at(sums, of, _sums(pieces))
        pieces.clear(), of.clear()
        held = 0

    at = 0
    for own in lines:
        seen: dict[str, int] = {}
        for line in own:
            if line:
                seen[line] = seen.get(line, 0) + 1
                for x in range(0, len(line), PART):
                    pieces.append(line[x : x + PART])
                    of.append(at)
                    held += len(pieces[-1])
                    if held >= PART:
                        add()
            at += 1
        if len(own) > len(seen):
            same[at - len(own) : at] = [seen.get(x, 0) > 1 for x in own]
    add()
    length, letter, capital, digit, stop, mark, doubled, full, word, bare, marked, upper, last, different = sums.T
    share = lambda x, y: x / np.maximum(y, 1)
    values = [length, word, share(full, word), share(letter, full), share(capital, letter), share(digit, full), share(stop, full), share(mark, full), share(doubled, full),
              share(bare, word), share(marked, word), share(upper, word), share(last, word), share(different, word), same]
    out = np.stack([np.searchsorted(edges, x, "right") for edges, x in zip(FEATURES.values(), values, strict=True)], 1).astype(np.uint8) if count else np.zeros((0, len(FEATURES)), np.uint8)
    return out, length, first


def _slots(binned: np.ndarray) -> np.ndarray:
    return binned.astype(np.int64) + WIDE * np.arange(binned.shape[1])


class Field:
    """weights[0..2]: of a line's own bins, of the line before and of the line after, each one number for good against bad; at_start and at_end stand for a
    line that isn't there; trans[a, b]: weight of label b after label a; slope and shift turn the share of good lines into a score."""

    def __init__(self, weights: np.ndarray, bias: float, ends: np.ndarray, trans: np.ndarray, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.ends, self.trans, self.slope, self.shift = weights, bias, ends, trans, slope, shift

    def leanings(self, binned: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What speaks for good in each line, without its neighbours' labels."""
        slots = _slots(binned)
        own, before, after = (w[slots].sum(1) for w in self.weights)
        out = own + self.bias
        out[1:] += before[:-1]
        out[:-1] += after[1:]
        last = np.append(first[1:], len(binned)) - 1
        inner = first[1:]
        out[inner] -= before[inner - 1]
        out[inner - 1] -= after[inner]
        out[first] += self.ends[0]
        out[last] += self.ends[1]
        return np.clip(out, -30, 30)

    def marginals(self, leaning: np.ndarray) -> list[float]:
        """The probability of good of each line of one text."""
        odds = np.exp(leaning).tolist()
        (bb, bg), (gb, gg) = np.exp(self.trans - self.trans.max()).tolist()
        ahead, r = [], 1.0
        for i, o in enumerate(odds):
            r = o if i == 0 else o * (bg + r * gg) / (bb + r * gb)
            ahead.append(r)
        out, back = [0.0] * len(odds), 1.0
        for i in range(len(odds) - 1, -1, -1):
            good = ahead[i] * back
            out[i] = good / (1 + good)
            x = odds[i] * back
            back = (gb + gg * x) / (bb + bg * x)
        return out

    def shares(self, binned: np.ndarray, length: np.ndarray, first: np.ndarray) -> list[float]:
        """Each text's share of good lines, by length."""
        leaning, out = self.leanings(binned, first), []
        for a, b in zip(first, np.append(first[1:], len(binned)), strict=True):
            weight = length[a:b] if length[a:b].any() else np.ones(b - a)
            out.append(float(np.dot(weight, self.marginals(leaning[a:b])) / weight.sum()))
        return out

    def score(self, share: float) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.slope * _logit(share) + self.shift))))

    def scores(self, texts: list[str]) -> list[float]:
        return [self.score(s) for s in self.shares(*bins(texts))] if texts else []


class Share:
    """What is said of every text where there is nothing to tell good from bad by."""

    def __init__(self, share: float):
        self.share = share

    def scores(self, texts: list[str]) -> list[float]:
        return [self.share] * len(texts)


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def _unpacked(x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    size = 3 * WIDE * len(FEATURES)
    return x[:size].reshape(3, -1), x[size], x[size + 1 : size + 3], x[size + 3 :].reshape(2, 2)


def loss(x: np.ndarray, chains: list[tuple[np.ndarray, np.ndarray]], l2: float, chained: bool) -> tuple[float, np.ndarray]:
    """The mean negative log-likelihood of a line's label given the text, with its gradient. Chains are (bins, labels); without `chained` labels are told apart one by one."""
    weights, bias, ends, trans = _unpacked(x)
    first = np.concatenate([[0], np.cumsum([len(b) for b, _ in chains])[:-1]]).astype(np.int64)
    binned, labels = np.concatenate([b for b, _ in chains]), np.concatenate([y for _, y in chains])
    u = Field(weights, bias, ends, trans).leanings(binned, first)
    n = len(u)
    size = np.diff(np.append(first, n))
    last = first + size - 1
    g_trans = np.zeros((2, 2))
    if chained:
        order = np.argsort(-size, kind="stable")
        first_, size_ = first[order], size[order]
        ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
        more = lambda a: np.logaddexp(a[:, 0, :], a[:, 1, :])
        node = np.stack([np.zeros(n), u], 1)
        ahead[first_] = node[first_]
        alive = [int(np.searchsorted(-size_, -t, "left")) for t in range(size_[0])]  # chains with more than t lines
        for t in range(1, size_[0]):
            at = first_[: alive[t]] + t
            ahead[at] = node[at] + more(ahead[at - 1][:, :, None] + trans[None])
        for t in range(size_[0] - 2, -1, -1):
            at = first_[: alive[t + 1]] + t
            nxt = node[at + 1] + back[at + 1]
            back[at] = np.logaddexp(trans[None, :, 0] + nxt[:, None, 0], trans[None, :, 1] + nxt[:, None, 1])
        whole = np.logaddexp(*ahead[last].T)
        z = np.repeat(whole, size)
        p = np.exp(ahead[:, 1] + back[:, 1] - z)
        inner = np.ones(n, bool)
        inner[first] = False
        at = np.flatnonzero(inner)
        both = np.exp(ahead[at - 1][:, :, None] + trans[None] + (node + back)[at][:, None, :] - z[at][:, None, None])
        g_trans = both.sum(0)
        np.add.at(g_trans, (labels[at - 1], labels[at]), -1.0)
        value = whole.sum() - (u * labels).sum() - trans[labels[at - 1], labels[at]].sum()
    else:
        p = 1 / (1 + np.exp(-u))
        value = np.logaddexp(0, u).sum() - (u * labels).sum()
    g = p - labels
    slots, parts = _slots(binned), []
    inside, starts = np.ones(n, bool), np.ones(n, bool)
    inside[last], starts[first] = False, False
    before, after = np.zeros(n), np.zeros(n)
    before[np.flatnonzero(inside)] = g[np.flatnonzero(inside) + 1]  # a line speaks for the one after it as that one's line before
    after[np.flatnonzero(starts)] = g[np.flatnonzero(starts) - 1]
    for each in (g, before, after):
        parts.append(np.bincount(slots.ravel(), np.repeat(each, slots.shape[1]), WIDE * len(FEATURES)))
    grad = np.concatenate([*parts, [g.sum(), g[first].sum(), g[last].sum()], g_trans.ravel()]) / n
    return value / n + l2 * (x @ x) / 2, grad + l2 * x


def _fitted(x: np.ndarray, chains, l2: float, chained: bool, steps: int = 120, keep: int = 8) -> np.ndarray:
    """Minimises the loss by gradients, with a limited memory of curvature and halved steps."""
    value, grad = loss(x, chains, l2, chained)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, kept = grad.copy(), []
        for s, y in reversed(past):
            a = (s @ way) / (s @ y)
            way -= a * y
            kept.append(a)
        if past:
            way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(kept), strict=True):
            way += s * (a - (y @ way) / (s @ y))
        step = 1.0
        while step > 1e-6:
            new, g = loss(x - step * way, chains, l2, chained)
            if new <= value - 1e-4 * step * (grad @ way):
                break
            step /= 2
        else:
            return x
        s, y = -step * way, g - grad
        done = value - new < 1e-7
        x, value, grad = x + s, new, g
        if s @ y > 1e-12:
            past = [*past, (s, y)][-keep:]
        if done:
            return x
    return x


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], l2: float = 1e-5) -> Field | Share:
    """From (bins, lengths, label) of texts."""
    good = [r for r in rows if r[2] == 1]
    if not good or len(good) == len(rows):
        return Share(len(good) / len(rows) if rows else 0.5)
    kept = [r for i, r in enumerate(rows) if i % 5 == 4]
    taught = [r for i, r in enumerate(rows) if i % 5 != 4]
    if len({r[2] for r in taught}) < 2:
        taught = rows
    cut = lambda b, y: [(b[i : i + CHAIN], y[i : i + CHAIN]) for i in range(0, len(b), CHAIN)]
    x = np.zeros(3 * WIDE * len(FEATURES) + 7)
    x = _fitted(x, [c for b, _, label in taught for c in cut(b, np.full(len(b), label))], l2, False)
    flat, chains = Field(*_unpacked(x)), []
    for b, _, label in taught:
        y = np.full(len(b), label)
        if not label:
            u = flat.leanings(b, np.zeros(1, np.int64))
            y = (u > 0).astype(np.int64)
            y[u.argmin()] = 0
        chains += cut(b, y)
    field = Field(*_unpacked(_fitted(x, chains, l2, True)))
    if len({r[2] for r in kept}) < 2:
        kept = taught
    z = np.array([_logit(s) for b, n, _ in kept for s in field.shares(b, n, np.zeros(1, np.int64))])
    truth = np.array([r[2] for r in kept], float)
    slope, shift = 1.0, 0.0
    for _ in range(50):  # logistic regression on the share's log-odds, slightly held back
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        w = p * (1 - p)
        g = np.array([((p - truth) * z).sum() + 0.1 * (slope - 1), (p - truth).sum() + 0.1 * shift])
        h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 1.0 / np.abs(d).max()) if np.abs(d).max() > 0 else 1.0
        slope, shift = max(0.05, slope - d[0]), shift - d[1]
    field.slope, field.shift = float(slope), float(shift)
    return field


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Field | Share:
    """Trains on at most `sample` rows of `docs` whose doc_id has a quality of 0 or 1 in `labels` and isn't held out."""
    marks = pick(labels, doc_id="long", quality="int").filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~_held_out()).distinct()
    texts = pick(docs, doc_id="long", text="string").filter(F.col("text").isNotNull())
    h = F.xxhash64("doc_id")
    # ids alone meet the labels; the texts stay where they are and meet a table of at most `sample` rows
    known = marks.join(texts.select("doc_id"), "doc_id", "left_semi").orderBy(h, "doc_id", "quality").limit(sample)
    chosen = written(known, "quality-sample")
    taken = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            for doc, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, length, _ = bins([text])
                yield pa.RecordBatch.from_pydict({"doc_id": [doc], "quality": pa.array([label], pa.int32()), "lines": [len(found)], "bins": [found.tobytes()], "length": [length.astype(np.int64).tobytes()]})

    ship(docs.sparkSession)
    binned = written(taken.mapInArrow(run, "doc_id long, quality int, lines long, bins binary, length binary").withColumn("h", h), "quality-bins")
    room, last = sample_bytes, None
    for r in sorted(binned.select("h", "doc_id", "quality", "lines").collect()):
        room -= r.lines * (len(FEATURES) + 8)
        if room < 0:
            break
        last = r
    if last is None:
        return train([])
    within = F.struct("h", "doc_id", "quality") <= F.struct(*(F.lit(last[i]).cast(t) for i, t in enumerate(("long", "long", "int"))))
    got = binned.filter(within).orderBy("h", "doc_id", "quality").collect()
    return train([(np.frombuffer(r.bins, np.uint8).reshape(-1, len(FEATURES)), np.frombuffer(r.length, np.int64), r.quality) for r in got])


def scored(docs: DataFrame, model: Field | Share, least: float = LEAST) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist()
            for a, b in slices(sizes, PART):
                rows = batch.slice(a, b - a)
                scores = shared.value.scores([x or "" for x in rows.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    base = pick(docs, text="string", doc_id="long").select("text", "doc_id", _held_out().alias("held_out"))
    found = base.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= least).cast("int"))


def op12_quality_crf(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs, fitted(docs, labels))
