"""N-gram Jaccard join with a count-vector R-tree.

Words are named by 128 bits of a cryptographic hash, shingles by a 64-bit mix of their words' names, a set (a class: all documents of one set) by a
cryptographic hash of two such mixes of each of its shingles. These names only find candidates and put equal sets together; which sets are linked is
decided on the words themselves.

1. Which classes can have a partner: of each set the SHORT smallest names are compared across classes. Two sets with a similarity of at least t have none
   of these in common with a probability of at most (1 - t) ** SHORT, for t = 0.75 as rare as two equal 64-bit names, whatever the texts, since the
   order of the names is that of a cryptographic hash. (Sets of up to about 4 * SHORT shingles certainly have one in common.) Those left must share, of
   their LONG smallest, as many with other sets as a partner would bring, again but for that probability. That removes documents which only have a
   passage in common with others.
2. Classes left are joined to families by the rarest of the LONG smallest (a prefix filter: of s names of which c are common to partners, one of
   the s - c + 1 rarest is). Linked classes are always in one family.
3. A family goes to one task with its texts, where shingles get numbers without hashing (words are numbered, then pairs of numbers, and so on up to a
   shingle). The numbers are dealt into GROUPS groups and the group counts indexed as points of an R-tree: the sum of the smaller coordinates of a point
   and a node's upper corner bounds the overlap with all that is below. Surviving pairs are verified by exact intersection, unless they are known to
   be connected already.
4. A family of over BLOCK rows or BLOCK_SHINGLES shingles is cut into blocks (bands of set sizes, salted; sets more than a band apart can't be linked), and
   each block settled by itself. Then the blocks' components meet by one row each. In a family that is in one piece by now, as a crowd of near copies
   is, nothing is left to compare. Else the rows outside the family's largest piece are cut into blocks of their own, and each meets the family's blocks: not
   every pair of blocks meets, and what is sent grows with the family and not with its square, unless a family falls into many large pieces.
5. Connected components of the verified links.

Null text and text without words have an empty set, linked with nothing: their component is their doc_id. A null doc_id isn't anyone's component unless the
component has no other. Repeated rows are copies. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, hot, parts, pick, spread_join, text_name, trimmed, written
from .components import components
from .units import slices

WORDS, PERCENT = 5, 75
SHORT, LONG = 32, 128
BLOCK, BLOCK_SHINGLES, GROUPS, LEAF = 2000, 2_000_000, 64, 16
#: Names of words that a worker remembers to the end of its task, of words up to so many bytes.
KEPT, KEPT_BYTES = 200_000, 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


_names: dict[bytes, bytes] = {}


def _words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(different words, each place's word, each text's first place, its number of places)"""
    cut = [t.translate(_LOWER).split() for t in texts]
    count = np.fromiter(map(len, cut), np.int64, len(cut))
    flat = list(itertools.chain.from_iterable(cut))
    number: dict[bytes, int] = defaultdict(itertools.count().__next__)
    at = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    return list(number), at, np.cumsum(count) - count, count


def _named(words: list[bytes]) -> np.ndarray:
    """Two 64-bit names of each word."""
    if len(_names) > KEPT:
        _names.clear()
    out = list(map(_names.get, words))
    for i, w in enumerate(words):
        if out[i] is None:
            out[i] = hashlib.blake2b(w, digest_size=16).digest()
            if len(w) <= KEPT_BYTES:
                _names[w] = out[i]
    return np.frombuffer(b"".join(out), np.uint64).reshape(-1, 2)


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, other names, how many a text has): distinct shingles of each text, ascending by name."""
    different, at, first, count = _words(texts)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    text = np.repeat(np.arange(len(texts)), count)
    position = np.arange(len(at)) - first[text]
    real = np.flatnonzero((position + words <= count[text]) | (position == 0) & (count[text] < words))
    text = text[real]
    rolled = []
    for half in _named(different).T:
        name = half[at]
        mixed = np.zeros(len(at), np.uint64)
        for k in range(words):  # of the words from each place on; a text's end is seen to below
            mixed[: max(0, len(at) - k)] ^= name[k:]
            mixed *= np.uint64(0xC2B2AE3D27D4EB4F + 2 * k)
            mixed ^= mixed >> np.uint64(32)
        for i in first[(count > 0) & (count < words)].tolist():  # texts of few words
            end, one = i + int(count[np.searchsorted(first, i, side="right") - 1]), 0
            for k, w in enumerate(name[i:end].tolist()):
                one = (one ^ w) * (0xC2B2AE3D27D4EB4F + 2 * k) & 0xFFFFFFFFFFFFFFFF
                one ^= one >> 32
            mixed[i] = one
        rolled.append(_mix(mixed[real]))
    order = np.lexsort((rolled[0], text))
    one, other, text = rolled[0][order], rolled[1][order], text[order]
    new = np.concatenate([[True], (one[1:] != one[:-1]) | (other[1:] != other[:-1]) | (text[1:] != text[:-1])])
    return one[new], other[new], np.bincount(text[new], minlength=len(texts))


def exact_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Numbers of the distinct shingles of each text; equal numbers are equal shingles, without any hashing. A window's number is that of the pair of
    numbers of the two windows that make it up."""
    _, at, first, count = _words(texts)
    names, width = at, 1
    while width < words:
        step = min(width, words - width)
        pairs = names[: len(names) - step] * np.int64(len(at) + 1) + names[step:] if len(names) > step else np.zeros(0, np.int64)
        names, width = np.unique(pairs, return_inverse=True)[1].astype(np.int64), width + step
    short: dict[bytes, int] = {}
    out = []
    for a, n in zip(first.tolist(), count.tolist(), strict=True):
        if n >= words:
            out.append(np.unique(names[a : a + n - words + 1]))
        else:  # the whole sequence is one shingle
            out.append(np.array([len(at) + short.setdefault(at[a : a + n].tobytes(), len(short))] if n else [], np.int64))
    return out


def least_overlap(a, b, percent: int = PERCENT):
    """The smallest intersection at which sets of sizes a and b are linked: percent * union <= 100 * intersection."""
    return -(-percent * (a + b) // (100 + percent))


def _tail(n: int, share: float) -> int:
    """The largest c for which n trials that succeed with probability `share` bring fewer than c with a probability of at most 2 ** -64."""
    from math import comb

    total, c = 0.0, 0
    while c <= n:
        total += comb(n, c) * share**c * (1 - share) ** (n - c)
        if total > 2.0**-64:
            break
        c += 1
    return max(1, c)


SETS = "doc_id long, dk long, th binary, n long, c1 long, c2 long, low array<long>"


def _sets(batches, words: int, long: int):
    for batch in batches:
        for x, y in slices(pc.fill_null(pc.binary_length(batch.column(3)), 0).to_pylist(), 3_000_000):
            part = batch.slice(x, y - x)
            found, other, n = shingles([t or b"" for t in part.column(3).to_pylist()], words)
            ends = np.cumsum(n)
            starts = ends - n
            both = np.stack([found, other], axis=1)
            digests = b"".join(hashlib.blake2b(both[a:b].tobytes(), digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
            cid = np.frombuffer(digests, np.int64).reshape(-1, 2)
            few = np.minimum(n, long)
            at = np.repeat(starts - (np.cumsum(few) - few), few) + np.arange(few.sum())
            low = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(few)]).astype(np.int32)), pa.array(found[at].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n.astype(np.int64)), pa.array(cid[:, 0].copy()), pa.array(cid[:, 1].copy()), low], names=[k.split()[0] for k in SETS.split(", ")])
    _names.clear()


class Tree:
    """An R-tree of count vectors, bulk-loaded: points in order of size, then tiled by their widest coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan: int = LEAF):
        wide = points.var(axis=0).argmax() if len(points) else 0
        order = np.argsort(sizes, kind="stable")
        slab = max(fan, fan * fan)
        self.order = np.concatenate([part[np.argsort(points[part, wide], kind="stable")] for part in np.split(order, range(slab, len(order), slab))]) if len(order) else order
        self.fan = fan
        corners, least, most = points[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(corners, least, most)]
        while len(corners) > fan:
            cuts = np.arange(0, len(corners), fan)
            corners, least, most = np.maximum.reduceat(corners, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)
            self.levels.append((corners, least, most))

    def near(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Places of the points that may be linked with this one."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corners, least, most = self.levels[depth]
            at = at[(100 * np.minimum(most[at], size) >= percent * np.maximum(least[at], size)) | (least[at] <= size) & (size <= most[at])]
            at = at[np.minimum(corners[at], point).sum(axis=1) >= least_overlap(size, least[at], percent)]
            if depth and len(at):
                at = (at[:, None] * self.fan + np.arange(self.fan)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at]


def linked(sets: list[np.ndarray], label: np.ndarray | None = None, sides: np.ndarray | None = None, percent: int = PERCENT):
    """Labels of the components of the links between sets. `label`: components that are known already, each named by one of its rows; `sides`: only rows
    of different sides are compared."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values, dense = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    group = (_mix(values.astype(np.uint64)) % np.uint64(GROUPS)).astype(np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    points = np.bincount(owner * GROUPS + group[dense], minlength=len(sets) * GROUPS).reshape(len(sets), GROUPS).astype(np.int32)
    tree = Tree(points, sizes)
    label = np.arange(len(sets)) if label is None else label.copy()
    mark = np.zeros(len(values), bool)
    for i in range(len(sets)):
        apart = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if sides is not None:
            apart = apart[sides[apart] != sides[i]]
        if 8 * len(apart) > len(sets):
            near = np.intersect1d(tree.near(points[i], sizes[i], percent), apart, assume_unique=True)
        else:  # a few points are bounded one by one
            near = apart[np.minimum(points[apart], points[i]).sum(axis=1) >= least_overlap(sizes[i], sizes[apart], percent)]
        if not len(near):
            continue
        mine = dense[starts[i] : ends[i]]
        mark[mine] = True
        k = sizes[near]
        at = np.repeat(starts[near] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        shared = np.add.reduceat(mark[dense[at]].astype(np.int64), np.cumsum(k) - k)
        mark[mine] = False
        for j in near[shared >= least_overlap(sizes[i], k, percent)].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
    return label


def _families(batches, words: int, percent: int):
    """Rows come ordered by task; a task's rows are held until all of them are there. Gives (u, v) for rows that are connected: v stands for u's component in
    its task."""
    held: list[pa.RecordBatch] = []

    def work(table: pa.Table):
        tasks = table["task"].to_numpy()
        nodes, sides, labels = (table[c].to_numpy() for c in ("node", "side", "label"))
        texts = table["bytes"]
        edges = []
        cuts = np.flatnonzero(np.concatenate([[True], tasks[1:] != tasks[:-1], [True]]))
        for a, b in zip(cuts, cuts[1:], strict=False):
            side = sides[a:b]
            if b - a < 2:
                continue
            _, lead, known = np.unique(labels[a:b], return_index=True, return_inverse=True)
            label = linked(exact_sets(texts.slice(a, b - a).to_pylist(), words), lead[known], side if side.min() != side.max() else None, percent)
            moved = np.flatnonzero(label != np.arange(b - a))
            edges += zip(nodes[a + moved].tolist(), nodes[a + label[moved]].tolist(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["u", "v"])

    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < 8_000_000:
            continue
        table = pa.Table.from_batches(held)
        tasks = table["task"].to_numpy()
        cut = int(np.flatnonzero(tasks != tasks[-1])[-1]) + 1 if (tasks != tasks[-1]).any() else 0
        if cut:
            yield work(table.slice(0, cut))
            held, size = [pa.Table.from_batches(held).slice(cut).combine_chunks().to_batches()[0]], 0
    if held:
        yield work(pa.Table.from_batches(held))


def classes(docs: DataFrame, words: int = WORDS, long: int = LONG) -> DataFrame:
    """(doc_id, dk, th, n, c1, c2, low): size and class of each row's set, and its smallest names."""
    base = pick(docs, doc_id="long", text="string").select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("dk"), text_name(F.col("text")).alias("th"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    return base.mapInArrow(lambda b: trimmed(_sets(b, words, long)), SETS)


def _candidates(rows: DataFrame, percent: int, short: int, long: int) -> tuple[DataFrame, DataFrame]:
    """Classes that may have a partner, as nodes: (node, c1, c2, dk, th, n), a row of each class standing for it; and (node, family)."""
    spark = rows.sparkSession
    tasks = parts(spark)
    first = rows.select("c1", "c2", F.explode(F.slice("low", 1, short)).alias("token"))
    total = rows.agg(F.sum(F.least("n", F.lit(short)))).first()[0] or 0
    by_token = first.groupBy("token").agg(F.count("*").alias("n"), F.min("c1").alias("one"), F.max("c1").alias("other"))
    shared = by_token.filter("one <> other").select("token")
    alive = spread_join(first, shared, "token", hot(by_token, total, tasks), "left_semi").select("c1", "c2").distinct()
    kept = rows.join(alive, ["c1", "c2"], "left_semi").groupBy("c1", "c2").agg(F.min(F.struct("dk", "th")).alias("row"), F.first("n").alias("n"), F.first("low").alias("low"))
    kept = written(kept.select(F.monotonically_increasing_id().alias("node"), "c1", "c2", "row.dk", "row.th", "n", "low"), "join-alive")

    spread = kept.select("node", "n", F.explode("low").alias("token"))
    total = kept.agg(F.sum(F.least("n", F.lit(long)))).first()[0] or 0
    often = spread.groupBy("token").agg(F.count("*").alias("df"))
    # up to this size a set and its partners are within their smallest names, and what they share is certain
    common = F.when(F.col("n") <= long * percent // 100, F.ceil(F.col("n") * percent / 100)).otherwise(F.lit(_tail(long, percent / 100))).cast("int")
    held = spread_join(spread, often.filter("df > 1"), "token", hot(often.withColumnRenamed("df", "n"), total, tasks))
    held = held.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    # all but common - 1 of the smallest names, the rarest first; those of one class alone are the rarest of all
    size = F.least(F.col("n"), F.lit(long))
    room = (size - common + 1) - (size - F.size("tokens"))
    held = written(held.filter(F.size("tokens") >= common).select("node", F.explode(F.slice("tokens", F.lit(1), room.cast("int"))["token"]).alias("token")), "join-prefixes")
    roots = held.groupBy("token").agg(F.min("node").alias("root"), F.count("*").alias("n"))
    tied = spread_join(held, roots.drop("n"), "token", hot(roots, held.count(), tasks))
    family = components(tied.select(F.col("node").alias("u"), F.col("root").alias("v")))
    return kept.drop("low"), written(family.select("node", F.col("root").alias("family")), "join-families")


def _blocked(rows: DataFrame, block: int, percent: int, heavy: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """`rows` (node, family, n, ...) with band and salt, and the blocks (family, band, salt). A family that fits is one block, of band 0. `heavy` has the
    families of many rows."""
    tasks = parts(rows.sparkSession)
    sizes = written(rows.groupBy("family").agg(F.count("*").alias("many"), F.sum("n").alias("total")), f"{name}-sizes")
    total = sizes.agg(F.sum("many")).first()[0] or 0
    fits = (F.col("many") <= block) & (F.col("total") <= BLOCK_SHINGLES)
    wide = float(np.log(100 / percent))
    in_band = F.when(F.col("fits"), F.lit(0)).otherwise(F.floor(F.log(F.col("n").cast("double")) / wide)).cast("int")
    banded = spread_join(rows, sizes.select("family", fits.alias("fits")), "family", heavy)
    banded = banded.withColumn("key", F.struct("family", in_band.alias("band"))).drop("fits")
    bands = written(banded.groupBy("key").agg(F.count("*").alias("many"), F.sum("n").alias("total")), f"{name}-bands")
    salts = F.greatest(F.ceil(F.col("many") / block), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    located = spread_join(banded, bands.select("key", salts.alias("dealt")), "key", hot(bands.withColumn("n", F.col("many")), total, tasks))
    located = located.select("*", "key.band", F.pmod(F.xxhash64("node"), F.col("dealt")).cast("int").alias("place")).drop("key", "dealt").withColumnRenamed("place", "salt")
    return located, bands.select("key.family", "key.band", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))


def _compared(sent: DataFrame, words: int, percent: int, name: str) -> DataFrame:
    """(u, v) of (task, side, node, label, bytes)."""
    ordered = sent.select("task", "side", "node", "label", "bytes").repartition(parts(sent.sparkSession), "task").sortWithinPartitions("task")
    return written(ordered.mapInArrow(lambda b: trimmed(_families(b, words, percent)), "u long, v long"), name)


def _met(ours: DataFrame, our_blocks: DataFrame, theirs: DataFrame, their_blocks: DataFrame, same: bool) -> DataFrame:
    """Rows to be compared across blocks of a family whose bands are at most one apart: every pair of blocks is a task. With `same`, both are one."""
    other = their_blocks.select("family", F.col("band").alias("band2"), F.col("salt").alias("salt2"))
    pairs = our_blocks.join(other, "family").filter("abs(band2 - band) <= 1")
    if same:
        pairs = pairs.filter("band2 > band OR band2 = band AND salt2 >= salt")
    pairs = pairs.withColumn("task", F.xxhash64("family", "band", "salt", "band2", "salt2"))
    mine = ours.join(pairs.select("task", "family", "band", "salt"), ["family", "band", "salt"]).withColumn("side", F.lit(0))
    others = pairs.filter("band2 <> band OR salt2 <> salt") if same else pairs
    others = others.select("task", "family", F.col("band2").alias("band"), F.col("salt2").alias("salt"))
    return mine.unionByName(theirs.join(others, ["family", "band", "salt"]).withColumn("side", F.lit(1)))


def links(docs: DataFrame, rows: DataFrame, words: int = WORDS, percent: int = PERCENT, short: int = SHORT, long: int = LONG, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(u, v): verified links between nodes, enough to connect each component; and the nodes (node, c1, c2, ...)."""
    kept, family = _candidates(rows.filter("n > 0"), percent, short, long)
    members = kept.join(family, "node").select("node", "family", "n", "dk", "th")
    base = pick(docs, doc_id="long", text="string").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("dk"), text_name(F.col("text")).alias("th"), F.col("text").cast("binary").alias("bytes"))
    if not rows.groupBy("dk", "th").agg(F.count("*").alias("many")).filter("many > 1").isEmpty():  # of rows equal in doc_id and text one is enough
        base = base.groupBy("dk", "th").agg(F.first("bytes").alias("bytes"))
    whole = base.join(members, ["dk", "th"]).select("node", "family", "n", "bytes")
    whole = written(whole.withColumn("label", F.col("node")), "join-texts")
    sizes = whole.groupBy("family").agg(F.count("*").alias("n"))
    heavy = written(hot(sizes, whole.count(), parts(docs.sparkSession)), "join-heavy")
    located, blocks = _blocked(whole, block, percent, heavy, "join-blocks")
    first = _compared(located.select("*", F.xxhash64("family", "band", "salt").alias("task"), F.lit(0).alias("side")), words, percent, "join-first")
    large = written(blocks.groupBy("family").agg(F.count("*").alias("many")).filter("many > 1").select("family"), "join-large")
    if large.isEmpty():
        return first, kept

    # one row of each block's component meets those of the family's other blocks
    some = spread_join(located, large, "family", heavy).join(first.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
    some = some.withColumn("label", F.coalesce("root", "node")).drop("root")
    leads, lead_blocks = _blocked(some.filter("node = label").drop("band", "salt"), block, percent, heavy, "join-lead-blocks")
    second = _compared(_met(leads, lead_blocks, leads, lead_blocks, True), words, percent, "join-second")
    tied = components(second).select(F.col("node").alias("label"), F.col("root").alias("piece"))
    pieces = written(some.drop("bytes").join(tied, "label", "left").select("node", "family", "n", "band", "salt", F.coalesce("piece", "label").alias("label")), "join-pieces")
    # what lies outside a family's largest piece meets all of it
    sizes = pieces.groupBy("family", "label").agg(F.count("*").alias("many"))
    major = sizes.groupBy("family").agg(F.max(F.struct("many", "label")).alias("top"), F.count("*").alias("pieces")).filter("pieces > 1").select("family", F.col("top.label").alias("major"))
    divided = written(spread_join(pieces, major, "family", heavy), "join-divided")
    if divided.isEmpty():
        return first.unionAll(second), kept
    texts = whole.select("node", "bytes")
    outside, outer_blocks = _blocked(divided.filter("label <> major").select("node", "family", "n", "label"), block, percent, heavy, "join-outer-blocks")
    # a family that fits is one block of band 0, which meets blocks of any band
    outer_blocks = outer_blocks.withColumn("alone", F.count("*").over(Window.partitionBy("family")) == 1)
    other = outer_blocks.select("family", F.col("band").alias("band2"), F.col("salt").alias("salt2"), "alone")
    pairs = blocks.join(other, "family").filter("alone OR abs(band2 - band) <= 1").withColumn("task", F.xxhash64("family", "band", "salt", "band2", "salt2"))
    mine = divided.drop("major", "n").join(pairs.select("task", "family", "band", "salt"), ["family", "band", "salt"]).select("task", "node", "label", F.lit(0).alias("side"))
    theirs = outside.join(pairs.select("task", "family", F.col("band2").alias("band"), F.col("salt2").alias("salt")), ["family", "band", "salt"]).select("task", "node", "label", F.lit(1).alias("side"))
    third = _compared(mine.unionAll(theirs).join(texts, "node"), words, percent, "join-third")
    return first.unionAll(second).unionAll(third), kept


def _classes_named(docs: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """classes(), and (c1, c2, root) of the classes that are linked with others: linked classes have one root."""
    rows = written(classes(docs, how.get("words", WORDS), how.get("long", LONG)), "join-classes")
    found, kept = links(docs, rows, **how)
    return rows, written(components(found).join(kept, "node").select("c1", "c2", "root"), "join-named")


def _grouped(rows: DataFrame, named: DataFrame, least) -> DataFrame:
    """(c1, c2, found): the smallest `least` of each class's component."""
    first = written(rows.filter("n > 0").groupBy("c1", "c2").agg(F.min(least).alias("one")).join(named, ["c1", "c2"], "left"), "join-least")
    of_root = first.filter("root IS NOT NULL").groupBy("root").agg(F.min("one").alias("found"), F.count("*").alias("n"))
    together = first.filter("root IS NOT NULL")
    heavy = hot(of_root, together.count(), parts(rows.sparkSession))
    tied = spread_join(together.select("c1", "c2", "root"), of_root.drop("n"), "root", heavy).select("c1", "c2", "found")
    return written(tied.unionAll(first.filter("root IS NULL").select("c1", "c2", F.col("one").alias("found"))), "join-found")


def component_ids(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    rows, named = _classes_named(docs, **how)
    least = _grouped(rows, named, F.col("doc_id"))
    out = rows.filter("n > 0").select("doc_id", "n", "c1", "c2").join(least, ["c1", "c2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("found").alias("component_id"))
    return out.unionAll(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))


def representatives(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` less all but one of each component, the one with the smallest doc_id. Rows with an empty set stay; of rows equal in doc_id
    and text one stays."""
    rows, named = _classes_named(docs, **how)
    stay = _grouped(rows, named, F.struct("dk", "th")).select("found.dk", "found.th").distinct().unionAll(rows.filter("n = 0").select("dk", "th").distinct())
    cols = docs.columns
    plain = docs.toDF(*(f"_{i}" for i in range(len(cols))))
    body = F.col(f"_{cols.index('text')}").cast("string")
    keyed = plain.withColumns({"dk": F.coalesce(F.col(f"_{cols.index('doc_id')}").cast("long"), F.lit(NO_ID)), "th": text_name(body)})
    return keyed.join(stay, ["dk", "th"], "left_semi").dropDuplicates(["dk", "th"]).drop("dk", "th").toDF(*cols)


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    return component_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
tied AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reached AS (SELECT doc_id AS d, doc_id AS r FROM n UNION SELECT reached.d, tied.y FROM reached JOIN tied ON tied.x = reached.r)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(l.first, documents.doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT d AS doc_id, min(r) AS first FROM reached GROUP BY 1) l USING (doc_id)
"""
