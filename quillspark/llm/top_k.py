"""Exact top-k search by a three-phase uniform threshold.

Vectors are packed into blocks of a few thousand rows, as integers of the width they need, queries likewise. A query block and a candidate block of the
same dimension make a tile. A vector's components are split into `segments`; a segment's partial score is one list of the threshold algorithm.

1. Each query block meets about the square root of the number of candidate blocks. Such a tile takes, for each query, the k best entries of each segment's
   list, resolves them, and reports the k best totals. The k-th best of all reported totals of a query is a safe cutoff: k candidates reach it,
   whatever the blocks that weren't met hold.
2. The cutoff goes to all tiles with the query block. Query blocks are grouped, up to `TOGETHER`, and so are candidate blocks; a group of queries is held by the
   task that has a group of candidates streamed past it, so a block moves once for each group of the other side and not for each block. A tile computes its lists, once. With lo_j the least partial score of segment j in the tile, an entry that
   reaches the cutoff has some partial score of at least lo_j + (cutoff - sum of lo) / segments; the tile collects the entries for which that holds.
3. The tile resolves the remaining segments of these entries exactly and reports those at or over the cutoff, at most k a query, ties to the
   smaller vec_id; the best k over all tiles are the answer.

Every query meets every candidate's lists once: the vectors have no structure that would let an exact search leave lists unread. What the threshold saves is
the collection and resolution of entries (README has figures) and the rows that tiles report.

Components become floor(scale * x); beyond the range of double they are its largest numbers. Vectors that are null or hold null or non-finite components, and
rows with a null vec_id, take no part. Vectors of different lengths aren't compared. Rows that repeat a vec_id count once, with their smallest vector. Sums
beyond 2**53 are computed with unbounded integers and cut to the range of long. Fewer than k candidates: all are returned. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, pick, written

K, SCALE, SEGMENTS, EVERY = 20, 64, 2, 20
BLOCK, QUERIES = 2048, 512
#: Query blocks that a task holds, and candidate blocks that pass them, at most.
TOGETHER = 16, 32
_LOWEST = -(1 << 63)


def _valid(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = pick(vectors, vec_id="long", embedding="array<double>").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))


def _narrow(flat: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds them."""
    most = np.abs(flat).max(initial=0)
    return flat.astype(next((t for t in (np.int8, np.int16, np.int32) if most <= np.iinfo(t).max), np.float64))


def _wide(data: bytes, rows: int, width: int) -> np.ndarray:
    kind = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.float64}[width]
    return np.frombuffer(data, kind).reshape(rows, -1) if rows else np.zeros((0, 0))


def _packed(rows: DataFrame, size: int, total: int, scale: int, cutoffs: bool = False) -> tuple[DataFrame, int]:
    """(dim, block, ids, width, matrix[, cutoffs]): a block has about `size` rows, dealt by a hash of vec_id; width is the bytes of a component."""
    blocks = max(1, -(-total // size))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        dim, block = table["dim"][0].as_py(), table["block"][0].as_py()
        with np.errstate(over="ignore"):
            flat = _narrow(np.nan_to_num(np.floor(scale * table["embedding"].combine_chunks().flatten().to_numpy().astype(np.float64))))
        last = {"cutoffs": [table["cutoff"].to_numpy().astype(np.int64).tobytes()]} if cutoffs else {}
        named = {"dim": pa.array([dim], pa.int32()), "block": pa.array([block], pa.int32()), "ids": [table["vec_id"].to_numpy().astype(np.int64).tobytes()]}
        return pa.table(named | {"width": pa.array([flat.itemsize], pa.int32()), "matrix": [flat.tobytes()], **last})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("dim", "block").applyInArrow(pack, "dim int, block int, ids binary, width int, matrix binary" + ", cutoffs binary" * cutoffs), blocks


def _partials(q: np.ndarray, c: np.ndarray, segments: int) -> list[np.ndarray]:
    """Each segment's partial scores, exact: in the narrowest type of numbers that holds all sums, as far as that is possible."""
    dim = q.shape[1]
    most = max(1.0, float(np.abs(q.astype(np.float64)).max(initial=0))) * max(1.0, float(np.abs(c.astype(np.float64)).max(initial=0))) * max(1, dim)
    if most < 2.0**53:
        q, c = (x.astype(np.float32 if most < 2.0**24 else np.float64) for x in (q, c))
    else:
        q, c = (np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape) for x in (q, c))
    edges = [dim * j // segments for j in range(segments + 1)]
    return [q[:, a:b] @ c[:, a:b].T if b > a else np.zeros((len(q), len(c)), q.dtype) for a, b in zip(edges, edges[1:], strict=False)]


def _whole(values) -> list[int]:
    return [max(_LOWEST, min(-_LOWEST - 1, int(v))) for v in values]


def _tiles(batches):
    """(dim, query ids, queries, candidate ids, candidates, rest) of the tiles that hold rows."""
    for batch in batches:
        for _, q_ids, q_width, q, c_ids, c_width, c, *rest in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            q_ids, c_ids = np.frombuffer(q_ids, np.int64), np.frombuffer(c_ids, np.int64)
            yield q_ids, _wide(q, len(q_ids), q_width), c_ids, _wide(c, len(c_ids), c_width), rest


def _first_phase(batches, k: int, segments: int):
    for q_ids, q, c_ids, c, _ in _tiles(batches):
        lists = _partials(q, c, segments)
        total = sum(lists[1:], lists[0])
        ids, best = [], []
        for i in range(len(q_ids)):
            own = c_ids == q_ids[i]
            picked = set()
            for s in lists:
                near = np.argpartition(s[i], -min(k + 1, len(c_ids)))[-(k + 1) :] if s.dtype != object else np.argsort(s[i])[-(k + 1) :]
                picked.update(near[~own[near]].tolist())
            got = sorted(_whole(total[i, list(picked)]), reverse=True)[:k]
            ids += [q_ids[i]] * len(got)
            best += got
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(best, pa.int64())], names=["query_id", "total"])


def sufficient(lists: list[np.ndarray], cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) places of the entries of any list that are over the uniform threshold. Thresholds are rounded down, never up."""
    whole = lists[0].dtype == object
    lows = [s.min(axis=1) for s in lists]
    # integers without bound; the lowest cutoff stands for none, as sums below it were cut to it
    over = [int(x) - sum(int(y) for y in low) if x > _LOWEST else 0 for x, low in zip(cut, zip(*lows, strict=True), strict=True)]
    enough = np.zeros(lists[0].shape, bool)
    for s, low in zip(lists, lows, strict=True):
        least = [int(a) + -(-o // len(lists)) for a, o in zip(low, over, strict=True)]
        # whole numbers below 2**53 on the left: one that is larger than the right's nearest double below it reaches the right
        enough |= (s >= np.array(least, dtype=object)[:, None]).astype(bool) if whole else s >= np.array([max(-(2.0**60), min(2.0**60, float(x))) for x in least])[:, None]
    return np.nonzero(enough)


def _passed(batches):
    """(query ids, queries, candidate ids, candidates, cutoffs) of the tiles of rows in which a group's queries come before its candidates."""
    now, held = None, []
    for batch in batches:
        for *group, candidates, ids, width, matrix, cut in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            ids = np.frombuffer(ids, np.int64)
            rows = _wide(matrix, len(ids), width)
            if group != now:
                now, held = group, []
            if candidates:
                for q_ids, q, least in held:
                    yield q_ids, q, ids, rows, least
            else:
                held.append((ids, rows, np.frombuffer(cut, np.int64)))


def _second_phase(batches, k: int, segments: int):
    for q_ids, q, c_ids, c, cut in _passed(batches):
        lists = _partials(q, c, segments)
        at_q, at_c = sufficient(lists, cut)
        total = sum((s[at_q, at_c] for s in lists[1:]), lists[0][at_q, at_c])
        score = np.array(_whole(total), np.int64) if total.dtype == object else total.astype(np.int64)
        good = (score >= cut[at_q]) & (q_ids[at_q] != c_ids[at_c])
        who, which, score = q_ids[at_q[good]], c_ids[at_c[good]], score[good]
        order = np.lexsort((which, ~score, who))  # ~x falls as x rises, without overflow
        who, which, score = who[order], which[order], score[order]
        starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, int)
        place = np.arange(len(who)) - np.repeat(starts, np.diff(np.r_[starts, len(who)]))
        few = place < k
        yield pa.RecordBatch.from_arrays([pa.array(who[few]), pa.array(which[few]), pa.array(score[few])], names=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, segments: int = SEGMENTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `vectors` for which the Column is_query (of vec_id) holds, the k best others."""
    rows = written(_valid(vectors), "top-vectors")
    total = rows.count()
    asked = rows.filter(is_query)
    n_asked = asked.count()
    packed, blocks = _packed(rows, BLOCK, total, scale)
    packed = written(packed, "top-blocks").select("dim", F.col("block").alias("c_block"), F.col("ids").alias("c_ids"), F.col("width").alias("c_width"), F.col("matrix").alias("c"))

    def tiles(queries: DataFrame, met: int, *more: str) -> DataFrame:
        """Each query block with `met` candidate blocks, from a place on that differs from query block to query block."""
        place = F.transform(F.sequence(F.lit(0), F.lit(met - 1)), lambda i: F.pmod(i + F.col("block"), F.lit(blocks)))
        spread = queries.withColumn("c_block", F.explode(place))
        return spread.join(packed, ["dim", "c_block"]).select("dim", F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("matrix").alias("q"), "c_ids", "c_width", "c", *more)

    first, _ = _packed(asked, QUERIES, n_asked, scale)
    near = tiles(first, math.isqrt(blocks - 1) + 1).mapInArrow(lambda b: _first_phase(b, k, segments), "query_id long, total long")
    down = Window.partitionBy("query_id").orderBy(F.desc("total"))
    cutoffs = near.withColumn("place", F.row_number().over(down)).filter(F.col("place") <= k).groupBy("query_id").agg(F.min("total").alias("least"), F.count("*").alias("n"))
    cutoffs = written(cutoffs.select(F.col("query_id").alias("vec_id"), F.when(F.col("n") == k, F.col("least")).otherwise(_LOWEST).alias("cutoff")), "top-cutoffs")
    with_cut = asked.join(cutoffs, "vec_id", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(_LOWEST)))
    second, asked_blocks = _packed(with_cut, QUERIES, n_asked, scale, cutoffs=True)
    tasks = parts(vectors.sparkSession)
    held = min(TOGETHER[0], asked_blocks)
    ways = -(-asked_blocks // held)
    past = max(1, min(TOGETHER[1], blocks * ways // (4 * tasks)))  # fewer where tasks would be too few
    groups = -(-blocks // past)
    copied = lambda rows, name, n: rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    queries = copied(second.withColumn("way", F.floor(F.col("block") / held).cast("int")), "group", groups)
    answers = copied(packed.withColumn("group", F.floor(F.col("c_block") / past).cast("int")), "way", ways)
    both = queries.select("dim", "way", "group", F.lit(False).alias("candidates"), "ids", "width", "matrix", "cutoffs").unionAll(
        answers.select("dim", "way", "group", F.lit(True), F.col("c_ids"), F.col("c_width"), F.col("c"), F.lit(None).cast("binary"))
    )
    sent = both.repartition(tasks, "dim", "way", "group").sortWithinPartitions("dim", "way", "group", "candidates")
    found = sent.mapInArrow(lambda b: _second_phase(b, k, segments), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_top_k(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)


OP10_SQL = f"""
WITH v AS (SELECT vec_id, [floor({SCALE} * x::DOUBLE) for x in embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
