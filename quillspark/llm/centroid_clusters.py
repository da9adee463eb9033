"""Centroid clustering by kd-tree filtering.

Each task packs the vectors it reads, `CHUNK` at a time, into kd-trees whose nodes hold a count, the integer sums and the box of their vectors. A round sends the
centroids to the trees. At a node the centroid nearest the box's middle rules out every other that is strictly farther from each point of the box (it is enough to look at the
corner that lies farthest towards the other); a centroid that only ties stays. A node with one centroid left is assigned whole, by its count and sums; at a leaf what is left is resolved exactly. A tree
returns a sum and a count a centroid, which Spark adds up; the driver gets one row a centroid and component, whatever the input. No vector is shuffled in
any round.

All numbers are whole: components floor(scale * x), distances, sums, and centroids, which are floors of exact quotients. Arithmetic is in doubles where all of it is
below 2**53, else in integers without bound. Distances and inertias beyond the range of long are cut to it.

Vectors that are null, hold null or non-finite components, or have another number of components take no part. Components beyond the range of double are its largest
numbers. A repeated vec_id is a vector each time; a null vec_id too, but it becomes a first centroid only after all others. Equal hashes (of a repeated vec_id)
go by the vectors' components. Fewer vectors than centroids: each is one. A vector with several nearest centroids goes to the smallest number; equal centroids are told apart that way, and the later of them
stays empty and where it is. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, written

K, DIM, SCALE, ROUNDS, SEED = 40, 64, 256, 5, 2
#: Vectors of a tree, and of a leaf at most.
CHUNK, LEAF = 16384, 32
#: Components up to this keep all terms of a squared distance, summed over DIM, below 2**53.
_PLAIN = 1 << 22
_LIMB = 40
_LONGEST = (1 << 63) - 1


def _whole(values: np.ndarray) -> np.ndarray:
    """floor'ed doubles as integers without bound."""
    return np.array([[int(x) for x in row] for row in values], dtype=object).reshape(values.shape)


class Tree:
    """A kd-tree over the rows of `points` (whole numbers held as doubles), in whose order `ids` and `points` are afterwards."""

    def __init__(self, ids: list, points: np.ndarray, leaf: int = LEAF):
        self.plain = not len(points) or bool(np.abs(points).max(initial=0) <= _PLAIN)
        order, nodes, stack = np.arange(len(points)), [], [(0, len(points), -1)]
        while stack:
            start, end, parent = stack.pop()
            part = points[order[start:end]]
            low, high = part.min(0), part.max(0)
            nodes.append([start, end, []])
            if parent >= 0:
                nodes[parent][2].append(len(nodes) - 1)
            if end - start > leaf and (low < high).any():
                with np.errstate(over="ignore"):
                    axis = int((high - low).argmax())
                middle = (start + end) // 2
                order[start:end] = order[start:end][np.argpartition(part[:, axis], middle - start)]
                stack += [(start, middle, len(nodes) - 1), (middle, end, len(nodes) - 1)]
        self.points = points[order]
        self.ids = [ids[i] for i in order]
        exact = self.points if self.plain else _whole(self.points)
        self.nodes = nodes
        self.low = np.array([exact[a:b].min(0) for a, b, _ in nodes])
        self.high = np.array([exact[a:b].max(0) for a, b, _ in nodes])
        self.sums = np.array([exact[a:b].sum(0) for a, b, _ in nodes])

    def assigned(self, centroids: list[list[int]]) -> Iterator[tuple[int, int, int, int, np.ndarray | None]]:
        """(start, end, centroid, node, None) of the nodes that are assigned whole and (start, end, -1, node, centroid of each row) of leaves."""
        plain = self.plain and all(abs(x) <= _PLAIN for c in centroids for x in c)
        kind = np.float64 if plain else object
        c = np.array(centroids, dtype=object).astype(kind)
        square = (c * c).sum(1)
        points = self.points if plain else _whole(self.points)
        low, high = (x if plain else x.astype(object) if not self.plain else _whole(x) for x in (self.low, self.high))
        stack = [(0, np.arange(len(centroids)))]
        while stack:
            node, left = stack.pop()
            start, end, below = self.nodes[node]
            if len(left) > 1:
                near = square[left] - c[left] @ (low[node] + high[node])  # the distance from the middle, less what is the same for all
                best = left[near.argmin()]
                way = c[left] - c[best]
                far = np.where(way > 0, way * high[node], way * low[node]).sum(1)
                left = left[square[left] - square[best] <= 2 * far]
            if len(left) == 1:
                yield start, end, int(left[0]), node, None
            elif below:
                stack += [(x, left) for x in below]
            else:
                part = points[start:end]
                yield start, end, -1, node, left[(square[left] - 2 * (part @ c[left].T)).argmin(1)]

    def totals(self, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
        """Number and integer sums of the vectors of each centroid that has any."""
        out: dict[int, tuple[int, list[int]]] = {}

        def add(k: int, n: int, sums) -> None:
            have, so_far = out.get(k, (0, [0] * len(sums)))
            out[k] = have + n, [x + int(y) for x, y in zip(so_far, sums, strict=True)]

        for start, end, k, node, each in self.assigned(centroids):
            if each is None:
                add(k, end - start, self.sums[node])
            else:
                part = self.points[start:end] if self.plain else _whole(self.points[start:end])
                for k in np.unique(each).tolist():
                    add(k, int((each == k).sum()), part[each == k].sum(0))
        return out

    def distances(self, centroids: list[list[int]]) -> tuple[list[int], list[int]]:
        """The centroid of each row and its squared distance."""
        of = np.zeros(len(self.points), np.int64)
        for start, end, k, _, each in self.assigned(centroids):
            of[start:end] = k if each is None else each
        c = np.array(centroids, dtype=object)
        if self.plain and all(abs(x) <= _PLAIN for row in centroids for x in row):
            far = ((self.points - c.astype(np.float64)[of]) ** 2).sum(1)
        else:
            far = ((_whole(self.points) - c[of]) ** 2).sum(1) if len(of) else []
        return of.tolist(), [min(int(x), _LONGEST) for x in far]


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, share): shares times 2**(40 * place) add up to the value, and each is small enough to be summed as a long."""
    sign, rest, place = (-1 if value < 0 else 1), abs(value), 0
    while rest:
        if part := rest & ((1 << _LIMB) - 1):
            yield place, sign * part
        rest, place = rest >> _LIMB, place + 1


def _planted(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(tree): the kd-trees of the vectors, each in the task that read them."""

    def packed(batches):
        ids, rows, held = [], [], 0

        def tree():
            with np.errstate(over="ignore"):
                points = np.nan_to_num(np.floor(scale * np.concatenate(rows)))
            return pa.RecordBatch.from_pydict({"tree": [pickle.dumps(Tree(ids, points))]})

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                ids += part.column(0).to_pylist()
                rows.append(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
                held += part.num_rows
                if held >= CHUNK:
                    yield tree()
                    ids, rows, held = [], [], 0
        if held:
            yield tree()

    return vectors.mapInArrow(packed, "tree binary")


def _valid(vectors: DataFrame, dim: int) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return pick(vectors, vec_id="long", embedding="array<double>").filter(F.col("embedding").isNotNull() & (F.size("embedding") == dim) & finite)


def _first(rows: DataFrame, k: int, scale: int, seed: int) -> list[list[int]]:
    """The k rows with the smallest hashes of their ids."""
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    least = rows.select(sha.alias("sha"), "embedding").orderBy(F.asc_nulls_last("sha"), "embedding").limit(k).collect()
    with np.errstate(over="ignore"):
        return [[int(x) for x in np.nan_to_num(np.floor(scale * np.array(r.embedding, np.float64)))] for r in least]


def _moved(trees: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: exact floors of the means, empty ones as they were."""

    def summed(batches):
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for packed in batch.column(0):
                for k, (n, sums) in pickle.loads(packed.as_py()).totals(centroids).items():
                    out.append((k, -1, 0, n))
                    out += [(k, j, place, part) for j, x in enumerate(sums) for place, part in _limbs(x)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["k", "j", "place", "part"])

    parts = trees.mapInArrow(summed, "k int, j int, place int, part long").groupBy("k", "j", "place").agg(F.sum("part").alias("part")).collect()
    counts = {r.k: r.part for r in parts if r.j < 0}
    sums = {k: [0] * len(centroids[k]) for k in counts}
    for r in parts:
        if r.j >= 0:
            sums[r.k][r.j] += r.part << (_LIMB * r.place)
    return [[x // counts[k] for x in sums[k]] if k in counts else c for k, c in enumerate(centroids)]


def clusters(vectors: DataFrame, k: int = K, dim: int = DIM, scale: int = SCALE, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector that takes part, and the final centroids."""
    rows = _valid(vectors, dim)
    centroids = _first(rows, k, scale, seed)
    trees = written(_planted(rows, dim, scale), "cluster-trees")
    for _ in range(rounds if centroids else 0):
        centroids = _moved(trees, centroids)

    def told(batches):
        for batch in batches:
            for packed in batch.column(0):
                tree = pickle.loads(packed.as_py())
                of, far = tree.distances(centroids)
                yield pa.RecordBatch.from_arrays([pa.array(tree.ids, pa.int64()), pa.array(of, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(told, "vec_id long, cluster int, distance long"), centroids


def described(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256, from one row a cluster."""
    spark = assigned.sparkSession
    assigned = written(assigned, "clusters")
    summed = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("far")).collect()
    total = min(_LONGEST, int(sum(r.far for r in summed)))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    per = spark.createDataFrame([(r.cluster, min(_LONGEST, int(r.far)), total, sha[r.cluster]) for r in summed], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    return described(*clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def _sql() -> str:
    steps = [
        f"v AS (SELECT vec_id, [floor({SCALE} * x::DOUBLE) for x in embedding] AS e FROM embeddings WHERE len(embedding) = {DIM} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY s) - 1 AS k, e FROM (SELECT sha256('{SEED}:' || vec_id) AS s, e FROM v ORDER BY s LIMIT {K}))",
    ]
    for i in range(ROUNDS + 1):
        far = "list_inner_product(v.e, v.e) - 2 * list_inner_product(v.e, c.e) + list_inner_product(c.e, c.e)"
        steps.append(f"a{i} AS (SELECT vec_id, any_value(e) AS e, arg_min(k, (d, k)) AS k, CAST(min(d) AS BIGINT) AS d FROM (SELECT vec_id, v.e, k, {far} AS d FROM v, c{i} c) GROUP BY vec_id)")
        if i < ROUNDS:
            steps.append(
                f"""m{i} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY j) AS e FROM (
                  SELECT k, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM a{i}) GROUP BY k, j) GROUP BY k)"""
            )
            steps.append(f"c{i + 1} AS (SELECT c.k, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m ON m.k = c.k)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string([CAST(CAST(x AS BIGINT) AS VARCHAR) for x in c.e], ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.k = a.k"""


OP13_SQL = _sql()
