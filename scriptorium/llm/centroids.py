"""K-means over whole-number vectors, by filtering centroids through kd-trees.

Each task builds kd-trees over blocks of its vectors; a node holds how many
vectors it has, their sum and their box. In a round every tree is walked from
the root with all centroids as candidates. Of a node's candidates the one
nearest to the middle of its box stands against the others: a centroid that is
strictly farther from the corner of the box that suits it best is farther from
every vector inside, and goes. A node with one candidate left is assigned as a
whole; a leaf is resolved vector by vector.

Trees are built once and stored; a round reads them and gives back a count and
a sum for each centroid and task. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import text as tx
from scriptorium.llm.pieces import runs
from scriptorium.llm.store import forget, stored

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 8, 10, 64, 1024
#: Vectors of a tree, and of a leaf.
BLOCK, LEAF = 8192, 16
#: Components are smaller than this, so that a squared distance in 64 dimensions fits into 63 bits.
BOUND = 1 << 27

TREES = pa.schema([("n", pa.int64()), ("vec_ids", pa.list_(pa.int64())), ("points", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("sums", pa.binary()), ("starts", pa.binary())])
SUMS = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
ASSIGNED = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def usable(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """Whether a vector has so many components, none null or non-finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & fine, F.lit(False))


class Tree:
    """A balanced kd-tree over the rows of points: node k has the children 2k + 1 and 2k + 2, and the rows starts[k]:starts[k] + counts[k] in the tree's order."""

    def __init__(self, points: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray, starts: np.ndarray):
        self.points, self.low, self.high, self.sums = points, low, high, sums
        self.starts, self.counts = starts[0], starts[1]

    @staticmethod
    def levels(n: int) -> int:
        return max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))

    @classmethod
    def built(cls, points: np.ndarray) -> tuple[np.ndarray, Tree]:
        """(order of the rows, tree over them in this order)."""
        n, d = points.shape
        depth = cls.levels(n)
        nodes = (2 << depth) - 1
        low, high, sums = np.zeros((nodes, d), np.int64), np.zeros((nodes, d), np.int64), np.zeros((nodes, d), np.int64)
        starts = np.zeros((2, nodes), np.int64)
        order = np.arange(n)
        starts[1, 0] = n
        for k in range(nodes):
            a, m = starts[0, k], starts[1, k]
            mine = points[order[a : a + m]]
            low[k], high[k], sums[k] = mine.min(0), mine.max(0), mine.sum(0)
            if 2 * k + 2 < nodes:
                half = m // 2
                widest = int((high[k] - low[k]).argmax())
                order[a : a + m] = order[a : a + m][np.argpartition(mine[:, widest], half)]
                starts[:, 2 * k + 1] = a, half
                starts[:, 2 * k + 2] = a + half, m - half
        return order, cls(points[order], low, high, sums, starts)

    def assign(self, centroids: np.ndarray, each: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(vectors of each centroid, their sums, and if asked for the centroid of each row and its squared distance); ties go to the first centroid."""
        k, d = centroids.shape
        n, sums = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        cluster = np.zeros(len(self.points), np.int64)
        nodes, candidates = np.zeros(1, np.int64), np.ones((1, k), bool)
        least = (len(self.starts) - 1) // 2
        leaves, of_leaf = [], []
        while len(nodes):
            candidates = self._filtered(nodes, candidates, centroids)
            one = candidates.sum(1) == 1
            owner = candidates[one].argmax(1)
            np.add.at(n, owner, self.counts[nodes[one]])
            np.add.at(sums, owner, self.sums[nodes[one]])
            cluster[runs(self.starts[nodes[one]], self.counts[nodes[one]])] = np.repeat(owner, self.counts[nodes[one]])
            leaf = ~one & (nodes >= least)
            leaves.append(nodes[leaf])
            of_leaf.append(candidates[leaf])
            inner = ~one & ~leaf
            nodes, candidates = np.stack([2 * nodes[inner] + 1, 2 * nodes[inner] + 2], 1).ravel(), np.repeat(candidates[inner], 2, 0)
        at, fit = np.concatenate(leaves), np.concatenate(of_leaf)
        rows = runs(self.starts[at], self.counts[at])
        distance = np.where(np.repeat(fit, self.counts[at], 0), distances(self.points[rows], centroids), np.iinfo(np.int64).max)
        cluster[rows] = distance.argmin(1)
        np.add.at(n, cluster[rows], 1)
        np.add.at(sums, cluster[rows], self.points[rows])
        if not each:
            return n, sums, cluster, distance
        apart = self.points - centroids[cluster]
        return n, sums, cluster, (apart * apart).sum(1)

    def _filtered(self, nodes: np.ndarray, candidates: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """The candidates of each node that are not strictly farther than its best from all of its box."""
        low, high = self.low[nodes], self.high[nodes]
        middle = distances(low + high, 2 * centroids)
        best = np.where(candidates, middle, np.iinfo(np.int64).max).argmin(1)
        kept = candidates.copy()
        for z in range(len(centroids)):
            apart = centroids[z] - centroids[best]
            corner = np.where(apart > 0, high, low)
            kept[:, z] &= (apart * (centroids[z] + centroids[best] - 2 * corner)).sum(1) <= 0
        return kept


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, exact: in floating point where every sum stays below 2**53."""
    largest = max(int(np.abs(x).max(initial=0)) for x in (points, centroids))
    if 4 * points.shape[1] * largest * largest < 1 << 53:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], 1)


def trees(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """A stored row for each block of (vec_id bigint, vector array<double>): its tree and its ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
                points = np.floor(flat.reshape(len(part), -1) * scale)
                if np.abs(points).max() >= BOUND:
                    raise ValueError(f"scaled components must be below {BOUND}")
                order, tree = Tree.built(points.astype(np.int64))
                packed = [x.astype(t).tobytes() for x, t in ((tree.points, np.int32), (tree.low, np.int32), (tree.high, np.int32), (tree.sums, np.int64), (np.stack([tree.starts, tree.counts]), np.int64))]
                ids = part.column(0).take(pa.array(order))
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *[pa.array([x]) for x in packed]], schema=TREES)

    return stored(vectors.mapInArrow(run, "n bigint, vec_ids array<bigint>, points binary, low binary, high binary, sums binary, starts binary"))


def _unpacked(batch: pa.RecordBatch, row: int, dimensions: int) -> Tree:
    def array(name: str, kind: type, *shape: int) -> np.ndarray:
        return np.frombuffer(batch.column(name)[row].as_buffer(), kind).reshape(shape).astype(np.int64)

    return Tree(*(array(c, np.int32, -1, dimensions) for c in ("points", "low", "high")), array("sums", np.int64, -1, dimensions), array("starts", np.int64, 2, -1))


def _moved(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: each centroid becomes the floor of the mean of its vectors; one without vectors stays."""
    k, d = centroids.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for batch in batches:
            for row in range(len(batch)):
                more, total, *_ = _unpacked(batch, row, d).assign(centroids, each=False)
                n, sums = n + more, sums + total
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), tx.ragged(sums[some].ravel(), np.full(len(some), d))], schema=SUMS)

    # a row for each centroid and task; sums of sums may be beyond 64 bits
    parts = forest.drop("vec_ids").mapInArrow(run, tx.ddl(SUMS)).select("cluster", "n", F.posexplode("sums").alias("at", "s"))
    rows = parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    moved = centroids.copy()
    for row in rows:
        moved[row.cluster, row.at] = int(row.s) // row.n
    return moved


def clustered(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each usable vector with its cluster, its squared distance to the centroid, and sums of these.

    Vectors with another number of components, or with one that is null or not
    finite, are left out, as null vectors are; components become
    floor(1024 * x) and must stay below BOUND, else the query fails, as
    distances would not fit. The centroids start as the vectors whose
    `<seed>:<vec_id>` has the smallest sha256, in its order; rows that share a
    vec_id come in the order of their components. A null vec_id stays null and
    starts no centroid. With fewer usable vectors there are fewer clusters, and
    without any no rows. Ties go to the smaller cluster; other columns are
    ignored.
    """
    vectors = table.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(usable(F.col("vector"), dimensions))
    forest = trees(vectors)
    named = vectors.filter("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"), "vector")
    first = named.orderBy("hash", "vector").limit(clusters).collect()
    if not first:
        forget(forest)
        return table.sparkSession.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    centroids = np.floor(np.array([r.vector for r in first]) * SCALE).astype(np.int64)
    for _ in range(rounds):
        centroids = _moved(forest, centroids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                *_, cluster, distance = _unpacked(batch, row, dimensions).assign(centroids, each=True)
                yield pa.RecordBatch.from_arrays([batch.column("vec_ids")[row].values, pa.array(cluster.astype(np.int32)), pa.array(distance)], schema=ASSIGNED)

    assigned = stored(forest.mapInArrow(run, tx.ddl(ASSIGNED)))
    forget(forest)
    # a row for each cluster
    inertia = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    spelled = [(k, inertia.get(k, 0), sum(inertia.values()), ",".join(map(str, c))) for k, c in enumerate(centroids.tolist())]
    small = table.sparkSession.createDataFrame(spelled, "cluster int, cluster_inertia bigint, inertia bigint, components string")
    return assigned.join(F.broadcast(small.withColumn("centroid_sha256", F.sha2("components", 256)).drop("components")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = 3) -> str:
    """The same as SQL for DuckDB, round by round, from the table `embeddings`."""
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS k, v FROM kept WHERE vec_id IS NOT NULL ORDER BY k LIMIT {clusters})",
    ]
    for i in range(rounds + 1):
        steps.append(f"d{i} AS MATERIALIZED (SELECT rowid_ AS r, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT rowid_, k, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM points p, c{i} c) GROUP BY rowid_)")
        if i < rounds:
            steps.append(f"m{i} AS MATERIALIZED (SELECT k, place, (s - ((s % n) + n) % n) // n AS x FROM (SELECT k, place, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range(1, {dimensions} + 1)) AS place FROM d{i} JOIN points ON rowid_ = r) GROUP BY k, place))")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT k, list(CAST(x AS BIGINT) ORDER BY place) AS v FROM m{i} GROUP BY k) n USING (k))")
    steps.insert(1, "points AS MATERIALIZED (SELECT row_number() OVER () AS rowid_, * FROM kept)")
    return f"""WITH {", ".join(steps)} SELECT vec_id, CAST(d.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY d.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM d{rounds} d JOIN points ON rowid_ = r JOIN c{rounds} c ON c.k = d.k"""
