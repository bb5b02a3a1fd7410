"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree splits at the median of a random projection, fitted on a bounded sample of the
vectors; every vector is then put into one leaf of each tree.  A query searches all trees
through one priority queue: a leaf's priority is the smallest signed margin on its path, so
taking leaves by falling priority, whatever their tree, is best-first search.  The vectors
of the leaves taken are reranked by the exact inner product.

Leaves are met by a shuffle on (tree, leaf, row chunk, query chunk); the chunks bound the
rows of a group, so a crowded leaf is spread over tasks.  Equal vectors are one entry with
their smallest ids, as many as any query can ask for, so copies cannot crowd a leaf.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part,
nor do rows without id or of another dimension than most; of rows with one vec_id the
smallest vector counts; ties go to the smaller vec_id; a query with fewer than ``k``
candidates gets all that were found; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from venuelens.llm.common import whole_groups
from venuelens.session import written

#: Vectors that the trees are fitted on, at most (in expectation; picked by hash).  All are indexed.
SAMPLE_BOUND = 20_000
TREES = 8
DEPTH = 8
#: Leaves that a query visits, over all trees.
VISITS = 352
#: Rows and queries of one group, at most about.
CHUNK = 8192

_OUT = "query_id bigint, vec_id bigint, score double"


@dataclass(frozen=True)
class Forest:
    """Planes of complete trees: normals and offsets by tree and node, nodes in level order."""

    normals: np.ndarray
    offsets: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int, depth: int, seed: int) -> Forest:
        rng = np.random.default_rng(seed)
        nodes, d = (1 << depth) - 1, sample.shape[1]
        normals = rng.normal(size=(trees, nodes, d))
        normals /= np.linalg.norm(normals, axis=2, keepdims=True)
        offsets = np.zeros((trees, nodes))
        for t in range(trees):
            parts = [np.arange(len(sample))]
            for node in range(nodes):
                part = parts[node]
                side = sample[part] @ normals[t, node]
                offsets[t, node] = np.median(side) if len(part) else 0.0
                parts += [part[side < offsets[t, node]], part[side >= offsets[t, node]]]
        return cls(normals, offsets)

    @property
    def depth(self) -> int:
        return int(self.offsets.shape[1] + 1).bit_length() - 1

    def margins(self, x: np.ndarray, tree: int) -> np.ndarray:
        return x @ self.normals[tree].T - self.offsets[tree]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.zeros((len(x), len(self.normals)), np.int32)
        for t in range(len(self.normals)):
            m, node = self.margins(x, t), np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (m[np.arange(len(x)), node] >= 0)
            out[:, t] = node - self.offsets.shape[1]
        return out

    def visits(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Trees and leaves of the first ``n`` leaves in the shared queue of each vector."""
        queues = []
        for t in range(len(self.normals)):
            m, best = self.margins(x, t), np.full((len(x), 1), np.inf)
            for level in range(self.depth):
                here = m[:, (1 << level) - 1 : (2 << level) - 1]
                best = np.stack([np.minimum(best, -here), np.minimum(best, here)], axis=2).reshape(len(x), -1)
            queues.append(best)
        queue = np.concatenate(queues, axis=1)
        first = np.argpartition(-queue, min(n, queue.shape[1]) - 1, axis=1)[:, :n]
        return first >> self.depth, first & ((1 << self.depth) - 1)


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, one per vec_id."""
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("embedding"))
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = v.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda c: c != 0))
    sizes = v.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    v = v.where(F.size("embedding") == (sizes[0]["size"] if sizes else 0))
    return v.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each query, each vec once; ties to the smaller vec."""
    order = np.lexsort([vec, -score, query])
    q, v = query[order], vec[order]
    twice = np.zeros(len(order), bool)
    twice[1:] = (q[1:] == q[:-1]) & (v[1:] == v[:-1])
    order, q = order[~twice], q[~twice]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def _search(k: int):
    """Task: in each group of rows and queries, the best rows of each query by exact inner product."""

    def run(batches):
        keys = ["tree", "leaf", "row_chunk", "query_chunk"]
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for frame in whole_groups(batches, keys):
            for _, group in frame.groupby(keys, sort=False):
                asks = group[group["ids"].isna()]
                rows = group[group["ids"].notna()]
                if not len(asks) or not len(rows):
                    continue
                q, x = _matrix(asks["embedding"]), _matrix(rows["embedding"])
                # All rows that reach the k-th of the others but for rounding, however many are equal.
                rough = q @ x.T
                n = min(len(rows), k + 1)
                least = np.partition(rough, len(rows) - n, axis=1)[:, len(rows) - n]
                margin = 1e-12 * q.shape[1] * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
                left, right = np.nonzero(rough >= (least - margin)[:, None])
                exact = np.zeros(len(left))
                for i in range(q.shape[1]):
                    exact += q[left, i] * x[right, i]
                ids = rows["ids"].to_numpy()
                counts = np.array([len(ids[i]) for i in range(len(rows))])
                vec = np.concatenate([ids[i] for i in right])
                query = np.repeat(asks["query_id"].to_numpy(np.int64)[left], counts[right])
                score = np.repeat(exact, counts[right])
                other = vec != query
                query, vec, score = query[other], vec[other].astype(np.int64), score[other]
                top = _best(query, vec, score, k)
                held.append((query[top], vec[top], score[top]))
                size += len(top)
                if size > 500_000:
                    held, size = [_merge(held, k)], 0
        if held:
            yield pd.DataFrame(dict(zip(["query_id", "vec_id", "score"], _merge(held, k), strict=True)))

    return run


def _merge(held: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    query, vec, score = (np.concatenate(x) for x in zip(*held, strict=True))
    top = _best(query, vec, score, k) if len(query) else np.zeros(0, int)
    return query[top], vec[top], score[top]


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, trees: int = TREES, depth: int = DEPTH,
    visits: int = VISITS, bound: int = SAMPLE_BOUND, seed: int = 11,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every vector that ``is_query`` picks."""
    spark = vectors.sparkSession
    kept = written(usable_vectors(vectors), "vectors")
    share = min(1.0, bound / max(1, kept.count()))
    place = F.pmod(F.xxhash64("vec_id", F.lit("forest sample")), F.lit(1 << 30))
    sample = kept.where(place < int(share * (1 << 30))).orderBy("vec_id").toPandas()
    if not len(sample):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    forest = Forest.fit(_matrix(sample["embedding"]), trees, depth, seed)

    copies = Window.partitionBy("embedding").orderBy("vec_id")
    rows = kept.withColumn("place", F.row_number().over(copies)).where(F.col("place") <= k + 1)
    rows = rows.groupBy("embedding").agg(F.collect_list("vec_id").alias("ids"))

    @F.pandas_udf("array<int>")
    def leaf_of(x: pd.Series) -> pd.Series:
        return pd.Series(list(forest.leaves(_matrix(x)))) if len(x) else pd.Series([], dtype=object)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def visited(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        tree, leaf = forest.visits(_matrix(x), min(visits, trees << depth))
        return pd.Series(list(((tree << depth) | leaf).astype(np.int32)))

    cells = rows.select("embedding", "ids", F.posexplode(leaf_of("embedding")).alias("tree", "leaf"))
    cells = written(cells, "leaves")
    asks = kept.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding", F.explode(visited("embedding")).alias("cell"))
    asks = asks.select("query_id", "embedding", F.shiftright("cell", depth).alias("tree"), F.col("cell").bitwiseAND(F.lit((1 << depth) - 1)).alias("leaf"))
    asks = written(asks, "asks")
    # Chunks per leaf, for at most trees * 2^depth leaves.
    row_chunks = cells.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("row_chunks"))
    ask_chunks = asks.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("ask_chunks"))
    chunks = F.broadcast(row_chunks.join(ask_chunks, ["tree", "leaf"]))

    def own(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    columns = ["tree", "leaf", "row_chunk", "query_chunk", "query_id", "ids", "embedding"]
    left = cells.join(chunks, ["tree", "leaf"]).withColumn("row_chunk", own("embedding", "row_chunks"))
    left = left.withColumn("query_chunk", every("ask_chunks")).withColumn("query_id", F.lit(None).cast("bigint"))
    right = asks.join(chunks, ["tree", "leaf"]).withColumn("query_chunk", own("query_id", "ask_chunks"))
    right = right.withColumn("row_chunk", every("row_chunks")).withColumn("ids", F.lit(None).cast("array<bigint>"))
    both = left.select(columns).union(right.select(columns))
    met = both.repartition("tree", "leaf", "row_chunk", "query_chunk")
    met = met.sortWithinPartitions("tree", "leaf", "row_chunk", "query_chunk", F.col("ids").isNull(), "query_id")
    found = met.mapInPandas(_search(k), _OUT)
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
