"""Nearest neighbours by largest inner product with a vantage-point tree for each shard.

Vectors get one more component, sqrt(M^2 - |x|^2) with the largest norm M, queries a zero; distance then orders like the inner product and obeys
the triangle inequality. A shard's tree splits its vectors at the median distance from a vantage point. A subtree is left out when
``factor`` times the least distance that the inequality allows it exceeds the distance of the k-th best found so far: factor 1 leaves out
only what can't matter (exact search), a larger one leaves out more. Shards are dealt by a hash of id and vector and stay where they are, queries are packed in blocks, and
each block comes past each shard once; a block's k best of every shard are then ranked.

The search finds the k-th largest product of a query, then all points that reach it within the rounding of a product; these are scored in component order, so that ties,
also those of different vectors, go to the smaller id.

Equal vectors are one point of the tree with a list of ids, so any number of copies costs no depth. Null or zero vectors and those with null or
non-finite components take no part, as candidate or as query; vectors of another dimension are never compared. Ties go to the smaller id. Repeated
ids are candidates of their own but a query skips every row with its own id; a repeated query is answered once. Null ids take no part. Fewer candidates than k
give fewer rows; an empty table gives an empty result. Only id and vector are read, so other columns cannot clash.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import saved

K, FACTOR, LEAF, SHARD_ROWS, BLOCK_ROWS, PAIRS = 20, 1.6, 256, 8_192, 1_024, 1 << 19


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(ok, F.lit(False)) & F.exists(vector, lambda x: x != 0)


class Tree:
    """Points in leaf order; node i covers points[begin[i]:end[i]], inner nodes have a vantage point and a median distance."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, leaf: int = LEAF, seed: int = 7):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        first = np.ones(len(ids), bool)
        first[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        self.ids, self.at = ids, np.append(np.flatnonzero(first), len(ids))
        points = vectors[first].astype(np.float64)
        extra = np.sqrt(np.maximum(longest**2 - (points**2).sum(axis=1), 0))
        self.points, self.longest = np.column_stack([points, extra]), longest
        self.order = np.arange(len(points))
        self.nodes: list[tuple] = []
        self._split(0, len(points), leaf, np.random.default_rng(seed))
        self.points = self.points[self.order]

    def _split(self, begin: int, end: int, leaf: int, rng: np.random.Generator) -> int:
        me = len(self.nodes)
        self.nodes.append((begin, end, -1, -1, None, 0.0))
        if end - begin > leaf:
            own = self.order[begin:end]
            point = self.points[own[rng.integers(len(own))]]
            far = np.sqrt(((self.points[own] - point) ** 2).sum(axis=1))
            half = len(own) // 2
            cut = np.argpartition(far, half)
            self.order[begin:end] = own[cut]
            middle = float(far[cut[half]])
            near = self._split(begin, begin + half, leaf, rng)
            rest = self._split(begin + half, end, leaf, rng)
            self.nodes[me] = (begin, end, near, rest, point, middle)
        return me

    def search(self, queries: np.ndarray, k: int, factor: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, point) that hold, for each query, the k points of largest product and all whose product can't be told from the k-th's by its rounding."""
        n = len(queries)
        self.queries, length = queries, np.sqrt((queries**2).sum(axis=1))
        self.square = length**2 + self.longest**2
        self.slack = 1e-12 * (length * self.longest + 1e-300)
        self.best = np.full((n, k), -np.inf)
        if not len(self.points):
            return
        self.leaves: list[tuple[int, int, np.ndarray]] = []
        self._visit(0, np.arange(n), factor)
        kth = self.best.min(axis=1) - self.slack
        some = max(1, PAIRS // len(self.points))
        for at in range(0, n, some):  # however many tie, no more than a slice of queries is held
            found = [(np.empty(0, int),) * 2]
            for begin, end, who in self.leaves:
                own = who[(who >= at) & (who < at + some)]
                q, p = np.nonzero(self._products(own, begin, end) >= kth[own, None])
                found.append((own[q], begin + p))
            yield tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def _products(self, who: np.ndarray, begin: int, end: int) -> np.ndarray:
        return self.queries[who] @ self.points[begin:end, :-1].T

    def _reach(self, who: np.ndarray, product: np.ndarray) -> np.ndarray:
        """Distance of a point with this product (all points have the length ``longest``), and what rounding may add."""
        return np.sqrt(np.maximum(self.square[who] - 2 * product, 0)) + 1e-7 * np.sqrt(self.square[who])

    def _visit(self, node: int, who: np.ndarray, factor: float) -> None:
        if not len(who):
            return
        begin, end, near, rest, point, middle = self.nodes[node]
        if near < 0:
            both = np.column_stack([self.best[who], self._products(who, begin, end)])
            k = self.best.shape[1]
            self.best[who] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            self.leaves.append((begin, end, who))
            return
        away = np.sqrt(((self.queries[who] - point[:-1]) ** 2).sum(axis=1) + point[-1] ** 2)
        inside = away < middle
        for first, then, mine in ((near, rest, inside), (rest, near, ~inside)):
            some, gap = who[mine], np.abs(away[mine] - middle)
            self._visit(first, some, factor)
            self._visit(then, some[factor * gap <= self._reach(some, self.best[some].min(axis=1) - self.slack[some])], factor)


def answer(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> Iterator[pd.DataFrame]:
    """(query_id, vec_id, score) with the k best ids of the tree for each query, itself left out."""
    for q, place in tree.search(queries, k + 1, factor):
        # a sum in component order for each pair, whatever block it stands in: equal vectors get equal scores
        score = np.zeros(len(q))
        for i in range(queries.shape[1]):
            score += queries[q, i] * tree.points[place, i]
        point = tree.order[place]
        count = np.minimum(tree.at[point + 1] - tree.at[point], k + 1)
        rows = np.repeat(np.arange(len(q)), count)
        step = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        out = pd.DataFrame({"query_id": query_ids[q[rows]], "vec_id": tree.ids[tree.at[point[rows]] + step], "score": score[rows]})
        out = out[out["query_id"] != out["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        yield out.groupby("query_id").head(k)


def _pack(matrix: np.ndarray) -> bytes:
    file = io.BytesIO()
    np.save(file, matrix, allow_pickle=False)
    return file.getvalue()


def _packed(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows (id, v, dim, part) packed into one row for each dim and part, whose sizes the caller bounds."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        matrix = np.array(part["v"].tolist(), np.float64)
        return pd.DataFrame({**{c: part[c].iloc[:1].values for c in by}, "ids": [_pack(part["id"].to_numpy(np.int64))], "matrix": [_pack(matrix)]})

    return rows.groupBy(*by).applyInPandas(pack, "".join(f"{c} int, " for c in by) + "ids binary, matrix binary")


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, factor: float = FACTOR, leaf: int = LEAF, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of all rows for each row that ``queries`` selects."""
    ids = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    # the query column may use any column of the table
    rows = ids.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"), queries.alias("asked"))
    rows = saved(rows.withColumn("dim", F.size("v")))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = saved(rows.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("asked").cast("int")).alias("q"), F.sqrt(F.max(square)).alias("longest")))
    shards = F.ceil(F.col("n") / shard_rows).cast("int")
    blocks = F.greatest(F.ceil(F.col("q") / block_rows), F.lit(1)).cast("int")
    sized = rows.join(facts, "dim")
    deal = F.xxhash64("id", "v")
    stored = _packed(sized.select("id", "v", "dim", F.pmod(deal, shards).cast("int").alias("shard")), ["dim", "shard"])
    asked = sized.filter("asked").dropDuplicates(["id", "dim"])
    asked = asked.select("id", "v", "dim", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    packed = saved(_packed(asked, ["dim", "block"])).select("dim", "block", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    everywhere = packed.join(facts.select("dim", shards.alias("shards"), "longest"), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    # a shard's vectors are sent once and made a tree once, the small blocks of queries come past them
    sent = saved(stored).withColumn("kind", F.lit(0)).unionByName(everywhere.drop("block", "shards").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    tasks = max(1, facts.agg(F.sum(shards)).first()[0] or 0)
    pairs = sent.repartition(min(tasks, 10_000), "dim", "shard").sortWithinPartitions("dim", "shard", "kind")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored_rows, tree = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["kind"] == 0:
                    stored_rows, tree = [np.load(io.BytesIO(row[c])) for c in ("ids", "matrix")], None
                    continue
                tree = tree or Tree(*stored_rows, row["longest"], leaf)
                for got in answer(tree, np.load(io.BytesIO(row["q_ids"])), np.load(io.BytesIO(row["q_matrix"])), k, factor):
                    yield pa.RecordBatch.from_pandas(got, preserve_index=False)

    got = pairs.mapInArrow(searched, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
