"""Hard negatives by rotated one-bit codes: popcount estimates with a certain error bound choose what is scored in integers.

Every integer vector is turned by one fixed rotation and stored as signs, each bit one sign: with a code its alignment to the vector is kept, and what the code leaves
over is coded again, ``LEVELS`` times in all; the length of the last rest is stored. An anchor is turned too and cut into ``PLANES`` bit planes, so
that code times anchor is a sum of popcounts. The rest stands at a right angle to the coded part, so by Cauchy and Schwarz it can add no more than
its length times the length of the anchor's part at that right angle; the planes' rounding adds no more than its own length times that of the coded part.
(One code alone leaves 0.6 of a vector's length, which in 64 dimensions excludes next to nothing; six leave a tenth.)
Only pairs whose interval can still matter are scored, in exact integers; the bound is certain, so the result is that of scoring all pairs.

Rows are packed in blocks as they lie in their partition (at most ``BLOCK_ROWS``, no shuffle, no key, so no key is hot); each block is sent to one task once,
the small anchor blocks come past it one after the other. A block gives its best few of an anchor, a window over these gives the best of all.

Rows with a null id, label or vector, an empty vector or a null or non-finite component take no part; vectors of another length are never compared.
Ties go to the smaller id. Repeated rows and ids are rows of their own as positives and negatives, but no row is a positive of an anchor with its own id, and an id with
several rows is an anchor once, by its least (length, label, vector). Fewer candidates give fewer rows, none gives none; an empty table gives an empty result. Scores
must fit 64 bits, larger ones raise an error. Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import saved

POSITIVES, NEGATIVES, LEAST, MOST = 5, 3, 50, 95
LEVELS, PLANES = 6, 7
BLOCK_ROWS, ANCHOR_ROWS, CELLS, SOME = 8_192, 512, 1 << 18, 512
BLOCK = "kind int, dim int, part int, seq int, ids binary, labels binary, x binary, codes binary, facts binary, limits binary"


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as an array of longs; null for vectors that take no part."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(ok, F.lit(False)) & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """The same orthogonal matrix in every task."""
    return np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))[0]


def _bits(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(signs, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


class Rows(NamedTuple):
    """A block of vectors with their codes (level, row, word) and facts: an alignment for each level, rest, coded length, length."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    codes: np.ndarray
    facts: np.ndarray


def coded(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, levels: int = LEVELS) -> Rows:
    """The block by id, every vector with its codes; all alignments are fitted anew with each code, so that the rest has none with any of them."""
    order = np.argsort(ids, kind="stable")
    ids, labels, x = ids[order], labels[order], x[order]
    y = x @ rotation(x.shape[1])
    rest, signs = y, np.empty((len(x), 0, x.shape[1]))
    for _ in range(levels):
        signs = np.concatenate([signs, np.where(rest >= 0, 1.0, -1.0)[:, None] / np.sqrt(x.shape[1])], axis=1)
        inverse = np.linalg.pinv(signs @ signs.transpose(0, 2, 1), rcond=1e-10, hermitian=True)
        weights = (inverse @ (signs @ y[:, :, None]))[:, :, 0]
        rest = y - (weights[:, None] @ signs)[:, 0]
    lengths = [np.linalg.norm(a, axis=1) for a in (rest, y - rest, y)]
    return Rows(ids, labels, x, np.stack([_bits(signs[:, level] > 0) for level in range(levels)]), np.stack([*weights.T, *lengths]))


def intervals(rows: Rows, x: np.ndarray, planes: int = PLANES) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible inner product of each anchor (rows of ``x``) with each row of the block."""
    dim, levels = x.shape[1], len(rows.codes)
    q = x @ rotation(dim)
    low = q.min(axis=1, keepdims=True)
    step = np.maximum((q.max(axis=1, keepdims=True) - low) / ((1 << planes) - 1), 1e-12)
    steps = np.rint((q - low) / step).astype(np.int64)
    own = np.linalg.norm(q, axis=1, keepdims=True)
    lost = np.linalg.norm(q - (low + step * steps), axis=1, keepdims=True)
    bits = [_bits((steps >> j) & 1 == 1) for j in range(planes)]
    whole = low * dim + step * steps.sum(axis=1, keepdims=True)
    kind = np.int16 if dim << planes < 1 << 15 else np.int32
    least, most = np.empty((2, len(x), len(rows.ids)))
    for at in range(0, len(rows.ids), SOME):  # a piece that stays in the processor's cache
        cut = slice(at, at + SOME)
        estimate = 0
        for code, weight in zip(rows.codes[:, cut], rows.facts[:levels, cut], strict=True):
            count = np.zeros((len(x), len(code)), kind)
            for j, plane in enumerate(bits):
                for w in range(code.shape[1]):
                    count += np.multiply(np.bitwise_count(plane[:, w, None] & code[:, w]), kind(1 << j), dtype=kind)
            set_bits = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
            estimate = estimate + weight / np.sqrt(dim) * (2 * (low * set_bits + step * count) - whole)
        rest, part, length = rows.facts[levels:, cut]
        error = part * lost
        along = np.maximum(np.abs(estimate) - error, 0) / np.maximum(part, 1e-300)
        radius = rest * np.sqrt(np.maximum(own**2 - along**2, 0)) + error + 1e-9 * own * length + 1e-6
        least[:, cut], most[:, cut] = estimate - radius, estimate + radius
    return least, most


def exact(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of left[a[i]] and right[b[i]]."""
    most = [max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))) for m in (left, right)]
    kind = np.int64 if most[0] * most[1] * left.shape[1] < 1 << 63 else object
    out = np.empty(len(a), kind)
    for at in range(0, len(a), 2_048):
        cut = slice(at, at + 2_048)
        x, y = left[a[cut]].astype(kind, copy=False), right[b[cut]].astype(kind, copy=False)
        out[cut] = np.einsum("ij,ij->i", x, y) if kind is np.int64 else (x * y).sum(axis=1)
    if kind is object and len(out) and max(map(abs, out)) >= 1 << 63:
        raise ValueError("inner products of these vectors do not fit 64 bits")
    return out.astype(np.int64)


def _largest(low: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, minus infinity where there are fewer."""
    n = low.shape[1]
    return np.partition(low, n - k, axis=1)[:, n - k, None] if n >= k else np.full((len(low), 1), -np.inf)


def _first(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each anchor."""
    order = np.lexsort((ids, -score, anchor))
    a = anchor[order]
    begins = np.searchsorted(a, a, "left")
    return order[np.arange(len(a)) - begins < k]


def _table(anchor: np.ndarray, place: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in ((anchor, "i8"), (place, "i4"), (ids, "i8"), (score, "i8"))], names=["anchor_id", "place", "vec_id", "score"])


def positives_in(rows: Rows, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, k: int = POSITIVES) -> pa.RecordBatch:
    """The block's k best rows of each anchor's label."""
    low, high = intervals(rows, x)
    same = (labels[:, None] == rows.labels) & (ids[:, None] != rows.ids)
    a, r = np.nonzero(same & (high >= _largest(np.where(same, low, -np.inf), k)))
    score = exact(x, rows.x, a, r)
    best = _first(a, score, rows.ids[r], k)
    return _table(ids[a[best]], np.zeros(len(best)), rows.ids[r[best]], score[best])


def negatives_in(rows: Rows, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, limits: np.ndarray, known: np.ndarray, k: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> pa.RecordBatch:
    """The block's k best rows of another label between ``least`` and ``most`` percent of each positive's score (``limits``, where ``known``)."""
    low, high = intervals(rows, x)
    other = labels[:, None] != rows.labels
    some = np.zeros(other.shape, bool)
    for place in range(limits.shape[1]):
        floor, ceiling = (limits[:, place, None] * (c / 100) for c in (least, most))
        floor, ceiling = floor - 1e-9 * np.abs(floor), ceiling + 1e-9 * np.abs(ceiling)
        near = other & known[:, place, None] & (high >= floor) & (low <= ceiling)
        sure = near & (low >= limits[:, place, None] * (least / 100) + 1e-6) & (high <= limits[:, place, None] * (most / 100) - 1e-6)
        some |= near & (high >= _largest(np.where(sure, low, -np.inf), k))
    a, r = np.nonzero(some)
    score = exact(x, rows.x, a, r)
    made = []
    for place in range(limits.shape[1]):
        of = limits[a, place]
        wide = max(int(np.abs(m).max(initial=0)) for m in (of, score)) > (1 << 63) // 100
        s, p = (score.astype(object), of.astype(object)) if wide else (score, of)
        fits = np.flatnonzero(known[a, place] & (least * p <= 100 * s).astype(bool) & (100 * s <= most * p).astype(bool))
        best = fits[_first(a[fits], score[fits], rows.ids[r[fits]], k)]
        made.append((ids[a[best]], np.full(len(best), place), rows.ids[r[best]], score[best]))
    return _table(*map(np.concatenate, zip(*made, strict=True)))


def _matrix(vectors: pa.ListArray, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Packed and coded blocks of at most ``block_rows`` rows of one length, as they follow one another in a partition."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), defaultdict(int), defaultdict(list)

        def made(dim: int, n: int) -> pa.RecordBatch:
            ids, labels, x = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
            if n < len(ids):
                held[dim].append((ids[n:], labels[n:], x[n:]))
            b = coded(ids[:n], labels[:n], x[:n])
            seq[dim] += 1
            return pa.RecordBatch.from_pylist(
                [{"kind": 0, "dim": dim, "part": part, "seq": seq[dim] - 1, "limits": None} | {c: getattr(b, c).tobytes() for c in b._fields}], to_schema)

        to_schema = pa.schema([(c, pa.int32() if t == "int" else pa.binary()) for c, t in (f.split() for f in BLOCK.split(", "))])
        for batch in batches:
            lengths = batch.column(2).value_lengths()
            for dim in lengths.unique().to_pylist():
                own = batch.filter(pa.compute.equal(lengths, dim))
                held[dim].append((own.column(0).to_numpy(), own.column(1).to_numpy(), _matrix(own.column(2), dim)))
                while (n := sum(len(h[0]) for h in held[dim])) >= block_rows:
                    yield made(dim, block_rows)
        for dim in list(held):
            if n := sum(len(h[0]) for h in held[dim]):
                yield made(dim, n)

    return rows.select("id", "label", "x").mapInArrow(packed, BLOCK)


def _numbered(blocks: DataFrame) -> DataFrame:
    """Blocks with a gapless number, ``lane``; the blocks of one length follow each other."""
    sizes = blocks.groupBy("dim", "part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("dim", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each length and partition
    offsets = sizes.select("dim", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return blocks.join(offsets, ["dim", "part"]).withColumn("lane", (F.col("_before") + F.col("seq")).cast("int")).drop("_before")


def _anchor_blocks(anchors: DataFrame, width: int) -> DataFrame:
    """Anchors (id, label, x, dim, scores) packed in blocks of about ANCHOR_ROWS; ``scores``: those of up to ``width`` positives."""
    sizes = anchors.groupBy("dim").agg(F.ceil(F.count("*") / ANCHOR_ROWS).cast("int").alias("_blocks"))
    dealt = anchors.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")).drop("_blocks")

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        limits = np.zeros((len(part), width + 1), np.int64)  # the last column counts
        for i, scores in enumerate(part["scores"]):
            limits[i, : len(scores)], limits[i, -1] = scores, len(scores)
        made = {"ids": part["id"].to_numpy(np.int64), "labels": part["label"].to_numpy(np.int64), "x": np.array(part["x"].tolist(), np.int64), "limits": limits}
        return pd.DataFrame({"kind": [1], "dim": [part["dim"].iat[0]]} | {c: [v.tobytes()] for c, v in made.items()})

    return dealt.groupBy("dim", "block").applyInPandas(pack, "kind int, dim int, ids binary, labels binary, x binary, limits binary")


def _met(blocks: DataFrame, anchors: DataFrame, width: int, search: Callable[..., pa.RecordBatch]) -> DataFrame:
    """What ``search`` gives for every block of rows with every block of anchors of the same length."""
    lanes = blocks.groupBy("dim").agg(F.min("lane").alias("_from"), F.max("lane").alias("_to"))
    sent = saved(_anchor_blocks(anchors, width)).join(lanes, "dim").withColumn("lane", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")
    number = max(1, blocks.count())
    both = blocks.drop("part", "seq").unionByName(sent, allowMissingColumns=True)
    dealt = both.repartition(min(number, 10_000), "lane").sortWithinPartitions("lane", "kind")

    def ints(data: bytes, *shape: int) -> np.ndarray:
        return np.frombuffer(data, np.int64).reshape(shape)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                dim, ids, labels = row["dim"], ints(row["ids"], -1), ints(row["labels"], -1)
                x = ints(row["x"], -1, dim)
                if row["kind"] == 0:
                    codes = np.frombuffer(row["codes"], np.uint64).reshape(-1, len(ids), -(-dim // 64))
                    rows = Rows(ids, labels, x, codes, np.frombuffer(row["facts"], np.float64).reshape(-1, len(ids)))
                    continue
                limits = ints(row["limits"], len(ids), width + 1)
                known = np.arange(width) < limits[:, -1:]
                some = max(1, CELLS // len(rows.ids))
                for at in range(0, len(ids), some):
                    cut = slice(at, at + some)
                    yield search(rows, ids[cut], labels[cut], x[cut], limits[cut, :-1], known[cut])

    return dealt.mapInArrow(searched, "anchor_id long, place int, vec_id long, score long")


def mine(rows: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "x", positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows that ``anchors`` selects.

    ``vector_col`` holds arrays of longs (see ``integers``). A positive is one of the first ``positives`` other rows of the anchor's label; its negatives are
    the first ``negatives`` rows of another label whose score lies between ``least`` and ``most`` percent of the positive's. Labels are whole numbers.
    """
    picked = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("x"), anchors.alias("asked"))
    picked = saved(picked.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0)))
    blocks = saved(_numbered(saved(_blocks(picked, block_rows))))
    one = picked.filter("asked").groupBy("id").agg(F.min(F.struct(F.size("x").alias("dim"), "label", "x")).alias("a"))
    asked = saved(one.select("id", "a.*"))
    none = F.array().cast("array<bigint>")

    found = _met(blocks, asked.withColumn("scores", none), 0, lambda r, i, lb, x, *_: positives_in(r, i, lb, x, positives))
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    near = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= positives)
    near = saved(near.select("anchor_id", (F.col("n") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    scores = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("s"))
    scores = scores.select(F.col("anchor_id").alias("id"), F.col("s.positive_score").alias("scores"))
    found = _met(blocks, asked.join(scores, "id"), positives, lambda r, i, lb, x, lim, known: negatives_in(r, i, lb, x, lim, known, negatives, least, most))
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    ranked = ranked.select("anchor_id", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return ranked.join(near, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
