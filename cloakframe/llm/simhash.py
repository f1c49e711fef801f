"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits: a bit is set if it is set in more than half of the hashes (XXH64, seed 42) of the text's shingles.
Two fingerprints that differ in at most ``bits`` bits agree in at least ``blocks - bits`` of ``blocks`` blocks. So each
fingerprint is filed under every choice of that many blocks, a join on the choice gives candidates, and the exact distance
is checked. Equal fingerprints are reduced to one row first.

A choice with more than ``hub_from`` different fingerprints is not paired off: each member names all points within half the
distance, and members that name one point are linked to the least of them. Two fingerprints are within the distance exactly
if they share such a point, so no link is lost, and the rows grow with the number of members, not with its square.

Null and empty texts and texts without a word have fingerprint zero and are linked like any other. Repeated rows and repeated
ids are rows of their own. Null ids take no part in the smallest id, unless a component has no other. An empty table gives an
empty result. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import WORD, by_text, parts, saved
from cloakframe.llm.components import components

BITS, BLOCKS, SHINGLE, HUB_FROM = 4, 7, 4, 500
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = bytes.maketrans(_UPPER, _LOWER)
_WORD = re.compile(WORD.encode())
SOME = 1 << 16


def _hashed(text: bytes, width: int, some: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the text's runs of ``width`` words, ``some`` at a time; a shorter text is one run, one without words has none."""
    words = _WORD.findall(text.translate(_TO_LOWER))
    if not words:
        return
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        yield np.array([h(joined, 42)], "<u8")
        return
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[:-1]]]
    n = len(words) - width + 1
    for at in range(0, n, some):
        yield np.array([h(joined[a:b], 42) for a, b in zip(starts[at : min(n, at + some)], ends[at + width - 1 :], strict=False)], "<u8")


def shingle_hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The hashes of all shingles of a UTF-8 text, repeats included."""
    return np.concatenate([np.empty(0, "<u8"), *_hashed(text, width, SOME)])


def _bit_counts(part: np.ndarray) -> np.ndarray:
    return np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes; zero for none."""
    counts = sum((_bit_counts(hashes[at : at + SOME]) for at in range(0, len(hashes), SOME)), np.zeros(64, np.int64))
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a UTF-8 text; a long text takes bounded memory."""
    counts, n = np.zeros(64, np.int64), 0
    for part in _hashed(text, width, SOME):
        counts, n = counts + _bit_counts(part), n + len(part)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, fp): the fingerprint as a signed long with the same bits."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in parts(batch, 0):
                fps = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(fps)], names=[*rows.schema.names[1:], "fp"])

    rows = docs.select(F.col(text_col).cast("string").alias("_text"), id_col, *carry)
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in (id_col, *carry))
    return by_text(rows).mapInArrow(marked, f"{kinds}fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(bits: int = BITS, blocks: int = BLOCKS) -> list[int]:
    """For each choice of ``blocks - bits`` blocks the mask of its bits."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    spans = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(spans, blocks - bits)]


def links(fps: DataFrame, bits: int = BITS, blocks: int = BLOCKS, hub_from: int = HUB_FROM) -> DataFrame:
    """Edges (u, v) between different fingerprints whose components are those of "at most ``bits`` bits differ".

    ``fps``: one column fp of distinct values. Every edge is a true link; in crowded blocks some links are implied by others.
    """
    masks = block_masks(bits, blocks)
    choices = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(masks)])
    filed = fps.select("fp", F.explode(choices).alias("x")).select("fp", "x.c", F.col("fp").bitwiseAND(F.col("x.m")).alias("key"))
    filed = saved(filed)
    size = filed.groupBy("c", "key").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = saved(size.filter(F.col("n") > hub_from))
    pairs_in = filed.join(size.filter(F.col("n") <= hub_from).select("c", "key"), ["c", "key"], "left_semi")
    a, b = pairs_in.alias("a"), pairs_in.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= bits
    pairs = a.join(b, (F.col("a.c") == F.col("b.c")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & near)
    edges = pairs.select(F.col("b.fp").alias("u"), F.col("a.fp").alias("v")).distinct()
    if crowded.isEmpty():
        return edges
    return edges.unionByName(hub_links(filed.join(crowded, ["c", "key"], "left_semi").select("fp").distinct(), bits))


def hub_links(fps: DataFrame, bits: int) -> DataFrame:
    """Edges by shared points: each fingerprint names every point within ``bits // 2`` bits (even ``bits``)."""
    if bits % 2:
        raise ValueError("crowded blocks need an even number of bits")
    flips = [0] + [sum(1 << i for i in c) for k in range(1, bits // 2 + 1) for c in combinations(range(64), k)]
    hubs = F.from_json(F.lit(json.dumps([_signed(x) for x in flips])), "array<bigint>")  # a constant of bits: 2,081 masks for 4
    named = fps.select("fp", F.explode(hubs).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"))
    named = saved(named)
    least = named.groupBy("hub").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1")
    return named.join(least, "hub").filter("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, bits: int = BITS, blocks: int = BLOCKS, hub_from: int = HUB_FROM) -> DataFrame:
    """One row per document: id, fingerprint (hex), component_id (smallest id reachable by links, itself included)."""
    marked = saved(fingerprints(docs, id_col, text_col, width))
    least = saved(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    found = components(links(least.select("fp"), bits, blocks, hub_from))
    linked = found.join(least, found.node == least.fp).select("node", "component", "least")
    named = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = linked.join(named, "component").select(F.col("node").alias("fp"), "component_id")
    per_fp = saved(least.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return marked.join(per_fp, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, bits: int = BITS, blocks: int = BLOCKS, hub_from: int = HUB_FROM) -> DataFrame:
    """One row of each component: that with the smallest id, of several texts with that id the one with the least digest.

    All columns are kept as they are and must be orderable: of rows equal in id and text the least row stays. Null ids stand last.
    """
    known = F.when(F.col(id_col).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(id_col).cast("string")))
    key = F.md5(F.concat(known, F.lit("\x00"), F.coalesce(F.col(text_col), F.lit("")))).alias("key")
    packed = docs.select(key, F.struct(*docs.columns).alias("row"))
    marked = saved(fingerprints(packed.select("key", f"row.{id_col}", f"row.{text_col}"), id_col, text_col, width, ("key",)))
    least = saved(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    found = components(links(least.select("fp"), bits, blocks, hub_from))
    to = marked.join(found, marked.fp == found.node, "left").select("key", F.col(id_col).alias("id"), F.coalesce("component", "fp").alias("component"))
    first = F.min_by("key", F.struct(F.col("id").isNull(), "id", "key")).alias("key")
    chosen = to.groupBy("component").agg(first).select("key")
    rows = packed.groupBy("key").agg(F.min("row").alias("row"))  # map-side: a third of all rows may be one row
    return rows.join(chosen, "key", "left_semi").select("row.*")
