"""Near-duplicates by the Jaccard similarity of their sets of word shingles: SimHash blocks and MinHash bands find candidates, exact sets decide.

Two texts are linked if their sets of ``WIDTH`` = 5 word shingles (64-bit hashes, words as in ``simhash``) have a similarity of ``LEAST`` = 0.8 or more; every link is
decided on the two exact sets. Candidates come from the pigeonhole blocks of ``simhash`` and from ``BANDS`` = 25 bands of ``ROWS`` = 4 minima: a pair of that similarity shares a
band with probability 1 - (1 - 0.8**4)**25, all but two in a million. Equal sets are one node from the start.

A band is not paired off. In each round its members are compared with one leader, links are merged to components, and only bands whose members still lie in several
components go on: a group of near copies ends after one round, rows grow with the members. A small band is then paired off. The members of a large band that ``ROUNDS``
leaders have not settled - texts that a common passage brings together - are filed by prefixes instead: shingles are ordered by how many of these texts have them, rarest
first; two sets of the similarity share one among the first n - ceil(8n/9) + 1 shingles of the smaller and the first n - ceil(4n/5) + 1 of the other, at places that
leave enough shingles behind them. That is exact, and a passage that all have stands last. Crowded shingles get leaders too before the rest is compared.

Null and empty texts and texts without a word have the empty set and are copies of each other; a text of fewer words than a shingle is one shingle. Long texts are hashed whole. Repeated
rows are one row. Of texts with one id, that with the least digest comes first; null ids stand last. An empty table gives an empty result. Columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm import simhash
from cloakframe.llm.common import by_text, parts, saved, scratch
from cloakframe.llm.components import components
from cloakframe.llm.words import mix

WIDTH, BANDS, ROWS, ROUNDS, FEW = 5, 25, 4, 2, 16
LEAST = (4, 5)
_RANDOM = np.random.default_rng(5)
_XOR = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
SOME = 1 << 12


def bands(found: np.ndarray) -> np.ndarray:
    """One key for each band; sets with the same minima in a band have its key in common."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(found), SOME):
        least = np.minimum(least, ((found[at : at + SOME] ^ _XOR) * _TIMES).min(axis=1))
    keys = mix(np.arange(BANDS, dtype=np.uint64))
    for row in least.reshape(BANDS, ROWS).T:
        keys = mix(keys ^ row)
    return keys


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.view(np.int64) for a in arrays], pa.list_(pa.int64()))


def _mapped(rows: DataFrame, kept: tuple[str, ...], once: str, made, kinds: str) -> DataFrame:
    """``kept`` columns and the columns that ``made`` gives for the first column's texts; a task gives each value of ``once`` once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            values = batch.column(once).to_pylist()
            new = [v not in seen and not seen.add(v) for v in values]
            for part, texts in parts(batch.filter(pa.array(new, pa.bool_())), 0):
                columns = made([simhash.shingle_hashes(t, WIDTH) for t in texts])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns.values()], names=[*part.schema.names[1:], *columns])

    types = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in kept)
    return by_text(rows).mapInArrow(run, types + kinds)


def _sketch(hashes: list[np.ndarray]) -> dict[str, pa.Array]:
    sets = [np.unique(h) for h in hashes]
    sig = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
    fps = np.array([simhash.majority(h) for h in hashes], np.uint64).view(np.int64)
    return {"fp": pa.array(fps), "sig": pa.array(sig), "n": pa.array([len(s) for s in sets], pa.int64()), "bands": _longs([bands(s) for s in sets])}


def _held(hashes: list[np.ndarray]) -> dict[str, pa.Array]:
    return {"held": _longs([np.unique(h) for h in hashes])}


def _near_in_size(a: Column | str, b: Column | str) -> Column:
    return F.least(a, b) * LEAST[1] >= F.greatest(a, b) * LEAST[0]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (u, v, and other columns that depend on them) whose exact sets (sig, held) are similar."""
    pairs = saved(pairs.distinct())
    a, b = sets.toDF("u", "a"), sets.toDF("v", "b")
    both = pairs.join(a, "u").join(b, "v").withColumn("both", F.size(F.array_intersect("a", "b"))).withColumn("all", F.size("a") + F.size("b"))
    return both.filter(F.col("both") * LEAST[1] >= (F.col("all") - F.col("both")) * LEAST[0]).select(*pairs.columns)


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components (sig, comp) after links (cu, cv) between components."""
    found = components(links.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    return saved(comp.join(found, comp.comp == found.node, "left").select("sig", F.coalesce("component", "comp").alias("comp")))


def _unsettled(filed: DataFrame, comp: DataFrame) -> DataFrame:
    """Members of the bands that hold several components, with their component and the band's size."""
    now = filed.join(comp, "sig")
    many = now.groupBy("band").agg(F.count("*").alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    return saved(now.join(many.select("band", "members"), "band"))


def _led(open_: DataFrame, turn: int) -> DataFrame:
    """Each member with its band's leader of this turn, where their sizes allow a link and their components differ. One order of leaders for all bands: many pairs are the same."""
    lead = open_.groupBy("band").agg(F.min_by(F.struct("sig", "n", "comp"), F.struct(F.xxhash64("sig", F.lit(turn)), "sig")).alias("lead"))
    met = open_.join(lead, "band").filter((F.col("comp") != F.col("lead.comp")) & _near_in_size("n", "lead.n"))
    return met.select(F.col("sig").alias("u"), F.col("lead.sig").alias("v"), F.col("comp").alias("cu"), F.col("lead.comp").alias("cv"))


def _paired(a: DataFrame, b: DataFrame, also: Column) -> DataFrame:
    """All pairs of a band's members whose components differ and that ``also`` lets pass (columns of aliases a and b)."""
    met = a.alias("a").join(b.alias("b"), (F.col("a.band") == F.col("b.band")) & (F.col("a.comp") != F.col("b.comp")) & _near_in_size("a.n", "b.n") & also)
    return met.select(F.col("b.sig").alias("u"), F.col("a.sig").alias("v"), F.col("b.comp").alias("cu"), F.col("a.comp").alias("cv"))


def settle_bands(filed: DataFrame, comp: DataFrame, sets: DataFrame, rounds: int = ROUNDS, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """Components after ``rounds`` leaders of each band, and the members (sig) of the bands that are still unsettled."""
    for turn in range(rounds):
        filed = _unsettled(filed, comp)
        if filed.isEmpty():
            break
        pairs = _led(filed, turn)
        if turn:
            small = filed.filter(F.col("members") <= few)
            pairs = pairs.union(_paired(small, small, F.col("a.sig") < F.col("b.sig")))
        comp = _merged(comp, verified(pairs, sets))
        # a pair is settled by its leader, a small band by its pairs
        filed = filed.filter(F.col("members") > (few if turn else 2)).select("band", "sig", "n")
    return comp, _unsettled(filed.select("band", "sig", "n"), comp).select("sig").distinct()


def prefixes(sets: DataFrame) -> DataFrame:
    """Shingles (band) that stand early enough in a set (sig, held) to prove a similar partner: sig, n, at (place), first (also as the smaller set). Rarest shingles come first."""
    tokens = sets.select("sig", F.size("held").cast("long").alias("n"), F.explode("held").alias("band"))
    often = tokens.groupBy("band").agg(F.count("*").alias("df")).filter("df > 1")
    own = Window.partitionBy("sig")
    placed = tokens.join(often, "band").withColumn("at", F.row_number().over(own.orderBy("df", "band")) - 1 + F.col("n") - F.count("*").over(own))
    early = placed.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * LEAST[0] / LEAST[1]))
    return early.select("band", "sig", "n", "at", (F.col("at") <= F.col("n") - F.ceil(F.col("n") * 2 * LEAST[0] / sum(LEAST))).alias("first"))


def settle_prefixes(comp: DataFrame, sets: DataFrame, rounds: int = ROUNDS, few: int = FEW) -> DataFrame:
    """Components after all links between ``sets``: exact, by prefixes."""
    filed = saved(prefixes(sets))
    for turn in range(rounds):
        crowded = _unsettled(filed.select("band", "sig", "n"), comp).filter(F.col("members") > few)
        if crowded.isEmpty():
            break
        comp = _merged(comp, verified(_led(crowded, turn + ROUNDS), sets))
    rest = saved(filed.join(comp, "sig"))
    smaller = F.struct("a.n", "a.sig") < F.struct("b.n", "b.sig")
    behind = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    enough = behind * sum(LEAST) >= (F.col("a.n") + F.col("b.n")) * LEAST[0]
    return _merged(comp, verified(_paired(rest.filter("first"), rest, smaller & enough), sets))


def classes(nodes: DataFrame, texts: DataFrame, rounds: int = ROUNDS, few: int = FEW) -> DataFrame:
    """(sig, comp) for every set: ``nodes`` (sig, key, n, fp, bands) with distinct sig, ``texts`` (_text, key)."""
    filed = saved(nodes.select("sig", "n", F.explode("bands").alias("band")))
    alone = filed.groupBy("band").agg(F.count("*").alias("c"), F.min("sig").alias("sig")).filter("c > 1").select("band")
    filed = saved(filed.join(alone, "band", "left_semi"))
    blocks = saved(simhash_pairs(nodes))
    met = filed.select("sig").union(blocks.select("u")).union(blocks.select("v")).distinct()
    wanted = saved(nodes.join(met, "sig", "left_semi").select("key", "sig"))
    sets = saved(_mapped(texts.join(wanted, "key").select("_text", "sig"), ("sig",), "sig", _held, "held array<bigint>").dropDuplicates(["sig"]))
    comp = nodes.select("sig", F.col("sig").alias("comp"))
    comp = _merged(comp, verified(blocks.select("u", "v", F.col("u").alias("cu"), F.col("v").alias("cv")), sets))
    comp, rest = settle_bands(filed, comp, sets, rounds, few)
    rest = saved(rest)
    return comp if rest.isEmpty() else settle_prefixes(comp, saved(sets.join(rest, "sig", "left_semi")), rounds, few)


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates (u, v) by fingerprint: sets with one fingerprint meet the least of them, linked fingerprints by theirs."""
    least = saved(nodes.groupBy("fp").agg(F.min(F.struct("sig", "n")).alias("s")))
    same = nodes.join(least, "fp").filter((F.col("sig") != F.col("s.sig")) & _near_in_size("n", "s.n")).select(F.col("sig").alias("u"), F.col("s.sig").alias("v"))
    a, b = least.select(F.col("fp").alias("u"), F.col("s").alias("a")), least.select(F.col("fp").alias("v"), F.col("s").alias("b"))
    linked = simhash.links(least.select("fp")).join(a, "u").join(b, "v").filter(_near_in_size("a.n", "b.n"))
    return same.union(linked.select(F.col("a.sig").alias("u"), F.col("b.sig").alias("v")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, few: int = FEW) -> DataFrame:
    """One row of each component of similar texts: that with the smallest id, of several texts with that id the one with the least digest.

    All columns are kept as they are and must be orderable: of rows equal in id and text the least row stays. Tables of the work are removed; what is left is the list of
    the rows that stay.
    """
    known = F.when(F.col(id_col).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(id_col).cast("string")))
    key = F.md5(F.concat(known, F.lit("\x00"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("key")
    packed = docs.select(key, F.struct(*docs.columns).alias("row"))
    texts = packed.select(F.col(f"row.`{text_col}`").cast("string").alias("_text"), "key", F.col(f"row.`{id_col}`").alias("id"))
    with scratch(docs.sparkSession) as keep:
        marked = saved(_mapped(texts, ("key", "id"), "key", _sketch, "fp bigint, sig bigint, n bigint, bands array<bigint>"))
        one = marked.groupBy("sig").agg(F.min_by(F.struct("key", "n", "fp", "bands"), "key").alias("o"))
        found = classes(saved(one.select("sig", "o.*")), texts.select("_text", "key"), rounds, few)
        first = F.min_by("key", F.struct(F.col("id").isNull(), "id", "key")).alias("key")
        chosen = keep(marked.join(found, "sig").groupBy("comp").agg(first).select("key"))
    rows = packed.join(chosen, "key", "left_semi")
    return rows.groupBy("key").agg(F.min("row").alias("row")).select("row.*")
