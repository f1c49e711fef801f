"""Many literal values in one sweep per text: findings, masked values to restore, originals that leak."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.operators.term_join import LINES_TYPE


class Literals:
    """Values to look for, in the order in which they take their places.

    They are filed by length, and lengths by first character: a place of the text is looked up once for each length that
    a value with its character has, whatever the number of values.
    """

    def __init__(self, values: list[str | None], first: int = 0):
        self.values, self.first = values, first
        self.rank_of: dict[str, int] = {}
        lengths: dict[str, set[int]] = {}
        for rank, value in enumerate(values):
            if value and value not in self.rank_of:
                self.rank_of[value] = rank
                lengths.setdefault(value[0], set()).add(len(value))
        self.lengths = {c: sorted(sizes) for c, sizes in lengths.items()}

    def hits(self, text: str) -> list[tuple[int, int]]:
        """Every place (rank, start) of a value, in the order of ranks, then places."""
        found = []
        for start, c in enumerate(text):
            for size in self.lengths.get(c, ()):
                rank = self.rank_of.get(text[start : start + size])
                if rank is not None:
                    found.append((rank, start))
        return sorted(found)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """Places (start, end, rank) in text order; a place that is taken stays with the value that came first."""
        taken = bytearray(len(text))
        spans = []
        for rank, start in self.hits(text):
            end = start + len(self.values[rank])
            if taken.find(1, start, end) < 0:
                taken[start:end] = b"\x01" * (end - start)
                spans.append((start, end, rank))
        return sorted(spans)

    def replaced(self, text: str, spans: list[tuple[int, int, int]], new: Callable[[int], str]) -> str:
        out, at = [], 0
        for start, end, rank in spans:
            out += [text[at:start], new(rank)]
            at = end
        return "".join(out) + text[at:]

    def line(self, line: dict, mark: str) -> dict:
        """The line with ``mark`` for each value."""
        text = line["t"]
        spans = self.spans(text)
        occ = [{"rank": self.first + rank, "original": text[s:e]} for s, e, rank in spans]
        return {"t": self.replaced(text, spans, lambda _: mark), "occ": line["occ"] + occ}


def swept_findings(lines: Column, values: Column, first: Column, mark: str) -> Column:
    """``lines`` (see LINES_TYPE) with ``mark`` in place of every value.

    What is recorded has rank ``first`` + the value's position (from 0). All values share one mark and are recorded in text
    order, so their number has no bound. Values replace in array order, each from left to right, as one literal replacement
    after another would. Rows without values (null or empty) don't go through Python.
    """
    occ = pa.list_(pa.struct([("rank", pa.int32()), ("original", pa.string())]))
    kind = pa.list_(pa.struct([("t", pa.string()), ("occ", occ)]))

    @F.arrow_udf(LINES_TYPE)
    def run(rows: pa.Array) -> pa.Array:
        out = []
        for i in range(len(rows)):  # one text at a time
            row = rows[i].as_py()
            s = row and Literals(row["texts"], row["first"])
            out.append(s and [s.line(x, mark) for x in row["lines"]])
        return pa.array(out, kind)

    run = run.asNondeterministic()  # kept as a step of its own: merged into what reads it, Spark can't place it
    work = F.struct(lines.alias("lines"), values.alias("texts"), first.cast("int").alias("first"))
    return F.coalesce(run(F.when(F.size(values) > 0, work)), lines)


def swept_originals(text: Column, mapping: Column, where: Column) -> Column:
    """Struct (t, n): ``text`` with the originals of its masked values, longest (in bytes) first, and their number; null unless ``where``.

    What has been put in is not read again, so an original that looks like another entry's masked value stays as it is.
    Entries with a null or empty masked value or a null original are left out.
    """
    kind = pa.struct([("t", pa.string()), ("n", pa.int64())])

    @F.arrow_udf("t STRING, n BIGINT")
    def run(rows: pa.Array) -> pa.Array:
        out = []
        for i in range(len(rows)):  # one text at a time
            row = rows[i].as_py()
            if row is None:
                out.append(None)
                continue
            entries = [(m, o) for m, o in zip(row["masked"], row["original"]) if m and o is not None]
            entries.sort(key=lambda e: -len(e[0].encode()))
            sweep = Literals([m for m, _ in entries])
            spans = sweep.spans(row["text"])
            out.append({"t": sweep.replaced(row["text"], spans, lambda r: entries[r][1]), "n": len(spans)})
        return pa.array(out, kind)

    masked, original = F.transform(mapping, lambda m: m["masked"]), F.transform(mapping, lambda m: m["original"])
    run = run.asNondeterministic()  # so that no later filter pulls the sweep down to where it can't run
    return run(F.when(where & text.isNotNull(), F.struct(text.alias("text"), masked.alias("masked"), original.alias("original"))))


def swept_contained(text: Column, values: Column, where: Column) -> Column:
    """Positions (from 0) of the values that occur in ``text``, ascending, equal values all; null unless ``where``."""

    @F.arrow_udf("array<int>")
    def run(rows: pa.Array) -> pa.Array:
        out = []
        for i in range(len(rows)):  # one text at a time
            row = rows[i].as_py()
            if row is None:
                out.append(None)
                continue
            sweep = Literals(row["texts"])
            seen = {rank for rank, _ in sweep.hits(row["text"])}
            out.append([j for j, v in enumerate(row["texts"]) if v == "" or (v is not None and sweep.rank_of[v] in seen)])
        return pa.array(out, pa.list_(pa.int32()))

    run = run.asNondeterministic()
    return run(F.when(where & text.isNotNull(), F.struct(text.alias("text"), values.alias("texts"))))
