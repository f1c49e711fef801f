"""Quality rules as a short-circuit cascade.

Every rule looks at one measure of a text. A bounded sample gives each rule's cost (seconds a text) and selectivity
(share it rejects); rules are then ordered by rejection per cost, and a text that one rule rejects is not shown to the next.
A text is kept when no rule rejects it, so the verdict doesn't depend on the order: the sample decides speed only.

Null and empty texts have no words and are rejected. Repeated rows and repeated ids are judged one by one. An empty
table gives an empty result. Input columns other than id and text are not read, so names cannot clash.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import by_text, parts, sized
from cloakframe.llm.words import Scan

SAMPLE = 256
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives a boolean for each text of a scan."""

    name: str
    rejects: Callable[[Scan], np.ndarray]


def _shouting(s: Scan) -> np.ndarray:
    """Words with two ASCII capitals in a row: more than half of at least 20 words."""
    upper = (s.buf >= 65) & (s.buf <= 90)
    pair = np.zeros(len(s.buf), bool)
    pair[:-1] = upper[:-1] & upper[1:]
    total = np.concatenate([[0], np.cumsum(pair)])
    start, end = s.borders
    loud = np.bincount(s.text_of_word[total[end] > total[start]], minlength=s.n)
    return (s.n_words >= 20) & (2 * loud > s.n_words)


RULES = (
    Rule("too_few_words", lambda s: s.n_words < 10),
    Rule("repeated_windows", lambda s: 100 * s.n_repeat_words > 20 * s.n_words),
    Rule("symbols", lambda s: 20 * s.n_symbols > 7 * s.n_words),
    Rule("repeated_lines", lambda s: 10 * s.n_dup_lines > 3 * np.maximum(1, s.count_bytes(s.buf == 10) + 1)),
    Rule("word_length", lambda s: (s.word_chars < 2 * s.n_words) | (s.word_chars > 100 * s.n_words)),
    Rule("shouting", _shouting),
)


def _cascade(texts: list[bytes], rules: tuple[Rule, ...], scan: Scan | None = None) -> np.ndarray:
    """Kept or not; a rule sees only what all rules before it kept."""
    alive = np.arange(len(texts))
    seen = scan
    for rule in rules:
        if not len(alive):
            break
        if seen is None or seen.n != len(alive):
            seen = Scan([texts[i] for i in alive])
        bad = rule.rejects(seen)
        if bad.any():
            alive = alive[~bad]
            seen = None if 2 * bad.sum() > 0 else seen
    kept = np.zeros(len(texts), bool)
    kept[alive] = True
    return kept


def measure_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> list[tuple[str, float, float]]:
    """(name, seconds a text, share rejected) of each rule on the first ``sample`` texts that Spark finds, as take() reads few partitions."""
    texts = [(r[0] or "").encode() for r in docs.select(F.col(text_col).cast("string")).take(sample)]
    figures = []
    for rule in rules if texts else ():
        began = time.perf_counter()
        bad = sum(int(rule.rejects(Scan(texts[at])).sum()) for at in sized([len(t) for t in texts]))
        figures.append((rule.name, (time.perf_counter() - began) / len(texts), bad / len(texts)))
    return figures


def order_rules(figures: list[tuple[str, float, float]], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Most rejection per cost first; rules without figures last, ties in the given order."""
    worth = {name: share / max(cost, 1e-9) for name, cost, share in figures}
    return tuple(sorted(rules, key=lambda r: -worth.get(r.name, -1.0)))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE, measures: bool = False) -> DataFrame:
    """id, ``kept``; with ``measures`` also the base measures of every text, which then are computed for rejected texts too."""
    ordered = order_rules(measure_rules(docs, text_col, rules, sample), rules)
    names = MEASURES if measures else ()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in parts(batch, 1):
                scan = Scan(texts) if names else None
                kept = _cascade(texts, ordered, scan)
                cols = [rows.column(0), pa.array(kept)]
                cols += [pa.array(getattr(scan, m).astype(np.int64)) for m in names]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "kept", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, kept boolean" + "".join(f", {m} long" for m in names)
    return by_text(rows).mapInArrow(judged, schema).withColumnRenamed("id", id_col)


def filter_documents(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that every rule keeps, all columns unchanged."""
    ordered = order_rules(measure_rules(docs, text_col, rules, sample), rules)
    at = docs.columns.index(text_col)

    def kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in parts(batch, at):
                yield rows.filter(pa.array(_cascade(texts, ordered)))

    return by_text(docs).mapInArrow(kept_rows, docs.schema)
