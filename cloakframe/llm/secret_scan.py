"""Secret scans over an incremental blob ledger.

Every version of every file is addressed by the SHA-256 of its text. The ledger, a table in a shared folder, says which blob was scanned
by which rule version and what was found. A scan looks only at pairs of blob and rule version that the ledger lacks, each blob once, however
many paths hold it, appends the result, and joins the findings back to all paths.

Null texts count as empty. Equal texts are one blob. Repeated rows and ids are answered row by row. An empty table gives an empty result and
leaves the ledger as it is. Only path and text are read, so other columns cannot clash. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import by_text, parts, saved

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the runs of AKIA[A-Z0-9]+ that have 20 characters or more
HEX = re.compile(r"[0-9a-f]{24,}")
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[\s\S]*?-----END (?:[A-Z]+ )*PRIVATE KEY-----)?")
SIGNED_TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
PREFIXED = re.compile(r"(?:ghp_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})")

SPAN = "struct<kind:string,start:int,end:int>"


@dataclass(frozen=True)
class SecretRule:
    """``find`` yields (start, end). Give a new ``version`` whenever what it finds changes."""

    kind: str
    version: int
    find: Callable[[str], Iterator[tuple[int, int]]]

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


def _assign(text: str) -> Iterator[tuple[int, int]]:
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        yield from (m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6)


def _with(mark: str, pattern: re.Pattern) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text)) if mark in text else iter(())


BASE = ("assign", "access", "hex")
RULES = (
    SecretRule("assign", 1, _assign),
    SecretRule("access", 1, _with("AKIA", ACCESS)),
    SecretRule("hex", 1, lambda text: (m.span() for m in HEX.finditer(text))),
    SecretRule("private_key", 1, _with("-----BEGIN ", PRIVATE_KEY)),
    SecretRule("signed_token", 1, _with("eyJ", SIGNED_TOKEN)),
    SecretRule("prefixed", 1, lambda text: (m.span() for m in PREFIXED.finditer(text)) if "ghp_" in text or "xox" in text or "sk_live_" in text else iter(())),
)


def _ledger(spark, ledger: str) -> DataFrame:
    schema = f"blob string, rules array<string>, spans array<{SPAN}>"
    try:
        return spark.read.schema(schema).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def update_ledger(docs: DataFrame, ledger: str, text_col: str = "text", rules: tuple[SecretRule, ...] = RULES) -> None:
    """Scan each unseen pair of blob and rule version of ``docs`` and append the findings."""
    spark = docs.sparkSession
    keys = [r.key for r in rules]
    done = _ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("have"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blobs = docs.select(F.sha2(text, 256).alias("blob"), text.alias("_text")).groupBy("blob").agg(F.min("_text").alias("_text"))
    wanted = F.array_except(F.array(*map(F.lit, keys)), F.coalesce("have", F.array().cast("array<string>")))
    todo = blobs.join(done, "blob", "left").select("blob", wanted.alias("rules"), "_text").filter(F.size("rules") > 0)
    by_key, order = {r.key: r for r in rules}, {k: i for i, k in enumerate(keys)}

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            for rows, texts in parts(batch, 2):
                found = []
                for which, t in zip(rows.column(1).to_pylist(), map(bytes.decode, texts), strict=True):
                    hits = [(a, order[k], by_key[k].kind, b) for k in which for a, b in by_key[k].find(t)]
                    found.append([{"kind": k, "start": a, "end": b} for a, _, k, b in sorted(hits)])
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(found, pa.list_(kind))], names=["blob", "rules", "spans"])

    by_text(todo).mapInArrow(scanned, f"blob string, rules array<string>, spans array<{SPAN}>").write.mode("append").parquet(ledger)


def findings(spark, ledger: str, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(blob, spans) by the current rule versions, spans by start, then kind as listed in ``rules``.

    One row of the ledger holds what one scan found; a rule version is scanned once for a blob, so rows don't overlap.
    """
    keys = F.array(*[F.lit(r.key) for r in rules])
    rank = F.array(*[F.lit(r.kind) for r in rules])
    rows = _ledger(spark, ledger).filter(F.arrays_overlap("rules", keys))
    current = {r.kind for r in rules}
    old = F.filter("rules", lambda k: ~F.array_contains(keys, k))
    # findings of a superseded version of a current kind are left out, whatever else that scan holds
    dead = F.transform(old, lambda k: F.substring_index(k, ":", 1))
    alive = F.filter("spans", lambda s: s["kind"].isin(*current) & ~F.array_contains(dead, s["kind"]))
    row = F.transform(alive, lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("at"), s["end"].alias("end"), s["kind"].alias("kind")))
    grouped = rows.select("blob", row.alias("s")).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("s"))
    return grouped.select("blob", F.transform("s", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def scan(docs: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(path, blob, spans) for every row of ``docs``."""
    update_ledger(docs, ledger, text_col, rules)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    paths = saved(docs.select(F.col(id_col).alias("path"), F.sha2(text, 256).alias("blob")))
    found = saved(findings(docs.sparkSession, ledger, rules))
    return paths.join(found, "blob").select("path", "blob", "spans")


def _replaced(text: str, spans: list[dict], mark: str) -> str:
    out, pos = [], 0
    for s in spans:
        if s["start"] >= pos:
            out += [text[pos : s["start"]], mark]
        pos = max(pos, s["end"])
    return "".join(out) + text[pos:]


def redact(docs: DataFrame, ledger: str, text_col: str = "text", mark: str = "[secret]", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """``docs`` with each found span, overlapping ones as one, replaced by ``mark``; all other columns unchanged."""
    update_ledger(docs, ledger, text_col, rules)
    hits = findings(docs.sparkSession, ledger, rules).filter(F.size("spans") > 0).select("blob", "spans")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = docs.select(F.struct(*docs.columns).alias("row"), F.sha2(text, 256).alias("blob"))
    joined = row.join(hits, "blob", "left").select("row.*", F.col("spans").alias("_spans"))
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _ in parts(batch, at):
                spans = rows.column(rows.num_columns - 1).to_pylist()
                texts = [_replaced(t, s, mark) if s else t for t, s in zip(rows.column(at).to_pylist(), spans, strict=True)]
                cols = [*rows.columns[:-1]]
                cols[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=rows.schema.names[:-1])

    return by_text(joined).mapInArrow(clean, docs.schema)
