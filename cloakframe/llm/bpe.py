"""BPE encoding and decoding of whole texts with a public tokenizer file, with tree concatenation for long texts.

Text is split at ASCII blanks, where this kind of vocabulary can't merge, and each distinct unsplit run is encoded once per
worker and kept in a bounded table. A text of more than ``piece`` characters is cut into halves, these into halves and so on; the
pieces are encoded as rows of their own, spread over the cluster, and joined pairwise up the tree. Around each join a window is
encoded again and grows until it agrees with the tokens on either side. A token sequence is what BPE gives exactly if each pair of
neighbours is, so one token that both share settles the join; two are asked for.

Null counts as empty and gives no ids. Repeated rows and ids are encoded row by row; of long texts each distinct one is encoded once.
An empty table gives an empty result. Columns other than those named are not read; kept ones may have any name, but the result's column takes the place of one with its own. Special
tokens are found as they are written, whatever the length of the text. The tokenizer file's path is a parameter and must
exist on every executor.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, StringType, StructField, StructType

from cloakframe.llm.common import by_text, parts, saved

PIECE, WINDOW, KEPT = 1 << 16, 64, 250_000
# ASCII capitals are lowered by the vocabulary's own normaliser; newline and tab are blanks to it
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\n\t", b"abcdefghijklmnopqrstuvwxyz  ")
# One word of composed Latin letters, then perhaps one group of marks: exactly one or two tokens with an end of word
_LATIN = re.compile(r"([a-zß-öø-ÿ]+)([,.;:!?|*%$#&]*)")


class Codec:
    """The tokenizer of a file with a bounded table of encoded runs; one in each Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.seen: dict[str, bytes] = {"": b""}
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.names = [""] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            self.names[i] = name
        self.is_end = np.array([n.endswith("</w>") for n in self.names])
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.lowers = "Lowercase" in json.dumps(file["normalizer"])
        # special tokens are looked for before the normaliser runs, in the case they have
        self.special = [t["content"].encode().translate(_PLAIN).decode() for t in file["added_tokens"] if not t["normalized"]]
        if file["decoder"] is not None or file["model"]["type"] != "BPE":
            raise ValueError("made for BPE files without a decoder: ids are then shown as their names, joined by blanks")

    def _runs(self, text: str) -> list[str]:
        """The text cut at blanks, lowered early where no special token can be touched by it."""
        if self.lowers:
            low = text.encode().translate(_PLAIN).decode()
            if not any(s in low for s in self.special):
                return low.split(" ")
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            runs = self._runs(text)
            new = set(runs).difference(self.seen)
            if new:
                if len(self.seen) > KEPT:
                    self.seen = {"": b""}
                    new = set(runs)
                self._learn(new)
            out.append(b"".join(map(self.seen.__getitem__, runs)))
        return out

    def _learn(self, runs: set[str]) -> None:
        """Encode runs into the table: plain ones as one text that is cut at its ends of words, others one by one."""
        plain, other = [], []
        for r in runs:
            m = _LATIN.fullmatch(r) if self.lowers else None
            (plain if m else other).append((r, 2 if m and m[2] else 1))
        ids = np.array(self.tok.encode_batch_fast([" ".join(r for r, _ in plain)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.is_end[ids]) + 1
        last = np.cumsum([n for _, n in plain], dtype=np.int64) - 1
        if len(plain) and len(ends) == last[-1] + 1:
            raw, cuts = ids.tobytes(), (4 * ends[last]).tolist()
            self.seen.update(zip((r for r, _ in plain), map(raw.__getitem__, map(slice, [0, *cuts], cuts)), strict=True))
        else:
            other += plain
        texts = [r for r, _ in other]
        for run, e in zip(texts, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            self.seen[run] = np.array(e.ids, "<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        """What the tokenizer's own decode gives with special tokens kept."""
        return " ".join(map(self.names.__getitem__, array("I", ids)))

    def spans(self, text: str, at: int = 0) -> np.ndarray:
        """Rows of (id, start, end, begins a word) with offsets from ``at``."""
        e = self.tok.encode(text, add_special_tokens=False)
        words = [-1 - i if w is None else w for i, w in enumerate(e.word_ids)]
        begins = [1, *(int(a != b) for a, b in zip(words, words[1:], strict=False))] if words else []
        offsets = np.array(e.offsets, np.int64).reshape(-1, 2) + at
        return np.column_stack([np.array(e.ids, np.int64), offsets, np.array(begins, np.int64)]) if words else np.empty((0, 4), np.int64)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def may_cut(text: str, at: int) -> bool:
    """No composition reaches over this place: what follows starts a character of its own."""
    if not 0 < at < len(text):
        return True
    c = text[at]
    return c < "̀" or not (unicodedata.category(c)[0] == "M" or unicodedata.combining(c) or 0x1100 <= ord(c) <= 0x11FF)


def halves(text: str, piece: int) -> list[tuple[int, int]]:
    """Borders of the leaves when the text and its parts are halved until none is longer than ``piece``."""
    out, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= piece:
            out.append((a, b))
            continue
        m = (a + b) // 2
        while m < b and not may_cut(text, m):
            m += 1
        if m == b:
            out.append((a, b))
        else:
            todo += [(m, b), (a, m)]
    return out


def _agreed(side: np.ndarray, window: np.ndarray, last: bool) -> tuple[int, int] | None:
    """Positions after the last (before the first) two neighbouring tokens that are the same in both."""
    rows = {tuple(r): i for i, r in enumerate(side.tolist())}
    same = [rows.get(tuple(r), -1) for r in window.tolist()]
    hits = [(same[k], k) for k in range(len(same) - 1) if same[k] >= 0 and same[k + 1] == same[k] + 1]
    if not hits:
        return None
    i, k = hits[-1] if last else hits[0]
    return (i + 2, k + 2) if last else (i, k)


def join(codec: Codec, text: str, left: np.ndarray, right: np.ndarray, cut: int, begin: int, end: int, window: int = WINDOW) -> np.ndarray:
    """Tokens of text[begin:end] from those of text[begin:cut] and text[cut:end]."""
    while True:
        a, b, i, j = begin, end, 0, len(right)
        for k in range(int(np.searchsorted(left[:, 1], max(begin, cut - window), "right")) - 1, 0, -1):
            if left[k, 1] >= left[k - 1, 2] and may_cut(text, int(left[k, 1])):
                a, i = int(left[k, 1]), k
                break
        for k in range(int(np.searchsorted(right[:, 1], min(end, cut + window), "left")), len(right)):
            if k and right[k, 1] >= right[k - 1, 2] and may_cut(text, int(right[k, 1])):
                b, j = int(right[k, 1]), k
                break
        w = codec.spans(text[a:b], a)
        # the last token of a cut-off word was made with an end of word that isn't there
        own = (0, 0) if a == begin else _agreed(left[i : len(left) - 1], w, True)
        far = (0, len(w)) if b == end else _agreed(right[:j], w[:-1], False)
        if own and far and own[1] <= far[1]:
            tail = right[j:] if b == end else right[far[0] :]
            return np.concatenate([left[: i + own[0]] if a != begin else left[:0], w[own[1] : far[1]], tail])
        window *= 2


def concatenate(codec: Codec, text: str, pieces: list[np.ndarray], borders: list[tuple[int, int]], window: int = WINDOW) -> np.ndarray:
    """Join neighbouring parts pairwise until one is left."""
    nodes = [(a, b, p) for (a, b), p in zip(borders, pieces, strict=True)]
    while len(nodes) > 1:
        up = []
        for x, y in zip(nodes[::2], [*nodes[1::2], None], strict=False):
            up.append(x if y is None else (x[0], y[1], join(codec, text, x[2], y[2], x[1], x[0], y[1], window)))
        nodes = up
    return nodes[0][2]


def _with(rows: DataFrame, name: str, kind: DataType, made) -> DataFrame:
    """Column ``name`` in place of ``_in``, the second column of ``rows``; ``made`` gives the values of an Arrow column. The first column goes along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values in made(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), values], names=["row", name])

    return by_text(rows).mapInArrow(run, StructType([rows.schema["row"], StructField(name, kind)]))


def _unpacked(rows: DataFrame, keep: tuple[str, ...], name: str) -> DataFrame:
    """The kept columns and ``name``, which stands in place of a kept column that has its name."""
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in keep if c != name], name)


def _short(rows: DataFrame, path: str) -> DataFrame:
    def encoded(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        for part, texts in parts(batch, 1):
            yield part, pa.array(codec(path).encode([t.decode() for t in texts]), pa.binary())

    return _with(rows, "ids", BinaryType(), encoded)


def _long(texts: DataFrame, path: str, piece: int) -> DataFrame:
    """(sha, ids) of distinct long texts (sha, _text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sha, text in zip(*map(pa.Array.to_pylist, batch.columns), strict=True):
                for a, b in halves(text, piece):
                    yield pa.RecordBatch.from_pylist([{"sha": sha, "a": a, "b": b, "part": text[a:b]}])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for row in batch.to_pylist():
                spans = c.spans(row["part"], row["a"])
                yield pa.RecordBatch.from_pylist([row | {"spans": spans.astype("<i8").tobytes()}])

    def joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("a")
        pieces = [np.frombuffer(s, "<i8").reshape(-1, 4) for s in rows["spans"]]
        whole = concatenate(codec(path), "".join(rows["part"]), pieces, list(zip(rows["a"], rows["b"], strict=True)))
        return pd.DataFrame({"sha": [key[0]], "ids": [whole[:, 0].astype("<u4").tobytes()]})

    pieces = texts.mapInArrow(cut, "sha string, a long, b long, part string")
    spread = pieces.repartition("sha", "a").mapInArrow(encoded, "sha string, a long, b long, part string, spans binary")
    return spread.groupBy("sha").applyInPandas(joined, "sha string, ids binary")


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), piece: int = PIECE) -> DataFrame:
    """The ``keep`` columns and ``ids`` (binary: little-endian unsigned 32-bit integers) of every row's whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("row"), text.alias("_in"))
    short = _short(rows.filter(F.length("_in") <= piece), path)
    long = rows.filter(F.length("_in") > piece).withColumn("_sha", F.sha2("_in", 256))
    texts = long.groupBy("_sha").agg(F.min("_in").alias("_text")).toDF("sha", "_text")
    ids = saved(_long(texts, path, piece))
    again = long.select("row", "_sha").join(ids, F.col("_sha") == ids.sha).select("row", "ids")
    return _unpacked(short.unionByName(again), keep, "ids")


def decode(rows: DataFrame, path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``decoded``: the text the tokenizer gives back for ``ids`` (null: empty)."""

    def decoded(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            yield part, pa.array([codec(path).decode(x or b"") for x in part.column(1).to_pylist()], pa.string())

    picked = rows.select(F.struct(*keep).alias("row"), F.col(ids_col).alias("_in"))
    return _unpacked(_with(picked, "decoded", StringType(), decoded), keep, "decoded")
