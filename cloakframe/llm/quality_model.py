"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A word is seen twice: as itself in lower case, and as its shape (runs of small letters, capitals, digits and each mark; one sign for a
word that repeats the one before it). Words and pairs of neighbours of both kinds are hashed into ``1 << bits`` weights; a feature's value is
its share of the text's words. A score is the sparse dot product of these shares with the weights, through the logistic function.

Training takes a bounded sample: about ``sample`` labelled rows at most, drawn by a hash of the id. The sample is split into ``shards``; in each round
every part runs the updates over its rows as a task of its own, starting from the mean state of the round before. Only the state, which
``bits`` bounds, comes to the driver.

Null and empty texts have no features and get the score of the bias. Rows are scored one by one, repeated ids too; of several labels of one id the
smallest counts, null labels and labels without a document are left out. Without any labels every score is 0.5. An empty table
gives an empty result. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import by_text, draw, parts, saved, sized
from cloakframe.llm.words import LOWER, P, Scan, mix

BITS, SAMPLE, PARTS, ROUNDS = 18, 12_000, 4, 3
ALPHA, BETA, L1, L2 = 5.0, 1.0, 0.005, 0.01
_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = _KIND[128:] = 97
_KIND[65:91] = 65
_KIND[48:58] = 48


@dataclass
class Model:
    """The learner's sums; the last place of each array is the bias."""

    z: np.ndarray
    n: np.ndarray

    @staticmethod
    def empty(bits: int) -> Model:
        return Model(np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        """One step with the features ``at`` (distinct) of values ``x`` and the label ``y``."""
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def features(scan: Scan, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram the text and the weight's place of each of its occurrences."""
    start, end = scan.borders
    text = scan.text_of_word
    word = scan.hashes(start, end, scan.prefix(LOWER[scan.buf]))
    kind = _KIND[scan.buf]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    at = np.concatenate([[0], np.cumsum(new)])
    shape = scan.hashes(at[start], at[end], scan.prefix(kind[new]))
    if len(word) > 1:
        again = np.zeros(len(word), bool)
        again[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
        shape[again] = np.uint64(1)
    out = []
    for salt, one in enumerate((word, shape)):
        pair = mix(one[:-1] * np.uint64(P) + one[1:]) if len(one) else one
        inside = text[1:] == text[:-1]
        for k, (of, h) in enumerate(((text, one), (text[:-1][inside], pair[inside] if len(one) else one))):
            out.append((of, (mix(h + np.uint64(2 * salt + k + 1)) >> np.uint64(64 - bits)).astype(np.int64)))
    return out


def scores(texts: list[bytes], weights: np.ndarray, bits: int) -> np.ndarray:
    """Between 0 and 1 for each text."""
    scan = Scan(texts)
    total = np.full(len(texts), weights[-1])
    share = 1 / np.maximum(scan.n_words, 1)
    for of, at in features(scan, bits):
        total += np.bincount(of, weights=weights[at], minlength=len(texts)) * share
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _learn(model: Model, texts: list[bytes], labels: list[int], bits: int) -> None:
    for part in sized([len(t) for t in texts]):
        scan = Scan(texts[part])
        of = [(np.searchsorted(t, np.arange(scan.n + 1)), at) for t, at in features(scan, bits)]
        for i, y in enumerate(labels[part]):
            places = np.concatenate([at[cut[i] : cut[i + 1]] for cut, at in of])
            at, count = np.unique(places, return_counts=True)
            x = np.append(count / max(int(scan.n_words[i]), 1), 1.0)
            model.update(np.append(at, 1 << bits), x, y)


def _round(model: Model, bits: int):
    """One pass over a part's rows, from ``model``."""

    def learnt(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_o", "_text"])
        own = Model(model.z.copy(), model.n.copy())
        _learn(own, [(t or "").encode() for t in part["_text"]], part["_y"].tolist(), bits)
        return pd.DataFrame({"z": [own.z.tobytes()], "n": [own.n.tobytes()]})

    return learnt


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", allowed: Column | None = None, bits: int = BITS, sample: int = SAMPLE, shards: int = PARTS, rounds: int = ROUNDS, seed: str = "quality") -> np.ndarray:
    """Weights, bias last. ``allowed`` says which ids of ``labels`` may be learnt from."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.filter(allowed) if allowed is not None else known
    known = known.groupBy(id_col).agg(F.min(label_col).cast("int").alias("_y"))
    n = known.count()
    known = known.filter(draw(seed, id_col) * n < sample)
    # about `sample` rows of two numbers: small enough to broadcast whatever the corpus
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("_text")).join(F.broadcast(known), id_col)
    order = draw(f"{seed}-order", id_col)
    rows = saved(rows.select("_text", "_y", order.alias("_o"), F.floor(draw(f"{seed}-part", id_col) * shards).alias("_part")))
    model = Model.empty(bits)
    for _ in range(rounds if n else 0):
        states = rows.groupBy("_part").applyInPandas(_round(model, bits), "z binary, n binary").collect()
        if not states:
            break
        model = Model(*(np.mean([np.frombuffer(s[k]) for s in sorted(states)], axis=0) for k in ("z", "n")))
    return model.weights()


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(id, score) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # (1 << bits) + 1 numbers

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in parts(batch, 1):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(scores(texts, shared.value, bits))], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return by_text(rows).mapInArrow(scored, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
