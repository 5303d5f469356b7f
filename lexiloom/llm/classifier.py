"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader (FTRL-proximal) updates and scored as sparse dot products.

A text is cut into words and runs of other signs; each of them, and each pair of neighbours, is
hashed into 2^bits places. Besides the words themselves their shape (lower case, capitals, ...) is
hashed, so that words never seen in training still carry something. The value of a feature is its
count over the number of tokens. Scoring a text is the sum of its features' weights times their
values; no dictionary is built. The weights are one vector of fixed size, which is what goes to
the executors.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import nullable_ids, portions

TOKEN = re.compile(r"\w+|[^\w\s]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def shape(token: str) -> str:
    """Kind of a token: 'a' lower case, 'A' capitals, 'Aa' capitalised, 'x' other letters, '0' with
    digits; signs stand for themselves."""
    if token.isalpha():
        return "\0a" if token.islower() else "\0A" if token.isupper() and len(token) > 1 else "\0Aa" if token[1:].islower() or len(token) == 1 else "\0x"
    return "\0" + "0" if token.isalnum() else "\0" + token


class Hasher:
    """Hashes of tokens and of their shapes, kept for the tokens seen lately."""

    def __init__(self, limit: int = 300_000) -> None:
        self.limit = limit
        self.table: dict[str, int] = {}

    def __call__(self, tokens: list[str]) -> np.ndarray:
        """(n, 2): for each token its hash and its shape's, both 32 bits, packed in one number."""
        if len(self.table) > self.limit:
            self.table.clear()
        table = self.table
        for t in set(tokens).difference(table):
            table[t] = zlib.crc32(t.lower().encode("utf-8", "surrogatepass")) << 32 | zlib.crc32(shape(t).encode("utf-8", "surrogatepass"))
        return np.fromiter(map(table.__getitem__, tokens), np.uint64, len(tokens))


def features(texts: list[str], bits: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Places of all features of all texts, one after the other, and the number of each text's."""
    mask = np.uint64((1 << bits) - 1)
    places, counts = [], []
    for text in texts:
        tokens = TOKEN.findall(text)
        counts.append(0)
        if not tokens:
            continue
        both = hasher(tokens)
        word, kind = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
        parts = [word * MIX, kind * MIX + np.uint64(1)]
        if len(tokens) > 1:
            parts += [(word[:-1] * MIX ^ word[1:]) * MIX + np.uint64(2), (kind[:-1] * MIX ^ kind[1:]) * MIX + np.uint64(3)]
            same = word[1:] == word[:-1]
            parts.append(np.where(same, np.uint64(4), np.uint64(5)) * MIX)
        hashed = np.concatenate(parts)
        places.append(((hashed >> np.uint64(64 - bits)) & mask).astype(np.int64))
        counts[-1] = len(hashed)
    return (np.concatenate(places) if places else np.zeros(0, np.int64)), np.array(counts, dtype=np.int64)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    bits: int

    def scores(self, texts: list[str], hasher: Hasher) -> np.ndarray:
        """Probability of label 1 for each text; a text without tokens gets the bias alone."""
        places, counts = features(texts, self.bits, hasher)
        owner = np.repeat(np.arange(len(texts)), counts)
        total = np.bincount(owner, self.weights[places], len(texts))
        margin = self.bias + total / np.maximum(1, counts)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def train(
    samples: list[tuple[np.ndarray, int]],
    bits: int,
    epochs: int = 3,
    alpha: float = 2.0,
    beta: float = 1.0,
    l1: float = 1e-4,
    l2: float = 1e-3,
    seed: int = 7,
) -> Model:
    """FTRL-proximal over (places, label) in an order drawn from `seed`. Both classes weigh the same
    per-coordinate rates; the bias is a feature of its own with value 1."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(zz) <= l1] = 0
        return w

    packed = []
    for places, label in samples:
        at, count = np.unique(places, return_counts=True)
        packed.append((np.append(at, size), np.append(count / max(1, len(places)), 1.0), label))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(packed)):
            at, value, label = packed[k]
            w = weight(at)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w @ value)))))
            g = (p - label) * value
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weight(np.arange(size + 1))
    return Model(w[:-1].astype(np.float32), float(w[-1]), bits)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    bits: int = 20,
    most_labelled: int = 6000,
    most_chars: int = 40_000_000,
) -> Model:
    """Learns from at most `most_labelled` labelled texts of `most_chars` characters together (two
    documented bounds: those with the least MD5 of their id come first, a text that would go beyond
    the second is left out), none of them held out. Null labels and ids are left aside; a document
    with several labels counts once for each distinct one, as do several texts under one id; repeated
    rows count once. Without any labels every score is 0.5."""
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
        .distinct()
        .orderBy(F.md5(F.col("id").cast("string")), "id", "label")
        .limit(most_labelled)
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    # At most `most_labelled` rows of two numbers.
    labelled = texts.join(F.broadcast(known), "id").withColumn("key", F.md5("text"))
    order = F.md5(F.col("id").cast("string"))
    sizes = labelled.select("id", "label", "key", F.length("text").alias("size")).distinct().orderBy(order, "id", "label", "key").limit(most_labelled).toPandas()
    taken, room = [], most_chars
    for k, size in enumerate(sizes["size"]):
        if size <= room:
            taken.append(k)
            room -= size
    if not taken:
        return train([], bits)
    chosen = docs.sparkSession.createDataFrame(sizes.iloc[taken][["id", "label", "key"]].values.tolist(), labelled.select("id", "label", "key").schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for pdf in batches:
            for part in portions(pdf["text"].tolist()):
                some = pdf.iloc[part]
                places, counts = features(some["text"].tolist(), bits, hasher)
                ends = np.cumsum(counts)
                packed = [places[a:b].astype(np.int32).tobytes() for a, b in zip(ends - counts, ends)]
                yield pd.DataFrame({"id": some["id"], "label": some["label"], "key": some["key"], "places": packed})

    own = labelled.join(F.broadcast(chosen), ["id", "label", "key"])  # bounded by most_labelled
    kinds = f"id {own.schema['id'].dataType.simpleString()}, label int, key string, places binary"
    rows = own.mapInPandas(run, kinds).groupBy("id", "label", "key").agg(F.first("places").alias("places")).toPandas()
    rows = rows.sort_values(["id", "label", "key"], ignore_index=True)
    return train([(np.frombuffer(p, np.int32), int(y)) for p, y in zip(rows["places"], rows["label"])], bits)


def classify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", positive_from: float = 0.7) -> DataFrame:
    """One row per row of `df`: id, held_out, score (0 to 1), predicted (1 if score >= positive_from).

    Scores see the whole text and nothing else. A null or empty text has no features and gets the
    score of the bias alone; repeated rows give repeated rows; null ids are not held out; an empty
    table gives no rows; other columns are ignored."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, own = Hasher(), shared.value
        for pdf in batches:
            texts = pdf["text"].tolist()
            for part in portions(texts):
                some = [x if isinstance(x, str) else "" for x in texts[part]]
                yield pd.DataFrame({"id": pdf["id"].iloc[part].array, "score": own.scores(some, hasher)})

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(nullable_ids(run), "id long, score double").select(
        F.col("id").alias(id_col),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= positive_from).cast("int").alias("predicted"),
    )
