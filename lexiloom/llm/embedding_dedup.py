"""Embedding near-dedup with randomised-rotation binary codes.

Every vector is normalised and turned by random orthogonal matrices. What is stored of it is a code
of bits: the signs of each turned vector; the turned vector itself in 4 bits a component, rounded up
or down at random in proportion; and the correction factor f = <o', o>, the inner product of the
signs of the first turn (as a unit vector o') with the vector. For another vector q, <o', q> / f is an
unbiased estimate of <o, q>; with q in its rounded form it stays one, and is counted from bits alone
(and, count bits, plane by plane). Its error is below eps times the sum of
sqrt((1 - f^2) / f^2) * sqrt(1 - t^2) / sqrt(D - 1) and half a rounding step over f, with a
probability that eps sets (for pairs at cosine t or more). Only pairs whose estimates come within
these bounds of the threshold, from both sides, are computed exactly, in double precision.

The signs also deal vectors into buckets: each of `bands` bands takes `width` signs as a key. Two
vectors at an angle of a agree on one sign with probability 1 - a/pi, so the number of bands follows
from the threshold and `miss`, the chance to miss a pair that lies exactly at the threshold (closer
pairs are missed far less often). The width grows with the logarithm of the number of vectors, so
that a bucket keeps about `bucket` rows at any size. Larger buckets are split into blocks and every
pair of blocks is a task of its own.

Buckets are dealt codes only. A first pass over them finds, by the bounds, which vectors of a bucket
have a pair to be computed there; only these vectors are fetched, into those buckets. A pair belongs
to the first band on whose key it agrees, so it is computed once, and tasks can add up links and send
on sums and spanning trees, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components, written

_ROTATIONS: dict[tuple[int, int, int], np.ndarray] = {}


def rotation(dim: int, index: int, seed: int) -> np.ndarray:
    """Random orthogonal matrix number `index`; the same in every worker."""
    key = (dim, index, seed)
    if key not in _ROTATIONS:
        if len(_ROTATIONS) > 64:
            _ROTATIONS.clear()
        _ROTATIONS[key] = np.linalg.qr(np.random.default_rng([seed, dim, index]).standard_normal((dim, dim)))[0]
    return _ROTATIONS[key]


def plan(n: int, threshold: float, miss: float, bucket: int) -> tuple[int, int]:
    """(width, bands) for n vectors."""
    width = max(1, round(math.log2(max(n, 2) / bucket))) if n > bucket else 1
    agree = (1 - math.acos(threshold) / math.pi) ** width
    return width, max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


#: Bits of a component in the rounded form.
LEVELS = 4
A = np.uint64(0x9E3779B97F4A7C15)
B = np.uint64(0xBF58476D1CE4E5B9)


def binary_codes(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turned unit vectors, their codes as unit vectors, and the correction factors."""
    dim = unit.shape[1]
    turned = (unit @ rotation(dim, 0, seed)).astype(np.float32)
    code = np.where(turned > 0, np.float32(1), np.float32(-1)) / np.float32(math.sqrt(dim))
    return turned, code, np.maximum((turned * code).sum(1), 1e-6)


def packed(bits: np.ndarray) -> np.ndarray:
    """Booleans (..., dim) as 64-bit words (..., words)."""
    dim = bits.shape[-1]
    words = -(-dim // 64)
    padded = np.zeros((*bits.shape[:-1], words * 64), bool)
    padded[..., :dim] = bits
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


class Codes:
    """Codes of n vectors of one length: signs (n, rotations, words), planes (n, LEVELS, words) of the
    rounded form, and factor, low and step (n each)."""

    def __init__(self, dim: int, signs: np.ndarray, planes: np.ndarray, scalars: np.ndarray) -> None:
        self.dim, self.signs, self.planes, self.scalars = dim, signs, planes, scalars
        self.factor, self.low, self.step = scalars.T
        self.ones = np.bitwise_count(signs[:, 0]).sum(-1).astype(np.float32)
        weights = (1 << np.arange(LEVELS)).astype(np.float32)
        self.level = np.bitwise_count(planes).sum(-1).astype(np.float32) @ weights

    @classmethod
    def of(cls, x: np.ndarray, node: np.ndarray, rotations: int, seed: int) -> Codes:
        dim = x.shape[1]
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        first, _, factor = binary_codes(unit, seed)
        turned = [first, *(unit @ rotation(dim, i, seed) for i in range(1, rotations))]
        signs = np.stack([packed(t > 0) for t in turned], axis=1)
        low = first.min(1)
        step = np.maximum((first.max(1) - low) / ((1 << LEVELS) - 1), np.float32(1e-9))
        noise = node.astype(np.uint64)[:, None] * A + np.arange(dim, dtype=np.uint64)
        noise = (noise ^ (noise >> np.uint64(30))) * B
        noise = ((noise ^ (noise >> np.uint64(27))) * A >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)
        level = np.clip(np.floor((first - low[:, None]) / step[:, None] + noise), 0, (1 << LEVELS) - 1).astype(np.uint8)
        planes = np.stack([packed(level >> p & 1 == 1) for p in range(LEVELS)], axis=1)
        return cls(dim, signs, planes, np.stack([factor, low, step], axis=1).astype(np.float32))

    def rows(self) -> list[bytes]:
        n = len(self.scalars)
        parts = [self.signs.reshape(n, -1).view(np.uint8), self.planes.reshape(n, -1).view(np.uint8), self.scalars.view(np.uint8)]
        return [x.tobytes() for x in np.hstack(parts)]

    @classmethod
    def read(cls, rows: list[bytes], dim: int) -> Codes:
        words = -(-dim // 64)
        raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
        at, end = raw.shape[1] - 12 - LEVELS * words * 8, raw.shape[1] - 12
        signs = np.ascontiguousarray(raw[:, :at]).view(np.uint64).reshape(len(rows), -1, words)
        planes = np.ascontiguousarray(raw[:, at:end]).view(np.uint64).reshape(len(rows), LEVELS, words)
        return cls(dim, signs, planes, np.ascontiguousarray(raw[:, end:]).view(np.float32))

    def keys(self, width: int, bands: int) -> np.ndarray:
        """Keys (n, bands) from the signs of as many rotations as they need."""
        n = len(self.signs)
        bits = np.unpackbits(self.signs.view(np.uint8).reshape(n, self.signs.shape[1], -1), axis=-1, bitorder="little")
        bits = bits[:, :, : self.dim].reshape(n, -1)[:, : width * bands].reshape(n, bands, width)
        return bits.astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))

    def estimate(self, i, j) -> np.ndarray:
        """<o', q> * sqrt(D) of code rows i with rounded rows j, which broadcast: indexes such as
        (a[:, None], b[None, :]) or two of one length."""
        shared = np.float32(0)
        for p in range(LEVELS):
            for w in range(self.signs.shape[2]):
                shared = shared + np.float32(1 << p) * np.bitwise_count(self.signs[i, 0, w] & self.planes[j, p, w])
        return self.step[j] * (2 * shared - self.level[j]) + self.low[j] * (2 * self.ones[i] - np.float32(self.dim))

    def apart(self, i, j) -> np.ndarray:
        """Number of signs of the first turn in which rows i and j differ."""
        differ = np.bitwise_count(self.signs[i, 0, 0] ^ self.signs[j, 0, 0])
        for w in range(1, self.signs.shape[2]):
            differ = differ.astype(np.uint16) + np.bitwise_count(self.signs[i, 0, w] ^ self.signs[j, 0, w])
        return differ

    def near(self, i, j, threshold: float, eps: float) -> np.ndarray:
        """Whether the estimate of rows i with j comes within its bound of the threshold."""
        f, dim = self.factor[i], self.dim
        turn = eps * np.sqrt(np.maximum(0, 1 - f * f)) * math.sqrt((1 - threshold**2) / max(1, dim - 1))
        least = (threshold * f - turn) * math.sqrt(dim)
        return self.estimate(i, j) >= least - np.float32(eps * 0.5 * math.sqrt(dim)) * self.step[j] - 1e-3


def candidates(codes: Codes, keys: np.ndarray, band: int, left: np.ndarray | None, threshold: float, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j whose bounds don't rule them out and whose first common key is that of `band`.
    left: if given, only pairs of a row with left and one without.

    The share of signs that differ estimates the angle; it is looked at first, with a bound of its own,
    and rules out most pairs with one count of bits."""
    n = len(keys)
    share = math.acos(threshold) / math.pi
    most = math.floor(codes.dim * share + eps * math.sqrt(codes.dim * share * (1 - share)))
    found_i, found_j = [], []
    step = max(1, 2_000_000 // n)
    for start in range(0, n, step):
        rows, others = np.arange(start, min(n, start + step)), np.arange(start + 1, n)
        good = (codes.apart(rows[:, None], others[None, :]) <= most) & (others[None, :] > rows[:, None])
        if left is not None:
            good &= left[rows][:, None] != left[others][None, :]
        i, j = np.nonzero(good)
        i, j = rows[i], others[j]
        near = codes.near(i, j, threshold, eps)
        i, j = i[near], j[near]
        near = codes.near(j, i, threshold, eps)
        i, j = i[near], j[near]
        first = ~(keys[i, :band] == keys[j, :band]).any(1)
        found_i.append(i[first])
        found_j.append(j[first])
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (empty, empty)


def exact_links(x: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs at cosine `threshold` or more."""
    norm = np.linalg.norm(x, axis=1)
    keep = [
        np.einsum("ij,ij->i", x[i[at : at + 50_000]], x[j[at : at + 50_000]]) / (norm[i[at : at + 50_000]] * norm[j[at : at + 50_000]]) >= threshold
        for at in range(0, len(i), 50_000)
    ]
    good = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[good], j[good]


def scaled(vectors: list) -> np.ndarray:
    """Vectors in double precision, each times a power of two, so that no square over- or underflows."""
    x = np.stack(vectors).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links i-j."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


#: A bucket is one number: length of the vectors, band and key.
def _bucket(dim: int, bands: int, keys: np.ndarray) -> np.ndarray:
    return (np.int64(dim) << np.int64(46)) + (np.arange(bands, dtype=np.int64) << np.int64(32))[None, :] + keys


def _in_blocks(rows: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Rows of buckets of more than `block` (sizes: bucket, n) dealt to every pair (p, q) of blocks that
    holds their own block; of such a pair a row is on the left side if its own block is p."""
    parts = F.coalesce(F.ceil(F.col("n") / block).cast("int"), F.lit(1))
    own = F.pmod(F.xxhash64("node"), parts.cast("long")).cast("int")
    dealt = rows.join(sizes, "bucket", "left").withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), parts - 1))})
    sides = [F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") <= F.col("other")).alias("left")]
    return dealt.select("bucket", *sides, *[c for c in rows.columns if c != "bucket"])


def near_copies(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    threshold: float = 0.9,
    miss: float = 1e-4,
    eps: float = 5.0,
    bucket: int = 3200,
    block: int = 4096,
    fetch: int = 512,
    seed: int = 20240601,
) -> DataFrame:
    """One row per row of `df`: id, n_links (other rows at cosine >= threshold), component_id
    (smallest id reachable over links, itself included) and kept (id is component_id).

    Rows whose vector is null, empty, zero, or holds a null or non-finite component link with
    nothing: n_links 0, component_id their own id. Vectors of different lengths don't link. Rows
    that repeat a vector exactly link with one another at cosine 1 and are compared as one. Vectors are
    told apart by content (a 96-bit hash of it), never by id, so rows that share an id may lie in several
    components. A null id is smaller than none: such rows get component_id null and kept false unless
    they link to rows with ids. An empty table gives no rows. Other columns of `df` are
    ignored."""
    spark = df.sparkSession
    kind = "array<float>" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("vec"))
    finite = ~F.coalesce(F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))
    good = F.coalesce(F.size("vec") > 0, F.lit(False)) & finite & F.coalesce(F.exists("vec", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("good", good)
    keyed = rows.filter("good").select("id", "vec", F.xxhash64("vec").alias("k1"), F.hash("vec").alias("k2"))
    # One node for each distinct vector, numbered by its content.
    nodes = written(
        keyed.groupBy("k1", "k2")
        .agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
        .withColumn("node", F.xxhash64("k1", "k2")),
        "emb-nodes",
    )
    n = nodes.count()
    width, bands = plan(n, threshold, miss, bucket)

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["vec"].map(len)):
                codes = Codes.of(scaled(part["vec"].to_list()), part["node"].to_numpy(), math.ceil(width * bands / dim), seed)
                yield pd.DataFrame({"node": part["node"].to_numpy(), "dim": np.int32(dim), "code": codes.rows()})

    coded = written(nodes.select("node", "vec").mapInPandas(encoded, "node long, dim int, code binary"), "emb-codes")

    def dealt(batches: Iterator[pd.DataFrame], full: bool) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                keys = Codes.read(part["code"].to_list(), int(dim)).keys(width, bands)
                buckets = _bucket(int(dim), bands, keys).ravel()
                if not full:
                    at, count = np.unique(buckets, return_counts=True)
                    yield pd.DataFrame({"bucket": at, "n": count})
                    continue
                each = np.repeat(np.arange(len(part)), bands)
                yield pd.DataFrame({"bucket": buckets, "node": part["node"].to_numpy()[each], "code": part["code"].to_numpy()[each]})

    counts = coded.mapInPandas(lambda it: dealt(it, False), "bucket long, n long")
    large = written(counts.groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > block), "emb-large")
    deal = coded.mapInPandas(lambda it: dealt(it, True), "bucket long, node long, code binary")
    deal = _in_blocks(deal, large, block) if large.limit(1).count() else deal.select("bucket", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(True).alias("left"), "node", "code")
    by = ["bucket", "p", "q"]

    def sides(group: pd.DataFrame) -> tuple[int, int, np.ndarray | None]:
        head = group.iloc[0]
        left = group["left"].to_numpy() if head["p"] != head["q"] else None
        return int(head["bucket"]) >> 46, int(head["bucket"]) >> 32 & 0x3FFF, left

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in grouped(batches, by):
            if len(group) < 2:
                continue
            dim, band, left = sides(group)
            codes = Codes.read(group["code"].to_list(), dim)
            i, j = candidates(codes, codes.keys(width, bands), band, left, threshold, eps)
            if len(i):
                yield group.iloc[np.unique(np.concatenate([i, j]))][["bucket", "node"]]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in grouped(batches, by):
            m = len(group)
            dim, band, left = sides(group)
            x, node, copies = scaled(group["vec"].to_list()), group["node"].to_numpy(), group["copies"].to_numpy()
            codes = Codes.of(x, node, math.ceil(width * bands / dim), seed)
            i, j = exact_links(x, *candidates(codes, codes.keys(width, bands), band, left, threshold, eps), threshold)
            if not len(i):
                continue
            links = np.bincount(i, copies[j], m) + np.bincount(j, copies[i], m)
            order = np.argsort(node)
            rank = np.empty(m, dtype=np.int64)
            rank[order] = np.arange(m)
            root = node[order][spanning(m, rank[i], rank[j])][rank]
            some = links > 0
            yield pd.DataFrame({"node": node[some], "links": links[some].astype(np.int64), "root": root[some]})

    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slots = max(parts, n * bands // 200_000)
    wanted = deal.repartition(slots, *by).sortWithinPartitions(*by).mapInPandas(needed, "bucket long, node long")
    wanted = written(wanted.distinct(), "emb-wanted")
    # The vectors of a bucket that are wanted, in blocks again, smaller ones: they are larger than codes.
    counts = wanted.groupBy("bucket").agg(F.count("*").alias("n"))
    found = written(
        _in_blocks(wanted, counts, fetch)
        .join(nodes.select("node", "copies", "vec"), "node")
        .repartition(slots, *by)
        .sortWithinPartitions(*by)
        .mapInPandas(compare, "node long, links long, root long")
        .groupBy("node", "root")
        .agg(F.sum("links").alias("links")),
        "emb-links",
    )
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "emb-cc")
    members = written(
        nodes.select("k1", "k2", "node", "least", "copies")
        .join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
        .join(roots, "node", "left")
        .select("k1", "k2", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")),
        "emb-members",
    )
    # The smallest id of a component is taken at the end: ids number no nodes.
    smallest = members.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(members.join(smallest, "root").select("k1", "k2", "n_links", "component_id"), "emb-classes")
    linked = keyed.select("id", "k1", "k2").join(classes, ["k1", "k2"]).select("id", "n_links", "component_id")
    alone = rows.filter("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col),
        "n_links",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def grouped(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of sorted batches, each whole; holds one batch and one group at a time."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        key = pdf[by].to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        if rest and (rest[-1][by].iloc[-1].to_numpy() != key[0]).any():
            yield pd.concat(rest) if len(rest) > 1 else rest[0]
            rest = []
        starts = [0, *cuts.tolist()]
        for a, b in zip(starts, [*starts[1:], len(pdf)]):
            rest.append(pdf.iloc[a:b])
            if b < len(pdf):
                yield pd.concat(rest) if len(rest) > 1 else rest[0]
                rest = []
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]
