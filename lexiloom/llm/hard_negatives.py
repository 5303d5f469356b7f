"""Hard-negative mining over one-dimensional distance keys (after iDistance, Yu et al. 2001).

Inner products become distances by one more coordinate: with M the largest norm, a vector x is taken
as (x, sqrt(M^2 - |x|^2)) and a query q as (q, 0), so their squared distance is |q|^2 + M^2 - 2 <q, x>
and the nearest vectors are those with the largest inner products. Every vector belongs to its nearest
pivot; the table is stored sorted by (pivot, distance to it) and cut into blocks of consecutive rows.
By the triangle inequality a vector at distance d from the query has a key between |q - pivot| - d and
|q - pivot| + d: a search looks at annuli around pivots, that is at intervals of keys, that is at
consecutive blocks.

A search goes in rounds. In each, a query takes the blocks with the least distance bound that it has
not looked at, four times as many as in the round before, and it ends when the bound of all blocks that
are left says that they hold nothing as good as the last of its k rows. Blocks that can hold only
scores above or below the range that it asks for are left out likewise. A round is a shuffle of queries
and of the blocks they take, and a product of two bounded matrices a task; results, not pairs, leave it.
So results are exact, whatever the pivots; these come from a bounded sample and decide only how much is
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import dropped, written

#: Rows of the sample that pivots are fitted on.
SAMPLE = 4096
#: Blocks have `block` rows, or as many more as it takes that there are not more than this number (but
#: one more for each pivot and partition): so large is the directory that tasks get.
MOST_BLOCKS = 1 << 18
#: In place of a block: the query has blocks left for a later round.
MORE = -1


def fitted(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k pivots of the sample by farthest-first choice and Lloyd's rounds."""
    chosen = [0]
    apart = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)):
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((x - x[chosen[-1]]) ** 2).sum(1))
    pivots = x[chosen].copy()
    for _ in range(rounds):
        at = distances(x, pivots).argmin(1)
        for c in np.unique(at):
            pivots[c] = x[at == c].mean(0)
    return pivots


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(0, square))


def matrix(vectors) -> np.ndarray:
    return np.frombuffer(b"".join(vectors)).reshape(len(vectors), -1)


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0, most * most - (x * x).sum(1)))[:, None]])


class Directory(NamedTuple):
    """Pivots by number of components (those of the sample; others have one at the origin), the largest
    norm, and by number of components the blocks: block, pivot, lo, hi (least and greatest key)."""

    pivots: dict[int, np.ndarray]
    most: float
    blocks: dict[int, pd.DataFrame]


class Index(NamedTuple):
    """The stored table with columns row (unique), id, label, anchor, dim, vec (binary, double precision)
    and block, and its directory."""

    table: DataFrame
    directory: Directory

    @classmethod
    def of(cls, rows: DataFrame, block: int) -> Index:
        """rows: id, label, anchor, vec (array of double, finite)."""

        def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                vectors = [np.asarray(v, np.float64) for v in pdf["vec"]]
                yield pdf.assign(id=pdf["id"].astype("Int64"), dim=np.array([len(v) for v in vectors], np.int32), norm=[float(v @ v) ** 0.5 for v in vectors], vec=[v.tobytes() for v in vectors])

        flat = written(rows.mapInPandas(packed, "id long, label int, anchor boolean, vec binary, dim int, norm double"), "neg-rows")
        n, most = flat.agg(F.count("*"), F.coalesce(F.max("norm"), F.lit(0.0))).first()
        block = max(block, -(-n // MOST_BLOCKS))
        sample = flat.select("dim", "vec", F.xxhash64("vec").alias("h")).orderBy("h", "vec").limit(SAMPLE).toPandas()
        k = max(1, min(256, n // (4 * block)))
        pivots = {int(d): fitted(augmented(matrix(part["vec"]), most), k) for d, part in sample.groupby("dim")}

        def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for dim, part in pdf.groupby("dim"):
                    apart = distances(augmented(matrix(part["vec"]), most), around(pivots, int(dim)))
                    at = apart.argmin(1)
                    yield part.assign(id=part["id"].astype("Int64"), pivot=at.astype(np.int32), dist=apart[np.arange(len(at)), at])

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            place = TaskContext.get().partitionId() << 32
            last, held, number, row = None, 0, -1, 0
            for pdf in batches:
                pdf = pdf.assign(id=pdf["id"].astype("Int64"))
                blocks = np.empty(len(pdf), np.int64)
                for i, key in enumerate(zip(pdf["dim"], pdf["pivot"])):
                    if key != last or held == block:
                        last, held, number = key, 0, number + 1
                    blocks[i] = place + number
                    held += 1
                yield pdf.assign(block=blocks, row=place + row + np.arange(len(pdf)))
                row += len(pdf)

        kind = "id long, label int, anchor boolean, vec binary, dim int, norm double, pivot int, dist double"
        parts = max(1, int(flat.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        order = ["dim", "pivot", "dist", "id", "vec"]
        keys = flat.mapInPandas(keyed, kind).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        table = written(keys.mapInPandas(cut, kind + ", block long, row long"), "neg-index")
        found = table.groupBy("dim", "pivot", "block").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi")).toPandas()
        return cls(table, Directory(pivots, most, {int(d): part.sort_values("block") for d, part in found.groupby("dim")}))


def around(pivots: dict[int, np.ndarray], dim: int) -> np.ndarray:
    """The pivots of a number of components; one at the origin if the sample has no such vector."""
    return pivots.get(dim, np.zeros((1, dim + 1)))


def bounds(directory: Directory, dim: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of the vectors of so many components, and the least and the greatest score (queries,
    blocks) that a row of each can have by its annulus, with some room for rounding."""
    found = directory.blocks[dim]
    apart = distances(np.hstack([q, np.zeros((len(q), 1))]), around(directory.pivots, dim))[:, found["pivot"].to_numpy()]
    lo, hi = found["lo"].to_numpy()[None, :], found["hi"].to_numpy()[None, :]
    nearest = np.maximum(0, np.maximum(lo - apart, apart - hi))
    total = (q * q).sum(1)[:, None] + directory.most**2
    room = 1e-9 * (1 + total)
    return found["block"].to_numpy(), (total - (apart + hi) ** 2) / 2 - room, (total - nearest**2) / 2 + room


def search(index: Index, queries: DataFrame, same: bool, k: int, first: int = 4, share: int = 2048) -> DataFrame:
    """The k best rows for every query and each of its tops: rows (query, top, score, id, rank), where
    score, the inner product, is between the floor that stands beside the top and the top itself, the
    row is not the query itself, and its label is the query's (`same`) or another. Greater scores come
    first, then smaller ids, rows without id last.

    queries: query (the row number of a row of the index), label, dim, vec, tops and floors (arrays of
    double of one length). Some thousands (`share`) of a block's queries at a time meet its rows."""
    index_rows = index.table.select("block", "row", "id", "label", "vec")
    kind = "query long, top double, score double, id long, row long"
    spark = queries.sparkSession
    directory = spark.sparkContext.broadcast(index.directory)
    best = spark.createDataFrame([], kind)
    start, batch = 0, first
    while True:
        # How good the last of a query's k rows is; nothing below it is looked at.
        last = best.groupBy("query", "top").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k)
        last = last.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("top", "least"))).alias("full"))
        state = queries.join(last.select("query", F.col("full.top").alias("full_tops"), F.col("full.least").alias("full_least")), "query", "left")

        def plan(batches: Iterator[pd.DataFrame], start: int = start, batch: int = batch) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for dim, part in pdf.groupby("dim"):
                    # So many queries at a time that their bounds of all blocks stay small.
                    step = max(1, min(64, 2_000_000 // len(directory.value.blocks[int(dim)])))
                    for at in range(0, len(part), step):
                        some = part.iloc[at : at + step]
                        blocks, low, high = bounds(directory.value, int(dim), matrix(some["vec"]))
                        for x, row in enumerate(some.itertuples()):
                            known = {} if row.full_tops is None else dict(zip(row.full_tops, row.full_least))
                            can, asked = np.zeros((2, len(blocks)), bool)
                            for top, floor in zip(row.tops, row.floors):
                                within = low[x] <= top
                                can |= within & (high[x] >= floor)
                                asked |= within & (high[x] >= max(floor, known.get(top, floor)))
                            order = np.flatnonzero(can)
                            order = order[np.argsort(-high[x, order], kind="stable")]
                            now, later = order[start : start + batch], order[start + batch :]
                            found = blocks[now[asked[now]]]
                            if asked[later].any():
                                found = np.append(found, MORE)
                            yield pd.DataFrame({"query": np.full(len(found), row.query, np.int64), "block": found})

        planned = written(state.mapInPandas(plan, "query long, block long"), "neg-planned")
        more = planned.filter(F.col("block") == MORE).limit(1).count() > 0
        wanted = planned.filter(F.col("block") != MORE)
        counts = wanted.groupBy("block").agg(F.ceil(F.count("*") / share).cast("int").alias("shares"))
        # A row for each block at most, whose number is bounded: small enough to be broadcast.
        shares = F.broadcast(written(counts, "neg-shares"))
        sides = wanted.join(shares, "block").withColumn("part", F.pmod(F.xxhash64("query"), F.col("shares").cast("long")).cast("int"))
        left = sides.select("query", "block", "part").join(queries, "query").groupBy("block", "part")
        right = index_rows.join(shares, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).groupBy("block", "part")

        def compare(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            return _best_of_block(asked, rows, same, k)

        found = left.cogroup(right).applyInPandas(compare, kind)
        ranked = best.unionByName(found).withColumn("rank", F.row_number().over(_by_score("query", "top"))).filter(F.col("rank") <= k)
        after = written(ranked if not more else ranked.drop("rank"), "neg-best")
        dropped(planned)
        if start:
            dropped(best)
        if not more:
            return after
        best, start, batch = after, start + batch, batch * 4


def _by_score(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")


def _best_of_block(asked: pd.DataFrame, rows: pd.DataFrame, same: bool, k: int) -> pd.DataFrame:
    """The k best rows of a block for each query and top."""
    none = pd.DataFrame({"query": [], "top": [], "score": [], "id": pd.array([], "Int64"), "row": []})
    if asked.empty or rows.empty:
        return none
    rows = rows.assign(id=rows["id"].astype("Int64")).sort_values(["id", "row"], na_position="last", kind="stable")
    x, label, number = matrix(rows["vec"]), rows["label"].to_numpy(), rows["row"].to_numpy()
    out = []
    for at in range(0, len(asked), 256):
        some = asked.iloc[at : at + 256]
        score = matrix(some["vec"]) @ x.T
        alike = some["label"].to_numpy()[:, None] == label[None, :]
        score[~alike if same else alike] = -np.inf
        score[some["query"].to_numpy()[:, None] == number[None, :]] = -np.inf
        order = np.argsort(-score, axis=1, kind="stable")
        score = np.take_along_axis(score, order, 1)
        for i, (query, tops, floors) in enumerate(zip(some["query"], some["tops"], some["floors"])):
            for top, floor in zip(tops, floors):
                first = int(np.searchsorted(-score[i], -top, "left"))
                mine = slice(first, first + int((score[i, first : first + k] >= max(floor, -1e308)).sum()))
                out.append((query, top, score[i, mine], order[i, mine]))
    sizes = [len(s) for _, _, s, _ in out]
    picked = rows.iloc[np.concatenate([o for *_, o in out])]
    return pd.DataFrame(
        {
            "query": np.repeat([q for q, *_ in out], sizes),
            "top": np.repeat([t for _, t, *_ in out], sizes),
            "score": np.concatenate([s for _, _, s, _ in out]),
            "id": picked["id"].array,
            "row": picked["row"].array,
        }
    )


def mine(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    anchor: Column | None = None,
    positives: int = 5,
    negatives: int = 5,
    margin: tuple[int, int] = (80, 100),
    block: int = 2048,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that
    `anchor` (a condition on `df`; all rows without it) holds of, its `positives` best other rows of its
    label, and for each of these the `negatives` best rows of other labels whose score s, times
    margin[1], lies between margin[0] and margin[1] times the positive's score. A score is the inner
    product with the anchor; greater ones come first, then smaller ids, rows without id last.

    Rows with a null label, a null or empty vector, or one with a null or non-finite component take no
    part. Vectors of different lengths are not compared. Rows are told apart by themselves, not by id:
    rows that repeat an id and vector are other rows to one another, each of them an anchor if one is.
    Anchors without positives, and positives without such negatives, give no rows, nor does an empty
    table. Scores are whole numbers if components are, exact below 2^53. Other columns, whatever their
    names, are read by `anchor` alone."""
    chosen = F.lit(True) if anchor is None else F.coalesce(anchor, F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"), chosen.alias("anchor"))
    odd = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.filter("label IS NOT NULL AND vec IS NOT NULL").filter((F.size("vec") > 0) & ~odd)
    index = Index.of(rows, block)
    anchors = index.table.filter("anchor").select(F.col("row").alias("query"), F.col("id").alias("anchor_id"), "label", "dim", "vec")
    whole = anchors.select("query", "label", "dim", "vec", F.array(F.lit(math.inf)).alias("tops"), F.array(F.lit(-math.inf)).alias("floors"))
    best = search(index, written(whole, "neg-queries"), True, positives)
    best = best.select("query", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    tops = best.groupBy("query").agg(F.sort_array(F.collect_set("positive_score")).alias("tops"))
    ranged = anchors.select("query", "label", "dim", "vec").join(tops, "query")
    ranged = ranged.withColumn("floors", F.transform("tops", lambda t: t * margin[0] / margin[1]))
    found = search(index, written(ranged, "neg-queries"), False, negatives)
    found = found.select("query", F.col("top").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = anchors.select("query", "anchor_id").join(best, "query").join(found, ["query", "positive_score"])
    scores = [F.col(c).cast("long").alias(c) for c in ("positive_score", "negative_score")]
    return out.select("anchor_id", "positive_id", "rank", "negative_id", *scores)
