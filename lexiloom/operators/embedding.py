"""Vectors of texts from a model, or, without one, from plain features of the text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import features16
from ..sources.cache import through


VECTORS = "content_hash string, vector array<float>"


def provider(*makers: Callable | None) -> Callable | None:
    """The first of some model makers that works here: tried once each on the driver, in order (a remote
    service, a local model, ...); None if none does, which means plain features."""
    for make in makers:
        if make is None:
            continue
        try:
            make()(["probe"])
        except Exception:  # noqa: BLE001  the next one has its turn
            continue
        return make
    return None


class Retry(Exception):
    """Raised by a sender for what may work later; `after` seconds, if the other side says so."""

    def __init__(self, message: str, after: float | None = None) -> None:
        super().__init__(message)
        self.after = after


def http_sender(url: str, model: str, key_variable: str | None = None, timeout: float = 60.0) -> Callable[[list[str]], list[list[float]]]:
    """Sends texts to a service that takes {"model", "input"} as JSON and answers {"data": [{"index",
    "embedding"}, ...]}. The key is read on the executor, from the environment variable of that name.
    Answers 408, 429 and 5xx, and broken connections, may be tried again."""
    import json
    import os
    import urllib.error
    import urllib.request

    def send(texts: list[str]) -> list[list[float]]:
        headers = {"Content-Type": "application/json"}
        if key_variable:
            headers["Authorization"] = f"Bearer {os.environ[key_variable]}"
        request = urllib.request.Request(url, json.dumps({"model": model, "input": texts}).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                data = json.load(answer)["data"]
        except urllib.error.HTTPError as e:
            if e.code in (408, 429) or e.code >= 500:
                after = e.headers.get("Retry-After")
                raise Retry(str(e), float(after) if after and after.isdigit() else None) from e
            raise
        except (urllib.error.URLError, ConnectionError, TimeoutError) as e:
            raise Retry(str(e)) from e
        return [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]

    return send


def remote(make_sender: Callable[[], Callable], tries: int = 6, wait: float = 0.5, longest: float = 30.0) -> Callable[[], Callable]:
    """A model maker for embed(): sends each batch, and after Retry again, up to `tries` times, waiting
    twice as long each time (from `wait`, at most `longest` seconds, a random half of it), or as long as
    the other side says. A batch whose answer has not one vector a text is an error. Waiting happens in
    the task that has the batch; other tasks go on."""

    def make() -> Callable[[list[str]], list[list[float]]]:
        import random
        import time

        send = make_sender()

        def model(texts: list[str]) -> list[list[float]]:
            for k in range(tries):
                try:
                    vectors = send(texts)
                except Retry as e:
                    if k + 1 == tries:
                        raise
                    pause = min(longest, wait * 2**k)
                    time.sleep(min(longest, e.after) if e.after is not None else pause * (0.5 + random.random() / 2))
                    continue
                if len(vectors) != len(texts):
                    raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
                return vectors
            raise AssertionError("unreachable")

        return model

    return make


def embed(df: DataFrame, text_col: str = "text", make_model: Callable | None = None, batch: int = 32, cache: str | None = None) -> DataFrame:
    """Adds `vector` (array of float). `make_model()` is called once in each task and returns a
    function from a list of texts to a list of vectors; every distinct text is encoded once, by MD5
    of its content, in batches of `batch`, and with `cache`, a path, kept there for later runs. A null
    text has no vector. Without a model the sixteen plain features are taken."""
    if make_model is None:
        return df.withColumn("vector", features16(F.col(text_col)).cast("array<float>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for pdf in batches:
            texts = pdf["text"].tolist()
            vectors = [v for at in range(0, len(texts), batch) for v in model(texts[at : at + batch])]
            yield pd.DataFrame({"content_hash": pdf["content_hash"], "vector": [list(map(float, v)) for v in vectors]})

    make = lambda rows: rows.select("content_hash", F.col(text_col).alias("text")).filter("text is not null").mapInPandas(run, VECTORS)
    if cache is not None:
        return through(df, [text_col], cache, make, VECTORS)
    keyed = df.withColumn("content_hash", F.md5(F.col(text_col)))
    distinct = keyed.filter("content_hash is not null").groupBy("content_hash").agg(F.first(text_col).alias(text_col))
    return keyed.join(make(distinct), "content_hash", "left").drop("content_hash")


def search(queries: DataFrame, rows: DataFrame, most: int | None = None, digits: int | None = None, block: int = 512, least: float | None = None) -> DataFrame:
    """Cosines of the vectors of `queries` with those of all `rows` of another id, both (id, vector):
    a_id, b_id, score; 0 if either vector is zero. With `most` only that many of the greatest of each
    query, the smaller id first of equal ones (after rounding to `digits`); with `least` only scores of
    at least that.

    Either side is dealt into blocks of about `block` and eight times as many vectors, and a task takes
    one block of each, as a product of two matrices; of its scores only the best leave it. Where all
    leave it, they come by score: equal ones stand together, and ids of a block are few, so columnar files
    hold a row in some three bytes."""
    parts = lambda df, size: max(1, -(-df.count() // size))
    n_a, n_b = parts(queries, block), parts(rows, 8 * block)
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = queries.select("id", "vector", place(n_a).alias("p")).withColumn("q", all_of(n_b))
    b = rows.select(F.col("id").alias("other"), F.col("vector").alias("w"), place(n_b).alias("v")).withColumn("u", all_of(n_a))

    def unit(vectors: pd.Series) -> np.ndarray:
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a_id": np.zeros(0, np.int64), "b_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if left.empty or right.empty:
            return empty
        right = right.sort_values("other", ignore_index=True)
        score = unit(left["vector"]) @ unit(right["w"]).T
        a_id, b_id = left["id"].to_numpy(), right["other"].to_numpy()
        if digits is not None:
            score = np.round(score, digits)
        good = a_id[:, None] != b_id[None, :]
        if least is not None:
            good &= score >= least
        if most is not None and most < score.shape[1]:
            # All that are as good as the last of the best: equal ones are told apart by their ids later.
            ranked = np.where(good, score, -np.inf)
            good &= ranked >= np.partition(ranked, -most, axis=1)[:, -most, None]
        if most is None:
            place = np.argsort(score, axis=None)
            place = place[good.ravel()[place]]
            return pd.DataFrame({"a_id": a_id[place // len(b_id)], "b_id": b_id[place % len(b_id)], "score": score.ravel()[place]}, copy=False)
        i, j = np.nonzero(good)
        return pd.DataFrame({"a_id": a_id[i], "b_id": b_id[j], "score": score[i, j]})

    found = a.groupBy("p", "q").cogroup(b.groupBy("u", "v")).applyInPandas(run, "a_id long, b_id long, score double")
    if most is None:
        return found
    rank = F.row_number().over(Window.partitionBy("a_id").orderBy(F.desc("score"), "b_id"))
    return found.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")
