"""Near-dedup with Order MinHash (after Marcais et al. 2019) and banded alignment.

A text is the sequence of its k-word shingles. A shingle that occurs several times is labelled with
the number of its occurrence, so that a text becomes a set. A sketch takes the `take` labelled
shingles that a random order puts first and keeps them in the order in which they stand in the
text; two texts agree on a sketch only if they share these shingles in the same order, so agreement
follows edit similarity, not only overlap. Texts that agree on a sketch are candidates, and
candidates are verified: the edit distance of the two texts as sequences of words, computed in a
band just wide enough for the threshold, over the longer length. Similarity is one minus that. One
changed word takes five shingles along, so that of two texts at 0.8 whose changes are spread over single
words a third of the shingles are left; two shingles a sketch and 96 sketches find nine in ten of these,
and more of all others.

Equal texts are put together first and compared once, under a 64-bit hash of their content. Within
the texts that agree on a sketch, each is aligned with one of them; texts in small groups are all
aligned with one another. Where a large group still holds texts of different classes after that
(unrelated texts that share a common passage, mostly), those of different classes are compared, in
blocks, by the number of labelled words that they share, which bounds their similarity, and aligned
if that is enough.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .embedding_dedup import grouped
from .exact_dedup import bit_map, marked
from .graph import components, dropped, written
from .pieces import portions

#: Fixed value: the white space that separates words.
SPACE = " \t\n\x0b\x0c\r"
_SPLIT = str.maketrans({c: " " for c in SPACE})
A = np.uint64(0x9E3779B97F4A7C15)
B = np.uint64(0xBF58476D1CE4E5B9)
C = np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * B
    x = (x ^ (x >> np.uint64(27))) * C
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str, table: dict[str, int]) -> np.ndarray:
    """32-bit hashes of the words of a text."""
    words = [w for w in text.translate(_SPLIT).split(" ") if w]
    for w in set(words).difference(table):
        table[w] = xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(table.__getitem__, words), np.uint32, len(words))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit numbers of the k-word shingles; a text of fewer words is one shingle, an empty one none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - k + 1)
    h = np.full(n, A, np.uint64)
    for i in range(min(k, len(words))):
        h = mixed(h * A + words[i : i + n].astype(np.uint64) + np.uint64(1))
    return h


def labelled(h: np.ndarray) -> np.ndarray:
    """Shingles with the number of their occurrence."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    occurrence = np.empty(len(h), np.uint64)
    occurrence[order] = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
    return mixed(h + occurrence * A)


def sketches(h: np.ndarray, count: int, take: int) -> np.ndarray:
    """`count` numbers: each of the `take` labelled shingles that come first in one random order, in
    text order. A text with fewer shingles takes what it has. Labels are well mixed, so that their
    products with a random odd number are a random order."""
    lab = labelled(h)
    seeds = mixed(np.arange(1, count + 1, dtype=np.uint64) * A) | np.uint64(1)
    m = min(take, len(h))
    out = np.full(count, A, np.uint64)
    last = np.uint64(0xFFFFFFFFFFFFFFFF)
    step = max(1, 50_000 // len(h))
    for a in range(0, count, step):
        orders = lab[None, :] * seeds[a : a + step, None]
        rows = np.arange(len(orders))
        first = np.empty((len(orders), m), np.int64)
        for k in range(m):
            first[:, k] = orders.argmin(axis=1)
            orders[rows, first[:, k]] = last
        first.sort(axis=1)
        for j in range(m):
            out[a : a + step] = mixed(out[a : a + step] * A + h[first[:, j]])
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    return int(differ.argmax()) if differ.any() else n


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences if it is `most` or less, else most + 1.

    Rows of the alignment matrix as bit vectors (Hyyro 2003), restricted to the band of 2 * most + 1
    diagonals around the main one. Bit t at step i stands for element i - most + t of the longer."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    head = _common(a, b)
    a, b = a[head:], b[head:]
    tail = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    if not m or not most:
        return min(n, most + 1)
    _, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    # Every element of the longer without a partner costs one edit at least.
    kinds = int(codes.max()) + 1
    shared = np.minimum(np.bincount(codes[:n], minlength=kinds), np.bincount(codes[n:], minlength=kinds))
    if n - int(shared.sum()) > most:
        return most + 1
    banded = n > most
    shift = most if banded else 0
    places: dict[int, int] = {}
    for i, c in enumerate(codes[:n].tolist()):
        places[c] = places.get(c, 0) | 1 << (i + shift)
    found = _band(places, n, codes[n:].tolist(), most) if banded else _whole(places, n, codes[n:].tolist())
    return min(found, most + 1)


def _band(places: dict[int, int], n: int, text: list[int], most: int) -> int:
    width = 2 * most + 1
    full = (1 << width) - 1
    vp, vn, distance = full ^ ((1 << most) - 1), 0, most
    diagonal, row = 1 << (width - 1), 1 << (width - 2)
    hopeless = most + len(text) - (n - most)
    for i, c in enumerate(text):
        x = (places.get(c, 0) >> i) & full
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = vn | (full ^ (d0 | vp))
        hn = d0 & vp
        if i < n - most:  # down the band's last diagonal
            distance += not d0 & diagonal
        else:  # along the last row
            distance += bool(hp & row) - bool(hn & row)
            row >>= 1
        if distance > hopeless:
            return most + 1
        vp = hn | (full ^ (d0 >> 1 | hp))
        vn = d0 >> 1 & hp
    return distance


def _whole(places: dict[int, int], n: int, text: list[int]) -> int:
    """The same without a band, for sequences no longer than the band is wide."""
    full, last = (1 << n) - 1, 1 << (n - 1)
    vp, vn, distance = full, 0, n
    for c in text:
        x = places.get(c, 0)
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = vn | (full ^ (d0 | vp))
        hn = d0 & vp
        distance += bool(hp & last) - bool(hn & last)
        hp = (hp << 1 | 1) & full
        vp = (hn << 1) & full | (full ^ (d0 | hp))
        vn = d0 & hp
    return distance


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    longer = max(len(a), len(b))
    most = math.floor((1 - threshold) * longer + 1e-9)
    return banded_distance(a, b, most) <= most


def near_copies(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    threshold: float = 0.8,
    count: int = 96,
    take: int = 2,
    small: int = 8,
    block: int = 512,
) -> DataFrame:
    """One row per row of `df`: id, n_copies (rows with the same text), class_id (smallest id of the
    texts linked to it, over any number of links) and kept (whether it stands for its class).

    Two texts are linked if the edit similarity of their word sequences is `threshold` or more; equal
    texts always are. Texts without words, null or empty, are one text and linked to no other. The
    row that stands for a class is that of the smallest id, of the least content hash where several
    texts share that id, and one without id only if no row of the class has one: then class_id is
    null. Texts are told apart by content, so rows that share an id may be in several classes; rows
    that repeat an id and text are marked alike. No rows give no rows; other columns are ignored.
    Texts are compared whole, of any length."""
    return classes(df, id_col, text_col, k, threshold, count, take, small, block).select(
        F.col("id").alias(id_col), "n_copies", "class_id", "kept"
    )


def survivors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `df`, all columns, less near copies: of each class the one row that near_copies()
    marks as kept stays, one of them where several repeat its id and text. Null and empty texts are
    one text, so one row of them stays; rows without ids stay if no copy has one; very long texts are
    compared whole; an empty table gives no rows; columns of any name come along."""
    kept = classes(df, id_col, text_col, **options).filter("kept").select(F.col("key").alias("__kept_key"), F.col("id").alias("__kept_id")).distinct()
    # The row as one column, so that its own columns may have any name.
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")
    rows = df.select(F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("__key"), F.col(id_col).cast("long").alias("__id"), whole)
    on = (F.col("__key") == F.col("__kept_key")) & F.col("__id").eqNullSafe(F.col("__kept_id"))
    # A kept row is one of its text's: the text's key alone tells it from all others.
    return rows.join(kept, on, "left_semi").dropDuplicates(["__key"]).select("__row.*")


def _node(key: Column) -> Column:
    """A text's number: a hash of its content. It stands for the text in all later tables, and two of
    n texts share one with a probability of n^2 / 2^65."""
    return F.xxhash64(key)


def classes(
    df: DataFrame,
    id_col: str,
    text_col: str,
    k: int = 5,
    threshold: float = 0.8,
    count: int = 96,
    take: int = 2,
    small: int = 8,
    block: int = 512,
) -> DataFrame:
    """Rows id, key (of the text), n_copies, class_id (least id of the class) and kept."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table: dict[str, int] = {}
        for pdf in batches:
            texts = pdf["text"].tolist()
            for part in portions(texts):
                if len(table) > 300_000:
                    table.clear()
                words = [word_hashes(x, table) for x in texts[part]]
                parts = [shingles(w, k) for w in words]
                yield pd.DataFrame(
                    {
                        "id": pdf["id"].iloc[part].astype("Int64").array,
                        "key": [hashlib.md5(x.encode("utf-8", "surrogatepass")).hexdigest() for x in texts[part]],
                        "len": [len(w) for w in words],
                        "sketches": [sketches(h, count, take).view(np.int64) if len(h) else None for h in parts],
                    }
                )

    kind = "id long, key string, len int, sketches array<long>"
    encoded = written(rows.mapInPandas(sketch, kind).withColumn("node", _node(F.col("key"))), "omh-rows")
    # One row for each text.
    nodes = written(
        encoded.groupBy("key", "node").agg(
            F.min("id").alias("least"), F.count("*").alias("n_copies"), F.first("len").alias("len"), F.first("sketches").alias("sketches")
        ),
        "omh-nodes",
    )
    # Sketches are large: once they are dealt out, the tables that hold them go.
    keys = written(encoded.select("id", "key"), "omh-keys")
    every = written(
        nodes.filter("len > 0").select("node", "len", F.posexplode("sketches").alias("at", "sketch")).select(
            "node", "len", F.xxhash64("at", "sketch").alias("group")
        ),
        "omh-every",
    )
    sketched, nodes = nodes, written(nodes.drop("sketches"), "omh-nodes")
    dropped(sketched)
    dropped(encoded)
    groups = _grouped(every)
    large = groups.filter(F.col("n") > small)
    # Small groups hold at most `small` texts: each with each. Large ones: each with the first.
    few = groups.filter(F.col("n") <= small).groupBy("group").agg(F.collect_list(F.struct("node", "len")).alias("all"))
    each = few.select("all", F.explode("all").alias("y")).select("y", F.explode("all").alias("x")).filter("x.node < y.node")
    star = large.filter(F.col("node") > F.col("first.node")).select(
        F.struct("node", "len").alias("y"), F.struct("first.node", "first.len").alias("x")
    )
    near = F.least("x.len", "y.len") >= threshold * F.greatest("x.len", "y.len") - 1e-9
    pairs = each.select("x", "y").unionByName(star.select("x", "y")).filter(near)
    links = _linked(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), rows, threshold)
    roots = components(links, "omh-cc")
    # Large groups that still hold texts of several classes: those of different classes are compared.
    own = large.join(roots, "node", "left").select("group", "node", "len", F.coalesce("root", "node").alias("root"))
    own = written(own, "omh-large")
    dropped(groups)
    low_high = own.groupBy("group").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
    several = written(low_high.filter("low < high").select("group", "size"), "omh-mixed")
    if several.limit(1).count():
        links = links.unionByName(_agreeing(own.join(several, "group"), rows, threshold, block))
        roots = components(links, "omh-cc")
    # What stands for a class: the smallest id, then the least key; texts without ids come last.
    stands = F.struct(F.col("least").isNull().alias("none"), "least", "key").alias("stands")
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    joined = written(members.join(nodes.select("node", stands), "node"), "omh-members")
    best = joined.groupBy("root").agg(F.min("stands").alias("best"))
    told = joined.join(best, "root").select("node", "best")
    found = written(nodes.join(told, "node", "left").select("key", "n_copies", F.coalesce("best", stands).alias("best")), "omh-classes")
    for old in (nodes, own, joined):
        dropped(old)
    all_rows = keys.join(found, "key")
    kept = (F.col("key") == F.col("best.key")) & F.col("id").eqNullSafe(F.col("best.least"))
    return all_rows.select("id", "key", "n_copies", F.col("best.least").alias("class_id"), kept.alias("kept"))


def _agreeing(own: DataFrame, rows: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links (a, b) of similar texts of a group that are not of one class yet. A group is split into
    blocks; every pair of blocks is dealt out on its own. Pairs that share as many labelled words as the
    threshold takes (an edit distance of d leaves all but d of the longer text's words in common) are
    aligned, those that share most first, unless links of the task already join their classes: what
    leaves a task is a spanning forest of its classes, not its pairs."""
    words = _texts(rows, own.select("node"))
    parts = F.ceil(F.col("size") / block).cast("int")
    by = ["group", "p", "q"]
    dealt = (
        own.join(words, "node")
        .withColumn("own", F.pmod(F.xxhash64("node"), parts.cast("long")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("group", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "len", "root", "words")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in grouped(batches, by):
            if len(group) < 2:
                continue
            node, length, root, part = (group[c].to_numpy() for c in ("node", "len", "root", "own"))
            texts = [np.frombuffer(x, np.uint32) for x in group["words"]]
            shared = _shared([labelled(x.astype(np.uint64)).astype(np.uint32) for x in texts])
            good = shared >= threshold * np.maximum(length[:, None], length[None, :]) - 1e-3
            good &= np.triu(root[:, None] != root[None, :], 1)
            if group["p"].iloc[0] != group["q"].iloc[0]:
                good &= part[:, None] != part[None, :]
            i, j = np.nonzero(good)
            order = np.argsort(-shared[i, j] / np.maximum(length[i], length[j]), kind="stable")
            _, label = np.unique(root, return_inverse=True)
            found = []
            for x, y in zip(i[order].tolist(), j[order].tolist()):
                if label[x] != label[y] and similar(texts[x], texts[y], threshold):
                    label[label == label[y]] = label[x]
                    found.append((node[x], node[y]))
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    spark = own.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = written(dealt.repartition(n, *by).sortWithinPartitions(*by).mapInPandas(run, "a long, b long"), "omh-links")
    dropped(words)
    return found


def _shared(labels: list[np.ndarray]) -> np.ndarray:
    """How many labels each two of some texts share; a text has no label twice."""
    owner = np.repeat(np.arange(len(labels)), [len(x) for x in labels])
    _, column, number = np.unique(np.concatenate(labels), return_inverse=True, return_counts=True)
    common = number[column] > 1  # labels of one text alone can't be shared
    names, column = np.unique(column[common], return_inverse=True)
    shared = np.zeros((len(labels), len(labels)), np.float32)
    for at in range(0, len(names), 4096):
        some = (column >= at) & (column < at + 4096)
        table = np.zeros((len(labels), min(4096, len(names) - at)), np.float32)
        table[owner[common][some], column[some] - at] = 1
        shared += table @ table.T
    return shared


def _linked(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough."""
    pairs = written(pairs.distinct(), "omh-pairs")
    texts = _texts(rows, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    found = written(verified(pairs, texts, threshold), "omh-links")
    dropped(pairs)
    dropped(texts)
    return found


def _grouped(every: DataFrame) -> DataFrame:
    """Rows of groups of two or more, with the size and the first text of each. A bit map over these
    groups keeps most rows of groups of one from being shuffled a second time."""
    first = F.min(F.struct("node", "len")).alias("first")
    sizes = written(every.groupBy("group").agg(F.count("*").alias("n"), first).filter("n > 1"), "omh-sizes")
    some = marked(every, F.col("group"), bit_map(sizes, "group")).filter("maybe").drop("maybe")
    groups = written(some.join(sizes, "group"), "omh-groups")
    dropped(every)
    dropped(sizes)
    return groups


#: Bits of the map that says which nodes may have a pair; a fixed 2 MB.
MAP_BITS = 24


def _texts(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hashed words (node, words) of the texts under `nodes`. The table of texts is read once more; a bit
    map of fixed size over the nodes keeps most others from being sent anywhere."""
    spark = rows.sparkSession
    place = F.pmod(F.xxhash64("node"), F.lit(1 << MAP_BITS))
    mark = F.expr("shiftleft(1L, cast(pmod(xxhash64(node), 64) as int))")
    filled = nodes.select((place / 64).cast("long").alias("w"), mark.alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    bits = np.zeros(1 << (MAP_BITS - 6), np.int64)
    bits[filled["w"].to_numpy()] = filled["m"].to_numpy()
    shared = spark.sparkContext.broadcast(bits)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table: dict[str, int] = {}
        for pdf in batches:
            at = pdf["place"].to_numpy()
            hit = (shared.value[at >> 6] >> (at & 63)) & 1 == 1
            some = pdf[hit].drop_duplicates("node")
            for part in portions(some["text"].tolist()):
                if len(table) > 300_000:
                    table.clear()
                own = some.iloc[part]
                yield pd.DataFrame({"node": own["node"], "words": [word_hashes(x, table).tobytes() for x in own["text"]]})

    found = rows.select(_node(F.md5("text")).alias("node"), "text").select("node", "text", place.alias("place")).mapInPandas(words, "node long, words binary")
    # Rows that repeat a text give it once.
    return written(found.groupBy("node").agg(F.first("words").alias("words")), "omh-texts")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = lambda x: np.frombuffer(x, np.uint32)
            keep = [similar(words(wa), words(wb), threshold) for wa, wb in zip(pdf["wa"], pdf["wb"])]
            yield pdf.loc[keep, ["a", "b"]]

    left = texts.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    right = texts.select(F.col("node").alias("b"), F.col("words").alias("wb"))
    return pairs.join(right, "b").join(left, "a").mapInPandas(align, "a long, b long")
