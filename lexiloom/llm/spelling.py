"""Grouping of spelling variants with letter-parity bitmask bands.

A word's mask has a bit for each letter, set if the letter occurs an odd number of times. One inserted
or deleted letter flips one bit, a replaced one at most two. The bits are split into three bands. Two
words of one length that are one edit apart agree on a band at least and meet under (band, its bits,
length); two words of lengths m and m - 1 agree on exactly two of the bands and meet under (these two
bands, their bits, m). There, pairs whose whole masks differ in more than two bits are ruled out by
counting bits, the others are verified letter by letter, many pairs at a time. A pair of one length
counts in the first band on which it agrees, so every pair counts once, and what leaves a task is one
row per word: how many near words it has there, and the best of them. Groups of many words are split
into blocks, and every pair of blocks is dealt out on its own.

A form occurs at least twice as often as its word, so chains of forms are short (at most the binary
logarithm of the largest number of occurrences) and are followed by doubling steps.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import dropped, written
from .pieces import portions

#: The letters of a run, and those that become small.
LETTERS = "[A-Za-zÀ-ÿ]"
SMALL = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

#: Bit of each letter by its code point: a to z have their own, the others share 38. Bands take every third.
BIT = np.zeros(256, np.uint64)
BIT[ord("a") : ord("z") + 1] = np.uint64(1) << np.arange(26, dtype=np.uint64)
BIT[0xC0:] = np.uint64(1) << (np.arange(64, dtype=np.uint64) % np.uint64(38) + np.uint64(26))
BANDS = 3
BAND = np.array([sum(1 << b for b in range(k, 64, BANDS)) for k in range(BANDS)], np.uint64)
#: Kinds of meetings: of words of one length on a band, then of neighbouring lengths on all but a band.
KINDS = [*BAND, *~BAND]


class Small(dict):
    """Words by run: A-Z in lower case, as text and in UTF-8. Bounded: emptied when it is full."""

    def __missing__(self, run: str) -> tuple[str, bytes]:
        if len(self) > 200_000:
            self.clear()
        word = run.translate(SMALL)
        self[run] = found = word, word.encode()
        return found


def add_runs(table: dict[str, int], number: str, text: str, pattern: re.Pattern, damage: int | None, small: Small) -> None:
    """Adds the runs of a text to word counts. With `damage`, a run whose h = crc32 of `<number>:<run>` it
    divides loses its letter h % length."""
    start = zlib.crc32(f"{number}:".encode())
    for run, n in Counter(pattern.findall(text)).items():
        word, raw = small[run]
        if damage:
            h = zlib.crc32(raw, start)
            if h % damage == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
        table[word] = table.get(word, 0) + n


def vocabulary(df: DataFrame, id_col: str, text_col: str, damage: int | None, least_length: int, least_n: int) -> DataFrame:
    """Rows (word, n). Each task adds up its own texts before anything is shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Shorter runs make no words: runs lose letters, they never gain any.
        pattern, small = re.compile(f"{LETTERS}{{{least_length},}}"), Small()
        table: dict[str, int] = {}
        chars = 0

        def told() -> Iterator[pd.DataFrame]:
            some = {w: n for w, n in table.items() if len(w) >= least_length}
            table.clear()
            if some:
                yield pd.DataFrame({"word": list(some), "n": list(some.values())})

        for pdf in batches:
            numbers, texts = pdf["id"].tolist(), pdf["text"].tolist()
            for part in portions(texts):
                for number, text in zip(numbers[part], texts[part]):
                    add_runs(table, number, text, pattern, damage, small)
                    chars += len(text)
                if len(table) > 300_000 or chars > 100_000_000:
                    yield from told()
                    chars = 0
        yield from told()

    rows = df.filter(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def masks(words: list[str]) -> np.ndarray:
    """Letter parities of words, none of them empty."""
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return np.bitwise_xor.reduceat(BIT[codes], np.concatenate([[0], ends[:-1]]))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of `a` (pairs, m) and `b` (pairs, m or m - 1) of letters are exactly one edit apart."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    # What the longer has before and after its extra letter makes up the shorter.
    before = np.logical_and.accumulate(a[:, :-1] == b, axis=1).sum(1)
    after = np.logical_and.accumulate((a[:, 1:] == b)[:, ::-1], axis=1).sum(1)
    return before + after >= b.shape[1]


def halves(words: list[str], m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, of this process, of the first m // 2 letters of each word and of the last m - m // 2. Of
    two words one edit apart that are dealt under m, the longer of that length, one half agrees."""
    first = m // 2
    front = [hash(w[:k]) for w, k in zip(words, first.tolist())]
    back = [hash(w[len(w) - k :]) for w, k in zip(words, (m - first).tolist())]
    return np.array(front, np.int64), np.array(back, np.int64)


#: Groups up to this size are compared with one another's, row by row at a distance; larger ones as matrices.
SHIFTS = 48
#: Cells of a matrix that is worked on at once: small enough for a core's own cache.
CELLS = 100_000


class Dealt(NamedTuple):
    """Rows sorted by `group`, a number: mask, kind, whether a word is the shorter one under its m, its
    side (0 in whole groups; else pairs are of sides 1 and 2 only) and its halves."""

    group: np.ndarray
    mask: np.ndarray
    kind: np.ndarray
    short: np.ndarray
    side: np.ndarray
    front: np.ndarray
    back: np.ndarray


def candidates(x: Dealt) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of one group whose masks differ in two bits at most and that share a half, each
    in the first kind of its own that brings the two together; of a pair of different lengths the longer
    word comes first."""
    n = len(x.group)
    sizes = np.bincount(x.group)
    found_i, found_j = [], []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        half = (x.front[i] == x.front[j]) | (x.back[i] == x.back[j])
        i, j = i[half], j[half]
        flips, kind = x.mask[i] ^ x.mask[j], x.kind[i]
        good = (np.bitwise_count(flips) <= 2) & ((x.short[i] != x.short[j]) == (kind >= BANDS)) & ((x.side[i] == 0) | (x.side[i] != x.side[j]))
        for k in range(BANDS - 1):
            good &= (kind <= k) | (kind >= BANDS) | (flips & BAND[k] != 0)
        i, j = i[good], j[good]
        found_i.append(np.where(x.short[i], j, i))
        found_j.append(np.where(x.short[i], i, j))

    rows = np.flatnonzero((sizes[x.group] > 1) & (sizes[x.group] <= SHIFTS))
    for d in range(1, SHIFTS):
        rows = rows[rows < n - d]
        rows = rows[x.group[rows] == x.group[rows + d]]
        if not len(rows):
            break
        keep(rows, rows + d)
    starts = np.cumsum(sizes) - sizes
    for g in np.flatnonzero(sizes > SHIFTS):
        start, end = int(starts[g]), int(starts[g] + sizes[g])
        own = x.mask[start:end]
        some_i, some_j, held = [], [], 0
        step = max(1, CELLS // (end - start))
        for at in range(0, end - start, step):
            # Each row with those from its block on; the triangle before the row itself is left out below.
            near = np.flatnonzero(np.bitwise_count(own[at : at + step, None] ^ own[None, at:]) <= 2)
            i, j = np.divmod(near, end - start - at)
            later = j > i
            some_i.append(start + at + i[later])
            some_j.append(start + at + j[later])
            held += len(near)
            if held > 1_000_000:
                keep(np.concatenate(some_i), np.concatenate(some_j))
                some_i, some_j, held = [], [], 0
        if some_i:
            keep(np.concatenate(some_i), np.concatenate(some_j))
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *found_i]), np.concatenate([empty, *found_j])


def verified(words: list[str], m: np.ndarray, short: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that are exactly one edit apart. m: length under which a row was dealt."""
    order = np.argsort(m[i], kind="stable")
    i, j = i[order], j[order]
    cuts = np.flatnonzero(np.diff(m[i], prepend=-1)).tolist()
    near = np.zeros(len(i), bool)
    for start, end in zip(cuts, [*cuts[1:], len(i)]):
        width = int(m[i[start]])
        for at in range(start, end, max(1, 4_000_000 // width)):
            x = slice(at, min(end, at + max(1, 4_000_000 // width)))
            a, b = (np.frombuffer("".join([words[r].ljust(width, "\0") for r in rows.tolist()]).encode("latin-1"), np.uint8).reshape(-1, width) for rows in (i[x], j[x]))
            less = short[j[x]]
            near[x] = np.where(less, one_edit(a, b[:, :-1]), one_edit(a, b))
    return i[near], j[near]


def nearest(words: list[str], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """One row for each word of the pairs (i, j): how many partners it has, and the one with the largest
    n, of several the first in code-point order."""
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    own, other = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort((rank[other], -n[other], own))
    own, other = own[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    best = other[first]
    return pd.DataFrame(
        {"word": [words[x] for x in own[first]], "n_near": np.diff(np.append(first, len(own))), "best_n": n[best], "best": [words[x] for x in best]}
    )


def variants(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    damage: int | None = None,
    least_length: int = 5,
    least_n: int = 3,
    ratio: int = 2,
    block: int = 8192,
) -> DataFrame:
    """One row per word of the texts that has `least_length` letters and `least_n` occurrences or more:
    word, n (occurrences), n_near (words one inserted, deleted or replaced letter away), form (of
    these the one with the largest n, of several the first in code-point order, if its n is `ratio`
    times the word's or more; else null), form_n (its n) and root (the last of the chain of forms from
    word; word itself without form).

    A null or empty text has no words; a null id counts as an empty one where `damage` asks for ids
    (see runs()); repeated rows and rows that share an id count each time; words are compared whole,
    of any length; an empty table gives no rows; other columns, whatever their names, are not read.
    Different words may be damaged into one; they count together."""
    if least_length < 1 or ratio < 2:
        raise ValueError("words need a letter, and forms twice their word's occurrences, so that chains end")
    words = written(vocabulary(df, id_col, text_col, damage, least_length, least_n), "spell-words")
    near = written(_near(words, block), "spell-near")
    chosen = (
        words.join(near, "word", "left")
        .withColumn("has", F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False)))
        .select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("has"), F.col("best")).alias("form"),
            F.when(F.col("has"), F.col("best_n")).alias("form_n"),
        )
    )
    chosen = written(chosen, "spell-forms")
    roots = _roots(chosen, ratio)
    return chosen.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def whole(batches: Iterator[pd.DataFrame], by: list[str], rows: int) -> Iterator[pd.DataFrame]:
    """Frames of some `rows` rows of sorted batches, of whole groups."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        held.append(pdf)
        if sum(map(len, held)) < rows:
            continue
        some = pd.concat(held, ignore_index=True)
        last = (some[by] == some[by].iloc[-1]).all(axis=1).to_numpy()
        at = int(last.argmax())
        if at:
            yield some.iloc[:at]
        held = [some.iloc[at:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _near(words: DataFrame, block: int) -> DataFrame:
    """Rows (word, n_near, best, best_n) of words that have near ones."""
    by = ["kind", "bits", "m"]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            mask, length = masks(pdf["word"].tolist()), pdf["word"].map(len).to_numpy(np.int32)
            for k, bits in enumerate(KINDS):
                for longer in (0, 1) if k >= BANDS else (0,):
                    yield pd.DataFrame(
                        {"kind": np.int32(k), "bits": (mask & bits).view(np.int64), "m": length + np.int32(longer), "word": pdf["word"].array, "n": pdf["n"].array, "mask": mask.view(np.int64)}
                    )

    dealt = words.mapInPandas(deal, "kind int, bits long, m int, word string, n long, mask long")
    # Blocks of so many words, or of 4 million letters.
    parts = F.ceil(F.greatest(F.col("size") / block, F.col("size") * F.col("m") / (1 << 22))).cast("int")
    large = written(dealt.groupBy(*by).agg(F.count("*").alias("size")).withColumn("parts", parts).filter("parts > 1").drop("size"), "spell-large")
    dealt = dealt.join(large, by, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts").cast("long")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select(*by, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), side.alias("side"), "word", "n", "mask")
    by = [*by, "p", "q"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in whole(batches, by, 50_000):
            spelled = some["word"].tolist()
            key = some[by].to_numpy(np.int64)
            group = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]).any(1)]))
            kind, m = key[:, 0], key[:, 2]
            short = some["word"].map(len).to_numpy() < m
            mask = some["mask"].to_numpy(np.int64).view(np.uint64)
            dealt = Dealt(group, mask, kind, short, some["side"].to_numpy(), *halves(spelled, m))
            i, j = verified(spelled, m, short, *candidates(dealt))
            if len(i):
                yield nearest(spelled, some["n"].to_numpy(np.int64), i, j)

    slots = max(words.sparkSession.sparkContext.defaultParallelism, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = dealt.repartition(slots, *by).sortWithinPartitions(*by).mapInPandas(compare, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def _roots(chosen: DataFrame, ratio: int) -> DataFrame:
    """Rows (word, root) of words with a form. Every form has `ratio` times its word's occurrences, which
    bounds the length of a chain; each step doubles the length that has been followed."""
    at = written(chosen.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "spell-roots")
    most = chosen.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(max(1, math.log(most, ratio)) + 1))):
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = written(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spell-roots")
        dropped(at)
        at = after
    return at
