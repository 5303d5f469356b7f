"""Quality rules combined by weak supervision.

Each rule looks at one document and votes 1 (good), 0 (bad) or abstains. Rules overlap and may
contradict one another: those on symbols, marked words, word length, bare signs and sentence ends
vote both ways, so one bad vote can be outvoted and several good votes can be too. Documents are
counted by their pattern of votes, a table of at most 3^rules rows whatever the number of
documents, and expectation-maximisation on that table estimates each rule's accuracy and the share
of good documents. A document's verdict is its posterior probability of being good.

Everything is DataFrame expressions: votes and counts are columns, and the whole estimation is one
fold over a row that holds the pattern table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import written

#: The white space between words, the symbols that are counted.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
#: A word without letter or digit, and the sign that ends a sentence at the end of a word.
BARE = r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])"
ENDS = r"[.!?](?![^\x20\x09-\x0D])"


def with_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the counts that rules look at: n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_upper, n_bare (words without letter or digit), n_ends (words that end a
    sentence). A null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    df = df.withColumns(
        {
            "_words": F.filter(F.split(text, SPACE), lambda x: x != ""),
            "_lines": lines,
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_bare": F.regexp_count(text, F.lit(BARE)).cast("long"),
            "n_ends": F.regexp_count(text, F.lit(ENDS)).cast("long"),
            "n_upper": F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long"),
        }
    )
    # Each word as a number, then each 5-word window.
    df = df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumns(
        {
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_words": F.size("_words").cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    ).drop("_words", "_lines")

    def later(a: str, k: int) -> Column:
        return F.slice(F.col(a), k + 1, F.greatest(F.size(a) - k, F.lit(0)))

    def joined(a: str, k: int, n: int) -> Column:
        """Numbers for windows of n words from those k words apart; the last n - 1 are no windows."""
        return F.slice(F.zip_with(F.col(a), later(a, k), lambda x, y: F.xxhash64(x, y)), 1, F.greatest(F.size("_h") - n + 1, F.lit(0)))

    df = df.withColumn("_two", joined("_h", 1, 2))
    df = df.withColumn("_four", joined("_two", 2, 4))
    # Words 1-4 and 2-5 make the window of five.
    df = df.withColumn("_fives", joined("_four", 1, 5)).drop("_h", "_two", "_four")
    # Only texts that repeat a window pay for sorting windows with their places.
    repeats = F.size(F.array_distinct("_fives")) < F.size("_fives")
    df = df.withColumn(
        "_sorted",
        F.when(repeats, F.sort_array(F.transform("_fives", lambda x, i: F.struct(x.alias("h"), i.alias("at"))))),
    )
    none = F.lit(None).cast("struct<h:bigint,at:int>")
    before = F.concat(F.array(none), F.slice("_sorted", 1, F.greatest(F.size("_sorted") - 1, F.lit(1))))
    df = df.withColumn("_before", before)
    marked = F.zip_with(
        F.zip_with("_sorted", "_before", lambda a, b: F.struct(a.alias("a"), a["h"].eqNullSafe(b["h"]).alias("same"))),
        later("_sorted", 1),
        lambda x, c: F.when(x["same"] | x["a"]["h"].eqNullSafe(c["h"]), x["a"]["at"]),
    )
    df = df.withColumn("_places", F.sort_array(F.filter(marked, lambda x: x.isNotNull())))
    covered = F.zip_with(
        F.col("_places"), later("_places", 1), lambda a, b: F.when(b.isNull(), F.lit(5)).otherwise(F.least(F.lit(5), b - a))
    )
    return df.withColumn(
        "n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long"))
    ).drop("_fives", "_sorted", "_before", "_places")


def rules() -> dict[str, Column]:
    """Votes by rule: 1 good, 0 bad, null abstains. Integer arithmetic only. Rules that look for one
    kind of junk say nothing of documents without it, which may hold another kind."""
    c = F.col
    words, some = c("n_words"), c("n_words") > 0

    def votes(bad: Column, good: Column | None = None) -> Column:
        told = F.when(bad, 0)
        return told if good is None else told.when(some & good, 1)

    chars = c("word_chars")
    return {
        "symbols": votes(20 * c("n_symbols") > chars, 100 * c("n_symbols") <= chars),
        "marked_words": votes(5 * c("n_symbols") > words, 50 * c("n_symbols") <= words),
        "word_length": votes((chars > 7 * words) | (chars < 3 * words), (chars >= 4 * words) & (chars <= 6 * words)),
        "bare_signs": votes(20 * c("n_bare") > words, 100 * c("n_bare") <= words),
        "sentences": votes((50 * c("n_ends") < words) | (5 * c("n_ends") > 2 * words), (25 * c("n_ends") >= words) & (4 * c("n_ends") <= words)),
        "capitals": votes(10 * c("n_upper") > chars),
        "dup_lines": votes((10 * c("n_dup_lines") > c("n_lines"))),
        "repeated": votes(20 * c("n_repeat_words") > words),
        "short": votes(words < 20),
    }


def estimate(votes: DataFrame, names: list[str], rounds: int = 40, share: float = 0.5, accuracy: float = 0.8) -> DataFrame:
    """One row: share (of good documents) and right (array: each rule's probability to be right when
    it votes).

    Expectation-maximisation over the counts of vote patterns, from `share` and `accuracy` as first
    guesses and with one document's worth of the latter (two of the former) as a prior, so that a
    rule that never votes keeps the first guess. Accuracies stay between 0.5 and 0.99 (a rule is
    never turned round), the share between 0.05 and 0.95. Patterns are taken in a fixed order, so
    reruns agree. Without documents the first guesses come back."""
    vector = F.array(*[F.coalesce(F.col(n), F.lit(-1)) for n in names])
    patterns = votes.select(vector.alias("v")).groupBy("v").agg(F.count("*").cast("double").alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("p"))
    m = len(names)
    state = "struct<share:double,right:array<double>>"
    start = F.struct(F.lit(share).alias("share"), F.array_repeat(F.lit(accuracy), m).alias("right")).cast(state)
    sums = "struct<n:double,good:double,voted:array<double>,right:array<double>>"

    def step(s: Column, _: Column) -> Column:
        zero = F.array_repeat(F.lit(0.0), m)
        empty = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("good"), zero.alias("voted"), zero.alias("right")).cast(sums)

        def add(t: Column, x: Column) -> Column:
            p, n, v = x["q"], x["n"], x["v"]
            right = [F.when(v[k] == 1, n * p).when(v[k] == 0, n * (1 - p)).otherwise(F.lit(0.0)) for k in range(m)]
            return F.struct(
                (t["n"] + n).alias("n"),
                (t["good"] + n * p).alias("good"),
                F.array(*[t["voted"][k] + F.when(v[k] >= 0, n).otherwise(F.lit(0.0)) for k in range(m)]).alias("voted"),
                F.array(*[t["right"][k] + right[k] for k in range(m)]).alias("right"),
            ).cast(sums)

        def weighted(x: Column) -> Column:
            q = posterior(s["share"], s["right"], [x["v"][k] for k in range(m)])
            return F.struct(x["v"].alias("v"), x["n"].alias("n"), q.alias("q"))

        def finish(t: Column) -> Column:
            each = F.arrays_zip(t["right"].alias("r"), t["voted"].alias("v"))
            right = F.transform(each, lambda x: F.greatest(F.lit(0.5), F.least(F.lit(0.99), (x["r"] + accuracy) / (x["v"] + 1))))
            part = F.greatest(F.lit(0.05), F.least(F.lit(0.95), (t["good"] + 2 * share) / (t["n"] + 2)))
            return F.struct(part.alias("share"), right.alias("right")).cast(state)

        return F.transform(F.array(F.aggregate(F.transform("p", weighted), empty, add)), finish)[0]

    fitted = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("s"))
    return fitted.select("s.share", "s.right")


def posterior(share: Column, right: Column, votes: list[Column]) -> Column:
    """Probability of being good. Votes: 1, 0, or anything else (null included) for none."""
    good, bad = share, 1 - share
    for k, v in enumerate(votes):
        good = good * F.when(v == 1, right[k]).when(v == 0, 1 - right[k]).otherwise(F.lit(1.0))
        bad = bad * F.when(v == 0, right[k]).when(v == 1, 1 - right[k]).otherwise(F.lit(1.0))
    return good / (good + bad)


def judged(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_from: float = 0.5,
    least_words: int = 10,
    most_repeated: int = 20,
    carry: bool = False,
) -> DataFrame:
    """One row per row of `df`: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed (fewer than `least_words` words, or over `most_repeated` per cent of them in repeated
    5-word windows), p_good (the posterior) and kept (not base_failed and p_good >= keep_from). With
    carry, instead the kept rows of `df` with all their columns.

    A null text counts as empty: no words, base_failed. Null ids stay null; repeated rows give
    repeated rows; an empty table gives no rows. Columns of `df` whose names clash with those made
    here are not touched, as only id and text are read. Texts are used whole, of any length."""
    held = F.struct(*[F.col(f"`{c}`") for c in df.columns]) if carry else F.lit(0)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), held.alias("_row"))
    counted = with_counts(rows, "_text")
    names = list(rules())
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    counted = counted.select("_id", "_row", *base, *[c.alias(n) for n, c in rules().items()])
    # Counted once: the votes are read twice.
    counted = written(counted if carry else counted.drop("_row"), "rule-counts")
    fitted = estimate(counted, names)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    # The estimate is one row by construction.
    out = counted.join(F.broadcast(fitted)).withColumns({"base_failed": failed, "p_good": posterior(F.col("share"), F.col("right"), [F.col(n) for n in names])})
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_from))
    if carry:
        return out.filter("kept").select("_row.*")
    return out.select(F.col("_id").alias(id_col), *base, "base_failed", "p_good", "kept")
