"""Text expressions: cleaning, splitting, word and character sets, features. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What starts a header or footer line (matched on lower-cased, stripped text).
HEADER_FOOTER = (
    r"^\d+$",
    r"^page\s+\d+",
    r"^第?\s*\d+\s*[ページ頁]",
    r"^\d+\s*/\s*\d+$",
    r"^-\s*\d+\s*-$",
    r"^copyright|^©",
    r"^confidential|^機密",
    r"^\d{4}[/-]\d{1,2}[/-]\d{1,2}",
    r"^[月火水木金土日]\s*曜日",
    r"^draft|^下書き|^草案",
    r"^header|^footer|^ヘッダー|^フッター",
    r"^chapter\s+\d+|^第\d+章$",
)
#: What starts a short line that matters.
IMPORTANT = (
    r"^第\d+[章節項条]",
    r"^\d+[\.)]",
    r"^[A-Z]\.",
    r"^\([a-z]\)",
    r"^[◆◇■□●○▲△]",
    r"^注[意記]?[:：]",
    r"^重要[:：]",
    r"^警告[:：]",
    r"^[※＊]",
)
#: Characters that cleaning keeps besides letters, digits and white space. CJK full
#: stop and comma are kept, so that sentences can still be found.
KEPT = r"""぀-ゟ゠-ヿ一-龯㐀-䶿.,!?;:()\[\]{}"'。、！？-"""
SPACES = r"[\s\x{3000}\x{A0}]"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, rf"^{SPACES}+|{SPACES}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(c, rf"{SPACES}+", " ")


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def without(strings: Column, pattern: str) -> Column:
    """The strings of an array that don't begin with the pattern."""
    return F.filter(strings, lambda x: ~x.rlike(f"^(?:{pattern})"))


def clean_lines(c: Column, remove: tuple[str, ...] = ()) -> Column:
    """Stripped lines without blank ones, without those that start with a pattern of `remove`, with
    white space collapsed and signs other than plain punctuation deleted."""
    found = F.filter(F.transform(lines(c), strip), lambda x: x != "")
    for pattern in remove:
        found = without(found, pattern)
    return F.transform(found, lambda x: F.regexp_replace(collapse(x), rf"[^\p{{L}}\p{{N}}_\s{KEPT}]", ""))


def clean_text(c: Column, remove: tuple[str, ...] = ()) -> Column:
    return F.array_join(clean_lines(c, remove), "\n")


def is_header_footer(c: Column, stripped: bool = False) -> Column:
    """Whether a line looks like a running header or footer; stripped: it has no space around it."""
    low, bare = (F.lower(c), c) if stripped else (strip(F.lower(c)), strip(c))
    capitals = (F.length(c) < 20) & (F.upper(c) == c) & (F.lower(c) != c) & ~c.rlike(r"\d")
    return low.rlike("|".join(f"(?:{p})" for p in HEADER_FOOTER)) | (F.length(bare) < 3) | capitals


def is_important_short(c: Column, stripped: bool = False) -> Column:
    return (c if stripped else strip(c)).rlike("|".join(f"(?:{p})" for p in IMPORTANT))


def body_lines(c: Column) -> Column:
    """Lines of running text: not blank, no header or footer, ten characters or important."""
    found = F.transform(lines(c), strip)
    return F.filter(found, lambda x: (x != "") & ~is_header_footer(x, True) & ((F.length(x) >= 10) | is_important_short(x, True)))


def clean_chunk(c: Column) -> Column:
    """White space collapsed, runs of three and more dots cut to three."""
    return strip(F.regexp_replace(collapse(c), r"\.{3,}", "..."))


def normal_title(c: Column) -> Column:
    """Lower case, without punctuation, white space collapsed."""
    return strip(collapse(F.regexp_replace(strip(F.lower(c)), r"[^\p{L}\p{N}_\s]", "")))


def token_estimate(c: Column) -> Column:
    """About four characters a token, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.expr("bigint(0)") + F.floor(F.length(c) / 4))


def words(c: Column) -> Column:
    return F.filter(F.split(c, rf"{SPACES}+"), lambda x: x != "")


def word_set(c: Column) -> Column:
    return F.array_distinct(words(F.lower(c)))


def char_set(c: Column) -> Column:
    """Distinct letters, digits and underscores, lower case."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]", ""), ""), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; two empty ones are equal."""
    return jaccard_of(F.size(a), F.size(b), F.size(F.array_intersect(a, b)))


def jaccard_of(size_a: Column, size_b: Column, shared: Column) -> Column:
    both = size_a + size_b - shared
    return F.when(both == 0, F.lit(1.0)).otherwise(shared / both)


def overlap(a: Column, b: Column) -> Column:
    """Shared share of the smaller set; 0 if it is empty."""
    return overlap_of(F.size(a), F.size(b), F.size(F.array_intersect(a, b)))


def overlap_of(size_a: Column, size_b: Column, shared: Column) -> Column:
    least = F.least(size_a, size_b)
    return F.when(least == 0, F.lit(0.0)).otherwise(shared / least)


def tokens_with_spaces(c: Column) -> Column:
    """Words and the white space between them, in order."""
    return F.regexp_extract_all(c, F.lit(r"(\S+|\s+)"), 1)


def sentences_terminal(c: Column) -> Column:
    """Parts between runs of sentence ends that a space or the end follows; trimmed, over 10 long."""
    parts = F.transform(F.split(c, r"[.!?。！？]+(?:\s+|$)"), strip)
    return F.filter(parts, lambda x: F.length(x) > 10)


def sentences_lookahead(c: Column) -> Column:
    """Parts that end with . ! or ? where white space and a capital or CJK letter follow."""
    return F.split(c, r"(?<=[.!?。！？])\s+(?=[A-Z぀-ヿ一-龯])")


def count_of(c: Column, sign: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))


def count_class(c: Column, negated: str) -> Column:
    """Number of characters outside of the class `negated`."""
    return F.length(F.regexp_replace(c, negated, ""))


def features16(c: Column) -> Column:
    """Sixteen plain features: length, words, shares of vowels, of signs and of kinds of letters."""
    low, n = F.lower(c), F.greatest(F.length(c), F.lit(1))
    shares = [count_of(low, x) for x in "aeiou"] + [count_of(c, x) for x in ".,"] + [count_of(c, " ")]
    kinds = [r"[^぀-ゟ]+", r"[^゠-ヿ]+", r"[^一-龯]+", r"\P{Nd}+", r"\P{Lu}+", r"\P{Ll}+"]
    shares += [count_class(c, k) for k in kinds]
    n_words = F.regexp_count(c, F.lit(f"[^{SPACES[1:]}+"))
    return F.array(F.length(c).cast("double"), n_words.cast("double"), *[s / n for s in shares])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if one of the vectors is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def match_type(score: Column, exact: float = 0.92, partial: float = 0.75) -> Column:
    return F.when(score >= exact, "exact").when(score >= partial, "partial").otherwise("poor")


def escape_html(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def format_bytes(c: Column) -> Column:
    """Bytes in the largest unit that leaves a number of 1 or more, two decimals."""
    units = [(0, "B"), (10, "KB"), (20, "MB"), (30, "GB")]
    shown = [F.format_string(f"%.2f {unit}", c / F.lit(float(1 << power))) for power, unit in units]
    return F.when(c < 1 << 10, shown[0]).when(c < 1 << 20, shown[1]).when(c < 1 << 30, shown[2]).otherwise(shown[3])
