"""Secret scans with a trigram index.

From each rule's regular expression a Boolean query of trigrams is derived that every match must
satisfy (after Cox's description of code search): literals give the trigrams they contain, a
sequence the conjunction of its parts, a branch the disjunction; optional and unbounded parts give
what their mandatory repetitions give. Letters are folded, so a query holds for either case.

Documents are indexed by segments, the batches in which a task reads them: one pass over the
segment's trigrams, as numbers, gives for each of those that some query names its postings, the
sorted documents that contain it. Queries intersect and unite postings; only the candidates are
searched with the regular expression. Rules whose expression has no mandatory trigram scan every
document. No row leaves its task. Expressions are written so that a search is linear in the text:
runs start at a boundary, do not give back what they took, or are bounded in length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from re import _constants as C
from re import _parser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import nullable_ids, portions

#: A query is ALL (every document), a trigram, or ("and" | "or", queries).
ALL = True


def conjunction(parts: list) -> object:
    flat = [q for p in parts for q in (p[1] if isinstance(p, tuple) and p[0] == "and" else [p]) if q is not ALL]
    flat = list(dict.fromkeys(flat))
    return ALL if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def disjunction(parts: list) -> object:
    if any(p is ALL for p in parts):
        return ALL
    flat = list(dict.fromkeys(q for p in parts for q in (p[1] if isinstance(p, tuple) and p[0] == "or" else [p])))
    return flat[0] if len(flat) == 1 else ("or", tuple(flat))


def of_strings(strings: frozenset[str]) -> object:
    """What holds for a text that contains one of the strings."""
    return disjunction([conjunction([s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


#: More strings than this for one part are no longer told apart.
MOST = 64


def exact(parsed) -> frozenset[str] | None:
    """The folded strings that the parsed part matches, if they are few; else None."""
    found = {""}
    for op, arg in parsed:
        if op is C.LITERAL:
            more = {chr(arg).lower()} if arg < 128 else None
        elif op is C.IN and all(o is C.LITERAL and a < 128 for o, a in arg):
            more = {chr(a).lower() for _, a in arg}
        elif op is C.SUBPATTERN:
            more = exact(arg[3])
        elif op is C.BRANCH:
            branches = [exact(b) for b in arg[1]]
            more = None if any(b is None for b in branches) else set().union(*branches)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[1] is not C.MAXREPEAT and arg[1] <= 4:
            one, more = exact(arg[2]), None
            if one is not None:
                more, power = set(), {""}
                for k in range(arg[1] + 1):
                    more |= power if k >= arg[0] else set()
                    power = {a + b for a in power for b in one}
                    if len(power) > MOST:
                        more = None
                        break
        elif op is C.AT:
            more = {""}
        else:
            more = None
        if more is None:
            return None
        found = {a + b for a in found for b in more}
        if len(found) > MOST:
            return None
    return frozenset(found)


def trigram_query(parsed) -> object:
    """A query that holds for every text with a match of the parsed part."""
    parts, run = [], frozenset({""})

    def close() -> None:
        parts.append(of_strings(run))

    for item in parsed:
        strings = exact([item])
        if strings is not None and len(run) * len(strings) <= MOST:
            run = frozenset(a + b for a in run for b in strings)
            continue
        close()
        run = frozenset({""}) if strings is None else strings
        if strings is None:
            op, arg = item
            if op is C.SUBPATTERN:
                parts.append(trigram_query(arg[3]))
            elif op is C.ATOMIC_GROUP:
                parts.append(trigram_query(arg))
            elif op is C.BRANCH:
                parts.append(disjunction([trigram_query(b) for b in arg[1]]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
                parts.append(trigram_query(arg[2]))
    close()
    return conjunction(parts)


@dataclass(frozen=True)
class Rule:
    """kind: its name; group, least: that group of a match must have so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)

    @cached_property
    def query(self) -> object:
        return trigram_query(_parser.parse(self.pattern, re.ASCII))

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.regex.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


#: The base kinds, in their order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True),
)
#: Further kinds: published token formats.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i:authorization)\x20*[:=]\x20*(?i:bearer|basic)\x20+([A-Za-z0-9+/_.=-]{16,})"),
    Rule("url_login", r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{0,31}://[^\s:/@]{1,256}+:([^\s:/@]{6,256}+)@", 1, 6),
)
RULES = BASE + MORE


def trigrams(query: object) -> set[str]:
    return set() if query is ALL else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


class Segment:
    """Inverted index of some documents: postings for the trigrams that the rules' queries name."""

    def __init__(self, texts: list[str], names: set[str]) -> None:
        self.every = frozenset(range(len(texts)))
        self.postings: dict[str, frozenset[int]] = dict.fromkeys(names, frozenset())
        # All texts in one run of code points, capitals of ASCII folded; a text ends with two zeros, so
        # no trigram reaches into the next.
        codes = np.frombuffer("\0\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        folded = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
        plain = np.where(folded < 128, folded, 0)
        numbers = plain[:-2] << 14 | plain[1:-1] << 7 | plain[2:]
        wanted = {ord(t[0]) << 14 | ord(t[1]) << 7 | ord(t[2]): t for t in names}
        table = np.zeros(1 << 21, bool)
        table[list(wanted)] = True
        at = np.flatnonzero(table[numbers])
        if len(at):
            ends = np.cumsum([len(x) + 2 for x in texts])
            pairs = np.unique(numbers[at].astype(np.int64) * (len(texts) + 1) + np.searchsorted(ends, at, side="right"))
            number, document = pairs // (len(texts) + 1), pairs % (len(texts) + 1)
            cuts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
            for a, b in zip(cuts, [*cuts[1:], len(number)]):
                self.postings[wanted[int(number[a])]] = frozenset(document[a:b].tolist())

    def candidates(self, query: object) -> frozenset[int]:
        if query is ALL:
            return self.every
        if isinstance(query, str):
            return self.postings[query]
        parts = [self.candidates(q) for q in query[1]]
        if query[0] == "or":
            return frozenset().union(*parts)
        parts.sort(key=len)
        return parts[0].intersection(*parts[1:])


def find(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """(start, rule number, end) of every finding in each text, sorted by start, then rule."""
    segment = Segment(texts, set().union(*(trigrams(r.query) for r in rules)))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, rule in enumerate(rules):
        for i in segment.candidates(rule.query):
            found[i] += [(a, k, b) for a, b in rule.spans(texts[i])]
    for x in found:
        x.sort()
    return found


def named(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of `df`: id; n_<kind> for each base rule; base_sha256, the SHA-256 of the
    base findings as kind:start:end joined by commas, by start, then in the rules' order; spans, all
    findings joined likewise.

    Positions count code points, the end is exclusive; findings of one kind don't overlap. A null
    text counts as empty and has no findings; ids may be null; repeated rows give repeated rows; an
    empty table gives no rows. Other columns are ignored. Texts are searched whole."""
    base = [r.kind for r in rules if r.base]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for part in portions(texts):
                some = [x if isinstance(x, str) else "" for x in texts[part]]
                found = find(some, rules)
                out = pd.DataFrame({"id": pdf["id"].iloc[part].array})
                own = [[x for x in spans if rules[x[1]].base] for spans in found]
                for kind in base:
                    out[f"n_{kind}"] = [sum(rules[k].kind == kind for _, k, _ in x) for x in own]
                out["base_sha256"] = [hashlib.sha256(named(x, rules).encode()).hexdigest() for x in own]
                out["spans"] = [named(x, rules) for x in found]
                yield out

    kind = "id long, " + "".join(f"n_{k} long, " for k in base) + "base_sha256 string, spans string"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(nullable_ids(run), kind).withColumnRenamed("id", id_col)


def redacted(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`df` with every finding in its texts replaced by the kind in square brackets (overlapping
    findings as one, under the kind of the first). A null text stays null, an empty one empty; texts
    are searched whole, whatever their length; repeated rows give repeated rows, an empty table gives
    none; other columns, ids among them, are as they were."""

    @F.pandas_udf("string")
    def clean(column: pd.Series) -> pd.Series:
        out, texts = [], column.tolist()
        for part in portions(texts):
            some = [x if isinstance(x, str) else "" for x in texts[part]]
            out += [redact(x, spans, rules) for x, spans in zip(some, find(some, rules))]
        return pd.Series(out, dtype=object).where(column.notna().to_numpy(), None)

    return df.withColumn(text_col, clean(F.col(text_col)))


def redact(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES) -> str:
    out, at, k = [], 0, 0
    while k < len(spans):
        start, rule, end = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][2])
            k += 1
        out += [text[at:start], f"[{rules[rule].kind}]"]
        at = end
    return "".join([*out, text[at:]])
