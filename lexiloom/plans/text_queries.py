"""Queries of the text layer: cleaning, splitting, sets, features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, pairwise
from .registry import query, read, sql

#: The same expressions in the SQL of the oracle.
D_SP = r"[\s\x{3000}\x{A0}]"


def d_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{D_SP}+|{D_SP}+$', '', 'g')"


def d_collapse(x: str) -> str:
    return rf"regexp_replace({x}, '{D_SP}+', ' ', 'g')"


D_KEPT = T.KEPT.replace("'", "''")
D_HEADER = "|".join(f"(?:{p})" for p in T.HEADER_FOOTER)
D_IMPORTANT = "|".join(f"(?:{p})" for p in T.IMPORTANT)


def d_header(x: str) -> str:
    low, bare = d_strip(f"lower({x})"), d_strip(x)
    capitals = f"(length({x}) < 20 AND upper({x}) = {x} AND lower({x}) <> {x} AND NOT regexp_matches({x}, '\\d'))"
    return f"(regexp_matches({low}, '{D_HEADER}') OR length({bare}) < 3 OR {capitals})"


def d_important(x: str) -> str:
    return f"regexp_matches({d_strip(x)}, '{D_IMPORTANT}')"


def d_words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '{D_SP}+'), lambda w: w <> '')"


def d_word_set(x: str) -> str:
    return f"list_distinct({d_words(f'lower({x})')})"


def d_char_set(x: str) -> str:
    return rf"list_distinct(list_filter(string_split(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_]', '', 'g'), ''), lambda w: w <> ''))"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


@query(
    rf"""SELECT doc_id, md5(cleaned) AS cleaned_md5, length(cleaned) AS cleaned_chars FROM (
    SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: {d_strip('x')}), lambda x: x <> ''),
      lambda x: regexp_replace({d_collapse('x')}, '[^\p{{L}}\p{{N}}_\s{D_KEPT}]', '', 'g')), chr(10)) AS cleaned FROM documents)"""
)
def clean_text(spark, sf_dir):
    cleaned = T.clean_text(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", cleaned.alias("c")).select(
        "doc_id", F.md5("c").alias("cleaned_md5"), F.length("c").cast("long").alias("cleaned_chars")
    )


@query(
    rf"""SELECT doc_id, md5(array_to_string(l, chr(10))) AS kept_md5, len(l) AS kept_lines FROM (
    SELECT doc_id, list_filter(list_filter(list_transform(string_split(text, chr(10)), lambda x: {d_strip('x')}), lambda x: x <> ''),
      lambda x: NOT (regexp_matches(x, '^(?:The|Of)') OR regexp_matches(x, '^(?:\d+)'))) AS l FROM documents)"""
)
def clean_remove_patterns(spark, sf_dir):
    """Lines that start with a configured pattern go before cleaning."""
    kept = F.filter(F.transform(T.lines(F.col("text")), T.strip), lambda x: x != "")
    for pattern in ("The|Of", r"\d+"):
        kept = T.without(kept, pattern)
    return docs(spark, sf_dir).select("doc_id", kept.alias("l")).select(
        "doc_id", F.md5(F.array_join("l", "\n")).alias("kept_md5"), F.size("l").cast("long").alias("kept_lines")
    )


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, count(*) FILTER (WHERE {d_header('line')}) AS header_lines, count(*) FILTER (WHERE {d_important('line')}) AS important_lines,
    count(*) AS n_lines FROM l GROUP BY doc_id"""
)
def strip_headers_footers(spark, sf_dir):
    line = docs(spark, sf_dir).select("doc_id", F.explode(T.lines(F.col("text"))).alias("line"))
    return line.groupBy("doc_id").agg(
        F.count_if(T.is_header_footer(F.col("line"))).alias("header_lines"),
        F.count_if(T.is_important_short(F.col("line"))).alias("important_lines"),
        F.count("*").alias("n_lines"),
    )


#: Beginnings and ends of short lines that are important, or part of a page's frame.
EDGES = ("第3章 ", "2) ", "A. ", "(b) ", "● ", "注意: ", "重要：", "警告: ", "※ ", "Page ", "- ", "DRAFT ", "2024-01-05 ", "機密 ", "© ", "ANNUAL ", "a copyright ", "")


@query(
    rf"""SELECT doc_id, k, {d_header('line')} AS header, {d_important('line')} AS important FROM
    (SELECT doc_id, k, concat([{', '.join(f"'{x}'" for x in EDGES)}][(doc_id + k) % {len(EDGES)} + 1], CASE WHEN (doc_id + k) % {len(EDGES)} IN (9, 10) THEN (k % 40)::VARCHAR ELSE left(x, 12) END, CASE WHEN (doc_id + k) % {len(EDGES)} = 10 THEN ' -' ELSE '' END) AS line
      FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS k, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""
)
def important_short(spark, sf_dir):
    """Beginnings of all lines behind marks that make lines important or part of the frame."""
    which = (F.col("doc_id") + F.col("k")) % len(EDGES)
    start = F.get(F.array(*[F.lit(x) for x in EDGES]), which.cast("int"))
    line = F.concat(start, F.when(which.isin(9, 10), (F.col("k") % 40).cast("string")).otherwise(F.left("x", F.lit(12))), F.when(which == 10, " -").otherwise(""))
    v = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "x")).select("doc_id", "k", line.alias("line"))
    return v.select("doc_id", "k", T.is_header_footer(F.col("line")).alias("header"), T.is_important_short(F.col("line")).alias("important"))


@query(
    f"""SELECT doc_id, len(b) AS body_lines, md5(array_to_string(b, chr(10))) AS body_md5 FROM (
    SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {d_strip('x')}),
      lambda x: x <> '' AND NOT {d_header('x')} AND (length(x) >= 10 OR {d_important('x')})) AS b FROM documents)"""
)
def body_text_plain(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.body_lines(F.col("text")).alias("b")).select(
        "doc_id", F.size("b").cast("long").alias("body_lines"), F.md5(F.array_join("b", "\n")).alias("body_md5")
    )


def blocks(spark, sf_dir):
    """The lines of the documents as blocks on pages of eight: some at the margins, some beside the text."""
    d = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "t"))
    row, side = F.col("k") % 8, F.col("k") % 5 == 3
    y0 = F.when(row == 0, 50.0).when(row == 7, 760.0).otherwise(100.0 + row * 80.0)
    x0, x1 = F.when(side, 5.0).otherwise(100.0), F.when(side, 60.0).otherwise(400.0)
    return d.select(F.concat_ws("-", "doc_id", F.floor(F.col("k") / 8)).alias("page"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), (y0 + 20.0).alias("y1"), "t")


D_BLOCKS = """(SELECT concat(doc_id, '-', k // 8) AS page, CASE WHEN k % 5 = 3 THEN 5.0 ELSE 100.0 END::DOUBLE AS x0, y0, CASE WHEN k % 5 = 3 THEN 60.0 ELSE 400.0 END::DOUBLE AS x1, y0 + 20 AS y1, t FROM
    (SELECT *, (CASE k % 8 WHEN 0 THEN 50.0 WHEN 7 THEN 760.0 ELSE 100.0 + k % 8 * 80.0 END)::DOUBLE AS y0 FROM
      (SELECT doc_id, generate_subscripts(l, 1) - 1 AS k, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))))"""


@query(
    f"""WITH k AS (SELECT *, {d_header('t')} AS hf FROM {D_BLOCKS})
    SELECT page, md5(string_agg(t, chr(10) ORDER BY y0, x0)) AS body_md5 FROM k WHERE (CASE WHEN y0 < 0.12 * 800 OR y1 > 0.88 * 800 THEN length(t) > 50 AND NOT hf
      WHEN x1 < 0.15 * 600 OR x0 > 0.85 * 600 THEN length(t) > 100 ELSE TRUE END) AND NOT hf AND (length(t) >= 10 OR {d_important('t')}) GROUP BY page"""
)
def body_text_positional(spark, sf_dir):
    from ..operators.layout import body_blocks

    return body_blocks(blocks(spark, sf_dir), 800.0, 600.0).groupBy("page").agg(
        F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y0", "x0", "t"))), lambda s: s["t"]), "\n")).alias("body_md5")
    )


@query(
    rf"""SELECT doc_id, {d_strip(d_collapse(r"regexp_replace(" + d_strip("lower(string_split(text, chr(10))[1])") + r", '[^\p{L}\p{N}_\s]', '', 'g')"))} AS title FROM documents"""
)
def normalize_title(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.normal_title(F.split("text", "\n")[0]).alias("title"))


@query(
    rf"""SELECT doc_id, md5(c) AS chunk_md5, length(c) AS n FROM (SELECT doc_id, {d_strip(rf"regexp_replace({d_collapse('text')}, '\.{{3,}}', '...', 'g')")} AS c FROM documents)"""
)
def chunk_text_clean(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.clean_chunk(F.col("text")).alias("c")).select(
        "doc_id", F.md5("c").alias("chunk_md5"), F.length("c").cast("long").alias("n")
    )


@query(r"""SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, '|')) AS tokens_md5 FROM (SELECT doc_id, regexp_extract_all(text, '\S+|\s+') AS t FROM documents)""")
def tokens_word_ws(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.tokens_with_spaces(F.col("text")).alias("t")).select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", "|")).alias("tokens_md5")
    )


@query("""SELECT c AS ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) GROUP BY c""")
def tokens_char(spark, sf_dir):
    char = F.explode(F.filter(F.split("text", ""), lambda x: x != "")).alias("ch")
    return docs(spark, sf_dir).select(char).groupBy("ch").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, generate_subscripts(l, 1) AS line_no, length(unnest(l)) AS n_chars FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def tokens_line(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("i", "line")).select(
        "doc_id", (F.col("i") + 1).cast("long").alias("line_no"), F.length("line").cast("long").alias("n_chars")
    )


D_SENTENCES = rf"list_filter(list_transform(string_split_regex(text, '[.!?。！？]+(?:\s+|$)'), lambda x: {d_strip('x')}), lambda x: length(x) > 10)"


@query(f"""SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM (SELECT doc_id, {D_SENTENCES} AS s FROM documents)""")
def sentences_terminal(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.sentences_terminal(F.col("text")).alias("s")).select(
        "doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("sentences_md5")
    )


@query(
    r"""SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM (SELECT doc_id,
    string_split(regexp_replace(text, '([.!?。！？])\s+([A-Z぀-ヿ一-龯])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM documents)"""
)
def sentences_lookahead(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.sentences_lookahead(F.col("text")).alias("s")).select(
        "doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("sentences_md5")
    )


@query("SELECT doc_id, greatest(1, length(text) // 4) AS token_estimate FROM documents")
def token_estimate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.token_estimate(F.col("text")).alias("token_estimate"))


LIMIT = 200


def d_pack(overlap: int) -> str:
    """Packing as a recursive query over numbered sentences."""
    tail = (
        f"""CASE WHEN {overlap} = 0 THEN [] ELSE coalesce((SELECT r FROM (SELECT unnest(range(1, len(p.cur) + 2)) AS j) g, LATERAL (SELECT p.cur[j:] AS r)
        WHERE coalesce(list_sum(list_transform(p.cur[j:], lambda x: greatest(1, length(x) // 4))), 0) <= {overlap} ORDER BY j LIMIT 1), []) END"""
        if overlap
        else "[]"
    )
    return f"""WITH RECURSIVE s AS (SELECT doc_id, {D_SENTENCES} AS s FROM documents),
    p AS (SELECT doc_id, s, 0 AS i, []::VARCHAR[] AS cur, 0::BIGINT AS n, []::VARCHAR[] AS done FROM s
      UNION ALL SELECT doc_id, s, i + 1,
        CASE WHEN is_full THEN list_append(tail, s[i + 1]) ELSE list_append(cur, s[i + 1]) END,
        CASE WHEN is_full THEN coalesce(list_sum(list_transform(tail, lambda x: greatest(1, length(x) // 4))), 0)::BIGINT + t ELSE n + t END,
        CASE WHEN is_full THEN list_append(done, array_to_string(cur, ' ')) ELSE done END
      FROM (SELECT *, n + t > {LIMIT} AND len(cur) > 0 AS is_full, {tail.replace('p.cur', 'cur')} AS tail FROM
        (SELECT *, greatest(1, length(s[i + 1]) // 4) AS t FROM p WHERE i < len(s)) p))
    SELECT doc_id, len(c) AS n_chunks, md5(array_to_string(c, '|')) AS chunks_md5 FROM
      (SELECT doc_id, CASE WHEN len(cur) > 0 THEN list_append(done, array_to_string(cur, ' ')) ELSE done END AS c FROM p WHERE i = len(s))"""


def packed(spark, sf_dir, overlap):
    return docs(spark, sf_dir).select(
        "doc_id", chunking.pack_sentences(T.sentences_terminal(F.col("text")), LIMIT, overlap).alias("c")
    ).select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.md5(F.array_join("c", "|")).alias("chunks_md5"))


@query(d_pack(0))
def chunk_pack(spark, sf_dir):
    return packed(spark, sf_dir, 0)


@query(d_pack(50))
def chunk_pack_overlap(spark, sf_dir):
    return packed(spark, sf_dir, 50)


@query(
    f"""SELECT doc_id, len(c) AS n_chunks, md5(array_to_string(c, '|')) AS chunks_md5 FROM (SELECT doc_id, CASE WHEN len(list_filter(c, lambda x: length(x) >= 300)) > 0 THEN list_filter(c, lambda x: length(x) >= 300) ELSE c END AS c FROM
    ({d_pack(50).replace("SELECT doc_id, len(c) AS n_chunks, md5(array_to_string(c, '|')) AS chunks_md5 FROM", "SELECT doc_id, c FROM")}))"""
)
def chunks_by_settings(spark, sf_dir):
    """Chunks whose limits come from the settings, here from variables of an environment."""
    from ..config import load
    from ..operators.configured import chunks

    settings = load((), {"LEXILOOM_MAX_TOKENS": str(LIMIT), "LEXILOOM_OVERLAP": "50", "LEXILOOM_MIN_CHUNK_SIZE": "300"})
    c = chunks(docs(spark, sf_dir), settings)
    return c.select("doc_id", F.size("chunks").cast("long").alias("n_chunks"), F.md5(F.array_join("chunks", "|")).alias("chunks_md5"))


@query()
def chunk_paragraphs(spark, sf_dir):
    """Packing of lines as paragraphs; those over the limit are split into sentences."""
    parts = F.filter(F.transform(T.lines(F.col("text")), lambda x: F.trim(x)), lambda x: x != "")
    return docs(spark, sf_dir).select("doc_id", chunking.pack_paragraphs(parts, LIMIT).alias("c")).select(
        "doc_id", F.size("c").cast("long").alias("n_chunks"), F.md5(F.array_join("c", "|")).alias("chunks_md5")
    )


PAIRS = """SELECT a.doc_id AS a_id, b.doc_id AS b_id, a.text AS a_text, b.text AS b_text FROM {documents} a JOIN {documents} b ON a.lang = b.lang
 AND abs(length(a.text) - length(b.text)) * 20 <= length(a.text) WHERE a.doc_id % 20 = 0 AND a.doc_id <> b.doc_id"""


def length_step(n: Column) -> Column:
    """Steps of 6 %: lengths within 5 % lie in the same one or in neighbouring ones."""
    return F.floor(F.log(F.greatest(n, F.lit(1))) / math.log(1.06))


#: Documents of a step are dealt into so many parts, so that one of a common length is no single task.
STEP_PARTS = 16


def pair_values(spark, sf_dir, value) -> DataFrame:
    """Document pairs of one language and about one length: the documents whose ids are divisible by
    20 against all others, with a value of each text (x and y), computed once for each document.
    Only documents of neighbouring steps of length meet."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("n"), value(F.col("text")).alias("v"))
    step = length_step(F.col("n"))
    near = F.explode(F.array(step - 1, step, step + 1)).alias("step")
    a = d.filter("doc_id % 20 = 0").select("lang", near, F.col("doc_id").alias("a_id"), F.col("n").alias("n_a"), F.col("v").alias("x"))
    a = a.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(STEP_PARTS - 1))))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(STEP_PARTS)).cast("int").alias("part")
    b = d.select("lang", step.alias("step"), part, F.col("doc_id").alias("b_id"), F.col("n").alias("n_b"), F.col("v").alias("y"))
    return a.join(b, ["lang", "step", "part"]).filter("a_id <> b_id AND abs(n_a - n_b) * 20 <= n_a").select("a_id", "b_id", "x", "y")


def pair_sets(spark, sf_dir, value, every: bool = False, spread: bool = False) -> DataFrame:
    """The same pairs with the sizes of two sets (`value` of a text) and of what they share, counted where
    blocks of documents meet."""
    return pairwise.sets_compared(pair_documents(spark, sf_dir, value, every, spread))


def pair_documents(spark, sf_dir, value, every: bool = False, spread: bool = False) -> DataFrame:
    """The documents of these pairs with a value of each text, as pairwise takes them; with `every`
    those of the pairs of all documents, whatever their ids. Values that take long to make are made in as
    many tasks as there are slots (`spread`), however few files there are."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    asked = F.lit(True) if every else F.col("doc_id") % 20 == 0
    d = d.repartition("doc_id") if spread else d
    d = d.select("doc_id", "lang", F.length("text").alias("n"), value(F.col("text")).alias("v"), asked.alias("asked"))
    return d.withColumn("step", length_step(F.col("n")))


def pairs(spark, sf_dir):
    """The same pairs with their texts."""
    return pair_values(spark, sf_dir, lambda text: text).withColumnsRenamed({"x": "a_text", "y": "b_text"})


def pair_key(a: Column, b: Column) -> Column:
    """Both ids, as one text."""
    return F.concat_ws("-", a.cast("string"), b.cast("string"))


D_PAIRS = PAIRS.replace("{documents}", "documents")
#: Of all documents, not only the asked ones.
D_ALL_PAIRS = D_PAIRS.replace("a.doc_id % 20 = 0 AND ", "")


@query(
    f"""SELECT a_id, b_id, CASE WHEN len(u) = 0 THEN 1.0 ELSE round(len(list_intersect(a, b))::DOUBLE / len(u), 6) END AS score FROM (SELECT *, list_distinct(list_concat(a, b)) AS u FROM
    (SELECT a_id, b_id, {d_word_set('a_text')} AS a, {d_word_set('b_text')} AS b FROM ({D_PAIRS})))"""
)
def jaccard_words(spark, sf_dir):
    p = pair_sets(spark, sf_dir, T.word_set)
    return p.select("a_id", "b_id", F.round(T.jaccard_of(F.col("size_a"), F.col("size_b"), F.col("shared")), 6).alias("score"))


@query(
    f"""SELECT a_id, b_id, CASE WHEN len(u) = 0 THEN 1.0 ELSE round(len(list_intersect(a, b))::DOUBLE / len(u), 6) END AS score FROM (SELECT *, list_distinct(list_concat(a, b)) AS u FROM
    (SELECT a_id, b_id, {d_char_set('a_text')} AS a, {d_char_set('b_text')} AS b FROM ({D_PAIRS})))"""
)
def jaccard_chars(spark, sf_dir):
    p = pair_sets(spark, sf_dir, T.char_set)
    return p.select("a_id", "b_id", F.round(T.jaccard_of(F.col("size_a"), F.col("size_b"), F.col("shared")), 6).alias("score"))


@query(
    f"""SELECT a_id, b_id, CASE WHEN least(len(a), len(b)) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)), 6) END AS score FROM
    (SELECT a_id, b_id, {d_word_set('a_text')} AS a, {d_word_set('b_text')} AS b FROM ({D_PAIRS}))"""
)
def overlap_coef(spark, sf_dir):
    p = pair_sets(spark, sf_dir, T.word_set)
    return p.select("a_id", "b_id", F.round(T.overlap_of(F.col("size_a"), F.col("size_b"), F.col("shared")), 6).alias("score"))


def _d_count(x: str, sign: str) -> str:
    return f"(length({x}) - length(replace({x}, '{sign}', '')))"


_D_F = (
    ["length(text)", f"len({d_words('text')})"]
    + [f"{_d_count('lower(text)', v)} / greatest(length(text), 1)" for v in "aeiou"]
    + [f"{_d_count('text', v)} / greatest(length(text), 1)" for v in ".,"]
    + [f"{_d_count('text', ' ')} / greatest(length(text), 1)"]
    + [rf"length(regexp_replace(text, '{k}', '', 'g')) / greatest(length(text), 1)" for k in ("[^぀-ゟ]", "[^゠-ヿ]", "[^一-龯]", r"\P{Nd}", r"\P{Lu}", r"\P{Ll}")]
)
#: The features of a document as a list.
D_FEATURES = "SELECT doc_id, [" + ", ".join(f"({x})::DOUBLE" for x in _D_F) + "] AS x FROM documents"
_F_NAMES = "f_len f_words f_a f_e f_i f_o f_u f_dot f_comma f_space f_hira f_kata f_kanji f_digit f_upper f_lower".split()


@query("SELECT doc_id, " + ", ".join(f"round(({x})::DOUBLE, 6) AS {n}" for x, n in zip(_D_F, _F_NAMES)) + " FROM documents")
def text_features16(spark, sf_dir):
    f = docs(spark, sf_dir).select("doc_id", T.features16(F.col("text")).alias("f"))
    return f.select("doc_id", *[F.round(F.col("f")[i], 6).alias(n) for i, n in enumerate(_F_NAMES)])


@query(
    """SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.2f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.2f KB', round(n / 1024, 2)) WHEN n < 1073741824 THEN printf('%.2f MB', round(n / 1048576, 2))
    ELSE printf('%.2f GB', round(n / 1073741824, 2)) END AS shown FROM (SELECT doc_id, n_chars * (1 + doc_id % 7 * 997) AS n FROM documents)"""
)
def format_bytes(spark, sf_dir):
    n = F.col("n_chars") * (1 + F.col("doc_id") % 7 * 997)
    return read(spark, sf_dir, "documents").select("doc_id", T.format_bytes(n).alias("shown"))


@query("""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped_md5 FROM documents""")
def html_escape(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.escape_html(F.col("text"))).alias("escaped_md5"))


@query("SELECT doc_id, 3 AS dim, round(length(text)::DOUBLE, 3) AS v0, round((length(text) % 7)::DOUBLE, 3) AS v1 FROM documents")
def embed_model(spark, sf_dir):
    """Vectors from a model (here a stand-in), each distinct text encoded once."""
    from ..operators.embedding import embed

    v = embed(docs(spark, sf_dir), make_model=lambda: lambda texts: [(len(t), len(t) % 7, 1) for t in texts])
    return v.select("doc_id", F.size("vector").alias("dim"), F.round(F.col("vector")[0].cast("double"), 3).alias("v0"), F.round(F.col("vector")[1].cast("double"), 3).alias("v1"))


@query("SELECT doc_id, 16 AS dim, length(text)::DOUBLE AS v0 FROM documents")
def embed_fallback(spark, sf_dir):
    """Plain features where there is no model."""
    from ..operators.embedding import embed

    return embed(docs(spark, sf_dir)).select("doc_id", F.size("vector").alias("dim"), F.col("vector")[0].cast("double").alias("v0"))
