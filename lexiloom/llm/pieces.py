"""SentencePiece encoding and decoding over a table of distinct chunks.

The model's pieces are checked once: if none has the whitespace marker after another character
(pieces of markers alone aside), no merge crosses from a character to a marker, so a text can be
cut in front of every run of markers and the parts encoded on their own. Each distinct part is
segmented once by the library and kept in a table of the worker; the ids of a text are joined back
from the table by position. The table is bounded: beyond `table_limit` parts those not used of
late are segmented again. A model whose pieces do cross markers is used on whole texts.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"


class Chunks(dict):
    """Ids, as unsigned 32-bit integers, of chunks that stand after one marker; filled on first use.
    Beyond `limit` the older generation goes."""

    def __init__(self, library, limit: int) -> None:
        super().__init__()
        self.library, self.limit, self.former = library, limit // 2, {}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.limit:
            self.former = dict(self)
            self.clear()
        ids = self.former.get(chunk)
        if ids is None:  # the library puts the marker in front, except of an empty text
            ids = array("I", self.library.encode(chunk) if chunk else [self.library.piece_to_id(MARK)]).tobytes()
        self[chunk] = ids
        return ids


class Segmenter:
    """Encodes and decodes with one model; holds the table of distinct chunks."""

    def __init__(self, model_path: str, table_limit: int = 1_000_000) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.table = Chunks(self.library, table_limit)
        special = ("is_byte", "is_control", "is_unknown")
        pieces = (
            self.library.id_to_piece(i)
            for i in range(self.library.get_piece_size())
            if not any(getattr(self.library, f)(i) for f in special)
        )
        crossing = any(MARK in p.lstrip(MARK) for p in pieces)
        # A text must get a marker in front and change in nothing else.
        plain = [self.library.encode(x, out_type=str) for x in ("a", " a", "a  b")]
        dummy = [MARK + "a", MARK * 2 + "a", MARK + "a" + MARK * 2 + "b"]
        self.split = not crossing and ["".join(p) for p in plain] == dummy
        #: Markers belong to what follows; the first of them is the one that the table supplies.
        self.cut = re.compile(f"[ {MARK}]([ {MARK}]*[^ {MARK}]*)")

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned 32-bit integers, without begin and end ids."""
        if not self.split:
            return [array("I", x).tobytes() for x in self.library.encode(texts, num_threads=1)]
        look = self.table.__getitem__
        return [b"".join(map(look, self.chunks(x))) for x in texts]

    def chunks(self, text: str) -> list[str]:
        """The text cut in front of every run of markers, less the first marker of each run."""
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " ":
            return self.cut.findall(" " + text)
        return text.split(" ")


_SEGMENTERS: dict[tuple[str, int], Segmenter] = {}


def segmenter(model_path: str, table_limit: int) -> Segmenter:
    key = (model_path, table_limit)
    if key not in _SEGMENTERS:
        _SEGMENTERS[key] = Segmenter(model_path, table_limit)
    return _SEGMENTERS[key]


def encode(
    df: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    table_limit: int = 1_000_000,
    columns: tuple[str, ...] = ("ids", "decoded"),
    place_col: str | None = None,
) -> DataFrame:
    """One row per row of `df`: id, the long in `place_col` if it is given, n_tokens (begin and end ids counted) and the named columns: ids
    (array of int), decoded (the text that the library decodes the ids to), ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers), decoded_sha256 (of the decoded text in UTF-8).

    A null text counts as empty: its ids are those of begin and end. Repeated rows give repeated
    rows, null ids stay null, an empty table gives no rows. Other columns are ignored. Each text is
    encoded whole, whatever its length; a worker holds one small batch of texts at a time."""
    kinds = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = segmenter(model_path, table_limit)
        lib = tool.library
        begin, end = array("I", [lib.bos_id()]).tobytes(), array("I", [lib.eos_id()]).tobytes()
        for pdf in batches:
            texts = pdf["text"].tolist()
            for part in portions(texts):
                some = [x if isinstance(x, str) else "" for x in texts[part]]
                ids = [begin + x + end for x in tool.ids(some)]
                numbers = [np.frombuffer(x, dtype=np.uint32) for x in ids]
                out = pd.DataFrame({"id": pdf["id"].iloc[part].array, "n_tokens": [len(x) for x in numbers]})
                if place_col is not None:
                    out["place"] = pdf["place"].iloc[part].array
                if "ids" in columns:
                    out["ids"] = [x.astype(np.int32) for x in numbers]
                if "ids_sha256" in columns:
                    out["ids_sha256"] = [hashlib.sha256(x.astype("<u4", copy=False)).hexdigest() for x in numbers]
                if "decoded" in columns or "decoded_sha256" in columns:
                    decoded = lib.decode([x.tolist() for x in numbers], num_threads=1)
                    out["decoded"] = decoded
                    out["decoded_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in decoded]
                yield out[["id", *places, "n_tokens", *columns]]

    places = [] if place_col is None else ["place"]
    kind = ", ".join(["id long", *(f"{p} long" for p in places), "n_tokens long", *(f"{c} {kinds[c]}" for c in columns)])
    place = [] if place_col is None else [F.col(place_col).cast("long").alias("place")]
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *place)
    out = rows.mapInPandas(nullable_ids(run), kind).withColumnRenamed("id", id_col)
    return out if place_col is None else out.withColumnRenamed("place", place_col)


def portions(texts: list, chars: int = 2_000_000) -> Iterator[slice]:
    """Slices of a batch of about so many characters, so that a batch of long texts stays small."""
    start = held = 0
    for i, x in enumerate(texts):
        held += len(x) if isinstance(x, str) else 0
        if held >= chars:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def nullable_ids(run):
    """Ids as pandas' nullable integers on the way in, so that a null id turns none into a float."""

    def wrapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def typed() -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(id=pdf["id"].astype("Int64"))

        for out in run(typed()):
            yield out.assign(id=out["id"].astype("Int64"))

    return wrapped

