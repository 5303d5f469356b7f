"""Layout of a page: blocks and spans with their places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def body_blocks(blocks: DataFrame, height: float, width: float, edge: float = 0.12, margin: float = 0.15) -> DataFrame:
    """Blocks (x0, y0, x1, y1, t) of running text: those in the top and bottom edge only if long and
    no header or footer, those in the side margins only if very long; of the rest no headers,
    footers or short scraps."""
    outer = (F.col("y0") < edge * height) | (F.col("y1") > (1 - edge) * height)
    aside = (F.col("x1") < margin * width) | (F.col("x0") > (1 - margin) * width)
    running = T.is_header_footer(F.col("t"))
    placed = F.when(outer, (F.length("t") > 50) & ~running).when(aside, F.length("t") > 100).otherwise(True)
    return blocks.filter(placed & ~running & ((F.length("t") >= 10) | T.is_important_short(F.col("t"))))
