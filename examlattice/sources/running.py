"""Running heads, feet and overlays of printed pages, taken out before questions are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lines import ANSWER_MARK, OPTION, START

BAND, STEP = 0.10, 8  #: the share of a page that is its head or foot; points within which two lines stand at one height
SHARE, LEAST = 0.4, 3  #: pages on which a line must stand, as a share of the paper's and as a number


def without_running_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """lines (paper_id, page, col, line_no, top, bottom, text) without those that run through a paper. pages: (paper_id, page, top, bottom) of
    each page's print area.

    A head or foot lies in a page's band and stands, page number aside, in the same column at the same height on a SHARE of the pages. An
    overlay names an address or a long number and stands, digits aside, anywhere on LEAST pages. What begins a question, or holds an
    option or an answer, always stays, and papers of fewer than LEAST pages stay as they are."""
    text, high = F.col("text"), F.col("page_bottom") - F.col("page_top")
    sizes = pages.groupBy("paper_id").agg(F.count_distinct("page").alias("pages"))
    boxes = pages.select("paper_id", "page", F.col("top").alias("page_top"), F.col("bottom").alias("page_bottom"))
    rows = lines.join(boxes, ["paper_id", "page"], "left").join(sizes, "paper_id", "left")
    band = (F.col("top") < F.col("page_top") + BAND * high) | (F.col("bottom") > F.col("page_bottom") - BAND * high)
    head = F.concat_ws("\u001f", F.col("col").cast("string"), F.bround(F.col("top") / STEP).cast("long").cast("string"), F.regexp_replace("text", r"(?U)\d+\s*[-–|]?\s*$", "#"))
    low = F.lower("text")
    address = low.contains("@") | low.contains(".com") | low.contains("www.") | text.rlike(r"(?U)\d{8,}")
    content = text.rlike(START) | text.rlike(OPTION) | text.rlike(f"(?i){ANSWER_MARK}")
    rows = rows.withColumns({"head": F.when(band, head), "overlay": F.when(address, F.regexp_replace(low, r"(?U)\d+", "#")), "stays": content | (F.coalesce("pages", F.lit(0)) < LEAST)})

    def often(key: str, least) -> DataFrame:
        own = rows.where(F.col(key).isNotNull() & (F.col("pages") >= LEAST)).groupBy("paper_id", key).agg(F.count_distinct("page").alias("on"), F.first("pages").alias("of"))
        return own.where(F.col("on") >= least).select("paper_id", key, F.lit(True).alias(f"{key}_runs"))

    rows = rows.join(often("head", F.greatest(F.lit(float(LEAST)), SHARE * F.col("of"))), ["paper_id", "head"], "left").join(often("overlay", F.lit(LEAST)), ["paper_id", "overlay"], "left")
    return rows.where(F.col("stays") | (F.col("head_runs").isNull() & F.col("overlay_runs").isNull())).select(*lines.columns)
