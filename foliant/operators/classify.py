"""First-tier classification of page blocks by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.geometry import has_flag
from foliant.functions.text import heading_kind
from foliant.schemas import BOLD, SUPERSCRIPT

#: Zones as fractions of the page, sizes in points, keywords.
HEADER, FOOTER, ZONE_CHARS = 0.08, 0.92, 100
FILIGREE_WIDTH, FILIGREE_TOP, FILIGREE_SIZE = 0.70, 0.20, 12.0
FILIGREE_KEYWORDS = ("Versione riservata", "Biblioteca It. Ciechi", "© Giuffrè")
TINY = 2.0
SUPERSCRIPT_NUMBER = "^\\d{1,4}$"


def block_text(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """Blocks with the text of their spans, joined without a separator, and what the rules need of them.

    ``spans`` carry the ``flat_idx`` of their block: an equi-join, one shuffle on (doc_id, flat_idx).
    """
    own = spans.groupBy("doc_id", "flat_idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_ord", "text"))), lambda s: s["text"]), "").alias("text"),
        F.count("*").alias("n_spans"),
        F.max("size").alias("max_size"),
        F.max(has_flag(F.col("flags"), SUPERSCRIPT)).alias("superscript"),
        F.max(has_flag(F.col("flags"), BOLD)).alias("bold"),
    )
    return blocks.join(own, ["doc_id", "flat_idx"], "left").fillna({"text": "", "n_spans": 0})


def _verdict(text: Column) -> Column:
    width, height = F.col("width_pt"), F.col("height_pt")
    keywords = F.lit(False)
    for k in FILIGREE_KEYWORDS:
        keywords = keywords | F.lower(text).contains(k.lower())
    filigree = (F.col("x1") - F.col("x0") >= FILIGREE_WIDTH * width) & (F.col("y0") <= FILIGREE_TOP * height) & (F.col("max_size") >= FILIGREE_SIZE) & keywords
    short = F.length(text) < ZONE_CHARS
    rules = (
        ("UNCLASSIFIED", "no_match", F.col("n_spans") == 0),
        ("ARTIFACT_FILIGREE", "filigree", filigree),
        ("ARTIFACT_PAGE_HEADER", "header_zone", (F.col("y1") <= HEADER * height) & short),
        ("ARTIFACT_FOOTER", "footer_zone", (F.col("y0") >= FOOTER * height) & short),
        ("BOOK_PAGE_ANCHOR", "tiny_font_anchor", F.col("max_size") < TINY),
        ("CROSS_REFERENCE", "superscript_cross_reference", (F.col("n_spans") == 1) & F.col("superscript") & text.rlike(SUPERSCRIPT_NUMBER)),
    )
    out = None
    for category, reason, test in rules:
        value = F.struct(F.lit(category).alias("category"), F.lit(reason).alias("reason"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.struct(F.lit("UNCLASSIFIED").alias("category"), F.lit("no_match").alias("reason")))


def classify(blocks: DataFrame, spans: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, flat_idx, page, category, subcategory, reason, text``; a page without blocks is one EMPTY_PAGE row with index -1."""
    judged = block_text(blocks, spans).join(pages, ["doc_id", "page"]).withColumn("v", _verdict(F.col("text")))
    judged = judged.select("doc_id", "flat_idx", "page", "v.category", F.lit(None).cast("string").alias("subcategory"), "v.reason", "text")
    empty = pages.join(blocks.select("doc_id", "page"), ["doc_id", "page"], "left_anti")
    empty = empty.select("doc_id", F.lit(-1).alias("flat_idx"), "page", F.lit("EMPTY_PAGE").alias("category"), F.col("page").cast("string").alias("subcategory"), F.lit("empty_page").alias("reason"), F.lit(None).cast("string").alias("text"))
    return judged.unionByName(empty)


def page_images(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Images of each page: how many, whether one covers 90 % of it, and their boxes in order."""
    share = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("width_pt") * F.col("height_pt"))
    found = images.join(pages, ["doc_id", "page"]).groupBy("doc_id", "page")
    return found.agg(F.count("*").cast("int").alias("count"), F.max(share >= 0.90).alias("has_full_page_image"), F.sort_array(F.collect_list(F.struct("x0", "y0", "x1", "y1"))).alias("bboxes"))


def horizontal_rules(drawings: DataFrame) -> DataFrame:
    """Drawings at most 2 points high and at least 100 wide."""
    return drawings.where("y1 - y0 <= 2.0 and x1 - x0 >= 100.0").withColumn("kind", F.lit("horizontal_rule"))


def classify_lines(lines: DataFrame, body_size: str = "body_size") -> DataFrame:
    """Role of a line by its size against the body's: short coloured or large lines are headings, small ones notes."""
    ratio = F.col("font_size") / F.col(body_size)
    short = F.length("text") <= 120
    role = (
        F.when(short & F.coalesce(F.col("colored"), F.lit(False)), "HEADING_2")
        .when(short & (ratio >= 1.5), "HEADING_1")
        .when(short & (ratio >= 1.25), "HEADING_2")
        .when(short & (ratio >= 1.12), "HEADING_3")
        .when(short & F.col("bold") & (ratio >= 1.04), "HEADING_4")
        .when(ratio <= 0.85, "NOTE")
        .otherwise("BODY")
    )
    return lines.withColumn("role", role)


def heading_lines(lines: DataFrame) -> DataFrame:
    """Lines with the kind of heading their pattern says."""
    return lines.withColumn("heading", heading_kind(F.col("text")))


def marginal(blocks: DataFrame, body: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Blocks wholly outside the body column of their page, with two letters or more and not a roman numeral only."""
    near = blocks.join(body, ["doc_id", "page"])
    outside = (F.col("x1") <= F.col("body_x0") + tolerance) | (F.col("x0") >= F.col("body_x1") - tolerance)
    letters = F.regexp_count("text", F.lit("\\p{L}")) >= 2
    return near.where(outside & letters & ~F.upper("text").rlike("^[IVXLCDM.\\s]+$"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks with ``ord``: by page, top, left, and then as given."""
    w = Window.partitionBy("doc_id").orderBy("page", "y0", "x0", "flat_idx")
    return blocks.withColumn("ord", F.row_number().over(w) - 1)
