"""Page furniture: lines that repeat over pages, folios that count with them, and headers fixed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import furniture_key

#: Bands at the page's edges as fractions of its height, least pages, deviation of a fixed place.
BAND, LEAST, SHARE_IN_BAND, SHARE_ANYWHERE = 0.12, 5, 0.15, 0.5
FIXED_PAGES, FIXED_DEVIATION = 3, 0.006


def repeated_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, key, n_pages``: normal forms that stand in a band on many pages, or anywhere on half of them.

    ``lines``: ``doc_id, page, text, y`` with y as a fraction of the page's height; ``pages``: ``doc_id, n_pages``.
    """
    own = lines.withColumn("key", furniture_key(F.col("text"))).where("key <> ''").withColumn("band", (F.col("y") < BAND) | (F.col("y") > 1 - BAND))
    by = own.groupBy("doc_id", "key").agg(F.countDistinct("page").alias("n"), F.countDistinct(F.when(F.col("band"), F.col("page"))).alias("n_band")).join(pages, "doc_id")
    in_band = F.col("n_band") >= F.greatest(F.lit(LEAST), F.ceil(F.col("n_pages") * SHARE_IN_BAND))
    anywhere = F.col("n") >= F.greatest(F.lit(LEAST), F.ceil(F.col("n_pages") * SHARE_ANYWHERE))
    return by.where(in_band | anywhere).select("doc_id", "key", F.col("n").alias("n_pages"))


def folios(lines: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, offset, n_pages``: bare numbers whose difference from the page holds on many pages."""
    number = lines.where(F.trim("text").rlike("^\\d{1,4}$")).withColumn("offset", F.trim("text").cast("int") - F.col("page"))
    return number.groupBy("doc_id", "offset").agg(F.countDistinct("page").alias("n_pages")).where(F.col("n_pages") >= least)


def fixed_headers(lines: DataFrame) -> DataFrame:
    """Normal forms on three pages or more whose place hardly moves."""
    by = lines.groupBy("doc_id", furniture_key(F.col("text")).alias("key")).agg(F.countDistinct("page").alias("n_pages"), F.stddev_pop("y").alias("deviation"))
    return by.where((F.col("n_pages") >= FIXED_PAGES) & (F.col("deviation") < FIXED_DEVIATION))


def drop_furniture(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines without those that are furniture by any of the three tests."""
    keyed = lines.withColumn("key", furniture_key(F.col("text")))
    keys = repeated_lines(lines, pages).select("doc_id", "key").union(fixed_headers(lines).select("doc_id", "key")).distinct()
    numbers = folios(lines).select("doc_id", "offset")
    out = keyed.join(keys, ["doc_id", "key"], "left_anti").withColumn("offset", F.when(F.trim("text").rlike("^\\d{1,4}$"), F.trim("text").cast("int") - F.col("page")))
    return out.join(numbers, ["doc_id", "offset"], "left_anti").drop("key", "offset")


def index_pages(lines: DataFrame) -> DataFrame:
    """Pages by how many lines end with a page reference: ``strong`` and ``weak`` index pages."""
    entry = F.col("text").rlike("[\\s.,]\\d{1,4}\\s*$")
    by = lines.groupBy("doc_id", "page").agg(F.count("*").alias("n_lines"), F.count_if(entry).alias("n_entries"))
    return by.withColumn("strong", (F.col("n_lines") >= 6) & (F.col("n_entries") >= 0.35 * F.col("n_lines"))).withColumn("weak", (F.col("n_entries") >= 10) & (F.col("n_entries") >= 0.20 * F.col("n_lines")))


def body_column(lines: DataFrame, width: str = "width", tolerance: float = 0.6) -> DataFrame:
    """Upper medians of the edges of lines of the body's size wider than 40 % of the page, from three lines on."""
    own = lines.where((F.abs(F.col("font_size") - F.col("body_size")) <= tolerance) & (F.col("x1") - F.col("x0") > 0.4 * F.col(width)))
    upper = lambda c: F.element_at(F.sort_array(F.collect_list(c)), (F.floor(F.count("*") / 2) + 1).cast("int"))
    return own.groupBy("doc_id", "page").agg(upper("x0").alias("body_x0"), upper("x1").alias("body_x1"), F.count("*").alias("n")).where("n >= 3").drop("n")
