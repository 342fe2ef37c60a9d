"""Library catalogue: search, tags, collocation, bookmarks and highlights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search(documents: DataFrame, query: str) -> DataFrame:
    """Documents whose title or file name contains the query, case not mattering; a blank one finds all. By title."""
    q = query.strip().lower()
    found = documents if not q else documents.where(F.lower("title").contains(q) | F.lower("source_file_name").contains(q))
    return found.orderBy(F.lower("title"), "id")


def with_any_tag(rows: DataFrame, tags: list[str], column: str = "tag_ids") -> DataFrame:
    """Rows with at least one of the tags; no tags: all rows."""
    return rows if not tags else rows.where(F.arrays_overlap(column, F.array(*map(F.lit, tags))))


def known_tags(rows: DataFrame, tags: DataFrame, column: str = "tag_ids") -> DataFrame:
    """Rows with the tags that exist only, in their order; rows without any keep an empty list. Rows need an ``id``."""
    each = rows.select("id", F.posexplode(column).alias("__k", "__t")).join(tags.select(F.col("id").alias("__t")).distinct(), "__t", "left_semi")
    own = each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__t"))), lambda x: x["__t"]).alias("__own"))
    return rows.join(own, "id", "left").withColumn(column, F.coalesce("__own", F.array().cast("array<string>"))).drop("__own")


def recents(documents: DataFrame, n: int = 5) -> DataFrame:
    """The documents opened last, hidden ones left out."""
    return documents.where("last_opened_at is not null and not hidden").orderBy(F.desc("last_opened_at"), "id").limit(n)


def uncollocated(documents: DataFrame, *levels: DataFrame) -> DataFrame:
    """Documents that no workspace, folder or subfolder holds."""
    placed = levels[0].select("document_id")
    for level in levels[1:]:
        placed = placed.union(level.select("document_id"))
    return documents.join(placed.withColumnRenamed("document_id", "id"), "id", "left_anti")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], width: int = 64) -> DataFrame:
    """Pairs of ranges of the same keys that share a place; ends are inclusive and may be given either way round.

    Ranges are dealt to buckets of ``width`` places, so ranges meet only where they are near; a pair is taken in the first bucket both
    reach. ``a`` and ``b``: keys, ``id, start, end``.
    """

    def dealt(df: DataFrame, side: str) -> DataFrame:
        lo, hi = F.least("start", "end"), F.greatest("start", "end")
        own = df.select(*keys, F.col("id").alias(f"{side}_id"), lo.alias(f"{side}_lo"), hi.alias(f"{side}_hi"))
        return own.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(f"{side}_lo") / width), F.floor(F.col(f"{side}_hi") / width))))

    both = dealt(a, "a").join(dealt(b, "b"), [*keys, "bucket"]).where("a_lo <= b_hi and b_lo <= a_hi")
    first = F.floor(F.greatest("a_lo", "b_lo") / width)
    return both.where(F.col("bucket") == first).drop("bucket")


def bookmarks(documents: DataFrame, column: str = "bookmarks") -> DataFrame:
    """All bookmarks of the library, by title and then place."""
    return documents.select(F.col("id").alias("document_id"), "title", F.explode(column).alias("b")).select("document_id", "title", "b.*").orderBy(F.lower("title"), "order_index_hint", "created_at")


def underlined(underlines: DataFrame, segment: str) -> DataFrame:
    return underlines.where(F.array_contains("segment_ids", segment))


#: Orders of a library: by title, last opened first (never opened last), newest import first. Ties by id.
ORDERS = {"title": ("title_key",), "opened": ("-last_opened_at",), "imported": ("-imported_at",)}


def sort_documents(documents: DataFrame, by: str = "title") -> DataFrame:
    """Documents in one of the library's orders."""
    keys = [F.desc_nulls_last(k[1:]) if k.startswith("-") else F.asc(F.lower("title")) for k in ORDERS[by]]
    return documents.orderBy(*keys, "id")
