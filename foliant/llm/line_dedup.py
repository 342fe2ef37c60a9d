"""Removal of lines that repeat in overlapping windows of three lines, by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import materialize, pinned

WINDOW = 3
#: A window with more than this part of all repeats is hot; there are fewer than one over it. Its occurrences meet in ``SALTS`` parts.
HOT, SALTS = 1 / 1000, 64


def _windows(width: int) -> Column:
    """``pos, h1, h2`` of each window of ``width`` lines of ``__t`` that aren't all blank."""
    starts = F.when(F.size("__t") >= width, F.sequence(F.lit(0), F.size("__t") - width)).otherwise(F.array().cast("array<int>"))

    def window(i: Column) -> Column:
        part = [F.get("__t", i + k) for k in range(width)]
        return F.struct(i.alias("pos"), F.xxhash64(*part).alias("h1"), F.xxhash64(F.lit(1), *part).alias("h2"), F.concat(*part).alias("t"))

    return F.transform(F.filter(F.transform(starts, window), lambda w: F.length(F.trim(w["t"])) > 0), lambda w: F.struct(w["pos"], w["h1"], w["h2"]))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """``doc_id, text_hash, positions``: starts of windows of which an earlier one exists, by document id, hash of the text, and position."""
    # trailing blanks don't count
    text = F.col(text_col).cast("string")
    lines = docs.where(F.col(id_col).isNotNull() & text.isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), pinned(F.transform(F.split(text, "\n", -1), lambda x: F.rtrim(x))).alias("__t"))
    found = lines.select("doc_id", "text_hash", pinned(_windows(width)).alias("w")).select("doc_id", "text_hash", F.explode("w").alias("w")).select("doc_id", "text_hash", "w.pos", "w.h1", "w.h2")
    place = F.struct("doc_id", "text_hash", "pos")
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    first = materialize(first.where("first <> last").select("h1", "h2", "first", "n"), "first")
    hot = _hot(first)
    first = first.withColumn("salt", F.explode(F.when(F.col("h1").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))) if hot else F.lit(0))
    found = found.withColumn("salt", F.when(F.col("h1").isin(hot), F.pmod(F.xxhash64("doc_id", "text_hash", "pos"), F.lit(SALTS)).cast("int")).otherwise(0) if hot else F.lit(0))
    later = found.join(first.drop("n").hint("merge"), ["h1", "h2", "salt"]).where(place != F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("positions"))


def _hot(first: DataFrame) -> list[int]:
    """Hashes of windows with more than ``HOT`` of all repeats: fewer than 1 / HOT."""
    total = first.agg(F.sum("n")).first()[0] or 0
    return [r["h1"] for r in first.where(F.col("n") > HOT * total).select("h1").distinct().collect()]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """``docs`` with ``text`` shortened by repeated lines, and ``n_lines``, ``n_removed`` and ``removed_spans``.

    A window is ``width`` consecutive ``\\n``-split lines, compared without trailing spaces; windows of
    blank lines only don't count. Of equal windows the one with the smallest (id, position) stays; lines covered by any
    other are removed, covered positions being merged into spans ``[start, end)``. Windows are judged on the input.

    Texts of fewer than ``width`` lines, null texts and rows with a null id pass unchanged. Rows that repeat an id with another text are
    documents of their own, in the order of the text's xxhash64; rows equal in both are one document, and what is removed is removed from each. Every input column is kept; the three added ones replace columns of the
    same name. An empty table stays empty.
    """
    hits = materialize(repeated_windows(docs, id_col, text_col, width), "windows").toDF("__id", "__hash", "__at")
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed_spans")]
    # the same join at every size: small tables would be broadcast, larger ones not
    joined = docs.select(*own).join(hits.hint("merge"), (F.col(id_col) == F.col("__id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__hash")), "left").drop("__id", "__hash")
    joined = joined.withColumn("__at", pinned(F.coalesce("__at", F.array().cast("array<int>")))).withColumn("__lines", pinned(F.split(F.col(text_col), "\n", -1)))
    at = F.col("__at")
    first = F.filter(at, lambda p, i: (i == 0) | (p - F.get(at, i - 1) > width))
    last = F.filter(at, lambda p, i: (i == F.size(at) - 1) | (F.get(at, i + 1) - p > width))
    spans = F.zip_with(first, last, lambda p, q: F.struct(p.alias("start"), (q + width).alias("end")))
    # merged spans and lines are in order: keep what lies between the end of one span and the start of the next
    lines = F.col("__lines")
    ends = F.concat(F.array(F.lit(0)), F.col("removed_spans.end"))
    starts = F.concat(F.col("removed_spans.start"), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(ends, starts, lambda a, b: F.slice(lines, a + 1, F.greatest(b - a, F.lit(0)))))
    out = joined.withColumn("removed_spans", pinned(spans))
    removed = F.aggregate("removed_spans", F.lit(0), lambda acc, s: acc + s["end"] - s["start"])
    out = out.withColumn("n_lines", F.coalesce(F.size("__lines"), F.lit(0))).withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.col("n_lines")).cast("long"))
    out = out.withColumn("n_removed", removed.cast("long"))
    out = out.withColumn(text_col, F.when(F.size("removed_spans") > 0, F.array_join(kept, "\n")).otherwise(F.col(text_col)))
    return out.select(*own, "n_lines", "n_removed", "removed_spans")
