"""Counts, distributions, digests and comparisons of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: relative difference up to which two counts are close.
CLOSE = 0.15


def category_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id", "category").agg(F.count("*").alias("n"))


def structural_summary(nodes: DataFrame, warnings: DataFrame, transformations: DataFrame) -> DataFrame:
    """Nodes, warnings and edits of each document; documents without the latter count 0."""
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    out = count(nodes, "n_nodes").join(count(warnings, "n_warnings"), "doc_id", "left").join(count(transformations, "n_transformations"), "doc_id", "left")
    return out.fillna(0, ["n_warnings", "n_transformations"])


def binding_summary(refs: DataFrame) -> DataFrame:
    """References bound and unbound, distinct sources and a digest of (source, target, marker), order not mattering."""
    line = F.concat_ws("|", "src_node_id", F.coalesce("target_node_id", F.lit("")), F.coalesce("source_marker", F.lit("")))
    return refs.groupBy("doc_id").agg(
        F.count("*").alias("n_refs"), F.count("target_node_id").alias("n_bound"), F.count_if(F.col("target_node_id").isNull()).alias("n_unbound"), F.countDistinct("src_node_id").alias("n_sources"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"),
    )


def lower_quartile(values: str, k: int):
    """Aggregate: element number max(1, k * n / 4) of the sorted values."""
    return F.element_at(F.sort_array(F.collect_list(values)), F.greatest(F.floor(F.lit(k) * F.count(values) / 4), F.lit(1)).cast("int"))


def length_distribution(rows: DataFrame, groups: list[str], length: str = "n_chars") -> DataFrame:
    """Count, extremes, quartiles by lower index, median, mean (both rounded half to even) and share of each length class, for each group.

    Lengths are counted first, so a group of any size is at most as many rows as it has different lengths.
    """
    limits = (50, 100, 500, 1000, 3000)
    by = rows.groupBy(*groups, length).agg(F.count("*").alias("c"))
    n = F.sum("c")
    pairs = F.array_sort(F.collect_list(F.struct(F.col(length).alias("v"), F.col("c"))))
    out = by.groupBy(*groups).agg(
        n.alias("n"), F.min(length).alias("min"), F.max(length).alias("max"), F.sum(F.col(length) * F.col("c")).alias("total"), pairs.alias("pairs"),
        *[F.sum(F.when((F.col(length) >= a) & (F.col(length) < b) if b else F.col(length) >= a, F.col("c")).otherwise(0)).alias(f"c{k}") for k, (a, b) in enumerate(zip((0, *limits), (*limits, None), strict=True))],
    )

    def at(rank):
        """Value of the element with a rank from 1."""
        return F.aggregate("pairs", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("v")), lambda acc, p: F.struct((acc["seen"] + p["c"]).alias("seen"), F.when(acc["v"].isNotNull(), acc["v"]).when(acc["seen"] + p["c"] >= rank, p["v"]).alias("v")), lambda acc: acc["v"])

    n = F.col("n")
    quartile = lambda k: at(F.greatest(F.floor(F.lit(k) * n / 4), F.lit(1)))
    median = (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2
    names = ("micro", "short", "medium", "long", "very_long", "mega")
    return out.select(
        *groups, "n", "min", quartile(1).alias("q1"), F.bround(median).cast("long").alias("median"), quartile(3).alias("q3"), "max", F.bround(F.col("total") / n).cast("long").alias("mean"),
        *[F.round(100.0 * F.col(f"c{k}") / n, 2).alias(f"{name}_percent") for k, name in enumerate(names)],
    )


def compare_counts(generic: DataFrame, baseline: DataFrame, key: str = "category") -> DataFrame:
    """Full outer comparison of counts: relative difference to the baseline and its band. Both zero: no row."""
    both = generic.select(key, F.col("n").alias("g")).join(baseline.select(key, F.col("n").alias("b")), key, "full_outer").fillna(0, ["g", "b"]).where("g > 0 or b > 0")
    delta = F.round(F.abs(F.col("g") - F.col("b")) / F.col("b"), 4)
    band = F.when(F.col("b") == 0, "NOT_COMPARABLE").when(F.col("g") == F.col("b"), "EXACT").when(delta <= CLOSE, "CLOSE").otherwise("DIVERGENT")
    return both.select(key, F.col("g").alias("produced"), F.col("b").alias("expected"), F.when(F.col("b") > 0, delta).alias("relative_delta"), band.alias("band"))


def produced_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(F.max("relative_delta").alias("max_delta"), F.round(F.avg("relative_delta"), 4).alias("mean_delta"), F.every(F.coalesce(F.col("relative_delta") <= CLOSE, F.lit(False))).alias("all_within"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Keys added, removed and changed between two snapshots."""
    both = old.select(key, F.col(value).alias("old"), F.lit(1).alias("o")).join(new.select(key, F.col(value).alias("new"), F.lit(1).alias("n")), key, "full_outer")
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("change", kind).where("change is not null").select(key, "change", "old", "new")


def topology(nodes: DataFrame) -> DataFrame:
    """Nodes, depth, headings by level, notes by length class of each document."""
    return nodes.groupBy("doc_id").agg(
        F.count("*").alias("n_nodes"), (F.max("depth") + 1).alias("max_depth"), *[F.count_if(F.col("category") == f"HEADING_{k}").alias(f"n_heading_{k}") for k in range(1, 5)],
        *[F.count_if((F.col("category") == "NOTE") & (F.col("length_category") == c)).alias(f"n_{c.lower()}") for c in ("MICRO", "SHORT", "MEDIUM", "LONG", "VERY_LONG", "MEGA")],
    )


def extraction_report(lines: DataFrame) -> DataFrame:
    """Lines, characters, bold share and sizes of a document, without its content."""
    sizes = lines.groupBy("doc_id", "font_size").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.count_if("bold").alias("bold"))
    return sizes.groupBy("doc_id").agg(F.sum("n").alias("n_lines"), F.sum("chars").alias("n_chars"), F.round(F.sum("bold") / F.sum("n"), 4).alias("bold_ratio"), F.array_sort(F.collect_list(F.struct("font_size", "n"))).alias("sizes"))


def tag_histogram(pages: DataFrame, text: str = "html", pattern: str = "<([a-zA-Z][a-zA-Z0-9]*)") -> DataFrame:
    """Opening tags over all pages."""
    return pages.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("t")).groupBy(F.lower("t").alias("tag")).agg(F.count("*").alias("n"))


def class_histogram(pages: DataFrame, text: str = "html") -> DataFrame:
    """Tokens of class attributes over all pages."""
    classes = F.explode(F.regexp_extract_all(text, F.lit('class="([^"]*)"'), F.lit(1)))
    return pages.select(classes.alias("c")).select(F.explode(F.split("c", "\\s+")).alias("css_class")).where("css_class <> ''").groupBy("css_class").agg(F.count("*").alias("n"))
