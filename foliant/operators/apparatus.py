"""References bound to notes: as-of, nearest, scoped and cascading joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.geometry import mid
from foliant.functions.text import marker


def with_markers(nodes: DataFrame) -> DataFrame:
    """Notes with their leading number, references with theirs."""
    n = F.when(F.col("category") == "NOTE", marker(F.col("text"))).when(F.col("category") == "CROSS_REFERENCE", marker(F.col("text"), "^\\s*\\(?(\\d+)\\)?\\s*$"))
    return nodes.withColumn("n", n)


def bind_preceding(rows: DataFrame, is_target: Column, keys: list[str], order: str, target: str) -> DataFrame:
    """As-of join backwards: each row that isn't a target with the last target before it of the same keys, in one window."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("bound", F.last(F.when(is_target, F.col(target)), ignorenulls=True).over(w)).where(~is_target)


SCOPES = ("HEADING_1", "HEADING_2")


def with_scopes(nodes: DataFrame, categories: tuple[str, ...] = SCOPES) -> DataFrame:
    """Nodes of a forest (``ord`` in pre-order, ``depth``) with ``scopes``: the ids of their ancestors of some categories, the nearest last.

    A node stands once for each depth above its own, where its ancestor is the last node of that depth: windows by document and depth.
    """
    at = nodes.select(F.struct(*nodes.columns).alias("__row"), "doc_id", "ord", "depth", "node_id", "category", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("__level"))
    upto = Window.partitionBy("doc_id", "__level").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    above = F.last(F.when(F.col("depth") == F.col("__level"), F.struct("node_id", "category")), ignorenulls=True).over(upto)
    at = at.withColumn("__a", above).withColumn("__scope", F.when((F.col("__level") < F.col("depth")) & F.col("__a.category").isin(*categories), F.struct("__level", "__a.node_id")))
    by = at.groupBy("doc_id", "ord").agg(F.first("__row").alias("__row"), F.transform(F.array_sort(F.collect_list("__scope")), lambda s: s["node_id"]).alias("scopes"))
    return by.select("__row.*", "scopes")


def bind_cross_references(nodes: DataFrame) -> DataFrame:
    """``doc_id, src_node_id, n, target_node_id, warning``: the nearest preceding note of the same number within scope.

    A reference's scope is the subtree of its nearest HEADING_1 or HEADING_2 ancestor, the document without one; a note lies in the scope of each such
    ancestor. So notes are repeated for each scope they lie in (at most two levels deep and the document), and references meet
    them in one window by (document, scope, number). Nodes need ``scopes``, as ``with_scopes`` gives them.
    """
    marked = with_markers(nodes).where("category in ('NOTE', 'CROSS_REFERENCE')")
    notes = marked.where("category = 'NOTE' and n is not null").withColumn("scope", F.explode(F.concat(F.array(F.lit("")), "scopes")))
    refs = marked.where("category = 'CROSS_REFERENCE'").withColumn("scope", F.coalesce(F.try_element_at("scopes", F.lit(-1)), F.lit("")))
    bound = bind_preceding(notes.unionByName(refs), F.col("category") == "NOTE", ["doc_id", "scope", "n"], "ord", "node_id")
    target = F.when(F.col("n").isNotNull(), F.col("bound"))
    warning = F.when(F.col("n").isNull(), F.concat(F.lit("unparseable_cross_reference_node_"), "node_id")).when(target.isNull(), F.concat(F.lit("unresolved_cross_reference_node_"), "node_id", F.lit("_n_"), "n"))
    return bound.select("doc_id", F.col("node_id").alias("src_node_id"), "n", target.alias("target_node_id"), warning.alias("warning"))


def nearest(sources: DataFrame, targets: DataFrame, keys: list[str], at: str, target_at: str, target_order: str) -> DataFrame:
    """Each source with the target of the same keys whose position differs least; of equal ones the first. No target: null.

    Both sides meet in one window in order of position: the candidates are the last target at or before and the first one after,
    so a page full of targets isn't multiplied with its sources.
    """
    s = sources.select(*sources.columns, F.lit(None).cast("double").alias("__t"), F.lit(None).cast("long").alias("__o"), F.col(at).cast("double").alias("__at"), F.lit(1).alias("__s"))
    by_place = targets.groupBy(*keys, F.col(target_at).cast("double").alias("__at")).agg(F.min(F.col(target_order).cast("long")).alias("__o"))
    t = by_place.select(*keys, *[F.lit(None).cast(sources.schema[c].dataType).alias(c) for c in sources.columns if c not in keys], F.col("__at").alias("__t"), "__o", "__at", F.lit(0).alias("__s"))
    both = s.unionByName(t)
    w = Window.partitionBy(*keys).orderBy("__at", "__s")
    place = F.when(F.col("__s") == 0, F.struct("__t", "__o"))
    found = both.withColumn("__b", F.last(place, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__a", F.first(place, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))).where("__s = 1")
    gap = lambda c: F.abs(F.col(f"{c}.__t") - F.col("__at"))
    best = F.when(F.col("__a").isNull(), F.col("__b.__o")).when(F.col("__b").isNull(), F.col("__a.__o")).when(gap("__b") < gap("__a"), F.col("__b.__o")).when(gap("__a") < gap("__b"), F.col("__a.__o")).otherwise(F.least("__a.__o", "__b.__o"))
    return found.withColumn("target", best).drop("__t", "__o", "__at", "__s", "__b", "__a")


def bind_marginals(nodes: DataFrame, kind: str = "MARGINAL_HEADING", to: str = "BODY") -> DataFrame:
    """Marginal headings with the body node of their page nearest in height; nodes need ``y0, y1``. Missing boxes stay unbound."""
    boxed = nodes.withColumn("mid", mid(F.col("y0"), F.col("y1")))
    sources = boxed.where(F.col("category") == kind).select("doc_id", "page_index", "node_id", "mid")
    targets = boxed.where((F.col("category") == to) & F.col("mid").isNotNull()).select("doc_id", "page_index", F.col("mid").alias("target_mid"), "ord")
    found = nearest(sources, targets, ["doc_id", "page_index"], "mid", "target_mid", "ord").withColumnRenamed("target", "ord")
    names = nodes.select("doc_id", "ord", F.col("node_id").alias("target_node_id"))
    target = F.when(F.col("mid").isNotNull(), F.col("target_node_id"))
    return found.join(names, ["doc_id", "ord"], "left").select("doc_id", F.col("node_id").alias("src_node_id"), target.alias("target_node_id"))


def bind_first_marker(refs: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """References with the first note of their keys, wherever it stands; null without one."""
    first = notes.groupBy(*keys).agg(F.min_by("node_id", "ord").alias("target_node_id"))
    return refs.join(first, keys, "left")


def chapter_of(nodes: DataFrame, opens: Column) -> DataFrame:
    """Nodes with ``chapter``: how many opening nodes stand at or before them."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return nodes.withColumn("chapter", F.sum(F.when(opens, 1).otherwise(0)).over(w))


def bind_cascade(markers: DataFrame, notes: DataFrame) -> DataFrame:
    """Inline markers with footnotes: on the same page if only one fits; else on the next page if it continues that page's numbers; else within the article.

    Each footnote is bound once, to the first marker in reading order; a marker that comes later stays unbound. ``markers``: ``doc_id,
    marker_id, page, article, n, ord``; ``notes``: ``doc_id, note_id, page, article, n``.
    """
    page = notes.groupBy("doc_id", "page", "n").agg(F.count("*").alias("c"), F.first("note_id").alias("id"))
    last = notes.groupBy("doc_id", "page").agg(F.max("n").alias("last_n"))
    article = notes.where("article is not null").groupBy("doc_id", "article", "n").agg(F.count("*").alias("ac"), F.first("note_id").alias("aid"))
    same = page.select("doc_id", "page", "n", F.col("c").alias("sc"), F.col("id").alias("sid"))
    after = page.select("doc_id", (F.col("page") - 1).alias("page"), "n", F.col("c").alias("nc"), F.col("id").alias("nid"))
    out = markers.join(same, ["doc_id", "page", "n"], "left").join(after, ["doc_id", "page", "n"], "left").join(last, ["doc_id", "page"], "left").join(article, ["doc_id", "article", "n"], "left")
    chosen = F.when(F.col("sc") == 1, F.col("sid")).when(F.col("sc").isNull() & (F.col("nc") == 1) & (F.col("n") == F.coalesce("last_n", F.lit(0)) + 1), F.col("nid")).when(F.col("ac") == 1, F.col("aid"))
    out = out.withColumn("note_id", chosen)
    w = Window.partitionBy("doc_id", "note_id").orderBy("ord")
    first = F.when(F.col("note_id").isNotNull(), F.row_number().over(w))
    return out.withColumn("note_id", F.when(first == 1, F.col("note_id"))).select(*markers.columns, "note_id")


def join_positions(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str) -> DataFrame:
    """The nth row of the left side with the nth of the right for each key; what has no partner on the right stays alone."""
    number = lambda df, order: df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return number(left, left_order).join(number(right, right_order), [*keys, "__n"], "left").drop("__n")
