"""From classified blocks in reading order to a node forest, kept flat: parent, depth and pre-order of each node."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.text import heading_kind, note_length

#: A continuation starts in this top share of its page; limits of heading fusion.
TOP_SHARE = 0.12
FUSE_X, FUSE_GAP, FUSE_CHARS, TERMINAL = 2.0, 8.0, 500, ".!?:"
MERGEABLE = ("BODY", "ARTICLE_BODY")
BARRIERS = ("HEADING_1", "HEADING_2", "HEADING_3", "HEADING_4", "ARTICLE_HEADER")
CHILD_OF_HEADING = ("BODY",)


def islands(df: DataFrame, keys: list[str], order: list[str], joins_previous: Column, name: str = "island") -> DataFrame:
    """Number of the run each row belongs to: a new one starts wherever ``joins_previous`` is false or unknown."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(joins_previous, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def join_text(df: DataFrame, keys: list[str], order: str, text: str = "text", separator: str = " ") -> Column:
    """Aggregate: texts of a group in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), separator)


def merge_continuations(items: DataFrame) -> DataFrame:
    """Body items that start near the top of their page, and are no heading, join the last body item before them.

    ``items``: ``doc_id, ord, category, text, y0, height_pt, flat_idx, page``. A heading or article between them prevents it; other
    items don't. The first item of a run keeps its place. Rows without a page height never join.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    body, barrier = F.col("category").isin(*MERGEABLE), F.col("category").isin(*BARRIERS)
    last_body = F.last(F.when(body, F.col("ord")), ignorenulls=True).over(before)
    last_barrier = F.last(F.when(barrier, F.col("ord")), ignorenulls=True).over(before)
    continues = body & (F.col("y0") < TOP_SHARE * F.col("height_pt")) & heading_kind(F.col("text")).isNull()
    joins = continues & last_body.isNotNull() & (F.coalesce(last_barrier, F.lit(-1)) < last_body)
    marked = items.withColumn("__joins", F.coalesce(joins, F.lit(False)))
    head = F.last(F.when(body & ~F.col("__joins"), F.col("ord")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("__head", F.when(F.col("__joins"), head).otherwise(F.col("ord")))
    first = F.min_by(F.struct(*[c for c in items.columns if c not in ("doc_id", "ord", "text")]), F.col("ord"))
    merged = marked.groupBy("doc_id", F.col("__head").alias("ord")).agg(join_text(marked, [], "ord").alias("text"), first.alias("__f"), F.array_sort(F.collect_list("flat_idx")).alias("block_indices"))
    return merged.select("doc_id", "ord", "text", "block_indices", "__f.*")


def fuse_headings(items: DataFrame) -> DataFrame:
    """Neighbouring headings of one category, page and typeface, set closely below one another, become one.

    The length limit holds for the text joined so far and the typeface is compared with the last part's, so the fold is by
    document, in pandas. ``items`` adds ``x0, y0, y1, signature`` (null when a block mixes typefaces) to reading-order columns.
    """
    out = "doc_id string, ord int, category string, page int, text string, block_indices array<int>, y0 double, height_pt double"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[dict] = []
        last = None
        for r in pdf.sort_values("ord").to_dict("records"):
            gap = r["y0"] - last["y1"] if last else None
            if (
                last and r["category"].startswith("HEADING") and r["category"] == last["category"] and r["page"] == last["page"] and abs(r["x0"] - last["x0"]) <= FUSE_X and 0 <= gap <= FUSE_GAP
                and rows[-1]["text"].rstrip()[-1:] not in TERMINAL and len(rows[-1]["text"]) + 1 + len(r["text"]) <= FUSE_CHARS and r["signature"] and r["signature"] == last["signature"]
            ):
                rows[-1]["text"] += " " + r["text"]
                rows[-1]["block_indices"] = [*rows[-1]["block_indices"], *r["block_indices"]]
            else:
                rows.append({k: r[k] for k in ("doc_id", "ord", "category", "page", "text", "y0", "height_pt")} | {"block_indices": list(r["block_indices"])})
            last = r
        return pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")])

    return items.groupBy("doc_id").applyInPandas(fold, out)


def assemble(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and warnings of a document's items: a stack of headings gives each node its parent.

    A heading of level L hangs below the entry L - 1 of the stack and cuts the stack there; one that skips levels is a root with a warning.
    Bodies hang below the heading, article bodies below the article, the rest below the article, else the heading. As
    items may attach to an earlier parent, pre-order (``ord``) is that of the paths from the roots.

    The stack is windows over the document. The k-th heading of a document stands at place min(its level, the place before + 1), which is k plus the running minimum of level - k;
    the entry at a place is the last heading there; and a heading is no orphan exactly if its place is its level. Levels have one digit, so there are nine places.
    """
    w = Window.partitionBy("doc_id").orderBy("__k")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    level = F.when(F.col("category").rlike("^HEADING_[0-9]$"), F.substring("category", -1, 1).cast("int"))
    rows = items.withColumn("__k", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1).withColumn("level", level)
    rows = rows.withColumn("__h", F.count("level").over(upto))
    place = F.greatest(F.least(F.col("__h") + F.min(F.col("level") - F.col("__h")).over(upto), F.col("__h")), F.lit(1))
    rows = rows.withColumn("__place", F.when(F.col("level").isNotNull(), place)).withColumn("__orphan", F.col("level").isNotNull() & (F.col("level") > F.col("__place")))
    own = F.array("__k")
    rows = rows.withColumn("__path", F.when(F.col("level").isNotNull(), own))
    for k in range(2, 10):
        above = F.last(F.when(F.col("__place") == k - 1, F.col("__path")), ignorenulls=True).over(before)
        rows = rows.withColumn("__path", F.when((F.col("__place") == k) & ~F.col("__orphan"), F.concat(above, own)).otherwise(F.col("__path")))
    rows = rows.withColumn("__heading", F.last("__path", ignorenulls=True).over(before))
    article = F.last(F.when(F.col("category") == "ARTICLE_HEADER", F.col("__k")).when(F.col("level").isNotNull(), F.lit(-1)), ignorenulls=True).over(before)
    rows = rows.withColumn("__article", F.when(article >= 0, F.concat(F.coalesce("__heading", F.array().cast("array<int>")), F.array(article))))
    heading, below = F.coalesce("__heading", F.array().cast("array<int>")), ["ARTICLE_HEADER", *CHILD_OF_HEADING]
    parent = F.when(F.col("category").isin(*below), heading).otherwise(F.coalesce("__article", heading))
    rows = rows.withColumn("__path", F.coalesce("__path", F.concat(parent, own)))
    lost = (F.col("category") == "ARTICLE_BODY") & F.col("__article").isNull()
    warning = F.when(F.col("__orphan"), F.concat(F.lit("reconstruct:orphan_heading_level_"), "level", F.lit("_page_"), "page")).when(lost, F.concat(F.lit("reconstruct:orphan_article_body_page_"), "page"))
    above = F.try_element_at("__path", F.lit(-2))
    node = lambda k: F.format_string("node_%04d", k)
    built = rows.select(
        "doc_id", node("__k").alias("node_id"), F.when(above.isNotNull(), node(above)).alias("parent_id"),
        (F.row_number().over(Window.partitionBy("doc_id").orderBy("__path")) - 1).alias("ord"), (F.size("__path") - 1).alias("depth"),
        (F.row_number().over(Window.partitionBy("doc_id", above).orderBy("__k")) - 1).alias("sibling_idx"), "category", F.col("page").cast("int").alias("page_index"), "text", "level", "block_indices",
        F.when(F.col("category") == "NOTE", note_length(F.col("text"))).alias("length_category"), warning.alias("warning"),
    )
    warnings = built.where("warning is not null").select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1).alias("seq"), F.col("warning").alias("text"))
    return built.drop("warning"), warnings


def subtree_end(nodes: DataFrame) -> DataFrame:
    """Nodes with the pre-order number of the last node of their subtree: the one before the next node that isn't deeper.

    A node closes the open nodes of its own depth and of every deeper one that the node before it left open, so over a document there are as many closings as nodes, and at each depth
    nodes and closings take turns: a node's subtree ends before the row that follows it among its depth's. Windows by document and depth, at any depth.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    before, last = F.lag("depth").over(w), F.max("ord").over(Window.partitionBy("doc_id"))
    closed = F.when(before >= F.col("depth"), F.sequence("depth", before)).otherwise(F.array().cast("array<int>"))
    row = F.struct(*nodes.columns)
    event = lambda depth, is_node: F.struct(depth.cast("int").alias("depth"), F.lit(is_node).alias("is_node"))
    events = nodes.select(row.alias("__row"), "doc_id", "ord", last.alias("__last"), F.concat(F.transform(closed, lambda d: event(d, False)), F.array(event(F.col("depth"), True))).alias("__e"))
    events = events.select("doc_id", "ord", "__last", "__row", F.explode("__e").alias("__e")).select("doc_id", "ord", "__last", F.when(F.col("__e.is_node"), F.col("__row")).alias("__row"), "__e.depth", "__e.is_node")
    # at one place the closing comes before the node
    following = F.lead("ord").over(Window.partitionBy("doc_id", "depth").orderBy("ord", "is_node"))
    out = events.withColumn("subtree_end", F.coalesce(following - 1, F.col("__last"))).where("is_node")
    return out.select("__row.*", "subtree_end")


def outline_ranges(nodes: DataFrame) -> DataFrame:
    """First and last page of each heading's subtree: ``doc_id, node_id, depth, category, title, lo, first_page, last_page``.

    Each node stands once at its own depth and at each smaller one, where the last node of that depth is its ancestor: rows grow with depth, not with headings times nodes.
    """
    at = nodes.select("doc_id", "node_id", "depth", "category", "text", "ord", "page_index", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("__level"))
    own = F.struct("node_id", "depth", "category", F.col("text").alias("title"), F.col("ord").alias("lo"))
    upto = Window.partitionBy("doc_id", "__level").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    above = at.select("doc_id", "page_index", F.last(F.when(F.col("depth") == F.col("__level"), own), ignorenulls=True).over(upto).alias("__a")).where(F.col("__a.category").startswith("HEADING_"))
    return above.groupBy("doc_id", "__a").agg(F.min("page_index").alias("first_page"), F.max("page_index").alias("last_page")).select("doc_id", "__a.*", "first_page", "last_page")


def pair_chapters(items: DataFrame, number: str = "(?i)^capitolo\\s+[ivxlcdm\\d]+\\.?$") -> DataFrame:
    """A chapter's number line and the title line after it become one heading, ``number. title``."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    is_number = F.col("text").rlike(number)
    takes = is_number & (F.lead("category").over(w) == F.col("category")) & ~F.lead(is_number).over(w)
    marked = items.withColumn("__title", F.when(takes, F.lead("text").over(w))).withColumn("__taken", F.coalesce(F.lag(takes).over(w), F.lit(False)))
    text = F.when(F.col("__title").isNotNull(), F.concat_ws(". ", F.regexp_replace("text", "\\.$", ""), "__title")).otherwise(F.col("text"))
    return marked.where("not __taken").withColumn("text", text).drop("__title", "__taken")


def carry_region(items: DataFrame, opens: Column, closes: Column, relabel: dict[str, str]) -> DataFrame:
    """Categories changed between an opening and a closing item: the state is carried forward in reading order."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(w)
    category = F.col("category")
    for old, new in relabel.items():
        category = F.when(F.coalesce(state, F.lit(False)) & (F.col("category") == old) & ~opens, new).otherwise(category)
    return items.withColumn("category", category)


def split_runs(spans: DataFrame, trigger: Column) -> DataFrame:
    """Spans of a node cut before each triggering span: ``doc_id, node_id, segment, text``, segment 0 what precedes the first."""
    w = Window.partitionBy("doc_id", "node_id").orderBy("span_ord").rowsBetween(Window.unboundedPreceding, 0)
    marked = spans.withColumn("segment", F.sum(F.when(trigger, 1).otherwise(0)).over(w))
    return marked.groupBy("doc_id", "node_id", "segment").agg(join_text(marked, [], "span_ord", separator="").alias("text")).where("trim(text) <> ''")


def split_notes(nodes: DataFrame) -> DataFrame:
    """Notes that hold several ``(N)`` markers, one row for each: ``part`` 0 keeps the id, the others are minted from it."""
    parts = F.filter(F.split("text", "(?=\\(\\d+\\))", -1), lambda x: F.trim(x) != "")
    return nodes.select(*[c for c in nodes.columns if c != "text"], F.posexplode(F.when(F.col("category") == "NOTE", parts).otherwise(F.array("text"))).alias("part", "text"))


def mint_references(nodes: DataFrame, pattern: str = "(?<![(\\d])\\((\\d+)\\)", cap: int = 500) -> tuple[DataFrame, DataFrame]:
    """A reference row for each inline marker up to ``cap``, and a warning row for each above it."""
    found = nodes.select("doc_id", F.col("node_id").alias("src_node_id"), "ord", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("seq", "marker"))
    found = found.withColumn("n", F.col("marker").cast("int"))
    return found.where(F.col("n") <= cap), found.where(F.col("n") > cap).select("doc_id", F.concat_ws("_", F.lit("refs:marker_above_cap"), "src_node_id", "marker").alias("text"))


def keep_first(items: DataFrame, keys: list[str], order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """The first row of each key, and the repeated ones."""
    numbered = items.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return numbered.where("__n = 1").drop("__n"), numbered.where("__n > 1").drop("__n")
