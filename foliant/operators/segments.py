"""From nodes to reading segments: sentences, packing to a target length, pages, notes placed, refreshers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.text import note_length_units, words
from foliant.operators.reconstruct import islands, join_text, subtree_end

#: Roles that aren't read, segments of a page, target lengths, bounds of a refresher, words of a title.
NOT_READ = ("MARGINAL_GLOSS", "TOC_GENERAL", "ARTIFACT_STAMP", "INDEX_ENTRY", "ARTIFACT_RUNNING_HEADER")
PER_PAGE = 20
TARGETS = {"fine": 400, "medium": 600, "coarse": 900, "very_coarse": 1200}
REFRESH_LEAST, REFRESH_MOST = 60, 180
TITLE_WORDS = 18
#: What a refresher doesn't begin with, and prefixes that keep their hyphen.
DIRTY_HEADS = ("^\\(?\\d{1,3}\\)", "^[)\\]»”’]", "^[;:,]")
COMPOUNDS = ("ex", "post", "pre", "anti", "neo", "sub", "vice", "semi", "auto", "co", "contro", "sopra", "sotto", "extra", "intra", "inter", "pro", "re", "iper", "ipo")
#: Abbreviations of legal Italian after which a full stop ends no sentence.
ABBREVIATIONS = tuple("art artt co cod cpv cfr cit ecc es lett n nn nt op p pag pagg par sent sez sg sgg ss tab v vd vol cass civ pen trib app cost proc reg dir d.lgs l dott prof avv sig".split())
#: Spoken introductions of roles.
INTRODUCTIONS = {"AMENDMENT": "Modifica", "QUOTED_TEXT_OLD": "Testo precedente", "QUOTED_TEXT_NEW": "Testo nuovo", "UPDATE_BLOCK": "Aggiornamento", "EDITORIAL_NOTE": "Nota redazionale", "NOTE": "Nota"}

_END = re.compile("[.!?][\"'»”’)\\]]*(?=\\s+[\"'«“‘(\\[]*[A-ZÀ-Þ0-9])")


def sentence_ends(text: str) -> list[int]:
    """Offsets past each sentence but the last: a stop with its closers, white space, and a start; not after abbreviations or initials."""
    out = []
    for m in _END.finditer(text):
        if text[m.start()] == ".":
            start = m.start()
            while start and (text[start - 1].isalnum() or text[start - 1] in "._"):
                start -= 1
            word = text[start : m.start()]
            if word.lower() in ABBREVIATIONS or (len(word) == 1 and word.isalpha() and word.isupper()):
                continue
        out.append(m.end())
    return out


def split_sentences(text: str | None) -> list[str]:
    if not text or not text.strip():
        return []
    edges = [0, *sentence_ends(text), len(text)]
    return [s for a, b in zip(edges, edges[1:], strict=False) if (s := text[a:b].strip())]


def sentences(text: Column) -> Column:
    """Sentences of each text, without the white space between them."""

    @F.pandas_udf("array<string>")
    def run(t: pd.Series) -> pd.Series:
        return t.map(split_sentences)

    return run(text)


def pack_sentences(parts: list[str], target: int) -> list[str]:
    """Sentences joined as long as they stay within the target; a longer one stands alone."""
    out: list[str] = []
    for s in parts:
        if out and len(out[-1]) + 1 + len(s) <= target:
            out[-1] += " " + s
        else:
            out.append(s)
    return out


def granularize(segments: DataFrame, target: int = TARGETS["fine"], role: str = "BODY") -> DataFrame:
    """Body segments cut into runs of whole sentences near the target length; others unchanged. Adds ``part``."""

    @F.pandas_udf("array<string>")
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda t: pack_sentences(split_sentences(t), target))

    parts = F.when((F.col("role") == role) & (F.length("text") > target), cut(F.col("text"))).otherwise(F.array("text"))
    return segments.select(*[c for c in segments.columns if c != "text"], F.posexplode(parts).alias("part", "text"))


def build_segments(nodes: DataFrame) -> DataFrame:
    """Nodes as reading segments in pre-order: whole subtrees of roles that aren't read, and nodes without text, are left out.

    The subtrees are dropped by an anti join on ranges of pre-order within the document, and adjacent ranges merge into one state by a window.
    """
    marked = subtree_end(nodes)
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    until = F.max(F.when(F.col("category").isin(*NOT_READ), F.col("subtree_end"))).over(w)
    read = marked.withColumn("__until", F.coalesce(until, F.lit(-1))).where(F.col("ord") > F.col("__until")).where("text is not null and trim(text) <> ''")
    role = F.col("category")
    intro = F.create_map(*[F.lit(x) for kv in INTRODUCTIONS.items() for x in kv])
    return read.select("doc_id", "ord", F.concat(F.lit("seg_"), F.col("node_id")).alias("segment_id"), role.alias("role"), "text", F.when(role == "NOTE", note_length_units(F.col("text"))).alias("length_category"), F.try_element_at(intro, role).alias("acoustic_intro"), "page_index")


def layout(segments: DataFrame, name: str) -> DataFrame:
    """Segments of a layout: ``continuous`` and ``doctrine`` read all, ``quick`` leaves notes out."""
    return segments.where(~F.col("role").isin("NOTE", "EDITORIAL_NOTE")) if name == "quick" else segments


def paginate(segments: DataFrame, keys: list[str], order: list[str], per_page: int = PER_PAGE) -> DataFrame:
    """Segments with ``page_number`` from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return segments.withColumn("page_number", F.ceil(F.row_number().over(w) / per_page).cast("int"))


def place_children(nodes: DataFrame) -> DataFrame:
    """Children with the place of their text in the parent's: first literal occurrence from 0, or null if it stands apart."""
    parent = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("text").alias("parent_text"))
    at = F.expr("locate(text, parent_text)")
    joined = nodes.join(parent, ["doc_id", "parent_id"])
    return joined.withColumn("start", F.when((at > 0) & (F.length("text") > 0), at - 1)).withColumn("end", F.col("start") + F.length("text")).drop("parent_text")


def merge_note_parts(notes: DataFrame) -> DataFrame:
    """Notes that go on: the one before doesn't end a sentence and the next begins lower-case or with a digit; a final hyphen joins the word."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    open_ = ~F.lag("text").over(w).rlike("[.!?»”\"')]\\s*$")
    goes_on = open_ & F.col("text").rlike("^\\s*[\\p{Ll}0-9]") & ~F.col("text").rlike("^\\s*\\(?\\d+\\)")
    runs = islands(notes, ["doc_id"], ["ord"], F.coalesce(goes_on, F.lit(False)))
    joined = F.regexp_replace(join_text(runs, [], "ord", separator="\u0001"), "(?U)(\\w)-\u0001(?=\\p{Ll})", "$1")
    return runs.groupBy("doc_id", "island").agg(F.min("ord").alias("ord"), F.regexp_replace(joined, "\u0001", " ").alias("text"), F.count("*").alias("n_parts")).drop("island")


def long_notes_at_headings(segments: DataFrame) -> DataFrame:
    """Order in which long notes are read at the next heading, all else in place: adds ``read_ord``."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    heading = F.first(F.when(F.col("role").startswith("HEADING_"), F.col("ord")), ignorenulls=True).over(w)
    long = (F.col("role") == "NOTE") & F.col("length_category").isin("LONG", "VERY_LONG", "MEGA")
    place = F.when(long, F.coalesce(heading.cast("double"), F.lit(float("inf"))) - 0.5).otherwise(F.col("ord").cast("double"))
    return segments.withColumn("__p", place).withColumn("read_ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("__p", "ord")) - 1).drop("__p")


def bibliography_last(segments: DataFrame, is_bibliography: Column) -> DataFrame:
    """Order in which each section's bibliography follows its other segments: adds ``read_ord``."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    section = F.sum(F.when(F.col("role").startswith("HEADING_"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = segments.withColumn("__s", section).withColumn("__b", is_bibliography)
    return marked.withColumn("read_ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("__s", "__b", "ord")) - 1).drop("__s", "__b")


def attach_punctuation(segments: DataFrame) -> DataFrame:
    """A segment that is a bare paragraph marker goes before the next one's text; one that is punctuation only after the one before."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    bare, point = F.col("text").rlike("^\\s*\\d+(?:-\\w+)?\\.\\s*$"), F.col("text").rlike("^\\s*[.,;:]+\\s*$")
    marked = segments.withColumn("__bare", bare).withColumn("__point", point)
    joins = F.lag("__bare").over(w) | F.col("__point")
    runs = islands(marked, ["doc_id"], ["ord"], F.coalesce(joins, F.lit(False)))
    text = F.regexp_replace(join_text(runs, [], "ord"), "\\s+([.,;:]+)$", "$1")
    return runs.groupBy("doc_id", "island").agg(F.max("ord").alias("ord"), text.alias("text"), F.max_by("role", F.struct(F.when(F.col("__bare") | F.col("__point"), 0).otherwise(1).alias("k"), "ord")).alias("role")).drop("island")


def refresher(text: str, at: int) -> str:
    """What to hear again before a marker at an offset: its sentence up to there, and sentences before it until there are 60 characters.

    Of more than 180 the nearest are kept, from a word's start. Remains of markers at the head go, and words cut by a hyphen are joined.
    """
    at = min(max(at, 0), len(text))
    ends = [0, *sentence_ends(text)]
    start = max((e for e in ends if e <= at), default=0)
    while at - start < REFRESH_LEAST and start > 0:
        start = max(e for e in ends if e < start)
    out = text[start:at]
    if len(out) > REFRESH_MOST:
        cut = re.search(r"\s+(?=\S)", out[len(out) - REFRESH_MOST :])
        out = out[len(out) - REFRESH_MOST + cut.end() :] if cut else out
    out, last = out.strip(), None
    while out != last:
        last = out
        for head in DIRTY_HEADS:
            out = re.sub(head, "", out).strip()
    return stitch(out)


def stitch(text: str) -> str:
    """Words with a hyphen between small letters joined, but after prefixes of real compounds."""
    first, *rest = text.split("-")
    out = first
    for part in rest:
        broken = out[-1:].islower() and part[:1].islower()
        left = re.search(r"[^\W\d_]*$", out).group().lower()
        out += ("" if broken and left not in COMPOUNDS else "-") + part
    return out


def memory_refresh(rows: DataFrame, text: str = "text", at: str = "marker_start") -> DataFrame:
    @F.pandas_udf("string")
    def run(t: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or pd.isna(y) else refresher(x, int(y)) for x, y in zip(t, a, strict=True)])

    return rows.withColumn("memory_refresh", run(F.col(text), F.col(at)))


def note_title(text: Column) -> Column:
    """The first words of a note without its marker."""
    w = words(F.regexp_replace(text, "^\\s*\\(?\\d+\\)?[.\\s]\\s*", ""))
    return F.concat(F.array_join(F.slice(w, 1, TITLE_WORDS), " "), F.when(F.size(w) > TITLE_WORDS, "…").otherwise(""))


def outline_parents(headings: DataFrame) -> DataFrame:
    """Each heading's parent: the last one before it of a smaller level, whatever the levels are. ``headings``: ``doc_id, ord, level``.

    The places of headings in a stack are found first: a heading's place is one more than its parent's. A document's headings are folded once, in order, by a stack of
    (level, ord) pairs: entries that aren't smaller go.
    """
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.struct("ord", "level"))),
        F.struct(F.array().cast("array<struct<level:bigint,ord:bigint>>").alias("stack"), F.array().cast("array<struct<ord:bigint,parent:bigint>>").alias("out")),
        lambda acc, h: _push(acc, h),
        lambda acc: acc["out"],
    )
    parents = headings.groupBy("doc_id").agg(fold.alias("__p")).select("doc_id", F.explode("__p").alias("__p")).select("doc_id", F.col("__p.ord").alias("ord"), F.col("__p.parent").alias("parent_ord"))
    return headings.join(parents, ["doc_id", "ord"])


def _push(acc: Column, h: Column) -> Column:
    open_ = F.filter(acc["stack"], lambda e: e["level"] < h["level"])
    above = F.try_element_at(open_, F.lit(-1))["ord"]
    entry = F.struct(h["level"].cast("bigint").alias("level"), h["ord"].cast("bigint").alias("ord"))
    return F.struct(F.concat(open_, F.array(entry)).alias("stack"), F.concat(acc["out"], F.array(F.struct(h["ord"].cast("bigint").alias("ord"), above.alias("parent")))).alias("out"))
