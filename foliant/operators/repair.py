"""Text repair with a reversible log: hyphens, ellipses, notes across pages, misread tokens, and the replay of the log."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType
from pyspark.sql.window import Window

from foliant.functions import ocr
from foliant.functions.text import NOTE_MARKER, note_length
from foliant.operators.reconstruct import islands, join_text
from foliant.session import settle, unsettle

#: Letters of hyphenated halves, the two hyphens, markers of a chain of marginal headings.
HYPHENATION = "([a-zA-Zàèéìòù]+)[-­]\n([a-zA-Zàèéìòù]+)"
HYPHENATION_OCR = "([a-zA-Zàèéìòù0-9]+)[-­]\n?([a-zA-Zàèéìòù0-9]+)"
TRAILING, LEADING = "\\s*(?:\\.\\.\\.|…)\\s*$", "^\\s*(?:\\.\\.\\.|…)\\s*"
HYPHEN = "[-­]\\n?"
_HYPHEN = re.compile(HYPHEN)
#: Rows of a batch that a worker holds at once.
BATCH_ROWS = 200
#: Corrections that each worker holds; matches that it remembers.
HELD, REMEMBERED = 1_000_000, 200_000
#: Candidates that a worker gathers before it hands them on.
CANDIDATES = 20_000
_EDITS = "array<struct<start:int,end:int,original:string,normalized:string>>"


def _halves(nodes: DataFrame, pattern: str) -> DataFrame:
    """Candidate joins: each match with the joined word, from the text alone (built-in functions)."""
    found = F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))
    both = nodes.where(F.col("text").rlike(pattern)).select("doc_id", "node_id", F.explode(F.array_distinct(found)).alias("original"))
    return both.withColumn("word", F.lower(F.regexp_replace("original", HYPHEN, "")))


def dehyphenate(nodes: DataFrame, lexicon: DataFrame, step_id: str = "dehyphenate_with_log", pattern: str = HYPHENATION) -> tuple[DataFrame, DataFrame]:
    """Nodes whose end-of-line hyphens are joined where the whole word is in the lexicon, and the edit log.

    The lexicon (``word``, lower case) may be of any size. Offsets in the log are of the text before the step. Other notes' length classes are found anew.
    """
    words = lexicon.select("word").where("word is not null").distinct()
    return _apply(nodes, _halves(nodes, pattern), words.withColumn("correction", F.col("word")), pattern, step_id, _whole, lambda original, correction: _HYPHEN.sub("", original))


def _whole(original: str) -> str | None:
    return _HYPHEN.sub("", original).lower()


def _whole_ocr(original: str) -> str | None:
    """The whole word of two halves, unless they are left alone."""
    before, after = _HYPHEN.split(original)
    if len(after) < ocr.LEAST_AFTER_HYPHEN or before.isdigit() and after.isdigit() or (before.lower(), after.lower()) in ocr.KEPT_HYPHENS:
        return None
    return (before + after).lower()


def _token(original: str) -> str | None:
    return None if original.isdigit() else original.lower()


def _distinct(nodes: DataFrame, pattern: str, word: Callable[[str], str | None]) -> DataFrame:
    """``word``: the distinct words that ``word`` makes of a pattern's matches, written as a table."""
    matcher = re.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[str] = set()
        for batch in batches:
            for t in batch.column("text").to_pylist():
                found.update(matcher.findall(t))
                if len(found) >= REMEMBERED:
                    yield pa.RecordBatch.from_arrays([pa.array({w for x in found if (w := word(x))}, pa.string())], ["word"])
                    found.clear()
        yield pa.RecordBatch.from_arrays([pa.array({w for x in found if (w := word(x))}, pa.string())], ["word"])

    return settle(nodes.where(F.col("text").isNotNull()).select("text").mapInArrow(run, "word string").distinct(), BATCH_ROWS)


def _apply(
    nodes: DataFrame,
    found: DataFrame,
    corrections: DataFrame,
    pattern: str,
    step_id: str,
    word: Callable[[str], str | None],
    final: Callable[[str, str], str],
    more: Callable[[str], list[tuple[int, int, str]]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Nodes whose matches of a pattern become what ``final`` makes of match and correction, and the log of edits.

    ``corrections`` (``word, correction``) has ``word`` of what is changed. Up to ``HELD`` of them each worker holds; more come with each node, from a join with
    ``found`` (``doc_id, node_id, word`` of the matches). ``more`` gives further (start, end, replacement) of a text, which come first where they overlap.
    Texts are rewritten once and in small batches: nodes and log are read from the table that this writes.
    """
    known, spark, place = settle(corrections), nodes.sparkSession, nodes.columns
    held = None
    if known.count() <= HELD:
        pairs = known.select("word", "correction").toArrow().to_pydict()
        # a word that is its own correction is one object
        held = spark.sparkContext.broadcast({w: w if w == c else c for w, c in zip(pairs["word"], pairs["correction"], strict=True)})
        rows = nodes.withColumn("__fix", F.lit(None).cast("array<struct<word:string,correction:string>>"))
    else:
        fixes = found.select("doc_id", "node_id", "word").join(known, "word").groupBy("doc_id", "node_id").agg(F.collect_set(F.struct("word", "correction")).alias("__fix"))
        rows = nodes.join(fixes, ["doc_id", "node_id"], "left").select(*place, "__fix")
    matcher = re.compile(pattern)

    def change(original: str, fix: dict[str, str]) -> str | None:
        w = word(original)
        x = final(original, fix[w]) if w in fix else None
        return None if x == original else x

    def edits_of(text: str, fix: dict[str, str], seen: dict[str, str | None]) -> list[tuple[int, int, str]]:
        edits = more(text) if more else []
        starts, ends = [e[0] for e in edits], [e[1] for e in edits]
        for m in matcher.finditer(text) if fix else ():
            original = m.group()
            if original not in seen:
                seen[original] = change(original, fix)
            if (x := seen[original]) is not None and not _over(starts, ends, m.start(), m.end()):
                edits.append((m.start(), m.end(), x))
        edits.sort()
        return edits

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, str | None] = {}
        for batch in batches:
            texts, fix = batch.column("text").to_pylist(), batch.column("__fix")
            pairs = fix.flatten()
            words, corrected = pairs.field(0).to_pylist(), pairs.field(1).to_pylist()
            sizes = pc.fill_null(pc.list_value_length(fix), 0).to_pylist()
            looked = [True] * len(texts) if more is None else [c in ocr.TEXT_CATEGORIES for c in batch.column("category").to_pylist()]
            at, offsets, log = 0, [0], []
            for k, (t, n, look) in enumerate(zip(texts, sizes, looked, strict=True)):
                if held is None or len(seen) > REMEMBERED:
                    seen.clear()
                if t and look:
                    edits = edits_of(t, held.value if held else dict(zip(words[at : at + n], corrected[at : at + n], strict=True)), seen)
                    out, last = [], 0
                    for a, b, x in edits:
                        out += [t[last:a], x]
                        last = b
                        log.append((a, b, t[a:b], x))
                    texts[k] = "".join([*out, t[last:]])
                at += n
                offsets.append(len(log))
            columns = [pa.array([e[j] for e in log], kind) for j, kind in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))]
            made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, ["start", "end", "original", "normalized"]))
            own = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in place]
            yield pa.RecordBatch.from_arrays([*own, made], [*place, "__edits"])

    schema = StructType([*nodes.schema.fields, StructField("__edits", DataType.fromDDL(_EDITS))])
    done = settle(rows.mapInArrow(rewrite, schema), BATCH_ROWS)
    if held:
        held.destroy()
    unsettle(known)
    log = done.where(F.size("__edits") > 0).select("doc_id", "node_id", "page_index", F.posexplode("__edits").alias("seq", "e")).select("doc_id", F.lit(step_id).alias("step_id"), "node_id", "page_index", "seq", "e.*")
    length = F.when((F.size("__edits") > 0) & (F.col("category") == "NOTE"), note_length(F.col("text"))).otherwise(F.col("length_category"))
    out = done.select(*[length.alias(c) if c == "length_category" else F.col(c) for c in place])
    out.made_of = done
    return out, log


def _over(starts: list[int], ends: list[int], a: int, b: int) -> bool:
    """Whether [a, b) meets one of the places, which are in order and apart."""
    k = bisect.bisect_left(starts, b) - 1
    return k >= 0 and ends[k] > a


def dehyphenate_ocr(nodes: DataFrame, lexicon: DataFrame, step_id: str = "dehyphenate_ocr_aggressive") -> tuple[DataFrame, DataFrame]:
    """As ``dehyphenate``, for scans: halves may hold digits, the line's end may be lost, and a whole word that isn't in the lexicon may be corrected into it.

    Pairs of numbers, halves of one letter after the hyphen, and words that keep theirs are left alone. Case is that of the two halves.
    """
    known = lexicon.select(F.lower("word").alias("word")).distinct()
    words = _distinct(nodes, HYPHENATION_OCR.replace("(", "(?:"), _whole_ocr)
    right = words.join(known, "word", "left_semi").select("word", F.col("word").alias("correction"))
    fixed = correct_tokens(words.select(F.col("word").alias("token")), lexicon).withColumnRenamed("token", "word")
    out = _apply(nodes, _halves(nodes, HYPHENATION_OCR), right.unionByName(fixed), HYPHENATION_OCR, step_id, _whole_ocr, lambda original, correction: ocr.like(_HYPHEN.sub("", original), correction))
    unsettle(words)
    return out


#: A rewrite with what every match of it holds.
_REWRITES = [(part, re.compile(p), x) for part, p, x in ocr.REWRITES]


def rewrites(text: str) -> list[tuple[int, int, str]]:
    """Places that the fixed rewrites and section labels change: from the left, the longest first, none over another."""
    found = [(m.start(), m.end(), x) for part, p, template in _REWRITES if part in text for m in p.finditer(text) if (x := m.expand(template)) != m.group()]
    labels = []
    for read, printed in ocr.MARKERS:
        at = text.find(read)
        while at >= 0:
            labels.append((at, at + len(read), printed))
            at = text.find(read, at + len(read))
    out: list[tuple[int, int, str]] = []
    for own in (found, labels):
        starts, ends, last = [e[0] for e in out], [e[1] for e in out], 0
        for a, b, x in sorted(own, key=lambda e: (e[0], e[0] - e[1])):
            if a >= last and not _over(starts, ends, a, b):
                out.append((a, b, x))
                last = b
        out.sort()
    return out


def normalize_ocr(nodes: DataFrame, lexicon: DataFrame, step_id: str = "normalize_ocr_with_dictionary") -> tuple[DataFrame, DataFrame]:
    """Misread words, section labels and signs of scanned text, and the log of edits.

    Rewrites in context and labels come first; other words that the lexicon lacks become the one word of it that is fewest substitutions away, in their own case.
    Distinct words meet the lexicon in joins.
    """
    read = nodes.where(F.col("text").isNotNull() & F.col("category").isin(*ocr.TEXT_CATEGORIES))
    found = read.select("doc_id", "node_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({ocr.TOKEN})"), F.lit(1)))).alias("original")).withColumn("word", F.lower("original"))
    words = _distinct(read, ocr.TOKEN, _token)
    out = _apply(nodes, found, correct_tokens(words.select(F.col("word").alias("token")), lexicon).withColumnRenamed("token", "word"), ocr.TOKEN, step_id, _token, ocr.like, rewrites)
    unsettle(words)
    return out


def replay(nodes: DataFrame, log: DataFrame) -> DataFrame:
    """Texts before a step: its edits undone from left to right, each found by the offsets of the text before.

    Steps that join texts log an empty ``original`` at the end of the first part for each part added, in order (``seq``).
    """
    edits = log.groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("start", "seq", "end", "original", "normalized"))).alias("__e"))
    undo = F.aggregate("__e", F.col("text"), lambda t, e: F.concat(F.substring(t, F.lit(1), e["start"]), e["original"], t.substr(e["start"] + F.length(e["normalized"]) + 1, F.length(t))))
    return nodes.join(edits, ["doc_id", "node_id"], "left").withColumn("text", F.when(F.col("__e").isNotNull(), undo).otherwise(F.col("text"))).drop("__e")


def merge_cross_page_notes(notes: DataFrame, strict_gap: bool = True) -> tuple[DataFrame, DataFrame]:
    """The first note of a page joins the note before it when it has no marker (and, with ``strict_gap``, its page is the next one).

    ``notes``: ``doc_id, ord, node_id, page_index, text``. Returns merged notes, and a log row for each join that ``replay`` undoes.
    """
    w, page = Window.partitionBy("doc_id").orderBy("ord"), Window.partitionBy("doc_id", "page_index").orderBy("ord")
    marked = notes.withColumn("__first", F.row_number().over(page) == 1).withColumn("__gap", F.col("page_index") - F.lag("page_index").over(w))
    joins = F.col("__first") & ~F.col("text").rlike(NOTE_MARKER) & ((F.col("__gap") == 1) if strict_gap else (F.col("__gap") >= 1))
    runs = islands(marked, ["doc_id"], ["ord"], F.coalesce(joins, F.lit(False)))
    run = Window.partitionBy("doc_id", "island").orderBy("ord")
    parts = runs.withColumn("seq", F.row_number().over(run) - 2).withColumn("head", F.first("node_id").over(run)).withColumn("start", F.length(F.first("text").over(run)))
    log = _added(parts, "merge_cross_page_notes")
    merged = runs.groupBy("doc_id", "island").agg(F.min("ord").alias("ord"), F.min_by("node_id", "ord").alias("node_id"), F.min("page_index").alias("page_index"), join_text(runs, [], "ord").alias("text"))
    return merged.drop("island").withColumn("length_category", note_length(F.col("text"))), log


def _added(parts: DataFrame, step_id: str) -> DataFrame:
    """Log of the parts of a run after its head: each adds a space and its text at the end of the head's."""
    return parts.where("seq >= 0").select(
        "doc_id", F.lit(step_id).alias("step_id"), F.col("head").alias("node_id"), "page_index", F.col("seq").cast("int").alias("seq"), F.col("start").cast("int").alias("start"), F.col("start").cast("int").alias("end"),
        F.lit("").alias("original"), F.concat(F.lit(" "), "text").alias("normalized"), F.array("node_id").alias("merged_from"),
    )


def recompose_ellipses(items: DataFrame) -> DataFrame:
    """Chains of marginal headings cut by ellipses as one text: a head that ends with one, followers that start with one.

    A chain counts only if it ends: its last part must not end with an ellipsis. Broken chains stay as they are. ``items``: ``doc_id, ord, node_id, text``.
    """
    return _ellipses(items)[0]


def _ellipses(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    ends, starts = F.col("text").rlike(TRAILING), F.col("text").rlike(LEADING)
    w = Window.partitionBy("doc_id").orderBy("ord")
    runs = islands(items, ["doc_id"], ["ord"], F.coalesce(starts & F.lag(ends).over(w), F.lit(False)))
    run = Window.partitionBy("doc_id", "island")
    valid = (F.count("*").over(run) > 1) & ~F.max_by(ends, F.col("ord")).over(run)
    bare = F.regexp_replace(F.regexp_replace("text", TRAILING, ""), LEADING, "")
    runs = runs.withColumn("__valid", valid).withColumn("__whole", F.col("text")).withColumn("text", F.when(valid, bare).otherwise(F.col("text"))).withColumn("__g", F.when(F.col("__valid"), F.col("island")).otherwise(-F.col("ord") - 1))
    return runs.groupBy("doc_id", "__g").agg(F.min("ord").alias("ord"), F.min_by("node_id", "ord").alias("node_id"), join_text(runs, [], "ord").alias("text"), F.count("*").alias("n_parts")).drop("__g"), runs


def recompose_with_log(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``recompose_ellipses``, with a log that ``replay`` undoes: of the head its last ellipsis, then each part added. ``items`` have ``page_index`` too."""
    merged, runs = _ellipses(items)
    run = Window.partitionBy("doc_id", "island").orderBy("ord")
    parts = runs.where("__valid").withColumn("seq", F.row_number().over(run) - 1).withColumn("head", F.first("node_id").over(run)).withColumn("start", F.length(F.first("text").over(run)))
    cut = parts.where("seq = 0").select(
        "doc_id", F.lit("recompose_marginal_ellipsis").alias("step_id"), "node_id", "page_index", F.lit(999_999).alias("seq"), F.col("start").cast("int").alias("start"), F.length("__whole").cast("int").alias("end"),
        F.expr("substring(__whole, start + 1)").alias("original"), F.lit("").alias("normalized"), F.array().cast("array<string>").alias("merged_from"),
    )
    # a head loses an ellipsis at its end only: its start is kept as it is
    return merged, cut.unionByName(_added(parts.withColumn("seq", F.col("seq") - 1), "recompose_marginal_ellipsis"))


def correct_tokens(tokens: DataFrame, lexicon: DataFrame, depth: int = ocr.MOST_SUBSTITUTIONS) -> DataFrame:
    """``token, correction``: distinct tokens that aren't in the lexicon and become a word of it by few substitutions.

    Layers of the search are tried from the nearest; the first with a word decides, and only if it has one. Candidates are made once for each distinct
    token and meet the lexicon in a join, whatever its size.
    """

    def layers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "layer", "word"]
        kinds = (pa.string(), pa.int32(), pa.string())
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names)
        rows = []
        for batch in batches:
            for token in batch.column("token").to_pylist():
                seen, front = {token}, {token}
                for k in range(1, depth + 1):
                    front = {n for t in front for n in ocr.neighbours(t)} - seen
                    seen |= front
                    rows += [(token, k, n) for n in front]
                if len(rows) >= CANDIDATES:
                    yield made(rows)
                    rows = []
        yield made(rows)

    known = lexicon.select(F.lower("word").alias("word")).distinct()
    odd = tokens.select(F.lower("token").alias("token")).where(F.length("token") >= ocr.LEAST_TOKEN).distinct().join(known.withColumnRenamed("word", "token"), "token", "left_anti")
    found = odd.mapInArrow(layers, "token string, layer int, word string").join(known, "word", "left_semi")
    per = found.groupBy("token", "layer").agg(F.count("*").alias("n"), F.first("word").alias("correction"))
    first = per.groupBy("token").agg(F.min_by(F.struct("n", "correction"), "layer").alias("b"))
    return first.where("b.n = 1").select("token", "b.correction")


def resolve_overlaps(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Matches that remain when overlapping ones are dropped: from the left, the longest first at a place. Greedy, so by key in pandas."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen, end = [], -1
        for k, r in pdf.sort_values(["start", "end"], ascending=[True, False]).iterrows():
            if r["start"] >= end:
                chosen.append(k)
                end = r["end"]
        return pdf.loc[chosen]

    return matches.groupBy(*keys).applyInPandas(keep, matches.schema)


def token_classes(texts: DataFrame) -> DataFrame:
    """Counts of tokens by class: digits inside letters, upper case, mixed case, numbers, words, others."""
    token = texts.select(F.explode(F.split("text", "(?U)\\s+", -1)).alias("t")).where("t <> ''")
    kind = (
        F.when(F.col("t").rlike("[A-Za-z][0-9]+[A-Za-z]"), "digit_inside")
        .when(F.col("t").rlike("^[0-9]+$"), "number")
        .when(F.col("t").rlike("^[A-Z]+$"), "upper")
        .when(F.col("t").rlike("^[a-z]+$"), "lower")
        .when(F.col("t").rlike("^[A-Z][a-z]+$"), "title")
        .otherwise("other")
    )
    return token.groupBy(kind.alias("token_class")).agg(F.count("*").alias("n"))


def matches_in_context(texts: DataFrame, name: str, pattern: str, around: int = 20) -> DataFrame:
    """Every occurrence of a pattern, with the text around it: ``doc_id, pattern, seq, match, context, position`` (from 1)."""
    matcher = re.compile(pattern)

    @F.pandas_udf("array<struct<match:string,context:string,position:int>>")
    def find(text: pd.Series) -> pd.Series:
        return pd.Series([[{"match": m.group(), "context": t[max(0, m.start() - around) : m.end() + around], "position": m.start() + 1} for m in matcher.finditer(t or "")] for t in text])

    return texts.select("doc_id", F.lit(name).alias("pattern"), F.posexplode(find("text")).alias("seq", "m")).select("doc_id", "pattern", "seq", "m.*")


#: Post-processing steps by the names that profiles list, in the order in which any profile lists them. Each takes nodes and a lexicon, and returns nodes and a log.
STEPS: dict[str, Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]] = {
    "dehyphenate_with_log": dehyphenate,
    "dehyphenate_ocr_aggressive": dehyphenate_ocr,
    "normalize_ocr_with_dictionary": normalize_ocr,
    "merge_cross_page_notes": lambda nodes, lexicon: _on_category(nodes, "NOTE", merge_cross_page_notes),
    "recompose_marginal_ellipsis": lambda nodes, lexicon: _on_category(nodes, "MARGINAL_HEADING", recompose_with_log),
}


def _on_category(nodes: DataFrame, category: str, step: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes of a category as a step that joins texts leaves them: those that went into others are gone."""
    merged, log = step(nodes.where(F.col("category") == category).select("doc_id", "ord", "node_id", "page_index", "text"))
    new = merged.select("doc_id", "node_id", F.col("text").alias("__text"))
    gone = log.select("doc_id", F.explode("merged_from").alias("node_id"))
    # other nodes' texts don't travel
    of = F.coalesce(F.col("category") == category, F.lit(False))
    out = nodes.where(of).join(gone, ["doc_id", "node_id"], "left_anti").join(new, ["doc_id", "node_id"], "left")
    text = F.coalesce("__text", "text")
    length = F.when(F.col("__text").isNotNull() & (F.col("category") == "NOTE"), note_length(text)).otherwise(F.col("length_category"))
    return out.select(*[{"text": text, "length_category": length}.get(c, F.col(c)).alias(c) for c in nodes.columns]).unionByName(nodes.where(~of)), log


def post_process(nodes: DataFrame, chosen: DataFrame, lexicon: DataFrame, steps: dict[str, tuple[str, ...]], registry: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes after the steps of their documents' profiles, and the log of all edits (``turn``: which step).

    ``chosen``: ``doc_id, profile_id``; ``steps``: the names that each profile lists. A step runs once, on all documents whose profile lists it, and its nodes and log are written
    before the next (a step reads its nodes several times); a name that isn't in the registry is an error.
    """
    registry = STEPS if registry is None else registry
    if unknown := {s for names in steps.values() for s in names} - set(registry):
        raise KeyError(f"no such step: {', '.join(sorted(unknown))}")
    columns, logs = nodes.columns, []
    lexicon = settle(lexicon)
    own = table = settle(nodes.join(chosen.select("doc_id", "profile_id"), "doc_id", "left"))
    for turn, (name, step) in enumerate(registry.items()):
        profiles = [p for p, names in steps.items() if name in names]
        if profiles:
            mine = F.coalesce(F.col("profile_id").isin(*profiles), F.lit(False))
            done, log = step(own.where(mine), lexicon)
            logs.append(settle(log.select("doc_id", F.lit(turn).alias("turn"), "step_id", "node_id", "page_index", "seq", "start", "end", "original", "normalized")))
            before, made = table, getattr(done, "made_of", None)
            if made is not None and own.where(~mine).isEmpty():  # all nodes stand in the step's own table
                own, table = done.select(*own.columns), made
            else:
                own = table = settle(own.where(~mine).unionByName(done.select(*own.columns)))
                unsettle(*[made] if made is not None else [])
            unsettle(before)
    unsettle(lexicon)
    log = logs[0]
    for more in logs[1:]:
        log = log.unionByName(more)
    return own.select(*columns), log


def lexicon_counts(words: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Sizes of a lexicon, and of the allowlist's words it lacks."""
    both = words.select(F.lower("word").alias("word"), F.lit(True).alias("own")).union(allowlist.select(F.lower("word").alias("word"), F.lit(False).alias("own")))
    return both.groupBy("word").agg(F.max("own").alias("own")).agg(F.count_if("own").alias("n_words"), F.count_if(~F.col("own")).alias("n_extra"))
