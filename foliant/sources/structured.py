"""Readers of structured legal XML, e-books, extracted JSON documents and page tables; writers of the JSON contract."""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import schemas

#: Thresholds of the two health checks.
ARTICLES_OK, ARTICLES_STUB, ATTACHMENTS_MANY, PARAGRAPHS_MANY = 5, 4, 50, 100
FLAT_SPANS, FLAT_NUMBERS, STRUCTURED_NUMBERS = 50, 5, 1
SCHEMA_VERSION = "0.7.0"

XML_HEALTH = "path string, verdict string, root_tag string, root_namespace string, body_article_count int, body_paragraph_count int, body_chapter_count int, attachment_count int, attachment_doc_count int, attachment_paragraph_count int, error_detail string"
XML_NODES = "path string, ord int, depth int, category string, eid string, text string"
EPUB_PAGES = "path string, page_index int, href string, html string, error string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of files; each is one row, so a file must fit in a task's memory."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _name(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _text(element: ElementTree.Element) -> str:
    return re.sub(r"\s+", " ", "".join(element.itertext())).strip()


def _all(element: ElementTree.Element | None, name: str) -> list[ElementTree.Element]:
    return [] if element is None else [e for e in element.iter() if _name(e) == name]


def xml_health(files: DataFrame) -> DataFrame:
    """One row for each file: counts of its parts and a verdict, OK, FRAGMENTED, NOT_AKN or INVALID_XML."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in XML_HEALTH.split(", ")]
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                row = dict.fromkeys(columns) | {"path": path}
                try:
                    root = ElementTree.fromstring(bytes(content))
                except ElementTree.ParseError as e:
                    rows.append(row | {"verdict": "INVALID_XML", "error_detail": str(e)})
                    continue
                space = root.tag[1:].partition("}")[0] if root.tag.startswith("{") else ""
                row |= {"root_tag": _name(root), "root_namespace": space}
                if _name(root) != "akomaNtoso":
                    rows.append(row | {"verdict": "NOT_AKN"})
                    continue
                body = next(iter(_all(root, "body")), None)
                attachments = _all(root, "attachment")
                n = {
                    "body_article_count": len(_all(body, "article")), "body_paragraph_count": len(_all(body, "paragraph")), "body_chapter_count": len(_all(body, "chapter")), "attachment_count": len(attachments),
                    "attachment_doc_count": sum(len(_all(a, "doc")) for a in attachments), "attachment_paragraph_count": sum(len(_all(a, "paragraph")) for a in attachments),
                }
                broken = n["body_article_count"] < ARTICLES_OK and n["body_article_count"] <= ARTICLES_STUB and n["attachment_doc_count"] >= ATTACHMENTS_MANY and n["attachment_paragraph_count"] >= PARAGRAPHS_MANY
                rows.append(row | n | {"verdict": "FRAGMENTED" if broken else "OK"})
            yield pd.DataFrame(rows, columns=columns)

    return files.mapInPandas(run, XML_HEALTH)


_LEVELS = {"book": "HEADING_1", "part": "HEADING_1", "title": "HEADING_1", "chapter": "HEADING_2", "section": "HEADING_3"}


def _walk(element: ElementTree.Element, depth: int) -> Iterator[tuple[int, str, str | None, str]]:
    """Depth, category, id and text of what an element and its children say, in document order."""
    name, eid = _name(element), element.get("eId")
    child = {_name(c): c for c in reversed(element)}
    label = " ".join(x for x in (_text(child[k]) for k in ("num", "heading") if k in child) if x)
    below = depth
    if name in _LEVELS:
        only_notes = name == "section" and not any(_name(c) in ("article", "paragraph", "content") for c in element.iter() if c is not element)
        if label and not only_notes:
            yield depth, _LEVELS[name], eid, label
            below = depth + 1
    elif name == "article":
        yield depth, "ARTICLE_HEADER", eid, label
        below = depth + 1
    elif name == "mod":
        yield depth, "AMENDMENT", eid, _text(element)
        for q in _all(element, "quotedText") + _all(element, "quotedStructure"):
            yield depth + 1, "QUOTED_TEXT_NEW" if q.get("endQuote") is not None or q is _all(element, _name(q))[-1] else "QUOTED_TEXT_OLD", q.get("eId"), _text(q)
        return
    elif name == "authorialNote":
        yield depth, "NOTE", eid, _text(element)
        return
    elif name == "point":
        yield depth, "LIST_ITEM", eid, _text(element)
        return
    elif name in ("paragraph", "p") and not any(_name(c) in ("list", "mod", "authorialNote") for c in element.iter() if c is not element):
        if text := _text(element):
            yield depth, "ARTICLE_BODY" if depth else "BODY", eid, text
        return
    for c in element:
        if _name(c) not in ("num", "heading", "meta"):
            yield from _walk(c, below)


def parse_xml(files: DataFrame) -> DataFrame:
    """Nodes of the body and the attachments of each legal XML file in document order; files that aren't such XML give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in XML_NODES.split(", ")]
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    root = ElementTree.fromstring(bytes(content))
                except ElementTree.ParseError:
                    continue
                parts = [*_all(root, "body"), *(d for a in _all(root, "attachment") for d in _all(a, "mainBody"))] if _name(root) == "akomaNtoso" else []
                for k, (depth, category, eid, text) in enumerate(x for p in parts for c in p for x in _walk(c, 0)):
                    rows.append((path, k, depth, category, eid, text))
            yield pd.DataFrame(rows, columns=columns).astype({"ord": "int32", "depth": "int32"})

    return files.mapInPandas(run, XML_NODES)


def epub_pages(files: DataFrame) -> DataFrame:
    """Pages of e-books in the order of their spine. A spine entry's file is found by its path, else by any name that ends with it."""

    def pages(content: bytes) -> list[tuple[str, str]]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            container = ElementTree.fromstring(z.read("META-INF/container.xml"))
            opf = next(e.get("full-path") for e in container.iter() if _name(e) == "rootfile")
            package = ElementTree.fromstring(z.read(opf))
            manifest = {e.get("id"): e.get("href") for e in _all(package, "item")}
            out = []
            for e in _all(package, "itemref"):
                href = manifest.get(e.get("idref"))
                if href is None:
                    continue
                exact = posixpath.normpath(posixpath.join(posixpath.dirname(opf), href))
                found = exact if exact in names else next((n for n in names if n.endswith(href)), None)
                if found:
                    out.append((href, z.read(found).decode("utf-8", "replace")))
            return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, k, href, html, None) for k, (href, html) in enumerate(pages(bytes(content)))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, StopIteration) as e:
                    rows.append((path, -1, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page_index", "href", "html", "error"]).astype({"page_index": "int32"})

    return files.mapInPandas(run, EPUB_PAGES)


def epub_health(pages: DataFrame) -> DataFrame:
    """Verdict of each e-book from class tokens of its pages: OK_FLAT_ATTACHMENT, OK_STRUCTURED, NOT_IPZS or INVALID."""
    token = lambda name: F.aggregate(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('class="([^"]*)"'), F.lit(1)), F.lit(0), lambda acc, c: acc + F.when(F.array_contains(F.split(c, "\\s+"), name), 1).otherwise(0))
    by = pages.groupBy("path").agg(F.max("error").alias("error"), F.count_if(F.col("page_index") >= 0).alias("n_pages"), F.sum(token("attachment-just-text")).alias("n_flat"), F.sum(token("article-num-akn")).alias("n_numbers"))
    verdict = F.when(F.col("error").isNotNull(), "INVALID").when((F.col("n_flat") >= FLAT_SPANS) & (F.col("n_numbers") <= FLAT_NUMBERS), "OK_FLAT_ATTACHMENT").when(F.col("n_numbers") >= STRUCTURED_NUMBERS, "OK_STRUCTURED").otherwise("NOT_IPZS")
    return by.withColumn("verdict", verdict)


def join_spine(manifest: DataFrame, spine: DataFrame, names: DataFrame) -> DataFrame:
    """Spine entries with the file of each: the exact path, else the first name that ends with it.

    Suffixes meet as equal keys: a name is listed under each of its path suffixes, so no row is compared with all others.
    """
    entries = spine.join(manifest.withColumnRenamed("item_id", "idref"), ["doc_id", "idref"])
    parts = F.split("name", "/")
    suffixes = names.withColumn("n", F.size(parts)).select("doc_id", "name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("href"))
    found = suffixes.groupBy("doc_id", "href").agg(F.min_by("name", F.struct((F.col("name") != F.col("href")).alias("k"), "name")).alias("name"))
    return entries.join(found, ["doc_id", "href"], "left")


def read_documents(spark: SparkSession, path: str, version: str = SCHEMA_VERSION) -> DataFrame:
    """JSON documents: ``path, document, error``. The version gate and the schema each have an error of their own."""
    schema = "struct<schema_version:string,document_id:string,metadata:struct<pages_pdf:int,source_filename:string>,profile:struct<profile_id:string,confidence:double>,warnings:array<string>,structure:string,transformations:string>"
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    parsed = raw.withColumn("document", F.from_json("value", schema))
    found = F.get_json_object("value", "$.schema_version")
    error = F.when(F.get_json_object("value", "$").isNull(), "not_json").when(found.isNull() | (found != version), "version").when(F.col("document.document_id").isNull(), "schema")
    return parsed.withColumn("error", error).drop("value")


def contract(documents: DataFrame, nodes: DataFrame, transformations: DataFrame, warnings: DataFrame) -> DataFrame:
    """``doc_id, json``: documents with nested structure, built from the flat tables document by document, nulls kept.

    The id is derived from the source name, so a second run gives the same one.
    """
    node = F.struct(*[c for c in ("ord", "node_id", "parent_id", "category", "page_index", "text", "level", "length_category") if c in nodes.columns])
    per = nodes.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(node)), {"ignoreNullFields": "false"}).alias("nodes"))
    edits = transformations.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("seq", *[c for c in transformations.columns if c not in ("doc_id", "seq")]))), {"ignoreNullFields": "false"}).alias("edits"))
    said = warnings.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda w: w["text"]).alias("said"))

    @F.pandas_udf("string")
    def nest(doc: pd.Series, nodes_json: pd.Series, edits_json: pd.Series, said_: pd.Series) -> pd.Series:
        out = []
        for d, n, e, w in zip(doc, nodes_json, edits_json, said_, strict=True):
            by_id, roots = {}, []
            for x in json.loads(n or "[]"):
                x["children"] = []
                by_id[x["node_id"]] = x
                (by_id[x["parent_id"]]["children"] if x.get("parent_id") in by_id else roots).append(x)
            for x in by_id.values():
                x.pop("parent_id", None), x.pop("ord", None)
                x["type"], x["id"] = x.pop("category"), x.pop("node_id")
            out.append(json.dumps({"schema_version": SCHEMA_VERSION, "document_id": d, "warnings": list(w) if w is not None else [], "transformations": json.loads(e or "[]"), "structure": roots}, indent=2, ensure_ascii=False) + "\n")
        return pd.Series(out)

    joined = documents.select("doc_id").join(per, "doc_id", "left").join(edits, "doc_id", "left").join(said, "doc_id", "left")
    key = F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)
    return joined.select("doc_id", nest(key, "nodes", "edits", "said").alias("json"))


def text_blocks(documents: DataFrame, text: str = "text") -> DataFrame:
    """Plain texts as page tables: each non-blank line is a block on page 0, in order."""
    lines = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split(text, "\n", -1)).alias("flat_idx", "text")).where("trim(text) <> ''")
    return lines.withColumn("page", F.lit(0))


def flatten_spans(raw: DataFrame) -> DataFrame:
    """Spans of pages given as nested blocks and lines, text blocks (type 0) only, with global order; a missing block number is 0.

    ``raw``: ``doc_id, page, blocks array<struct<number, type, lines array<struct<spans array<struct<text, font, size, flags, color, bbox>>>>>>``.
    """
    from pyspark.sql.window import Window

    blocks = raw.select("doc_id", "page", F.posexplode("blocks").alias("b", "block")).where("block.type = 0")
    lines = blocks.select("doc_id", "page", "b", F.coalesce("block.number", F.lit(0)).alias("block_index"), F.posexplode("block.lines").alias("line_index", "line"))
    spans = lines.select("doc_id", "page", "b", "block_index", "line_index", F.posexplode("line.spans").alias("span_index", "s"))
    order = ("page", "b", "line_index", "span_index")
    out = spans.withColumn("span_ord", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1).withColumn("flat_idx", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page", "b")) - 1)
    box = [F.col("s.bbox")[k].alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))]
    return out.select("doc_id", "flat_idx", "page", "block_index", "line_index", "span_index", "span_ord", "s.text", "s.font", "s.size", "s.flags", "s.color", *box)


def read_pdf(files: DataFrame) -> DataFrame:
    """Spans of PDF files, by a PDF library if one is installed; an encrypted file gives no rows."""
    try:
        import fitz  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs a PDF library; every operator also takes span tables") from e

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        columns = [c.split()[0] for c in schemas.SPANS.split(", ")]
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                doc = fitz.open(stream=bytes(content), filetype="pdf")
                if doc.needs_pass and not doc.authenticate(""):
                    continue
                k = 0
                for page in doc:
                    for b in page.get_text("dict")["blocks"]:
                        if b.get("type") == 0:
                            for li, line in enumerate(b["lines"]):
                                for si, s in enumerate(line["spans"]):
                                    rows.append((path, page.number, b.get("number", 0), li, si, k, s["text"], s["font"], float(s["size"]), s["flags"], s["color"], *map(float, s["bbox"])))
                                    k += 1
            yield pd.DataFrame(rows, columns=columns)

    return files.mapInPandas(run, schemas.SPANS)


def write_contract(documents: DataFrame, path: str, buckets: int = 64) -> None:
    """``doc_id`` and JSON text of each document, one a line, in folders by a hash of the id: as many folders for any number of documents."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    documents.select("doc_id", "json", bucket.alias("bucket")).write.partitionBy("bucket").json(path)


def read_contract(spark, path: str, doc_ids: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """What ``write_contract`` wrote; of the documents named only the folders that may hold them are read."""
    out = spark.read.schema("doc_id string, json string, bucket int").json(path)
    if doc_ids is not None:
        wanted = [r[0] for r in spark.createDataFrame([(d,) for d in doc_ids], "d string").select(F.pmod(F.xxhash64("d"), F.lit(buckets)).cast("int")).distinct().collect()]
        out = out.where(F.col("bucket").isin(wanted) & F.col("doc_id").isin(doc_ids))
    return out.drop("bucket")


def document_summary(documents: DataFrame, nodes: DataFrame, warnings: DataFrame, version: str = SCHEMA_VERSION) -> DataFrame:
    """Id, profile, version, pages, nodes and warnings of each document."""
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    pages = nodes.groupBy("doc_id").agg((F.max("page_index") + 1).alias("n_pages"), F.count("*").alias("n_nodes"))
    return documents.select("doc_id", "profile_id").join(pages, "doc_id", "left").join(count(warnings, "n_warnings"), "doc_id", "left").fillna(0, ["n_pages", "n_nodes", "n_warnings"]).withColumn("schema_version", F.lit(version))


def json_schema(ddl: str) -> str:
    """A table's schema as JSON with sorted keys."""
    from pyspark.sql.types import StructType

    return json.dumps(StructType.fromDDL(ddl).jsonValue(), indent=2, sort_keys=True) + "\n"


def write_snapshot(summary: DataFrame, path: str) -> None:
    """Rows as JSON, one a line, nulls kept; columns in alphabetical order."""
    summary.select(*sorted(summary.columns)).write.option("ignoreNullFields", "false").json(path)
