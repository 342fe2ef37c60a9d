"""Profile rules, warning templates and the small joins beside them."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import warnings
from foliant.operators import apparatus, cascades, profile, reconstruct
from foliant.sources import structured

BLOCK = "doc_id string, ord int, flat_idx int, page int, text string, category string, x0 double, y0 double, x1 double, y1 double, width_pt double, size double, font string, bold boolean, italic boolean"


def blocks(spark, rows, doc="d"):
    return spark.createDataFrame([(doc, k, k, 0, t, c, 100.0, 0.0, 300.0, 10.0, 480.0, float(s), f, b, i) for k, (t, c, s, f, b, i) in enumerate(rows)], BLOCK)


def categories(df):
    return [r["category"] for r in df.orderBy("doc_id", "ord").collect()]


def test_open_blocks_only(spark):
    rows = [("Capitolo Primo", "UNCLASSIFIED", 12, "x", False, False), ("1.2. Titolo", "UNCLASSIFIED", 10, "x", True, False), ("1. Titolo", "ARTIFACT_FOOTER", 10, "x", True, False), ("123_a.indb", "ARTIFACT_FOOTER", 6, "x", False, False), ("testo", "UNCLASSIFIED", 10.2, "x", False, False), ("altro", "UNCLASSIFIED", 5, "x", False, False)]
    assert categories(cascades.refine(blocks(spark, rows), "compendio_utet")) == ["HEADING_2", "HEADING_4", "ARTIFACT_FOOTER", "ARTIFACT_STAMP", "BODY", "UNCLASSIFIED"]


def test_notes_region(spark):
    rows = [("corpo", "UNCLASSIFIED", 12, "arial", False, False), ("Note:", "ARTIFACT_FOOTER", 12, "arial", True, False), ("(1) nota", "UNCLASSIFIED", 12, "arial", False, False), ("DOTTRINA", "UNCLASSIFIED", 9, "arial", True, False), ("corpo", "UNCLASSIFIED", 12, "arial", False, False)]
    assert categories(cascades.refine(blocks(spark, rows), "dejure_dottrina")) == ["BODY", "SECTION_LABEL", "NOTE", "GENRE_BANNER", "BODY"]


def test_referral_and_regions(spark):
    rows = [("MASSIMA", "UNCLASSIFIED", 9, "arial", True, False), ("uno", "UNCLASSIFIED", 12, "arial", False, False), ("due", "UNCLASSIFIED", 12, "arial", False, False)]
    assert categories(cascades.refine(blocks(spark, rows), "dejure_massime")) == ["MASSIMA_LABEL", "REFERRAL", "BODY"]
    rows = [("FONTI. —", "UNCLASSIFIED", 9, "s", True, False), ("a", "UNCLASSIFIED", 9, "s", False, False), ("LETTERATURA. —", "UNCLASSIFIED", 9, "s", True, False), ("b", "UNCLASSIFIED", 9, "s", False, False)]
    assert categories(cascades.refine(blocks(spark, rows), "enciclopedia_moderna")) == ["SECTION_LABEL", "FONTI", "SECTION_LABEL", "LETTERATURA"]


def test_each_document_by_its_profile(spark):
    row = [("1. Titolo", "UNCLASSIFIED", 12, "x", True, False)]
    both = blocks(spark, row, "a").union(blocks(spark, row, "b")).union(blocks(spark, row, "c"))
    chosen = spark.createDataFrame([("a", "manuale_zanichelli_giuridica"), ("b", "dejure_massime")], "doc_id string, profile_id string")
    assert categories(cascades.refine_all(both, chosen)) == ["HEADING_3", "TITLE", "UNCLASSIFIED"]


def test_code_books(spark):
    """Fonts of the family, parts as first headings, and rules that hold for one kind of code only."""
    p, m = "PalatinoLinotype-Bold", "MyriadPro-Regular"
    rows = [
        ("X", "UNCLASSIFIED", 20, "BD700x300", False, False), ("PARTE SECONDA", "UNCLASSIFIED", 7.48, p, True, False), ("CAPO II", "UNCLASSIFIED", 7.48, p, True, False), ("CAPO II", "UNCLASSIFIED", 7.48, "Arial", True, False),
        ("competenza: t.", "UNCLASSIFIED", 6.49, m, False, False), ("12-bis. Nome", "UNCLASSIFIED", 8.98, p, True, False), ("3-7. Nome", "UNCLASSIFIED", 8.98, p, True, False), ("(omissis)", "UNCLASSIFIED", 9, p, False, True), ("testo", "UNCLASSIFIED", 7.48, p, False, False),
    ]
    head = ["ARTIFACT_FILIGREE", "HEADING_1", "HEADING_3", "UNCLASSIFIED"]
    both = blocks(spark, rows, "a").union(blocks(spark, rows, "b"))
    chosen = spark.createDataFrame([("a", "giuffre_codici", "penale"), ("b", "giuffre_codici", "civile")], "doc_id string, profile_id string, code_type string")
    penal, civil = [*head, "PROCEDURAL", "ARTICLE_HEADER", "ARTICLE_HEADER", "UNCLASSIFIED", "ARTICLE_BODY"], [*head, "NOTE", "ARTICLE_HEADER", "ARTICLE_HEADER", "ARTICLE_BODY", "ARTICLE_BODY"]
    got = cascades.refine_all(both, chosen)
    assert categories(got.where("doc_id = 'a'")) == penal and categories(got.where("doc_id = 'b'")) == civil


def test_every_profile_has_rules_or_is_the_fallback(spark):
    assert {p.name for p in profile.PROFILES} == {*cascades.RULES, profile.FALLBACK}
    for name in cascades.RULES:
        assert cascades.refine(blocks(spark, [("x", "UNCLASSIFIED", 1, "x", False, False)]), name).count() == 1


def test_leading_span(spark):
    spans = spark.createDataFrame([("d", 0, 0, "  ", 9.0, "a", 0), ("d", 0, 1, "x", 8.0, "b", 18), ("d", 1, 2, " ", 7.0, "c", 0)], "doc_id string, flat_idx int, span_ord int, text string, size double, font string, flags int")
    got = {r["flat_idx"]: (r["font"], r["bold"], r["italic"]) for r in cascades.leading_spans(spans).collect()}
    assert got == {0: ("b", True, True), 1: ("c", False, False)}


def test_warnings(spark):
    w = spark.createDataFrame([("d", 0, "a:orphan_level_3_page_12"), ("d", 1, "a:unbound_node_0007"), ("d", 2, "else")], "doc_id string, seq int, text string")
    got = [(r["template"], r["values"]) for r in warnings.parse(w, ["a:orphan_level_<level>_page_<page>", "a:unbound_<id>"]).orderBy("seq").collect()]
    assert got == [("a:orphan_level_<level>_page_<page>", ["3", "12"]), ("a:unbound_<id>", ["node_0007"]), (None, [])]
    nodes = spark.createDataFrame([("d", "node_0007")], "doc_id string, node_id string")
    assert warnings.drop_of_nodes(w, nodes).count() == 2
    assert [r["seq"] for r in warnings.ordered_union(w, w).orderBy("seq").collect()] == list(range(6))
    with pytest.raises(ValueError, match="unknown placeholder"):
        warnings.pattern("a:<what>")
    assert warnings.ambiguous(["a:<text>", "a:<n>"], ["a:1", "a:x"]) == ["a:1"]


def test_positions_and_first(spark):
    a = spark.createDataFrame([("p", 1, "x"), ("p", 2, "y"), ("q", 1, "z")], "page string, o int, left string")
    b = spark.createDataFrame([("p", 5, "m")], "page string, r int, right string")
    assert {(r["left"], r["right"]) for r in apparatus.join_positions(a, b, ["page"], "o", "r").collect()} == {("x", "m"), ("y", None), ("z", None)}
    first, again = reconstruct.keep_first(a, ["page"], "o")
    assert first.count() == 2 and again.first()["left"] == "y"


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("d", 0, "node_0000", None, "BODY", 4, "t", None, None)], "doc_id string, ord int, node_id string, parent_id string, category string, page_index int, text string, level int, length_category string")
    none = spark.createDataFrame([], "doc_id string, seq int, text string")
    docs = spark.createDataFrame([("d", "unknown_generic")], "doc_id string, profile_id string")
    structured.write_contract(structured.contract(docs, nodes, none.drop("text"), none), str(tmp_path / "json"))
    back = structured.read_contract(spark, str(tmp_path / "json"), ["d"]).collect()
    assert [r["doc_id"] for r in back] == ["d"] and back[0]["json"].startswith("{")
    assert structured.read_contract(spark, str(tmp_path / "json"), ["e"]).count() == 0
    s = structured.document_summary(docs, nodes, none)
    assert (s.first()["n_pages"], s.first()["n_warnings"]) == (5, 0)
    structured.write_snapshot(s, str(tmp_path / "snap"))
    assert spark.read.json(str(tmp_path / "snap")).first()["n_nodes"] == 1
    assert '"doc_id"' in structured.json_schema("doc_id string, n int")


def test_sections_and_spine(spark):
    manifest = spark.createDataFrame([("d", "a", "t/a.xhtml"), ("d", "b", "b.xhtml")], "doc_id string, item_id string, href string")
    spine = spark.createDataFrame([("d", 0, "b"), ("d", 1, "a")], "doc_id string, pos int, idref string")
    names = spark.createDataFrame([("d", "OEBPS/t/a.xhtml"), ("d", "b.xhtml"), ("d", "x/b.xhtml")], "doc_id string, name string")
    assert [r["name"] for r in structured.join_spine(manifest, spine, names).orderBy("pos").collect()] == ["b.xhtml", "OEBPS/t/a.xhtml"]
    chapters = reconstruct.pair_chapters(spark.createDataFrame([("d", 0, "HEADING_2", "Capitolo I"), ("d", 1, "HEADING_2", "Le fonti"), ("d", 2, "BODY", "x")], "doc_id string, ord int, category string, text string"))
    assert [r["text"] for r in chapters.orderBy("ord").collect()] == ["Capitolo I. Le fonti", "x"]
    parts = reconstruct.split_notes(spark.createDataFrame([("d", "n", "NOTE", "(1) uno (2) due")], "doc_id string, node_id string, category string, text string"))
    assert [(r["part"], r["text"]) for r in parts.orderBy("part").collect()] == [(0, "(1) uno "), (1, "(2) due")]
    refs, above = reconstruct.mint_references(spark.createDataFrame([("d", "n", 0, "a (3) b (900)")], "doc_id string, node_id string, ord int, text string"))
    assert refs.first()["n"] == 3 and above.count() == 1
    runs = reconstruct.split_runs(spark.createDataFrame([("d", "n", k, t) for k, t in enumerate(["a", "1", "b", "2"])], "doc_id string, node_id string, span_ord int, text string"), F.col("text").rlike("^\\d$"))
    assert [r["text"] for r in runs.orderBy("segment").collect()] == ["a", "1b", "2"]
