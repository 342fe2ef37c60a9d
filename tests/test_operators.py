"""Small hand-made cases of the page, node and repair operators."""

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import apparatus, classify, furniture, library, profile, reconstruct, repair, reports, segments
from foliant.sources import structured
from foliant.streaming import incremental


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "text string").select(f(F.col("text")).alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "want"), [("(1) " + "a" * 49, "MICRO"), ("a" * 50, "SHORT"), ("a" * 3000, "MEGA"), ("(12)  ", None), ("", None), (None, None)])
def test_note_length(spark, value, want):
    assert one(spark, value, T.note_length) == want


@pytest.mark.parametrize(("value", "want"), [("CAPITOLO XII", "CHAPTER"), ("Capitolo Primo", "CHAPTER"), ("1.2. È vero", "SUB_PARAGRAPH"), ("§ 3-bis. Titolo", "PARAGRAPH"), ("4. Titolo", "PARAGRAPH"), ("Titolo", None)])
def test_heading_kind(spark, value, want):
    assert one(spark, value, T.heading_kind) == want


def test_text_functions(spark):
    assert one(spark, "𝄞a", T.utf16_length) == 3
    assert one(spark, "a (1) b((2) c3(4)", T.inline_markers) == [1]
    assert one(spark, "My File (2).pdf", T.slug) == "my_file_2"
    assert one(spark, "xiv", T.is_roman) and not one(spark, "IIX", T.is_roman)
    assert one(spark, "1. Uno – 2. Due", T.toc_items)[1]["title"] == "Due"
    assert one(spark, "1. Uno – senza numero", T.toc_items) is None
    row = spark.createDataFrame([(["una pa-", "rola", "sola"],)], "x array<string>").select(T.join_lines(F.col("x"))).first()
    assert row[0] == "una parola sola"


def test_tier1_order(spark):
    pages = spark.createDataFrame([("d", 0, 100.0, 1000.0), ("d", 1, 100.0, 1000.0)], "doc_id string, page int, width_pt double, height_pt double")
    box = "doc_id string, flat_idx int, page int, x0 double, y0 double, x1 double, y1 double"
    blocks = spark.createDataFrame([("d", 0, 0, 0.0, 10.0, 90.0, 50.0), ("d", 1, 0, 0.0, 10.0, 50.0, 80.0), ("d", 2, 0, 0.0, 920.0, 9.0, 930.0), ("d", 3, 0, 0.0, 500.0, 9.0, 510.0), ("d", 4, 0, 0.0, 500.0, 9.0, 510.0), ("d", 5, 0, 0.0, 500.0, 9.0, 510.0)], box)
    spans = spark.createDataFrame([("d", 0, 0, "© giuffrÈ x", 12.0, 0), ("d", 1, 1, "head", 9.0, 0), ("d", 2, 2, "foot", 9.0, 0), ("d", 3, 3, "a", 1.0, 0), ("d", 4, 4, "12", 6.0, 1)], "doc_id string, flat_idx int, span_ord long, text string, size double, flags int")
    got = {r["flat_idx"]: r["category"] for r in classify.classify(blocks, spans, pages).collect()}
    assert got == {0: "ARTIFACT_FILIGREE", 1: "ARTIFACT_PAGE_HEADER", 2: "ARTIFACT_FOOTER", 3: "BOOK_PAGE_ANCHOR", 4: "CROSS_REFERENCE", 5: "UNCLASSIFIED", -1: "EMPTY_PAGE"}


def _items(spark, categories):
    return spark.createDataFrame([("d", k, c, 0, f"t{k}", [k]) for k, c in enumerate(categories)], "doc_id string, ord int, category string, page int, text string, block_indices array<int>")


def test_heading_stack_orphan(spark):
    nodes, warnings = reconstruct.assemble(_items(spark, ["HEADING_3", "HEADING_2", "BODY", "HEADING_1", "ARTICLE_HEADER", "ARTICLE_BODY", "BODY", "NOTE"]))
    parent = {r["node_id"]: r["parent_id"] for r in nodes.collect()}
    assert parent == {"node_0000": None, "node_0001": "node_0000", "node_0002": "node_0001", "node_0003": None, "node_0004": "node_0003", "node_0005": "node_0004", "node_0006": "node_0003", "node_0007": "node_0004"}
    assert [r["text"] for r in warnings.collect()] == ["reconstruct:orphan_heading_level_3_page_0"]
    order = [r["node_id"] for r in nodes.orderBy("ord").collect()]
    assert order.index("node_0007") < order.index("node_0006")  # the note attaches back below the article


def test_heading_stack_against_a_plain_one(spark):
    """Any order of categories: the windows give the forest of a stack kept step by step."""
    import random

    def plain(categories):
        parents, stack, article = [], [], None
        for k, c in enumerate(categories):
            top = stack[-1] if stack else None
            if c.startswith("HEADING"):
                level = int(c[-1])
                parents.append(stack[level - 2] if level > 1 and len(stack) >= level - 1 else None)
                stack[level - 1 :] = [k]
                article = None
            else:
                parents.append(top if c in ("ARTICLE_HEADER", "BODY") else top if article is None else article)
                article = k if c == "ARTICLE_HEADER" else article
        below: dict = {}
        for k, p in enumerate(parents):
            below.setdefault(p, []).append(k)
        order, todo = [], [(k, 0) for k in reversed(below.get(None, []))]
        while todo:
            k, depth = todo.pop()
            order.append((k, depth))
            todo += [(c, depth + 1) for c in reversed(below.get(k, []))]
        return parents, order

    rng = random.Random(3)
    kinds = [*(f"HEADING_{k}" for k in range(1, 10)), "ARTICLE_HEADER", "ARTICLE_BODY", "BODY", "NOTE"]
    docs = {f"d{k}": rng.choices(kinds, k=rng.randint(1, 60)) for k in range(30)}
    rows = [(d, i, c, 0, f"t{i}", [i]) for d, cs in docs.items() for i, c in enumerate(cs)]
    items = spark.createDataFrame(rows, "doc_id string, ord int, category string, page int, text string, block_indices array<int>")
    nodes = reconstruct.assemble(items)[0]
    ends = {}
    for r in reconstruct.subtree_end(nodes).collect():
        ends.setdefault(r["doc_id"], []).append(r)
    for d, cs in docs.items():
        parents, order = plain(cs)
        got = sorted(ends[d], key=lambda r: r["ord"])
        name = lambda k: None if k is None else f"node_{k:04d}"
        assert [(r["node_id"], r["depth"], r["parent_id"]) for r in got] == [(name(k), depth, name(parents[k])) for k, depth in order]
        for i, r in enumerate(got):
            assert r["subtree_end"] == next((j - 1 for j in range(i + 1, len(got)) if got[j]["depth"] <= r["depth"]), len(got) - 1)


def test_subtrees_of_any_depth(spark):
    """Chains far deeper than headings go, as legal XML nests them, with their page ranges and scopes."""
    rows = [("d", f"n{k}", k, k, k, "HEADING_1" if k % 7 == 0 else "LIST_ITEM", f"t{k}") for k in range(41)] + [("d", f"m{k}", 41 + k, k + 3, 50 + k, "LIST_ITEM", f"u{k}") for k in range(38)]
    nodes = spark.createDataFrame(rows, "doc_id string, node_id string, ord int, depth int, page_index int, category string, text string")
    got = {r["node_id"]: r["subtree_end"] for r in reconstruct.subtree_end(nodes).collect()}
    assert all(got[f"n{k}"] == (78 if k <= 2 else 40) for k in range(41)) and all(got[f"m{k}"] == 78 for k in range(38))
    ranges = {r["node_id"]: (r["first_page"], r["last_page"]) for r in reconstruct.outline_ranges(nodes).collect()}
    assert ranges == {"n0": (0, 87), **{f"n{k}": (k, 40) for k in range(7, 41, 7)}}
    scopes = {r["node_id"]: r["scopes"] for r in apparatus.with_scopes(nodes).collect()}
    assert scopes["n0"] == [] and scopes["n20"] == ["n0", "n7", "n14"] and scopes["m37"] == ["n0"]


def test_outline_of_any_level(spark):
    rows = [("d", k, level) for k, level in enumerate([1, 7, 9, 8, 3, 12, 7, 2, 1, 40])]
    got = [r["parent_ord"] for r in segments.outline_parents(spark.createDataFrame(rows, "doc_id string, ord int, level int")).orderBy("ord").collect()]
    assert got == [None, 0, 1, 1, 0, 4, 4, 0, None, 8]


def test_subtree_end(spark):
    nodes, _ = reconstruct.assemble(_items(spark, ["HEADING_1", "BODY", "HEADING_2", "BODY", "HEADING_1"]))
    assert [r["subtree_end"] for r in reconstruct.subtree_end(nodes).orderBy("ord").collect()] == [3, 1, 3, 3, 4]


def test_cross_reference_scopes(spark):
    rows = [("d", "n1", 1, "NOTE", "1. a", ["h1"]), ("d", "r1", 2, "CROSS_REFERENCE", "(1)", ["h1"]), ("d", "n2", 3, "NOTE", "1. b", ["h1", "h2"]), ("d", "r2", 4, "CROSS_REFERENCE", "1", ["h1"]), ("d", "r3", 5, "CROSS_REFERENCE", "1", ["h9"]), ("d", "r4", 6, "CROSS_REFERENCE", "x", [])]
    nodes = spark.createDataFrame(rows, "doc_id string, node_id string, ord int, category string, text string, scopes array<string>")
    got = {r["src_node_id"]: r["target_node_id"] for r in apparatus.bind_cross_references(nodes).collect()}
    assert got == {"r1": "n1", "r2": "n2", "r3": None, "r4": None}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30)), max_size=8), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30)), max_size=8))
def test_nearest_against_all(spark, sources, targets):
    s = spark.createDataFrame([(k, p, float(v)) for k, (p, v) in enumerate(sources)], "id int, page int, v double")
    t = spark.createDataFrame([(p, float(v), k) for k, (p, v) in enumerate(targets)], "page int, w double, o long")
    got = {r["id"]: r["target"] for r in apparatus.nearest(s, t, ["page"], "v", "w", "o").collect()}
    want = {k: min(((abs(v - w), o) for o, (q, w) in enumerate(targets) if q == p), default=(0, None))[1] for k, (p, v) in enumerate(sources)}
    assert got == want


def test_dispatch_ties_and_fallback(spark):
    docs = spark.createDataFrame([(1, 0.6), (2, 0.5)], "doc_id int, w double")
    make = lambda n: profile.Profile(n, (("x", lambda: F.col("w") > 0.55, 0.6),))
    got = {r["doc_id"]: r["profile_id"] for r in profile.dispatch(docs, (make("b"), make("a"))).collect()}
    assert got == {1: "b", 2: "unknown_generic"}


def test_all_profiles_score(spark):
    """Each profile's own kind of document, with the sum of the weights of what holds; else-penalties, gates and ties."""
    from foliant.schemas import SIGNALS

    def row(key, fonts, size=(500.0, 700.0), producer="", creator="", apparatus=(0, 0, 0, 0), outline=0, markers=()):
        return (key, fonts, apparatus, *size, producer, creator, "", outline > 0, outline, 0, list(markers))

    arial = [("ArialMT", 12.0, 80.0), ("Arial-BoldMT", 9.0, 5.0)]
    letter, code = (612.0, 792.0), (357.0, 547.0)
    rows = [
        row("compendio", [("TimesTenLTStd-Roman", 10.2, 75.0), ("TimesTen-Roman-SC700", 5.6, 1.0), ("TimesTen-Roman", 8.5, 2.0)], producer="Adobe PDF Library 9"),
        row("dottrina", [*arial, ("Arial-BoldMT", 13.0, 5.0)], letter, "Aspose.PDF for .NET", markers=[("dejure_banner_text", True, "DOTTRINA")]),
        row("nota", [*arial, ("Arial-BoldMT", 13.0, 5.0)], letter, "Aspose.PDF for .NET", markers=[("dejure_banner_text", True, "NOTE E DOTTRINA")]),
        row("massime", [*arial, ("Arial-BoldMT", 12.1, 5.0)], letter, "Aspose.PDF for .NET"),
        row("moderna", [("SimonciniGaramond", 9.0, 60.0), ("SimonciniGaramond-Italic", 7.5, 9.0), ("TimesNewRoman", 12.0, 1.0)], (481.0, 680.0)),
        row("storica", [("Times-Roman", 9.0, 40.0), ("Times-Italic", 7.5, 9.0)], (481.0, 700.0), "Acrobat Paper Capture"),
        row("codici", [("PalatinoLinotype", 7.48, 35.0)], code, "PDFsharp 1.50", apparatus=(0, 60, 0, 0), markers=[("giuffre_codici_banner_text", True, " Codice penale ")]),
        row("leggi", [("PalatinoLinotype", 7.48, 35.0)], code, markers=[("giuffre_codici_banner_text", True, "leggi")]),
        row("bic", [("Verdana", 12.0, 60.0)], producer="iLovePDF", outline=120),
        row("giappichelli", [("SimonciniGaramondStd", 10.98, 30.0)], (482.0, 682.0), creator="Adobe InDesign 20.0", apparatus=(0, 50, 0, 0), outline=100),
        row("diretto", [("MScotchRoman", 11.47, 50.0), ("TimesNewRomanPS-BoldMT", 12.97, 1.0)], apparatus=(50, 0, 0, 0)),
        row("wolters", [("TimesTenLTStd-Roman", 10.0, 30.0)], apparatus=(50, 50, 0, 0)),
        row("zanichelli", [("TimesNewRomanPSMT", 11.0, 71.0), ("Helvetica-Light", 9.0, 3.0)], (481.89, 680.31)),
        row("materiali", [("Calibri", 11.0, 70.0)], (596.0, 842.0), "Skia/PDF m120 Google Docs Renderer"),
        row("nothing", [("Garamond", 11.0, 90.0)]),
        row("wrong case", arial, letter, "aspose.pdf"),
        row("none", [], (None, None), None, None),
    ]
    want = {
        "compendio": ("compendio_utet", 0.95), "dottrina": ("dejure_dottrina", 0.8), "nota": ("dejure_nota_sentenza", 0.8), "massime": ("dejure_massime", 0.8), "moderna": ("enciclopedia_moderna", 0.7),
        "storica": ("enciclopedia_storica", 0.85), "codici": ("giuffre_codici", 1.0), "leggi": ("giuffre_codici", 0.75), "bic": ("manuale_bic", 0.75), "giappichelli": ("manuale_giappichelli", 0.9),
        "diretto": ("manuale_giuffre_diretto", 0.7), "wolters": ("manuale_utet_wolterskluwer", 0.85), "zanichelli": ("manuale_zanichelli_giuridica", 0.9), "materiali": ("materiali_studio", 0.75),
        "nothing": ("unknown_generic", 0.0), "wrong case": ("unknown_generic", 0.0), "none": ("unknown_generic", 0.0),
    }
    got = profile.dispatch(spark.createDataFrame(rows, SIGNALS)).collect()
    assert {r["doc_id"]: (r["profile_id"], round(r["confidence"], 6)) for r in got} == want
    scores = {r["doc_id"]: {x["profile_id"]: round(x["score"], 6) for x in r["scores"]} for r in got}
    assert scores["dottrina"]["dejure_nota_sentenza"] == 0.55 and scores["massime"]["dejure_dottrina"] == 0.5 and scores["dottrina"]["dejure_massime"] == 0.4
    assert scores["nothing"]["giuffre_codici"] == 0.0 and scores["wrong case"]["dejure_massime"] == 0.5


def test_dehyphenate_and_replay(spark):
    text = "una pa-\nrola e una stra-\nna cosa-\nxyz"
    nodes = spark.createDataFrame([("d", "n", 0, "BODY", text, None), ("d", "m", 0, "BODY", None, None)], "doc_id string, node_id string, page_index int, category string, text string, length_category string")
    out, log = repair.dehyphenate(nodes, spark.createDataFrame([("parola",), ("strana",)], "word string"))
    got = {r["node_id"]: r["text"] for r in out.collect()}
    assert got == {"n": "una parola e una strana cosa-\nxyz", "m": None}
    assert {r["node_id"]: r["text"] for r in repair.replay(out, log).collect()}["n"] == text


@pytest.mark.parametrize("held", [500_000, 0])
def test_dehyphenate_rewrites_once(spark, monkeypatch, held):
    """Nodes and log are read from a written table: texts aren't rewritten for each, nor in batches of thousands of rows. A lexicon beyond what workers hold gives the same."""
    monkeypatch.setattr(repair, "HELD", held)
    text = "una pa-\nrola, Pa-\nROLA, una stra-\nna cosa-\nxyz pa-\nrola-\ncosa"
    nodes = spark.createDataFrame([("d", "n", 0, "NOTE", text, None), ("e", "n", 0, "BODY", "pa-\nrola", None), (None, "m", 0, "BODY", None, None)], "doc_id string, node_id string, page_index int, category string, text string, length_category string")
    out, log = repair.dehyphenate(nodes, spark.createDataFrame([("parola",), ("strana",), (None,)], "word string"))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {"d": "una parola, PaROLA, una strana cosa-\nxyz parola-\ncosa", "e": "parola", None: None}
    assert [(r["seq"], r["start"], r["original"], r["normalized"]) for r in log.where("doc_id = 'd'").orderBy("seq").collect()] == [
        (0, 4, "pa-\nrola", "parola"), (1, 14, "Pa-\nROLA", "PaROLA"), (2, 28, "stra-\nna", "strana"), (3, 47, "pa-\nrola", "parola")
    ]
    for df in (out, log):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan
    assert repair.BATCH_ROWS <= 1000


NODE_ROWS = "doc_id string, node_id string, ord int, page_index int, category string, text string, length_category string"


def _undone(out, log, nodes):
    back = {(r["doc_id"], r["node_id"]): r["text"] for r in repair.replay(out, log).collect()}
    old = {(r["doc_id"], r["node_id"]): r["text"] for r in nodes.collect()}
    return all(old[k] == v for k, v in back.items())


def test_scanned_hyphens(spark):
    """Halves are joined into words of the lexicon, also misread ones; numbers, kept hyphens and single letters are left alone."""
    words = spark.createDataFrame([(w,) for w in ("parola", "giudice", "decretolegge", "alto", "norma", "cosa")], "word string")
    rows = [("a", "Pa-\nrola e pa-rola"), ("b", "giu-\nd1ce"), ("c", "decreto-legge"), ("d", "12-34"), ("e", "alt-o"), ("f", "NOR-\nMA"), ("g", "xyz-\nabc"), ("h", None)]
    nodes = spark.createDataFrame([("d", k, i, 0, "NOTE", t, None) for i, (k, t) in enumerate(rows)], NODE_ROWS)
    out, log = repair.dehyphenate_ocr(nodes, words)
    assert {r["node_id"]: r["text"] for r in out.collect()} == {"a": "Parola e parola", "b": "giudice", "c": "decreto-legge", "d": "12-34", "e": "alt-o", "f": "NORMA", "g": "xyz-\nabc", "h": None}
    assert _undone(out, log, nodes) and log.count() == 4


def test_scanned_words(spark):
    """Rewrites, labels and words of the lexicon; in the case of the text; not where two words are as near, nor inside what a rewrite has changed."""
    words = spark.createDataFrame([(w,) for w in ("comma", "giudice", "norma", "legge", "lotto", "letto", "citta", "umano")], "word string")
    rows = [
        ("a", "BODY", "il cornma e il Giud1ce"), ("b", "BODY", "10o euro, art. ll7 e 100· della citta"), ("c", "SECTION_LABEL", "LETTEHATURA e Sez. lII"), ("d", "BODY", "NORMA n0rma N0RMA"), ("e", "BODY", "l0tto"),
        ("f", "ARTIFACT_FOOTER", "cornma"), ("g", "BODY", "uma 12"), ("h", "NOTE", "perche •· cosi"), ("i", "BODY", None),
    ]
    nodes = spark.createDataFrame([("d", k, i, 0, c, t, None) for i, (k, c, t) in enumerate(rows)], NODE_ROWS)
    out, log = repair.normalize_ocr(nodes, words)
    got = {r["node_id"]: r["text"] for r in out.collect()}
    assert got == {"a": "il comma e il Giudice", "b": "100 euro, art. 117 e 100. della città", "c": "LETTERATURA e Sez. III", "d": "NORMA norma NORMA", "e": "lotto", "f": "cornma", "g": "uma 12", "h": "perché così", "i": None}
    assert _undone(out, log, nodes)


@pytest.mark.parametrize("held", [500_000, 0])
def test_scan_steps_read_what_they_wrote(spark, monkeypatch, held):
    """Both steps for scans rewrite texts once, whether workers hold the corrections or they come with each node."""
    monkeypatch.setattr(repair, "HELD", held)
    words = spark.createDataFrame([("parola",), ("giudice",), ("comma",)], "word string")
    nodes = spark.createDataFrame([("d", "a", 0, 0, "BODY", "pa-\nrola giu-\nd1ce 12-34 cornma perche", None), ("d", "b", 1, 0, "BODY", None, None)], NODE_ROWS)
    for step, want, n in ((repair.dehyphenate_ocr, "parola giudice 12-34 cornma perche", 2), (repair.normalize_ocr, "pa-\nrola giù-\nd1ce 12-34 comma perché", 3)):
        out, log = step(nodes, words)
        assert {r["node_id"]: r["text"] for r in out.collect()} == {"a": want, "b": None} and _undone(out, log, nodes) and log.count() == n
        for df in (out, log):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan


def test_post_processing_by_profile(spark):
    """Each document gets the steps of its profile, in order, with one log that says what was done; unknown steps are an error."""
    words = spark.createDataFrame([("parola",), ("comma",)], "word string")
    rows = [(d, f"n{k}", k, k, "NOTE", t, None) for d in ("scan", "plain", "none") for k, t in enumerate(["(1) pa-\nrola", "cornma due", "(2) tre"])]
    nodes = spark.createDataFrame(rows, NODE_ROWS)
    chosen = spark.createDataFrame([("scan", "enciclopedia_storica"), ("plain", "dejure_dottrina")], "doc_id string, profile_id string")
    steps = {p.name: p.steps for p in profile.PROFILES}
    out, log = repair.post_process(nodes, chosen, words, steps)
    got = {}
    for r in out.orderBy("doc_id", "ord").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {"scan": ["(1) parola comma due", "(2) tre"], "plain": ["(1) parola", "cornma due", "(2) tre"], "none": ["(1) pa-\nrola", "cornma due", "(2) tre"]}
    assert [(r["doc_id"], r["step_id"]) for r in log.orderBy("doc_id", "turn").collect()] == [("plain", "dehyphenate_with_log"), ("scan", "dehyphenate_with_log"), ("scan", "normalize_ocr_with_dictionary"), ("scan", "merge_cross_page_notes")]
    with pytest.raises(KeyError):
        repair.post_process(nodes, chosen, words, {"x": ("no such step",)})


def test_merges_replay(spark):
    """Notes joined over several pages, and chains of ellipses, come apart again."""
    notes = spark.createDataFrame([("d", k, f"n{k}", k, t) for k, t in enumerate(["1. a b", "c d", "e", "2. f", "g"])], "doc_id string, ord int, node_id string, page_index int, text string")
    out, log = repair.merge_cross_page_notes(notes)
    assert [r["text"] for r in out.orderBy("ord").collect()] == ["1. a b c d e", "2. f g"]
    assert {r["node_id"]: r["text"] for r in repair.replay(out, log).collect()} == {"n0": "1. a b", "n3": "2. f"}
    assert sorted((r["node_id"], r["merged_from"][0], r["normalized"][1:]) for r in log.collect()) == [("n0", "n1", "c d"), ("n0", "n2", "e"), ("n3", "n4", "g")]
    heads = spark.createDataFrame([("d", k, f"n{k}", 0, t) for k, t in enumerate(["Uno ...", "... due …", "… tre", "solo ..."])], "doc_id string, ord int, node_id string, page_index int, text string")
    out, log = repair.recompose_with_log(heads)
    assert [r["text"] for r in out.orderBy("ord").collect()] == ["Uno due tre", "solo ..."]
    assert {r["node_id"]: r["text"] for r in repair.replay(out, log).collect()} == {"n0": "Uno ...", "n3": "solo ..."}


def test_every_match_in_context(spark):
    got = repair.matches_in_context(spark.createDataFrame([("d", "ab ab xx ab")], "doc_id string, text string"), "p", "ab", 2).collect()
    assert [(r["seq"], r["position"], r["context"]) for r in got] == [(0, 1, "ab a"), (1, 4, "b ab x"), (2, 10, "x ab")]


def test_notes_across_pages(spark):
    rows = [("d", 0, "a", 0, "1. uno"), ("d", 1, "b", 1, "continua"), ("d", 2, "c", 1, "2. due"), ("d", 3, "e", 3, "dopo")]
    merged, log = repair.merge_cross_page_notes(spark.createDataFrame(rows, "doc_id string, ord int, node_id string, page_index int, text string"))
    assert [r["text"] for r in merged.orderBy("ord").collect()] == ["1. uno continua", "2. due", "dopo"]
    assert [(r["node_id"], r["start"], r["merged_from"]) for r in log.collect()] == [("a", 6, ["b"])]


def test_ellipsis_chain_must_end(spark):
    rows = [("d", 0, "a", "uno..."), ("d", 1, "b", "…due…"), ("d", 2, "c", "...tre"), ("e", 0, "a", "uno..."), ("e", 1, "b", "…due…")]
    got = repair.recompose_ellipses(spark.createDataFrame(rows, "doc_id string, ord int, node_id string, text string")).orderBy("doc_id", "ord").collect()
    assert [r["text"] for r in got] == ["uno due tre", "uno...", "…due…"]


def test_correction_needs_one_word(spark):
    lexicon = spark.createDataFrame([("legge",), ("modo",), ("nodo",)], "word string")
    tokens = spark.createDataFrame([("1egge",), ("lbgge",), ("zzzz",), ("legge",)], "token string")
    assert {r["token"]: r["correction"] for r in repair.correct_tokens(tokens, lexicon).collect()} == {"1egge": "legge", "lbgge": "legge"}


def test_overlaps_and_furniture(spark):
    m = spark.createDataFrame([("d", 0, 5), ("d", 0, 3), ("d", 4, 8), ("d", 5, 6)], "doc_id string, start int, end int")
    assert sorted((r["start"], r["end"]) for r in repair.resolve_overlaps(m, ["doc_id"]).collect()) == [(0, 5), (5, 6)]
    lines = spark.createDataFrame([("d", p, f"Capo {p}", 0.05) for p in range(6)] + [("d", p, str(p + 10), 0.97) for p in range(6)] + [("d", p, f"testo {'x' * p}", 0.3 + p / 20) for p in range(6)], "doc_id string, page int, text string, y double")
    pages = spark.createDataFrame([("d", 6)], "doc_id string, n_pages int")
    assert furniture.folios(lines).first()["offset"] == 10
    assert furniture.drop_furniture(lines, pages).count() == 6


def test_sentences_and_packing():
    text = "L'art. 5 vale. È così? Sì! Il sig. Rossi e G. Verdi. fine"
    assert segments.split_sentences(text) == ["L'art. 5 vale.", "È così?", "Sì!", "Il sig. Rossi e G. Verdi. fine"]
    assert segments.split_sentences(None) == []
    assert segments.pack_sentences(["aa", "bb", "c" * 9, "d"], 5) == ["aa bb", "c" * 9, "d"]
    assert len(segments.refresher("parola " * 100, 600)) <= 180


def test_segments_skip_subtrees(spark):
    nodes, _ = reconstruct.assemble(_items(spark, ["HEADING_1", "BODY", "TOC_GENERAL", "NOTE"]))
    assert [r["role"] for r in segments.build_segments(nodes).orderBy("ord").collect()] == ["HEADING_1", "BODY", "NOTE"]


def test_reports(spark):
    a = spark.createDataFrame([("x", 10), ("y", 3), ("z", 0)], "category string, n long")
    b = spark.createDataFrame([("x", 10), ("y", 4), ("w", 2), ("z", 0)], "category string, n long")
    got = {r["category"]: (r["band"], r["relative_delta"]) for r in reports.compare_counts(a, b).collect()}
    assert got == {"x": ("EXACT", 0.0), "y": ("DIVERGENT", 0.25), "w": ("DIVERGENT", 1.0)}
    s = reports.produced_summary(reports.compare_counts(a, b)).first()
    assert s["max_delta"] == 1.0 and not s["all_within"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 300)), max_size=6), st.lists(st.tuples(st.integers(0, 300), st.integers(0, 300)), max_size=6))
def test_overlapping_against_all(spark, a, b):
    make = lambda rows: spark.createDataFrame([("s", k, x, y) for k, (x, y) in enumerate(rows)], "seg string, id int, start int, end int")
    got = sorted((r["a_id"], r["b_id"]) for r in library.overlapping(make(a), make(b), ["seg"]).collect())
    assert got == sorted((i, j) for i, p in enumerate(a) for j, q in enumerate(b) if min(p) <= max(q) and min(q) <= max(p))


def test_tags(spark):
    rows = spark.createDataFrame([("a", ["x", "q", "y"]), ("b", []), ("c", ["q"])], "id string, tag_ids array<string>")
    tags = spark.createDataFrame([("y",), ("x",)], "id string")
    assert {r["id"]: r["tag_ids"] for r in library.known_tags(rows, tags).collect()} == {"a": ["x", "y"], "b": [], "c": []}
    assert {r["id"] for r in library.with_any_tag(rows, ["q"]).collect()} == {"a", "c"}


AKN = b"""<akomaNtoso xmlns="x"><act><body><chapter><num>Capo I</num><heading>Norme</heading><article eId="a1"><num>Art. 1</num><paragraph><content><p>Testo  uno.</p></content></paragraph>
<paragraph><content><p>Nota <authorialNote><p>una nota</p></authorialNote></p></content></paragraph></article></chapter></body></act></akomaNtoso>"""


def test_xml(spark):
    files = spark.createDataFrame([("a", bytearray(AKN)), ("b", bytearray(b"<html/>")), ("c", bytearray(b"<x"))], "path string, content binary")
    assert {r["path"]: r["verdict"] for r in structured.xml_health(files).collect()} == {"a": "OK", "b": "NOT_AKN", "c": "INVALID_XML"}
    got = [(r["category"], r["text"]) for r in structured.parse_xml(files).orderBy("ord").collect()]
    assert got[:3] == [("HEADING_2", "Capo I Norme"), ("ARTICLE_HEADER", "Art. 1"), ("ARTICLE_BODY", "Testo uno.")] and ("NOTE", "una nota") in got


def test_epub(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("O/a.xhtml", '<h2 class="article-num-akn big">1</h2>')
        z.writestr("X/b.xhtml", "<p/>")
    files = spark.createDataFrame([("a", bytearray(buffer.getvalue())), ("b", bytearray(b"no"))], "path string, content binary")
    pages = structured.epub_pages(files)
    assert [r["href"] for r in pages.where("path = 'a'").orderBy("page_index").collect()] == ["a.xhtml", "b.xhtml"]
    assert {r["path"]: r["verdict"] for r in structured.epub_health(pages).collect()} == {"a": "OK_STRUCTURED", "b": "INVALID"}


def test_contract_nests(spark):
    import json

    nodes, warnings = reconstruct.assemble(_items(spark, ["HEADING_1", "BODY"]))
    edits = spark.createDataFrame([], "doc_id string, seq int, step_id string")
    out = json.loads(structured.contract(spark.createDataFrame([("d",)], "doc_id string"), nodes, edits, warnings).first()["json"])
    assert out["structure"][0]["children"][0]["type"] == "BODY" and out["warnings"] == []


def test_ingest(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id int, t string").write.parquet(str(tmp_path / "in"))
    q = incremental.ingest(spark, str(tmp_path / "in"), "id int, t string", lambda d: d.withColumn("u", F.upper("t")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first()["u"] == "A"
