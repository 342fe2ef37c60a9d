"""Explicit schemas of the page, node, edit-log and catalogue tables. Every table is keyed by ``doc_id``; recursion is flattened."""

from __future__ import annotations

_BOX = "x0 double, y0 double, x1 double, y1 double"

SPANS = f"doc_id string, page int, block_index int, line_index int, span_index int, span_ord long, text string, font string, size double, flags int, color int, {_BOX}"
BLOCKS = f"doc_id string, flat_idx int, page int, block_index int, {_BOX}, span_start int, span_end int"
PAGES = "doc_id string, page int, width_pt double, height_pt double, rotation int"
PAGE_IMAGES = "doc_id string, page int, count int, has_full_page_image boolean, bboxes array<struct<x0:double,y0:double,x1:double,y1:double>>"
DRAWINGS = f"doc_id string, page int, {_BOX}, kind string"
CLASSIFIED = "doc_id string, flat_idx int, page int, category string, subcategory string, reason string"
NODES = (
    "doc_id string, node_id string, parent_id string, ord int, depth int, sibling_idx int, category string, page_index int, text string, level int, block_indices array<int>, "
    "items array<struct<number:string,title:string>>, toc_items array<struct<number:string,title:string,page_number:int>>, length_category string"
)
REFS = "doc_id string, src_node_id string, kind string, target_node_id string, source_marker string, seq int"
TRANSFORMATIONS = "doc_id string, seq int, step_id string, node_id string, page_index int, start int, end int, original string, normalized string, split_into array<string>, merged_from array<string>"
WARNINGS = "doc_id string, seq int, text string"
SIGNALS = (
    "doc_id string, fonts array<struct<family:string,size:double,dominance_percent:double>>, apparatus struct<marginal_headings:int,footnote_markers:int,italic_9pt_blocks:int,summary_markers:int>, "
    "width_pt double, height_pt double, producer string, creator string, creation_date string, has_outline boolean, entries_count int, depth_levels int, "
    "specific_markers array<struct<name:string,present:boolean,value:string>>"
)
LINES = "doc_id string, page int, line_idx int, text string, font_size double, bold boolean, italic boolean, color string, x0 double, x1 double, y_top double, y_bottom double"
SEGMENTS = "doc_id string, ord int, segment_id string, role string, text string, length_category string, acoustic_intro string, memory_refresh string, page_number int"

#: The closed set of semantic categories.
CATEGORIES = tuple(
    """HEADING_1 HEADING_2 HEADING_3 HEADING_4 ARTICLE_HEADER ARTICLE_BODY PROCEDURAL BODY BODY_CONTINUATION NOTE NOTE_CONTINUATION
    MARGINAL_HEADING MARGINAL_GLOSS EXAMPLE_BOX CHAPTER_SUMMARY TOC_GENERAL INDEX_ENTRY EDITORIAL_NOTE MASSIMA_LABEL REFERRAL TITLE
    FONTE_LABEL FONTE_VALUE META_LABEL META_VALUE AUTHORS SECTION_LABEL GENRE_BANNER SUBTITLE HEADING_LETTER_INITIAL FONTI LETTERATURA
    AMENDMENT QUOTED_TEXT_OLD QUOTED_TEXT_NEW UPDATE_BLOCK CROSS_REFERENCE LIST_ITEM BOOK_PAGE_ANCHOR ARTIFACT_RUNNING_HEADER
    ARTIFACT_FOOTER ARTIFACT_FILIGREE ARTIFACT_STAMP ARTIFACT_PAGE_HEADER EMPTY_PAGE UNCLASSIFIED""".split()
)
#: Bits of a span's flags.
SUPERSCRIPT, ITALIC, SERIF, MONOSPACE, BOLD = 1, 2, 4, 8, 16
