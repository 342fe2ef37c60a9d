"""Signals of a document's typography, weighted scores of profiles, and the choice among them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: least confidence of a profile; below it the fallback is taken.
LEAST = 0.6
FALLBACK = "unknown_generic"


def font_dominance(spans: DataFrame, top: int = 25) -> DataFrame:
    """Share of characters of each (font, size rounded to 2 places), in percent, the ``top`` of each document."""
    by = spans.groupBy("doc_id", "font", F.round("size", 2).alias("size")).agg(F.sum(F.length("text")).alias("chars"))
    total = F.sum("chars").over(Window.partitionBy("doc_id"))
    ranked = by.withColumn("dominance_percent", 100.0 * F.col("chars") / total).withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("chars"), "font", "size")))
    return ranked.where(F.col("rank") <= top)


def fonts_of(spans: DataFrame) -> DataFrame:
    """``doc_id, fonts``: the dominant fonts as the array the predicates below take."""
    rows = font_dominance(spans)
    fonts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "font", "size", "dominance_percent"))), lambda s: F.struct(s["font"].alias("family"), s["size"].alias("size"), s["dominance_percent"].alias("dominance_percent")))
    return rows.groupBy("doc_id").agg(fonts.alias("fonts"))


def has_font(family: Callable[[Column], Column], size: float | None = None, within: float = 0.1, share: float = 0.0) -> Column:
    """A font of a family, of a size strictly within the tolerance and at least the share of characters."""
    return F.exists("fonts", lambda f: family(f["family"]) & (F.lit(True) if size is None else F.abs(f["size"] - size) < within) & (f["dominance_percent"] >= share))


def begins(prefix: str) -> Callable[[Column], Column]:
    return lambda family: family.startswith(prefix)


def named(*names: str) -> Callable[[Column], Column]:
    return lambda family: family.isin(*names)


def stem(name: str) -> Callable[[Column], Column]:
    """What stands before the first dash is the name."""
    return lambda family: F.substring_index(family, "-", 1) == name


def band_dominance(low: float, high: float, least: float, prefix: str = "") -> Column:
    """Fonts of sizes from low to high, both included, together reach the share."""
    inside = F.filter("fonts", lambda f: f["size"].between(low, high) & f["family"].startswith(prefix))
    return F.aggregate(inside, F.lit(0.0), lambda acc, f: acc + f["dominance_percent"]) >= least


def page_size(width: float, height: float, tolerance: float, strict: bool = False) -> Column:
    dx, dy = F.abs(F.col("width_pt") - width), F.abs(F.col("height_pt") - height)
    return (dx < tolerance) & (dy < tolerance) if strict else (dx <= tolerance) & (dy <= tolerance)


def page_between(width: tuple[float, float], height: tuple[float, float]) -> Column:
    return F.col("width_pt").between(*width) & F.col("height_pt").between(*height)


def made_by(text: str, *fields: str) -> Column:
    """The producer or creator (or only the fields named) contains a text, in this case."""
    out = F.lit(False)
    for field_ in fields or ("producer", "creator"):
        out = out | F.trim(F.coalesce(F.col(field_), F.lit(""))).contains(text)
    return out


def marker_value(name: str, present: bool = False) -> Column:
    """Value of the first marker of a name, with ``present`` of the first one that is present and has a value; null without one."""
    first = F.filter("specific_markers", lambda m: (m["name"] == name) & ((m["present"] & m["value"].isNotNull()) if present else F.lit(True)))
    return F.try_element_at(first, F.lit(1))["value"]


Signal = tuple[str, Callable[[], Column], float]


@dataclass(frozen=True)
class Profile:
    """A named, ordered list of weighted predicates and the refinements of a family of documents.

    ``steps`` names post-processing steps; ``refine`` maps classified blocks to classified blocks; without ``needs`` the score is 0.
    """

    name: str
    signals: tuple[Signal, ...] = ()
    steps: tuple[str, ...] = ()
    refine: Callable[[DataFrame], DataFrame] | None = None
    layouts_disabled: tuple[str, ...] = field(default=())
    needs: Callable[[], Column] | None = None

    def score(self) -> Column:
        """Weights of the predicates that hold, added in the declared order, kept within 0 and 1."""
        total = F.lit(0.0)
        for _, test, weight in self.signals:
            total = total + F.when(test(), weight).otherwise(0.0)
        total = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(total, 6)))
        return total if self.needs is None else F.when(self.needs(), total).otherwise(0.0)


def at_least(name: str, least: int) -> Column:
    """A counter of the apparatus reaches a number."""
    return F.col(f"apparatus.{name}") >= least


def _arial_exports(*more: Signal) -> tuple[Signal, ...]:
    """What the three exports set in Arial have in common."""
    body = lambda: has_font(begins("ArialMT"), 12.0, 0.15, 40.0)
    return (
        ("arial body", body, 0.30), ("no arial body", lambda: ~body() & ~has_font(begins("Arial"), share=40.0), -0.40), ("exporter", lambda: made_by("Aspose.PDF"), 0.20),
        ("letter page", lambda: page_size(612.0, 792.0, 1.0, strict=True), 0.10), ("small bold", lambda: has_font(begins("Arial-BoldMT"), 9.0, 0.15), 0.10),
        ("marginal headings", lambda: at_least("marginal_headings", 50), -0.20), *more,
    )


_TITLE: Callable[[], Column] = lambda: has_font(begins("Arial-BoldMT"), 13.0, 0.15)
_EXPORT_BANNER = "dejure_banner_text"
_CODE_BANNER: Callable[[], Column] = lambda: F.upper(F.trim(F.coalesce(marker_value("giuffre_codici_banner_text", present=True), F.lit(""))))


def _or_else(name: str, test: Callable[[], Column], weight: float, other: float) -> tuple[Signal, Signal]:
    """A weight if a test holds, and another if it doesn't."""
    return (name, test, weight), (f"not {name}", lambda: ~test(), other)


#: Profiles in the order that breaks ties. Names of fonts, programs and markers, sizes, shares, counts and weights are fixed values.
PROFILES: tuple[Profile, ...] = (
    Profile("compendio_utet", (
        ("body", lambda: has_font(begins("TimesTenLTStd"), 10.2, 0.1, 70.0), 0.45), ("small capitals", lambda: has_font(lambda f: f.contains("SC700")), 0.20),
        ("contents font", lambda: has_font(stem("TimesTen"), 8.5, 0.1), 0.10), ("programs", lambda: made_by("PDF Library", "producer") | made_by("InDesign CS", "creator"), 0.05),
        ("no outline", lambda: ~F.col("has_outline"), 0.05), ("apparatus", lambda: at_least("footnote_markers", 50) | at_least("marginal_headings", 50), -0.30),
        ("no apparatus", lambda: ~at_least("footnote_markers", 1) & ~at_least("marginal_headings", 1), 0.10))),
    Profile("dejure_dottrina", _arial_exports(
        *_or_else("title", _TITLE, 0.10, -0.20), ("banner of the other genre", lambda: F.coalesce(marker_value(_EXPORT_BANNER) == "NOTE E DOTTRINA", F.lit(False)), -0.25)), ("dehyphenate_with_log",)),
    Profile("dejure_massime", _arial_exports(
        ("bold at body size", lambda: has_font(begins("Arial-BoldMT"), 12.0, 0.15), 0.10), ("title", _TITLE, -0.30)), ("dehyphenate_with_log",)),
    Profile("dejure_nota_sentenza", _arial_exports(
        *_or_else("title", _TITLE, 0.10, -0.20), ("banner of the other genre", lambda: F.coalesce(marker_value(_EXPORT_BANNER) == "DOTTRINA", F.lit(False)), -0.25)), ("dehyphenate_with_log",)),
    Profile("enciclopedia_moderna", (
        *_or_else("body", lambda: has_font(named("SimonciniGaramond"), 9.0, 0.15, 30.0), 0.45, -0.40), ("notes", lambda: has_font(named("SimonciniGaramond", "SimonciniGaramond-Italic"), 7.5, 0.15), 0.10),
        ("bold heads", lambda: has_font(named("SimonciniGaramond-Bold"), 9.0, 0.15), 0.05), ("footer", lambda: has_font(named("TimesNewRoman"), 12.0, 0.15), 0.10),
        ("copyright", lambda: has_font(begins("Helvetica-Bold"), 6.0, 0.15), 0.10), ("page", lambda: page_between((475.0, 580.0), (670.0, 730.0)), 0.05),
        ("marginal headings", lambda: at_least("marginal_headings", 200), -0.20)), ("dehyphenate_with_log", "merge_cross_page_notes")),
    Profile("enciclopedia_storica", (
        ("scanner", lambda: made_by("Paper Capture"), 0.45), ("times body", lambda: band_dominance(8.0, 9.7, 30.0, "Times"), 0.20),
        ("other body", lambda: ~band_dominance(8.0, 9.7, 30.0, "Times") & has_font(lambda f: ~f.startswith("Times"), share=30.0), -0.40),
        ("italic notes", lambda: F.exists("fonts", lambda f: (f["family"] == "Times-Italic") & f["size"].between(7.0, 8.0)), 0.10),
        ("page", lambda: page_between((475.0, 515.0), (690.0, 735.0)), 0.10), ("garamond", lambda: has_font(begins("SimonciniGaramond")), -0.30)),
        ("dehyphenate_with_log", "dehyphenate_ocr_aggressive", "normalize_ocr_with_dictionary", "merge_cross_page_notes")),
    Profile("giuffre_codici", (
        ("penal banner", lambda: _CODE_BANNER().contains("PENALE"), 0.50), ("civil banner", lambda: ~_CODE_BANNER().contains("PENALE") & _CODE_BANNER().contains("CIVILE"), 0.50),
        ("laws banner", lambda: ~_CODE_BANNER().rlike("PENALE|CIVILE") & _CODE_BANNER().contains("LEGGI"), 0.40), *_or_else("body", lambda: has_font(begins("PalatinoLinotype"), 7.48, 0.1, 30.0), 0.20, -0.30),
        ("page", lambda: page_size(357.17, 547.09, 5.0, strict=True), 0.15), ("program", lambda: made_by("PDFsharp"), 0.05), ("many notes", lambda: at_least("footnote_markers", 50), 0.10)), ("dehyphenate_with_log",)),
    Profile("manuale_bic", (
        ("body", lambda: F.lit(True), 0.50), ("program", lambda: made_by("iLovePDF", "producer"), 0.15), ("outline", lambda: F.col("has_outline") & (F.col("entries_count") >= 100), 0.10)),
        ("dehyphenate_with_log",), needs=lambda: has_font(begins("Verdana"), 12.0, 0.15, 50.0)),
    Profile("manuale_giappichelli", (
        ("body", lambda: has_font(begins("SimonciniGaramondStd"), 10.98, 0.1, 25.0), 0.30), *_or_else("family", lambda: has_font(begins("SimonciniGaramondStd")), 0.20, -0.30), ("notes", lambda: at_least("footnote_markers", 50), 0.20),
        ("program", lambda: made_by("InDesign 20", "creator") | made_by("Adobe Photoshop", "creator"), 0.10), ("page", lambda: page_size(482.0, 680.0, 2.0), 0.05), ("outline", lambda: F.col("entries_count") >= 100, 0.05)),
        ("dehyphenate_with_log", "merge_cross_page_notes")),
    Profile("manuale_giuffre_diretto", (
        *_or_else("body", lambda: has_font(begins("MScotchRoman"), 11.47, 0.15, 40.0), 0.35, -0.20), ("marginal headings", lambda: at_least("marginal_headings", 50), 0.25),
        ("filigree", lambda: has_font(begins("TimesNewRoman"), 15.35, 0.15) | F.exists("specific_markers", lambda m: m["present"] & F.coalesce(m["value"], F.lit("")).rlike("(?iu)Versione riservata|Biblioteca\\s+It\\.\\s+Ciechi|©\\s*Giuffr[èe]")), 0.15),
        ("part heads", lambda: has_font(begins("TimesNewRomanPS-BoldMT"), 12.97, 0.15), 0.10), ("program", lambda: made_by("PDFsharp"), 0.05), ("notes", lambda: at_least("footnote_markers", 50), -0.30)), ("dehyphenate_with_log",)),
    Profile("manuale_utet_wolterskluwer", (
        ("body", lambda: has_font(begins("TimesTenLTStd"), 10.0, 0.1, 25.0), 0.40), ("notes", lambda: at_least("footnote_markers", 50), 0.25), ("marginal headings", lambda: at_least("marginal_headings", 50), 0.15),
        ("boxes", lambda: at_least("italic_9pt_blocks", 50), 0.10), ("programs", lambda: made_by("PDF Library", "producer") | made_by("InDesign", "creator"), 0.05), ("no outline", lambda: ~F.col("has_outline"), 0.05),
        ("no apparatus", lambda: ~at_least("footnote_markers", 1) & ~at_least("marginal_headings", 1) & ~at_least("italic_9pt_blocks", 1), -0.30)), ("dehyphenate_with_log", "recompose_marginal_ellipsis")),
    Profile("manuale_zanichelli_giuridica", (
        ("body", lambda: has_font(begins("TimesNewRomanPS"), 11.0, 0.1, 70.0), 0.50), ("summary", lambda: has_font(begins("Helvetica"), 9.0, 0.1), 0.20),
        ("no metadata", lambda: F.trim(F.concat(F.coalesce("producer", F.lit("")), F.coalesce("creator", F.lit("")))) == "", 0.10), ("page", lambda: page_size(481.89, 680.31, 1.0), 0.05),
        ("no outline", lambda: ~F.col("has_outline"), 0.05))),
    Profile("materiali_studio", (
        ("program", lambda: F.lit(True), 0.40), ("body", lambda: has_font(lambda f: f.startswith("Arial") | f.startswith("Calibri"), share=60.0), 0.20),
        *_or_else("page", lambda: page_between((594.0, 597.0), (840.0, 843.0)) | page_between((611.0, 613.0), (791.0, 793.0)), 0.15, -0.10),
        ("publisher's programs", lambda: _any_of("Aspose.PDF", "PDFsharp", "Acrobat Distiller", "Paper Capture", "ABCpdf", "iLovePDF", "PScript5", "Adobe PDF Library", "Adobe InDesign"), -0.25),
        ("apparatus", lambda: at_least("marginal_headings", 50) | at_least("footnote_markers", 50), -0.20)),
        ("dehyphenate_with_log",), needs=lambda: (made_by("Skia/PDF", "producer") & made_by("Google Docs", "producer")) | _any_of("Microsoft® Word", "Microsoft Word")),
    Profile(FALLBACK),
)


def _any_of(*programs: str) -> Column:
    """Producer and creator, one after the other, contain any of the texts."""
    both = F.concat(F.trim(F.coalesce("producer", F.lit(""))), F.lit(" "), F.trim(F.coalesce("creator", F.lit(""))))
    return F.exists(F.array(*map(F.lit, programs)), lambda x: both.contains(x))


def dispatch(signals: DataFrame, profiles: tuple[Profile, ...] = PROFILES, least: float = LEAST) -> DataFrame:
    """Signals with every profile's score, and the best (ties: declared order) or the fallback below ``least``.

    All profiles are columns of one projection: no cross join.
    """
    scored = signals.withColumn("scores", F.array(*[F.struct(p.score().alias("score"), F.lit(-k).alias("turn"), F.lit(p.name).alias("profile_id")) for k, p in enumerate(profiles)]))
    best = F.array_max("scores")
    return scored.withColumn("profile_id", F.when(best["score"] >= least, best["profile_id"]).otherwise(FALLBACK)).withColumn("confidence", F.when(best["score"] >= least, best["score"]).otherwise(0.0))


def body_size(lines: DataFrame) -> DataFrame:
    """The largest size, in half points, that has at least half as many characters as the commonest."""
    by = lines.groupBy("doc_id", (F.round(F.col("font_size") * 2) / 2).alias("size")).agg(F.sum(F.length("text")).alias("chars"))
    top = F.max("chars").over(Window.partitionBy("doc_id"))
    return by.withColumn("top", top).where(F.col("chars") * 2 >= F.col("top")).groupBy("doc_id").agg(F.max("size").alias("body_size"))


def most_of(rows: DataFrame, keys: list[str], value: str, weight: Column, order: str) -> DataFrame:
    """The value with the largest weight for each key; of equal ones the first seen."""
    by = rows.groupBy(*keys, value).agg(F.sum(weight).alias("w"), F.min(order).alias("o"))
    return by.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("w"), -F.col("o"))).alias(value))


def line_summary(spans: DataFrame) -> DataFrame:
    """Each line's weighted mean size, bold and italic (60 % of characters or more) and commonest colour."""
    n = F.length("text")
    share = lambda bit: F.sum(F.when(F.col("flags").bitwiseAND(F.lit(bit)) != 0, n).otherwise(0)) >= 0.6 * F.sum(n)
    keys = ["doc_id", "page", "block_index", "line_index"]
    own = spans.groupBy(*keys).agg((F.sum(F.col("size") * n) / F.sum(n)).alias("font_size"), share(16).alias("bold"), share(2).alias("italic"))
    return own.join(most_of(spans, keys, "color", n, "span_ord"), keys)
