"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds (exclusive) of the note length classes, in characters.
LENGTH_CLASSES = ((50, "MICRO"), (100, "SHORT"), (500, "MEDIUM"), (1000, "LONG"), (3000, "VERY_LONG"))
LONGEST = "MEGA"
#: Markers of notes and references.
LEADING_MARKER = "^\\s*\\(?\\d+\\)\\s*"
NOTE_MARKER = "^\\s*\\(?(\\d+)\\)?[\\.\\s]"
REFERENCE_DIGITS = "^\\s*\\(?(\\d+)\\)?\\s*$"
LEADING_PARENTHESISED = "^\\((\\d+)\\)"
INLINE_PARENTHESISED = "(?<![(\\d])\\((\\d+)\\)"
ORDINALS = "Primo|Secondo|Terzo|Quarto|Quinto|Sesto|Settimo|Ottavo|Nono|Decimo|Undicesimo|Dodicesimo|Tredicesimo|Quattordicesimo|Quindicesimo|Sedicesimo|Diciassettesimo|Diciottesimo|Diciannovesimo|Ventesimo"
#: Heading patterns, first match wins.
HEADINGS = (
    ("CHAPTER", "(?U)^CAPITOLO\\s+[IVXLCDM]+(?:-BIS|-TER)?\\b"),
    ("CHAPTER", f"(?U)^Capitolo\\s+(?:{ORDINALS})$"),
    ("SUB_PARAGRAPH", "(?U)^\\d+\\.\\d+\\.\\s+\\w"),
    ("PARAGRAPH", "(?U)^§\\s*\\d+(?:-bis|-ter)?\\.\\s+\\w"),
    ("PARAGRAPH", "(?U)^\\d+\\.\\s+\\w"),
)
ROMAN = "^(?=[MDCLXVI])M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"


def strip(text: Column) -> Column:
    """Without white space at both ends; Spark's trim takes spaces only."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def _bucket(n: Column) -> Column:
    out = F.when(n < LENGTH_CLASSES[0][0], LENGTH_CLASSES[0][1])
    for limit, name in LENGTH_CLASSES[1:]:
        out = out.when(n < limit, name)
    return out.otherwise(LONGEST)


def note_length(text: Column) -> Column:
    """Length class of a note without its leading marker; null when nothing is left."""
    n = F.length(strip(F.regexp_replace(text, LEADING_MARKER, "")))
    return F.when(n > 0, _bucket(n))


def utf16_length(text: Column) -> Column:
    """Code units: characters beyond the basic plane count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, "[^\\x{10000}-\\x{10FFFF}]", ""))


def note_length_units(text: Column) -> Column:
    """Length class of the trimmed text in UTF-16 units; never null for text."""
    return _bucket(utf16_length(strip(text)))


def heading_kind(text: Column) -> Column:
    """CHAPTER, SUB_PARAGRAPH, PARAGRAPH or null."""
    out = F.when(text.rlike(HEADINGS[0][1]), HEADINGS[0][0])
    for name, pattern in HEADINGS[1:]:
        out = out.when(text.rlike(pattern), name)
    return out


def marker(text: Column, pattern: str = NOTE_MARKER) -> Column:
    """Number of the marker a text begins with, else null."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")


def inline_markers(text: Column) -> Column:
    """Numbers of all ``(N)`` in a text that don't follow a digit or parenthesis."""
    return F.transform(F.regexp_extract_all(text, F.lit(INLINE_PARENTHESISED), F.lit(1)), lambda x: x.cast("int"))


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, "(?U)\\s+", -1), lambda w: w != "")


def preview(text: Column, n: int = 8) -> Column:
    """The first ``n`` words, with an ellipsis if there are more."""
    w = words(text)
    return F.concat(F.array_join(F.slice(w, 1, n), " "), F.when(F.size(w) > n, "…").otherwise(""))


def furniture_key(text: Column) -> Column:
    """Normal form under which running heads repeat: lower case, digit runs as ``#``, single spaces."""
    return F.lower(collapse(F.regexp_replace(text, "(?U)\\d+", "#")))


def is_roman(text: Column) -> Column:
    """Whether the upper-cased text is a canonical roman numeral."""
    return F.upper(strip(text)).rlike(ROMAN)


def slug(name: Column) -> Column:
    """File name without extension as lower-case letters, digits and single underscores."""
    stem = F.regexp_replace(name, "\\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def caps_ratio(text: Column) -> Column:
    """Upper-case letters over letters; 0 without letters."""
    letters = F.regexp_count(text, F.lit("\\p{L}"))
    return F.when(letters > 0, F.regexp_count(text, F.lit("\\p{Lu}")) / letters).otherwise(0.0)


def transfer_case(source: Column, target: Column) -> Column:
    """``target`` in the case of ``source``: all upper, first upper, else unchanged."""
    upper = (source == F.upper(source)) & (source != F.lower(source))
    first = F.substring(source, 1, 1)
    title = (first == F.upper(first)) & (first != F.lower(first))
    return F.when(upper & (F.length(source) > 1), F.upper(target)).when(title, F.concat(F.upper(F.substring(target, 1, 1)), F.expr("''"), target.substr(F.lit(2), F.length(target)))).otherwise(target)


def join_lines(lines: Column) -> Column:
    """Lines as one text: a hyphen at a line's end joins the halves of a word, other lines are joined by a space."""
    return F.aggregate(
        lines,
        F.lit(""),
        lambda acc, x: F.when(acc == "", x).when(acc.rlike("(?U)\\w-$") & x.rlike("^\\p{Ll}"), F.concat(F.regexp_replace(acc, "-$", ""), x)).otherwise(F.concat(acc, F.lit(" "), x)),
    )


def page_label(first: Column, last: Column) -> Column:
    """``p. 3`` or ``pp. 3-5`` of a first and last page counted from 0."""
    return F.when(first == last, F.concat(F.lit("p. "), (first + 1).cast("string"))).otherwise(F.concat(F.lit("pp. "), (first + 1).cast("string"), F.lit("-"), (last + 1).cast("string")))


def digest(lines: Column) -> Column:
    """Order-insensitive SHA-256 of an array of lines."""
    return F.sha2(F.array_join(F.array_sort(lines), "\n"), 256)


def row_digest(line: Column) -> Column:
    """Aggregate: order-insensitive digest of lines, the sum of 60 bits of each one's SHA-256, as text. No rows are gathered."""
    return F.sum(F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")


def toc_items(text: Column, separator: str = "\\s+[–—]\\s+", item: str = "^(\\d+(?:\\.\\d+)*)\\.\\s*(.+?)\\s*$") -> Column:
    """Summary items ``array<struct<number, title>>`` of a text split on dashes; null unless every part is an item."""
    parts = F.filter(F.split(strip(text), separator, -1), lambda x: x != "")
    parsed = F.transform(parts, lambda x: F.struct(F.regexp_extract(x, item, 1).alias("number"), F.regexp_extract(x, item, 2).alias("title")))
    return F.when((F.size(parts) > 0) & F.forall(parts, lambda x: x.rlike(item)), parsed)
