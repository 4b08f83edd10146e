"""Text as Column expressions: normalisation, fingerprints, words, classifiers, coverage.

White space is one explicit class everywhere, so that no-break and other Unicode spaces count
as they do in the layouts' own tools; regular expressions' default class is ASCII only.
Lengths that thresholds compare count UTF-16 units (:func:`units`); words count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white-space class, as characters for a bracket expression.
SPACES = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The same class for Java's expressions, nested so that two tests tell a Latin letter apart and not one for each range.
_SPACE = r"\t-\r \x{A0}[\x{1680}-\x{FFFF}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]"
LEAST_PAGE_TEXT = 32

# Fonts whose names mark metadata in a canonical text stream.
METADATA_FONTS = ("Raavi", "Shruti", "Kalinga", "Microsoft Himalaya", "Malgun Gothic", "PMingLiU", "SimSun", "Estrangelo Edessa")
# Patterns of line classes, on normalised text.
CAPTION = r"^(figur|tabell)\s+\d+\s*[:.]"
SOURCE_NOTE = r"^(källa|not)\s*:"
FOOTNOTE = r"^\d+\s+\S"
CELL_LENGTH = 35


def normalized(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{_SPACE}]++", " "))


def matchable(text: Column) -> Column:
    """Normalised, in lower case."""
    return F.lower(normalized(text))


def comparable(text: Column) -> Column:
    """Matchable, hyphens at line ends joined and punctuation as spaces."""
    # Normalised text has no other white space than single spaces, and punctuation becomes more of these.
    joined = F.replace(matchable(text), F.lit("- "), F.lit(""))
    return F.trim(F.regexp_replace(joined, r"[ .,;:()\[\]{}]++", " "))


def fingerprint(text: Column) -> Column:
    """SHA-1 of the normalised text, in hex (T4)."""
    return F.sha1(F.encode(normalized(text), "UTF-8"))


def paragraph_text(runs: Column) -> Column:
    """Texts of an array of runs end to end (T5)."""
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def joined(texts: Column, by: str = "\n") -> Column:
    return F.array_join(texts, by)


def words(text: Column, least: int = 5) -> Column:
    """Distinct words of the comparable text in order of appearance (T6). Lengths are code points."""
    return F.array_distinct(F.filter(F.split(comparable(text), " "), lambda w: F.length(w) >= least))


def without_controls(text: Column) -> Column:
    """Control characters but tab, line feed and carriage return are dropped."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def units(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


# Letters and digits that make a text readable.
SOLID = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzÅÄÖåäö0123456789"


def readable(plain: Column) -> Column:
    """:func:`is_readable` of a text that is normalised already."""
    length, solid = units(plain), F.length(plain) - F.length(F.translate(plain, SOLID, ""))
    return (length >= 2) & (solid >= 2) & (solid / F.greatest(length, F.lit(1)) >= 0.35)


def is_readable(text: Column) -> Column:
    """Two characters or more, two or more of them letters or digits, which are 35 % or more."""
    return readable(normalized(text))


def noisy(plain: Column, fonts: tuple[str, ...] = METADATA_FONTS) -> Column:
    """:func:`is_noise` of a text that is normalised already."""
    marked = F.contains(plain, F.lit("\ufffd")) | F.contains(plain, F.lit("\uffff"))
    for name in fonts:
        marked |= F.contains(plain, F.lit(name))
    return marked | ((F.octet_length(plain) > 1000) & (units(plain) > 1000) & (F.regexp_count(plain, F.lit("https?://")) > 3))


def is_noise(text: Column, fonts: tuple[str, ...] = METADATA_FONTS) -> Column:
    """Replacement characters, a metadata font's name, or a long text with more than three addresses."""
    return noisy(normalized(text), fonts)


def is_caption(text: Column, pattern: str = CAPTION, plain: bool = False) -> Column:
    """Like the other line classes (T10), of a text that is normalised already if ``plain``."""
    return (text if plain else normalized(text)).rlike(f"(?iu){pattern}")


def is_source_note(text: Column, pattern: str = SOURCE_NOTE, plain: bool = False) -> Column:
    return (text if plain else normalized(text)).rlike(f"(?iu){pattern}")


def is_footnote(text: Column, pattern: str = FOOTNOTE, plain: bool = False) -> Column:
    return (text if plain else normalized(text)).rlike(pattern)


def is_table_cell(text: Column, plain: bool = False) -> Column:
    text = text if plain else normalized(text)
    return text.rlike(r"\d") | (units(text) <= CELL_LENGTH)


def looks_like_heading(text: Column, known: Column | None = None, most: int = 95) -> Column:
    """A known heading, or a short text with a letter that neither ends as a sentence nor has a comma."""
    shape = (units(text) <= most) & ~text.rlike(r"[.!?]$") & text.rlike("[A-ZÅÄÖa-zåäö]") & ~F.contains(text, F.lit(","))
    return shape if known is None else known | shape


def sanitized(text: Column) -> Column:
    """Without NUL and carriage return."""
    return F.translate(text, "\x00\r", "")


def color_hex(color: Column) -> Column:
    """The low 24 bits as #rrggbb."""
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(color.bitwiseAND(F.lit(16777215))), 6, "0")))


def landmark(text: Column, length: int = 80) -> Column:
    """The beginning of a text without its last, perhaps cut, word."""
    return F.regexp_replace(F.substring(text, 1, length), f"[{SPACES}]+[^{SPACES}]*$", "")


def as_array(value: Column) -> Column:
    """A single value as an array of one; null as an empty array."""
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value))


def literal(value: Column) -> Column:
    """A text as a quoted literal of ASCII alone (T14): JSON's escapes, and \\uXXXX for each UTF-16 unit beyond ASCII."""
    quoted = F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', "$1")
    # In hex, four digits a unit: those of ASCII go back to their character.
    unit = F.regexp_extract_all(F.hex(F.encode(quoted, "UTF-16BE")), F.lit("(.{4})"))
    return F.array_join(F.transform(unit, lambda u: F.when(F.startswith(u, F.lit("00")) & (u < "0080"), F.decode(F.unhex(F.substring(u, 3, 2)), "UTF-8")).otherwise(F.concat(F.lit("\\u"), F.lower(u)))), "")


def parsed_color(value: Column) -> Column:
    """A colour as a struct with its text; empty: null."""
    return F.when(F.length(value) > 0, F.struct(value.alias("hex")))


def let(value: Column, body) -> Column:
    """body of a value that is computed once, also where body uses it in the lambda of another function."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _share(sought: Column, text: Column, empty: float) -> Column:
    def body(given: Column) -> Column:
        found = F.size(F.filter(given["sought"], lambda w: F.contains(given["text"], w)))
        return F.when(F.size(given["sought"]) == 0, F.lit(empty)).otherwise(found / F.size(given["sought"]))

    return let(F.struct(sought.alias("sought"), text.alias("text")), body)


def coverage_canonical(source: Column, target: Column) -> Column:
    """Share of the words of three letters or more that the target contains; none: 0 (V1)."""
    return _share(F.filter(F.split(matchable(source), " "), lambda w: F.length(w) >= 3), matchable(target), 0.0)


def coverage_words(source: Column, target: Column) -> Column:
    """The same for four letters or more; none: 1 (V2)."""
    return _share(F.filter(F.split(matchable(source), " "), lambda w: F.length(w) >= 4), matchable(target), 1.0)


def coverage_text(source: Column, target: Column) -> Column:
    """Share of distinct words of five letters or more in the comparable target; none: 1 (V3)."""
    return _share(words(source), comparable(target), 1.0)


def page_score(paragraph: Column, page: Column) -> Column:
    """Like :func:`coverage_text`, for a page that is comparable already; no words: 0 (V4)."""
    return _share(words(paragraph), page, 0.0)


def expected_text_present(expected: Column, whole: Column, length: int = 120, least: float = 0.72) -> Column:
    """The expected text's landmark, or enough of its words, is in the whole."""

    def body(given: Column) -> Column:
        sought = F.array_distinct(F.filter(F.split(given["expected"], " "), lambda w: F.length(w) >= 5))
        return F.contains(given["whole"], landmark(given["expected"], length)) | (_share(sought, given["whole"], 1.0) >= least)

    return let(F.struct(comparable(expected).alias("expected"), comparable(whole).alias("whole")), body)
