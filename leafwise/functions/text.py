"""Text functions: whitespace, headings, sections, tokens and sentences."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafwise.functions.arrays import let
from leafwise.schema import (
    BACKGROUND_KEYWORDS,
    MIN_SENTENCE_CHARS,
    SCOPE_KEYWORDS,
    SECTION_LOOKAHEAD,
)

# Fixed patterns. WS is every Unicode white-space character; TOKEN is a word with
# inner apostrophes and full stops kept ("don't", "3.14").
WS = r"\x09-\x0D\x1C-\x20\x85\p{Z}"
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WORD = r"\p{L}\p{M}\p{N}_"
TOKEN = rf"[{WORD}]++(?:['’.][{WORD}]++)*+"
NUMBERED_HEADING = rf"^\p{{Nd}}+\.(\p{{Nd}}+\.)*[{WS}]+[A-Z]"
NEXT_SECTION = rf"\n[A-Z\p{{Nd}}][A-Z{WS}]{{5,}}\n"
FRAGMENT = r"[^.!?\n]+[.!?]*"
PIECE = rf"(?s){TOKEN}|."


def strip_ws(text: Column) -> Column:
    """Remove white space of any kind from both ends; what lies between is not searched."""
    return F.btrim(text, F.lit(SPACES))


def fold_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def is_upper(text: Column) -> Column:
    """At least one capital letter and no other cased letter."""
    # most texts have a small letter soon, but no capital for long
    return ~text.rlike(r"[\p{IsLowercase}\p{Lt}]") & text.rlike(r"[\p{IsUppercase}]")


def extract_headings(text: Column, limit: int | None = None) -> Column:
    """The lines that are all capitals or carry a dotted number; the first ``limit``, if given."""

    def is_heading(line):
        length = F.length(line)
        return (is_upper(line) & (length > 3) & (length < 100)) | line.rlike(NUMBERED_HEADING)

    # White space has no case, so lines can be left out before they are stripped.
    likely = F.filter(F.split(text, "\n"), lambda line: is_upper(line) | line.rlike(rf"^[{WS}]*\p{{Nd}}+\."))
    headings = F.filter(F.transform(likely, strip_ws), is_heading)
    return headings if limit is None else F.slice(headings, 1, limit)


def _section_from(text: Column, start: Column, chars: int | None) -> Column:
    rest = F.substring(text, start + 1, F.length(text))
    return let(
        rest,
        lambda r: let(
            F.split(F.substring(r, F.lit(SECTION_LOOKAHEAD + 1), F.length(r)), NEXT_SECTION, 2),
            lambda cut: strip_ws(
                F.substring(
                    r,
                    F.lit(1),
                    F.when(F.size(cut) == 2, SECTION_LOOKAHEAD + F.length(cut[0])).otherwise(F.length(r) if chars is None else F.lit(chars)),
                )
            ),
        ),
    )


def extract_section(text: Column, keywords, chars: int | None = None) -> Column:
    """Text from the first whole-word hit of the first keyword that occurs.

    Keywords are tried in the given order, not in text order. The section ends
    at the next line of capitals, looked for after its first 100 characters, or
    else with the text, or after ``chars`` characters. Null when no keyword occurs.
    """

    def found(low, keyword):
        # The length of what precedes a match is its position in code points;
        # regexp_instr would count UTF-16 units. What precedes is looked at where the
        # keyword stands, not at every place.
        before = F.split(low, rf"{keyword}(?<![\p{{L}}\p{{N}}_]{keyword})(?![\p{{L}}\p{{N}}_])", 2)
        position = let(before, lambda p: F.when(F.size(p) == 2, F.length(p[0])))
        # A plain search is much faster and most texts lack the keyword.
        return F.when(F.contains(low, F.lit(keyword)), position)

    start = let(F.lower(text), lambda low: F.coalesce(*[found(low, k.lower()) for k in keywords]))
    return let(start, lambda s: F.when(s.isNotNull(), _section_from(text, s, chars)))


def background(text: Column, chars: int | None = None) -> Column:
    return extract_section(text, BACKGROUND_KEYWORDS, chars)


def scope(text: Column, chars: int | None = None) -> Column:
    return extract_section(text, SCOPE_KEYWORDS, chars)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"^(.+)\.[^.]+$", "$1")


def tokenize(text: Column) -> Column:
    """Lower-case word tokens in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def split_sentences(text: Column) -> Column:
    """Stripped sentences longer than 20 characters."""
    pieces = F.transform(F.split(F.translate(text, "!?", ".."), r"\."), strip_ws)
    return F.filter(pieces, lambda s: F.length(s) > MIN_SENTENCE_CHARS)


def truncate(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def blank_to_null(text: Column) -> Column:
    return F.when(F.length(text) > 0, text)
