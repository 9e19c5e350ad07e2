"""String expressions shared by all operators. Everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, as a trim set and as a regex class (same in Java and RE2).
SPACES = (
    "\t\n\x0b\x0c\r \x85\xa0          "
    "      　"
)
SPACE_CLASS = r"[\s\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Named character references that get decoded, ampersand last.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", "\xa0"), ("&copy;", "©"), ("&middot;", "·"), ("&hellip;", "…"),
    ("&mdash;", "—"), ("&ndash;", "–"), ("&laquo;", "«"), ("&raquo;", "»"),
    ("&yen;", "¥"), ("&amp;", "&"),
]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """White-space runs to one blank, ends trimmed."""
    return strip(F.regexp_replace(text, SPACE_CLASS + "+", " "))


def wide(pattern: str) -> str:
    """The pattern with the digits and white space of all scripts.

    Pages in Japanese write full-width digits and the ideographic space, which the JVM's own
    classes leave out.
    """
    return pattern.replace(r"\d", r"\p{Nd}").replace(r"\s", SPACE_CLASS)


def ascii_digits(text: Column) -> Column:
    """Full-width digits as plain ones."""
    return F.translate(text, "０１２３４５６７８９", "0123456789")


def cut(text: Column, length: int | None) -> Column:
    """First ``length`` characters; the whole text without a length."""
    return text if length is None else F.substring(text, 1, length)


def shorten(text: Column, length: int, tail: str = "...") -> Column:
    """First ``length`` characters plus ``tail`` when something was cut."""
    return F.when(F.length(text) <= length, text).otherwise(F.concat(cut(text, length), F.lit(tail)))


def _code_point(code: Column) -> Column:
    """The character of a code point; U+FFFD for zero, surrogates and numbers beyond the last one."""
    real = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(code.isNull(), F.lit(None).cast("string")).when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")


def _decoded(token: Column) -> Column:
    """A character reference as its character, any other piece of text as it is."""
    digits = lambda start: F.substring(token, start, 2_000_000_000)
    number = (
        F.when(token.rlike("^&#[xX][0-9a-fA-F]{1,8};$"), F.conv(F.replace(digits(4), F.lit(";"), F.lit("")), 16, 10).cast("long"))
        .when(token.rlike("^&#[0-9]{1,10};$"), F.replace(digits(3), F.lit(";"), F.lit("")).cast("long"))
        .when(token.rlike("^&#[xX]?[0-9a-fA-F]+;$"), F.lit(0))
    )
    return F.when(token.startswith("&"), F.coalesce(lookup(token, dict(ENTITIES)), _code_point(number), token)).otherwise(token)


def decode_entities(text: Column) -> Column:
    """Named references of ``ENTITIES`` and all numeric ones as characters, each decoded once."""
    out = text
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    pieces = F.regexp_extract_all(text, F.lit("&#?[0-9a-zA-Z]+;|[^&]+|&"), F.lit(0))
    by_piece = F.array_join(F.transform(pieces, _decoded), "")
    return F.when(F.contains(text, F.lit("&#")), by_piece).when(F.contains(text, F.lit("&")), out).otherwise(text)


def blank(text: Column) -> Column:
    """NULL, empty or white space only."""
    return text.isNull() | (strip(text) == "")


def none_if_empty(text: Column) -> Column:
    return F.when(text != "", text)


def first_group(text: Column, pattern: str, group: int = 0) -> Column:
    """First match of a pattern, NULL when it does not match."""
    return none_if_empty(F.regexp_extract(text, pattern, group))


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def chain(pairs: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    """CASE WHEN over (condition, value) pairs in order."""
    if not pairs:
        return default if default is not None else F.lit(None)
    out = F.when(pairs[0][0], pairs[0][1])
    for condition, value in pairs[1:]:
        out = out.when(condition, value)
    return out if default is None else out.otherwise(default)


def lookup(value: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """CASE over a small fixed dictionary."""
    return chain([(value == k, F.lit(v)) for k, v in table.items()], default)
