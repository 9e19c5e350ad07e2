"""Markup expressions: tokens, tag names, attributes.

A token is a comment, a declaration, a whole opaque subtree, a tag or a text run.
Joining the tokens of a text gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import SPACE_CLASS, decode_entities, strip

# Elements without an end tag.
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "param", "source", "track", "wbr",
]

TAG_BODY = r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*"""


def token_pattern(opaque: tuple[str, ...] = ("script", "style")) -> str:
    """Regex of one token; an ``opaque`` element is one token with its content."""
    subtrees = "".join(rf"<{tag}\b.*?</{tag}\s*>|" for tag in opaque)
    return rf"(?is)<!--.*?-->|<![^>]*>|{subtrees}</?[a-z]{TAG_BODY}>|[^<]+|<"


def token_array(html: Column, opaque: tuple[str, ...] = ("script", "style")) -> Column:
    return F.regexp_extract_all(html, F.lit(token_pattern(opaque)), F.lit(0))


def is_text(token: Column) -> Column:
    return ~token.startswith("<") | (token == "<")


def _lower(name: Column) -> Column:
    """Lower case; names that are written so, nearly all, are only looked at."""
    return F.when(name.rlike("[^a-z0-9_:-]"), F.lower(name)).otherwise(name)


def tag_name(token: Column) -> Column:
    return _lower(F.regexp_extract(token, r"^</?([a-zA-Z][a-zA-Z0-9:-]*)", 1))


def token_kind(token: Column, tag: Column, opaque: tuple[str, ...]) -> Column:
    return (
        F.when(is_text(token), "text")
        .when(token.startswith("<!"), "comment")
        .when(token.startswith("</"), "close")
        .when(tag.isin(*opaque) & token.rlike(r"(?i)</[a-z]+\s*>$"), "opaque")
        .when(tag.isin(*VOID_TAGS), "void")
        .otherwise("open")
    )


ATTRIBUTE = r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def attribute_map(token: Column) -> Column:
    """Attributes of a start tag as map<string,string>; the first of a repeated name counts."""
    inside = F.regexp_replace(token, r"^<[a-zA-Z][^\s/>]*|/?>$", "")
    unquoted = lambda v: F.when(v.startswith('"') | v.startswith("'"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    cleaned = lambda value: decode_entities(unquoted(value))

    def found(inside: Column) -> Column:
        names = F.transform(F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(1)), _lower)
        return F.struct(names.alias("names"), F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(2)).alias("values"))

    def pairs(each: Column) -> Column:
        names, values = each["names"], each["values"]
        all_of = F.transform(names, lambda name, i: F.struct(name.alias("key"), cleaned(F.get(values, i)).alias("value")))
        once = F.filter(all_of, lambda p, i: F.array_position(names, p["key"]) == i + 1)
        return F.map_from_entries(F.when(F.size(F.array_distinct(names)) == F.size(names), all_of).otherwise(once))

    bare = F.create_map().cast("map<string,string>")
    return F.when(token.rlike(r"^<[a-zA-Z][^\s/>]*/?>$"), bare).otherwise(_bound(_bound(inside, found), pairs))


def attribute(attrs: Column, name: str) -> Column:
    """Value of one attribute, NULL when absent."""
    return F.try_element_at(attrs, F.lit(name))


def class_text(attrs: Column) -> Column:
    """Class attribute with single blanks, '' when absent."""
    return F.coalesce(strip(F.regexp_replace(attribute(attrs, "class"), SPACE_CLASS + "+", " ")), F.lit(""))


def has_class(classes: Column, name: str) -> Column:
    return F.array_contains(F.split(classes, " "), name)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]+>", "")
