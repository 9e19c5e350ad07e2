"""Dates written in article text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import ascii_digits, first_group, wide

# The notations, in the order they are tried.
DATE_NOTATIONS = [
    r"(\d{4})年(\d{1,2})月(\d{1,2})日",
    r"(\d{4})\.(\d{1,2})\.(\d{1,2})",
    r"(\d{4})/(\d{1,2})/(\d{1,2})",
    r"(\d{4})-(\d{1,2})-(\d{1,2})",
]
ANY_DATE = wide(r"\d{4}[年./\-]\d{1,2}[月./\-]\d{1,2}日?")


def date_from_text(text: Column) -> Column:
    """yyyy-mm-dd of the first notation found, without a calendar check; NULL if none."""
    text = ascii_digits(text)
    found = [
        F.when(
            F.regexp_extract(text, notation, 0) != "",
            F.concat_ws(
                "-",
                F.regexp_extract(text, notation, 1),
                F.lpad(F.regexp_extract(text, notation, 2), 2, "0"),
                F.lpad(F.regexp_extract(text, notation, 3), 2, "0"),
            ),
        )
        for notation in DATE_NOTATIONS
    ]
    return F.coalesce(*found)


def date_text(text: Column) -> Column:
    """First stretch of text that looks like a date, NULL if none."""
    return first_group(text, ANY_DATE)


def date_from_head(text: Column, mode: str = "ordered", head_chars: int | None = None) -> Column:
    """Date of a body, or of its first ``head_chars`` characters.

    ``mixed`` takes the first date-like stretch and reads it; ``ordered`` tries the
    notations one after another over the whole text.
    """
    head = text if head_chars is None else F.substring(text, 1, head_chars)
    if mode == "mixed":
        return date_from_text(date_text(head))
    if mode == "ordered":
        return date_from_text(head)
    raise ValueError(f"unknown mode {mode!r}")


def calendar_date(iso: Column) -> Column:
    """The text as a date, NULL when there is no such day."""
    return F.try_to_date(iso, "yyyy-MM-dd")
