"""Columns over markdown table cells and list titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import UNICODE_SPACE, normalize, squash

# Cell texts that say nothing.
PLACEHOLDERS = ("", "-", "--", "---", "–", "—", "n/a", "na", "tbd", "?")
GENERIC_LABELS = (
    "paper", "papers", "code", "link", "links", "website", "site", "project", "project page",
    "github", "repo", "arxiv", "pdf", "demo", "blog", "hf", "huggingface", "hugging face",
    "model", "models", "dataset", "openreview", "yes", "no", "x", "check",
)
# Fixed value: first words of a trailing note that is not a publisher.
NOTE_WORDS = ("gated", "preview", "note", "see", "visual", "text")

# Markup that cells and headings carry.
_ANCHOR = r"""(?i)<a\s+name=['"]?[^'">]*['"]?\s*>\s*</a>"""
_LINK = r"\[([^\]]*)\]\([^)\s]+[^)]*\)"
# Fixed value: pictograph and arrow blocks dropped from headings.
_PICTOGRAPHS = (
    r"[\x{1F000}-\x{1FAFF}\x{2190}-\x{21FF}\x{2300}-\x{27BF}\x{FE0F}\x{2B00}-\x{2BFF}\x{2600}-\x{26FF}]"
)


def _without_tags(source: Column) -> Column:
    """Text without anchors and tags, link labels kept; NULL gives an empty string."""
    text = F.regexp_replace(F.coalesce(source, F.lit("")), _ANCHOR, "")
    return F.regexp_replace(F.regexp_replace(text, _LINK, "$1"), "<[^>]+>", " ")


def clean_cell(cell: Column) -> Column:
    """A table cell without markdown and HTML, link labels kept."""
    return squash(F.translate(_without_tags(cell), "*`", ""))


def clean_heading(heading: Column) -> Column:
    """A heading without markdown, HTML, pictographs and edge punctuation."""
    text = F.regexp_replace(_without_tags(heading), _PICTOGRAPHS, "")
    text = F.replace(F.replace(text, F.lit("**"), F.lit("")), F.lit("`"), F.lit(""))
    return F.btrim(squash(F.replace(text, F.lit("#"), F.lit(""))), F.lit(" .:-"))


def informative(cell: Column) -> Column:
    """True when a cleaned cell is neither empty, a placeholder nor a generic label."""
    folded = normalize(cell)
    return ~folded.isin(*PLACEHOLDERS) & ~folded.isin(*GENERIC_LABELS)


def publisher_parts(title: Column) -> tuple[Column, Column]:
    """(title, publisher) of ``Name (Publisher)``; the publisher is empty when it is a note.

    A publisher has 2 to 48 characters, at most five words, starts with an upper-case letter
    and not with a note word. The trailing parenthesis is cut either way.
    """
    tail = r"\(([^()]{2,48})\)" + SPACES_AT_END
    found = title.rlike(tail)
    note = squash(F.regexp_extract(title, tail, 1))
    trimmed = F.regexp_replace(F.regexp_replace(title, tail, ""), r"(?U)^\s+|\s+$", "")
    words = F.size(F.filter(F.split(note, " "), lambda w: w != ""))
    is_publisher = (
        found
        & (words <= 5)
        & note.rlike(r"^\p{Lu}")
        & ~F.lower(note).rlike("^(?:" + "|".join(NOTE_WORDS) + ")")
    )
    name = F.when(found & (trimmed != ""), trimmed).otherwise(title)
    return name, F.when(is_publisher, note).otherwise(F.lit(""))


SPACES_AT_END = UNICODE_SPACE + r"*$"
