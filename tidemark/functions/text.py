"""Text columns: folding, slugs, markdown to summary, truncation.

Everything here takes and returns Spark columns and stays inside built-in expressions.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, literal_map

# White space is the Unicode property plus the four ASCII separators, spelled out
# because an explicit class is several times faster than the property.
_ASCII_SPACE = r" \t\n\x0B\f\r\x1c-\x1f"
SPACE = f"[{_ASCII_SPACE}]"
UNICODE_SPACE = (
    f"[{_ASCII_SPACE}" + r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)

# Fixed value: ASCII characters that count as word separators in folded text.
SEPARATORS = r"""[-_/\\.,;:()\[\]{}"'`*~|+]"""


@lru_cache(maxsize=1)
def _ascii_folds() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition reduced to ASCII, for every code point that has one.

    Returns the aligned (from, to) strings of the one-to-one folds and a dict of the folds
    that give several characters (ligatures, fractions, enclosed forms).
    """
    single_from, single_to, several = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if not unicodedata.decomposition(char):
            continue
        folded = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode("ascii")
        if len(folded) == 1:
            single_from.append(char)
            single_to.append(folded)
        elif folded:
            several[char] = folded
    return "".join(single_from), "".join(single_to), several


def _char_class(chars) -> str:
    """A regex class over the given characters, written as code point ranges."""
    codes = sorted(map(ord, chars))
    spans, start, prev = [], codes[0], codes[0]
    for code in codes[1:]:
        if code != prev + 1:
            spans.append((start, prev))
            start = code
        prev = code
    spans.append((start, prev))
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in spans) + "]"


def to_ascii(text: Column) -> Column:
    """NFKD, then drop what is not ASCII. ASCII text passes through untouched."""
    single_from, single_to, several = _ascii_folds()
    folds = literal_map(several)
    # The look-ahead rejects ASCII at once; the class has many ranges.
    several_class = r"(?=[^\x00-\x7F])" + _char_class(several)

    def spread(raw: Column) -> Column:
        # Only the distinct multi-character folds that occur in a text are replaced in it.
        found = F.array_distinct(F.regexp_extract_all(raw, F.lit("(" + several_class + ")")))
        replaced = F.aggregate(found, raw, lambda acc, char: F.replace(acc, char, F.element_at(folds, char)))
        return F.when(raw.rlike(several_class), replaced).otherwise(raw)

    def folded(raw: Column) -> Column:
        single = F.translate(spread(raw), single_from, single_to)
        return F.when(raw.rlike(r"[^\x00-\x7F]"), F.regexp_replace(single, r"[^\x00-\x7F]", "")).otherwise(raw)

    return let(text, folded)


def normalize(text: Column) -> Column:
    """Lower-case, separator-free ASCII form used for matching and title keys.

    Non-ASCII characters go before separators are replaced: an en dash vanishes, a hyphen
    becomes a space. NULL gives an empty string.
    """
    lowered = F.lower(to_ascii(F.coalesce(text, F.lit(""))))
    gaps = SEPARATORS[:-1] + SPACE[1:-1] + "]+"
    return F.trim(F.regexp_replace(lowered, gaps, " "))


def slug(text: Column) -> Column:
    """Identifier fragment: runs outside ``a-z0-9`` become one dash."""
    return F.btrim(F.regexp_replace(normalize(text), "[^a-z0-9]+", "-"), F.lit("-"))


def squash(text: Column) -> Column:
    """Collapse white space to single spaces and trim; NULL gives an empty string."""
    collapsed = F.regexp_replace(F.coalesce(text, F.lit("")), UNICODE_SPACE + "+", " ")
    return F.trim(collapsed)


def truncate(text: Column, limit: int | None) -> Column:
    """Cut at the last space inside the first ``limit`` characters and mark the cut; None keeps all."""
    if limit is None:
        return text

    def cut(full: Column) -> Column:
        whole_words = F.regexp_replace(F.substring(full, 1, limit), r"(?s) [^ ]*$", "")
        marked = F.concat(F.rtrim(whole_words, F.lit(" ,;:.")), F.lit("..."))
        return F.when(F.length(full) <= limit, full).otherwise(marked)

    return let(text, cut)


# Markdown and HTML constructs removed on the way to a summary, in order, each with the strings of
# which a text has one if the pattern can match at all.
_MARKUP = (
    (r"(?s)\A---" + SPACE + r"*\n.*?\n---" + SPACE + r"*\n", "", ("---",)),
    (r"(?s)<!--.*?-->", " ", ("<!--",)),
    (r"(?s)```.*?```", " ", ("```",)),
    (r"!\[[^\]]*\]\([^)]*\)", " ", ("![",)),
    (r"\[([^\]]*)\]\(([^)]*)\)", "$1", ("](",)),
    (r"<[^>]+>", " ", ("<",)),
    (r"`([^`]*)`", "$1", ("`",)),
    (r"(?m)^" + SPACE + r"{0,3}#{1,6}" + SPACE + "*", "", ("#",)),
    (r"(\*\*|__|\*|_)", "", ("*", "_")),
)
_EDGE = " -*|#>\t"


def strip_markdown(text: Column, limit: int | None = None) -> Column:
    """One plain paragraph from a README-like text; empty when nothing usable is left.

    Paragraphs under 40 characters and left-over table rows are dropped. With a ``limit``, paragraphs
    are taken until their summed length passes it, then the result is cut at a word.
    """
    def removed(pattern: str, replacement: str, marks: tuple[str, ...]) -> Callable[[Column], Column]:
        # A search for a plain string costs a fraction of a pass of the pattern, and prose has few of them.
        some = lambda plain: reduce(or_, [F.contains(plain, F.lit(m)) for m in marks])
        return lambda plain: F.when(some(plain), F.regexp_replace(plain, pattern, replacement)).otherwise(plain)

    body = F.coalesce(text, F.lit(""))
    for step in _MARKUP:
        body = let(body, removed(*step))

    def clean(chunk: Column) -> Column:
        return F.btrim(F.regexp_replace(chunk, UNICODE_SPACE + "+", " "), F.lit(_EDGE))

    def usable(piece: Column) -> Column:
        bars = F.length(piece) - F.length(F.replace(piece, F.lit("|"), F.lit("")))
        return (F.length(piece) >= 40) & (bars <= 3)

    start = F.struct(F.lit(0).cast("int").alias("size"), F.lit("").alias("text"))

    def taken(acc: Column, piece: Column) -> Column:
        grown = F.when(acc["text"] == "", piece).otherwise(F.concat(acc["text"], F.lit(" "), piece))
        more = F.struct((acc["size"] + F.length(piece)).cast("int").alias("size"), grown.alias("text"))
        return F.when(acc["size"] <= limit, more).otherwise(acc)

    def single(plain: Column) -> Column:
        return let(clean(plain), lambda one: F.when(F.length(one) >= 40, one).otherwise(F.lit("")))

    def summary(plain: Column) -> Column:
        pieces = F.filter(F.transform(F.split(plain, "\n\n"), clean), usable)
        joined = F.array_join(pieces, " ") if limit is None else F.aggregate(pieces, start, taken, lambda acc: acc["text"])
        return let(joined, lambda kept: F.when(kept != "", kept).otherwise(single(plain)))

    return truncate(let(body, summary), limit)


def match_text(title: Column, summary: Column, section: Column, venue: Column, facets: Column) -> Column:
    """The text that rules are matched on: upstream fields only, folded.

    ``facets`` is a ``map<string,array<string>>``; five of its keys take part.
    """
    # Fixed value: facet fields that carry upstream vocabulary.
    fields = ("tags", "topics", "pipeline_tag", "task_categories", "arxiv_categories")
    parts = [F.nullif(c, F.lit("")) for c in (title, summary, section, venue)]
    parts += [F.array_join(F.try_element_at(facets, F.lit(f)), " ") for f in fields]
    return normalize(F.concat_ws(" ", *parts))


def raw_text(title: Column, summary: Column) -> Column:
    """Title and summary as published, for rules written against raw text."""
    return F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(summary, F.lit("")))


def title_case(key: Column) -> Column:
    """``chart_qa`` to ``Chart Qa``."""
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def reading_minutes(text: Column, words_per_minute: int = 160) -> Column:
    """Reading time label of an HTML text: ``less than 1``, ``1`` or whole minutes."""
    stripped = F.regexp_replace(
        F.coalesce(text, F.lit("")), r"(?is)<script.*?</script>|<!--.*?-->|<style.*?</style>|<.*?>", ""
    )
    words = F.size(F.filter(F.split(stripped, r"[\s\x00]+"), lambda w: w != ""))
    return (
        F.when(words < 180, F.lit("less than 1"))
        .when(words < 360, F.lit("1"))
        .otherwise(F.floor(words / words_per_minute).cast("string"))
    )
