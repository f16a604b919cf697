"""URL columns: canonical form, link extraction, host names, exact identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

# Fixed value: query parameters that never identify a page.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "ref", "referrer", "source", "fbclid", "gclid", "spm",
)

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _decode(part: Column) -> Column:
    stray = F.regexp_replace(part, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(part.rlike(r"[%+]"), F.coalesce(F.try_url_decode(stray), part)).otherwise(part)


def _encode(part: Column) -> Column:
    encoded = F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A"))
    encoded = F.replace(encoded, F.lit("%7E"), F.lit("~"))
    return F.when(part.rlike(r"[^A-Za-z0-9_.~\-]"), encoded).otherwise(part)


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no tracking or blank parameters, no fragment, no end slash.

    Text without scheme and host is only trimmed. NULL gives an empty string.
    """
    trimmed = F.btrim(F.coalesce(url, F.lit("")), F.lit(" \t\n\r\x0b\x0c"))
    source = F.translate(trimmed, "\t\r\n", "")
    names = ("scheme", "host", "path", "query")
    parts = F.struct(*[F.regexp_extract(source, _PARTS, i).alias(n) for i, n in enumerate(names, 1)])

    def rebuilt(url_parts: Column) -> Column:
        scheme, host, path, query = (url_parts[n] for n in names)
        pairs = F.transform(
            F.filter(F.split(query, "&"), lambda p: p.rlike(r"(?s)^[^=]*=.")),
            lambda p: F.struct(
                _decode(F.regexp_extract(p, r"(?s)^([^=]*)=", 1)).alias("k"),
                _decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v"),
            ),
        )
        kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING_PARAMS))
        encoded = F.transform(kept, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"])))
        tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(encoded, "&"))).otherwise(F.lit(""))
        bare = F.rtrim(path, F.lit("/"))
        clean_path = F.when(bare == "", F.lit("/")).otherwise(bare)
        rooted = clean_path.startswith("/") & F.lower(scheme).isin("http", "https", "ftp", "file")
        location = (
            F.when(host != "", F.concat(F.lit("//"), F.lower(host), clean_path))
            .when(rooted, F.concat(F.lit("//"), clean_path))
            .otherwise(clean_path)
        )
        prefix = F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(F.lit(""))
        return F.when((scheme == "") & (host == ""), trimmed).otherwise(F.concat(prefix, location, tail))

    return let(parts, rebuilt)


def host_name(url: Column) -> Column:
    """Host without user, port and leading ``www.``; the text itself when it has no host."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host == "", url).otherwise(F.regexp_replace(host, r"^www\.", ""))


MARKDOWN_LINK = r"\[([^\]]*)\]\(([^)\s]+)[^)]*\)"
HTML_LINK = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""


def markdown_links(text: Column) -> Column:
    """Targets of all markdown links of a text, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MARKDOWN_LINK), 2)


def html_links(text: Column) -> Column:
    """``href`` of all anchors of an HTML text, in order, as written (entities decoded for &)."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(HTML_LINK), 1)
    return F.transform(found, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def owner_of(repo_id: Column) -> Column:
    """The part before the first slash; empty when there is no slash."""
    return F.when(repo_id.contains("/"), F.trim(F.split_part(repo_id, F.lit("/"), F.lit(1)))).otherwise(F.lit(""))
