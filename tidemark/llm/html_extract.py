"""HTML extraction by consensus of a host's pages.

Every page's containers are scored by their running text. The best ones vote for their generalised path of
tags and classes, Spark sums the votes per host, and every page is extracted again from the container
under its host's winning path, or from the article or main element around it. With the votes travel, for each
path, a smallest and a largest hash of its text, which tell what all pages of a host repeat.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored
from .common import map_texts, quoted, text_bytes
from .tokens import Generations

#: Containers of a page that vote, best first.
VOTES_PER_PAGE = 3
#: Bytes of hosts and what their pages agree on that may be broadcast.
BROADCAST_BYTES = 32 << 20
#: Pages from which on a host's repeated text counts as not being the article.
REPEATED_PAGES = 3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title noscript template iframe object svg math xmp noframes".split())
SKIPPED = RAW | frozenset("head nav footer aside form button select dialog menu canvas audio video fieldset label input".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Parts of class names and ids of what is not the article.
SKIPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox sponsor sponsored sponsors promo promos "
    "banner banners nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside footer masthead topbar toolbar menus "
    "cookie cookies consent gdpr notice notices popup modal lightbox newsletter subscribe signup login sharing sharebar "
    "comment comments commentlist disqus respond replies pagination pager".split()
)
#: Parts of names that sections of an article may have as well: these are left out where most of their text is in
#: links, or where they hold a control of a form.
DOUBTFUL_NAMES = frozenset(
    "menu related recommended recommendations social share promotion search form register subscription discussion reply "
    "notification notifications alert alerts overlay skip".split()
)
#: Ids that mean reader comments even inside an article, where other ids may be those of its sections.
COMMENT_IDS = frozenset("comments commentlist disqus_thread respond".split())
#: Elements that names tell something about; a heading or a paragraph is text, whatever it is called.
NAMED = frozenset("div section aside ul ol dl details center header footer article main address table".split())
#: These are headers of the page unless they stand inside the article.
PAGE_HEADER_NAMES = frozenset(["header", "head"])
CONTAINERS = frozenset("article main section div td body".split())
#: Characters from which on a block counts as running text.
RUNNING = 40
CONTROLS = frozenset("form input select textarea button".split())
#: Containers that a page itself declares to be the text, and a path that goes on inside one.
WHOLE = ("article", "main")
INSIDE_WHOLE = r"(?s)^((?:.*>)?(?:article|main)(?:\.[^>]*)?)>.*$"
WHOLE_PATH = r"(?:^|>)(?:article|main)(?:[.>]|$)"

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# A name like "has-sidebar" or "no-comments" tells what else is on the page.
_ABOUT_OTHERS = re.compile(r"(?:has|with|without|no|not|is)[-_]", re.I)
_NAME_PARTS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(source)}


def _name_parts(value: str) -> set[str]:
    split = re.sub(r"([a-z])([A-Z])", r"\1 \2", value)
    return set(_NAME_PARTS.findall(split.lower()))


def _verdict(tag: str, attributes: dict[str, str], in_article: bool) -> str:
    """"skip" for what is not the article, "doubt" where its text has to tell, else "keep"."""
    if tag in SKIPPED:
        return "skip"
    if tag in ("html", "body"):
        return "keep"
    if tag == "header" and not in_article:
        return "skip"
    if not attributes:
        return "keep"
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or _HIDDEN.search(attributes.get("style", "")):
        return "skip"
    if attributes.get("role", "").lower() in SKIPPED_ROLES:
        return "skip"
    classes, own = attributes.get("class", "").split(), attributes.get("id", "").split()
    if tag == "main":
        return "keep"
    if tag == "article":
        return "keep" if SKIPPED_NAMES.isdisjoint(n.lower() for n in classes + own) else "skip"
    if tag not in NAMED:
        # Only a class that says nothing else counts, and none on a heading.
        return "skip" if tag[0] != "h" and not SKIPPED_NAMES.isdisjoint(n.lower() for n in classes) else "keep"
    if not COMMENT_IDS.isdisjoint(n.lower() for n in own):
        return "skip"
    parts, by_id = (_name_parts(" ".join(n for n in names if not _ABOUT_OTHERS.match(n))) for names in (classes, own))
    if not parts.isdisjoint(SKIPPED_NAMES) or not in_article and not (parts | by_id).isdisjoint(SKIPPED_NAMES | PAGE_HEADER_NAMES):
        return "skip"
    return "keep" if (parts | by_id).isdisjoint(SKIPPED_NAMES | DOUBTFUL_NAMES) else "doubt"


def _label(tag: str, attributes: dict[str, str]) -> str:
    """Tag and classes, numbers generalised, so that pages of one template agree."""
    classes = sorted(set(_DIGITS.sub("0", c.lower()) for c in attributes.get("class", "").split()))
    return ".".join([tag, *(re.sub(r"[>.\s]", "-", c) for c in classes)])


def _step(path: int, label: str) -> int:
    return zlib.crc32(label.encode(), path) or 1


def path_key(path: str) -> int:
    """The number under which an element with this path is found."""
    key = 0
    for label in path.split(">"):
        key = _step(key, label)
    return key


class Agreement(NamedTuple):
    """Keys of paths on which a host's pages agree: those with the same text on all, and those most pages have."""

    repeated: frozenset[int]
    common: frozenset[int]


class Page:
    """Blocks of text in page order, and the containers around them."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, int]] = []  # text, container, characters in links
        self.containers: list[tuple[str, int, int]] = []  # label, parent, key of the path
        self._doubtful: set[int] = set()  # containers whose text has to tell whether they are left out
        self._controls: set[int] = set()  # containers with a control of a form directly inside
        self._words: list[str] = []
        self._linked = 0
        self._read(html)
        if self._doubtful:
            left_out = self._left_out()
            self.blocks = [b for b in self.blocks if not left_out[b[1]]]

    def _left_out(self) -> list[bool]:
        """For every container, and at the end for none, whether it lies in a doubtful one that is not text."""
        size, linked, control = ([0] * len(self.containers) for _ in range(3))
        for text, container, in_links in self.blocks:
            for c in self._around(container):
                size[c] += len(text)
                linked[c] += in_links
        for container in self._controls:
            for c in self._around(container):
                control[c] = 1
        out = []
        for i, (_, parent, _) in enumerate(self.containers):
            out.append(parent >= 0 and out[parent] or i in self._doubtful and (control[i] == 1 or 2 * linked[i] >= size[i]))
        return [*out, False]

    def _flush(self, container: int) -> None:
        text = " ".join("".join(self._words).split())
        if text:
            self.blocks.append((text, container, self._linked))
        self._words, self._linked = [], 0

    def _read(self, html: str) -> None:
        # Of each open element: tag, container, whether inside the article.
        stack: list[tuple[str, int, bool]] = [("", -1, False)]
        skipping: list[str] = []  # the skipped element and block elements open inside it
        links, at, end = 0, 0, len(html)
        while at < end:
            m = _MARKUP.search(html, at)
            stop = m.start() if m else end
            if not skipping and stop > at:
                text = html[at:stop]
                if "&" in text:
                    text = unescape(text)
                self._words.append(text)
                if links:
                    self._linked += len(text)
            if m is None:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing = m[1] or m[4]
            if skipping and not self._leaves(skipping, stack, tag, bool(closing)):
                if tag in RAW and not closing:
                    at = self._after(html, at, tag)
                continue
            if skipping:
                ended, skipping = tag == skipping[0] and closing, []
                if ended:
                    continue
            block = tag in BLOCKS
            if block:
                self._flush(stack[-1][1])
            elif tag == "br":
                self._words.append(" ")
            if closing:
                if tag == "a":
                    links = max(0, links - 1)
                elif block:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == tag:
                            del stack[i:]
                            break
                continue
            source = m[3] or m[6] or ""
            if tag in CONTROLS and stack[-1][1] >= 0:
                self._controls.add(stack[-1][1])
            if tag in VOID:
                continue
            if tag in RAW:
                at = self._after(html, at, tag)
                continue
            attributes = _attributes(source) if source.strip(" /\t\r\n") else {}
            if block and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                stack.pop()
            if tag == "li" and stack[-1][0] == "li" or tag in ("dd", "dt") and stack[-1][0] in ("dd", "dt"):
                stack.pop()
            verdict = _verdict(tag, attributes, stack[-1][2])
            if verdict == "skip":
                skipping = [tag]
                continue
            if tag == "a":
                links += 1
            if block:
                _, container, inside = stack[-1]
                if tag in CONTAINERS or verdict == "doubt":
                    label = _label(tag, attributes)
                    key = _step(self.containers[container][2] if container >= 0 else 0, label)
                    self.containers.append((label, container, key))
                    container = len(self.containers) - 1
                    if verdict == "doubt":
                        self._doubtful.add(container)
                stack.append((tag, container, inside or tag in WHOLE))
        self._flush(stack[-1][1])

    @staticmethod
    def _leaves(skipping: list[str], stack: list[tuple[str, int, bool]], tag: str, closing: bool) -> bool:
        """Whether this tag ends the skipped element: its end tag, or one that shows it was left open."""
        if closing:
            if tag in skipping:
                if len(skipping) == 1:
                    return True
                while skipping.pop() != tag:
                    pass
                return not skipping
            return tag in BLOCKS and any(t == tag for t, *_ in stack)
        if skipping == ["p"] and tag in BLOCKS or skipping[0] == "head" and tag == "body":
            return True
        if tag in BLOCKS or tag == skipping[0]:
            skipping.append(tag)
        return False

    @staticmethod
    def _after(html: str, at: int, tag: str) -> int:
        """Where an element whose content is no markup ends; without an end tag, at the end of the page."""
        m = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
        return m.end() if m else len(html)

    def scores(self) -> list[float]:
        """Running text of each container: its own blocks in full, those of containers inside it by half."""
        found = [0.0] * len(self.containers)
        for text, container, linked in self.blocks:
            worth = max(0, len(text) - 2 * linked) * (1.0 if len(text) >= RUNNING else 0.3)
            while container >= 0 and worth >= 1:
                found[container] += worth
                worth /= 2
                container = self.containers[container][1]
        bonus = {"article": 1.5, "main": 1.3, "body": 0.8}
        return [s * bonus.get(label.split(".")[0], 1.0) for s, (label, *_) in zip(found, self.containers)]

    def path(self, container: int) -> str:
        labels = []
        while container >= 0:
            label, container, _ = self.containers[container]
            labels.append(label)
        return ">".join(reversed(labels))

    def votes(self) -> list[tuple[str, float]]:
        """(path, share of the page's score) of its best containers."""
        scores = self.scores()
        total = sum(scores)
        best = sorted(range(len(scores)), key=lambda i: (-scores[i], i))[:VOTES_PER_PAGE] if total else []
        return [(self.path(i), scores[i] / total) for i in best if scores[i]]

    def _around(self, container: int) -> list[int]:
        """A container and those around it, from the inside out."""
        found = []
        while container >= 0:
            found.append(container)
            container = self.containers[container][1]
        return found

    def own_texts(self) -> dict[int, int]:
        """A hash of what stands directly in each container that has text."""
        found: dict[int, int] = {}
        for text, container, _ in self.blocks:
            if container >= 0:
                found[container] = zlib.crc32(text.encode(), found.get(container, 0))
        return found

    def text(self, winner: int | None, agreed: Agreement | None = None) -> str:
        """Blocks under the winning path; where a page has none of it, under its own best container.

        A container inside an article or main element stands for all of it. Without such an element, the text goes
        on in the nearest container around it that has more running text, unlinked and not what the host's pages
        repeat. That may be the body: then only paths that are common on the host belong to the text, if the host has
        pages enough to tell. Unlinked blocks that stand directly in a container around it belong to it as well.
        """
        chosen = {i for i, (*_, key) in enumerate(self.containers) if key == winner} if winner is not None else set()
        if not chosen:
            scores = self.scores()
            if scores and max(scores) > 0:
                chosen = {max(range(len(scores)), key=lambda i: (scores[i], -i))}
        if not chosen:
            return "\n\n".join(t for t, *_ in self.blocks)
        wholes, direct, lone = set(), set(), []
        for i in chosen:
            around = self._around(i)
            whole = next((c for c in around if self.containers[c][0].split(".")[0] in WHOLE), None)
            wholes.add(i if whole is None else whole)
            if whole is None:
                direct.update(around[1:])
                lone.append(around[1:])
        inside, wider = self._inside(wholes), [False] * len(self.containers)
        unlinked = [c >= 0 and not inside[c] and 2 * linked < len(t) for t, c, linked in self.blocks]
        if lone and any(unlinked):
            keys = [key for *_, key in self.containers]
            more = {c for (t, c, _), free in zip(self.blocks, unlinked) if free and len(t) >= RUNNING and not (agreed and keys[c] in agreed.repeated)}
            nearest = [next((c for c in around if c in reach), None) for reach in [{c for m in more for c in self._around(m)[1:]}] for around in lone]
            wider = self._inside({c for c in nearest if c is not None})
            for i, key in enumerate(keys):
                top = self._around(i)
                in_div = any(c in nearest and self.containers[c][0].split(".")[0] != "body" for c in top)
                wider[i] = wider[i] and (agreed is None or key not in agreed.repeated and (in_div or key in agreed.common))
        return "\n\n".join(
            t for (t, c, _), free in zip(self.blocks, unlinked) if c >= 0 and (inside[c] or free and (c in direct or wider[c]))
        )

    def _inside(self, tops: set[int]) -> list[bool]:
        """For every container whether it is one of ``tops`` or inside one."""
        inside = []
        # A container's number is above its parent's, so one pass settles all.
        for i, (_, parent, _) in enumerate(self.containers):
            inside.append(i in tops or parent >= 0 and inside[parent])
        return inside


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def winning_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, votes, pages, repeated, common) of the container path with most votes of each host.

    Votes are summed before they are shuffled, so a host of any size is a few rows per task. Equal votes
    go to the smaller path. A winner inside an article or main element gives the path of the nearest one;
    for any other one ``repeated`` has the keys of the paths under which all pages of the host have the same text,
    and ``common`` those of the paths that at least half of its pages have, with different texts.
    """
    rows = pages.select(host_of(quoted(url)).alias("host"), F.col(quoted(html)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Of a host and path: votes, pages, smallest and largest hash of a page's text under it.
            sums: dict[tuple[str, str], list] = {}
            for host, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                if not raw:
                    continue
                page, paths = Page(raw.decode()), {}
                for i, mark in page.own_texts().items():
                    path = page.path(i)
                    paths[path] = zlib.crc32(mark.to_bytes(4), paths.get(path, 0))
                for path, mark in paths.items():
                    entry = sums.setdefault((host, path), [0.0, 0, mark, mark])
                    entry[1:] = entry[1] + 1, min(entry[2], mark), max(entry[3], mark)
                for path, share in page.votes():
                    sums.setdefault((host, path), [0.0, 0, None, None])[0] += share
            columns = list(zip(*sums.values())) or [(), (), (), ()]
            numbers = [pa.array([round(v * 1e6) for v in columns[0]], pa.int64()), *[pa.array(c, pa.int64()) for c in columns[1:]]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in sums], pa.string()), pa.array([p for _, p in sums], pa.string()), pa.array([path_key(p) for _, p in sums], pa.int64()), *numbers],
                names=["host", "path", "key", "votes", "pages", "low", "high"],
            )

    found = rows.mapInArrow(run, "host string, path string, key long, votes long, pages long, low long, high long")
    found = stored(found, "votes").groupBy("host", "path", "key").agg(F.sum("votes").alias("votes"), F.sum("pages").alias("pages"), F.min("low").alias("low"), F.max("high").alias("high"))
    best = F.min_by(F.when(F.col("votes") > 0, F.col("path")), F.struct((-F.col("votes")).alias("v"), "path"))
    hosts = found.groupBy("host").agg(best.alias("best"), F.max("votes").alias("votes"), F.max("pages").alias("pages"))
    hosts = stored(hosts.where("best IS NOT NULL"), "hosts")
    # Where the article is marked as such, nothing else of the page is asked for.
    open_hosts = hosts.where(~F.col("best").rlike(WHOLE_PATH) & (F.col("pages") >= REPEATED_PAGES)).select("host", F.col("pages").alias("of"))
    varied = F.col("low") < F.col("high")
    paths = found.join(open_hosts, "host").where((~varied & (F.col("pages") >= REPEATED_PAGES)) | (varied & (2 * F.col("pages") >= F.col("of"))))
    keys = lambda which: F.sort_array(F.collect_set(F.when(which, F.col("key"))))
    agreed = paths.groupBy("host").agg(keys(~varied).alias("repeated"), keys(varied).alias("common"))
    return hosts.join(agreed, "host", "left").select("host", F.regexp_replace("best", INSIDE_WHOLE, "$1").alias("path"), "votes", "pages", "repeated", "common")


def extract_pages(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Adds ``text``, the main text of every page, and ``path``, the winning path of its host.

    Blocks are joined by an empty line, character references are decoded and white space inside a block is
    one space. NULL and empty pages, and pages without text, give an empty text. Pages without a host vote
    together. Repeated rows each get their text; columns with a result's name are replaced.
    """
    # What a host's pages agree on, as one line: the path, and where there are pages enough to tell, the other paths.
    listed = lambda c: F.array_join(F.coalesce(F.col(c), F.array()).cast("array<string>"), ",")
    told = F.concat_ws("\t", "path", F.when(F.col("pages") >= REPEATED_PAGES, F.concat_ws("\t", listed("repeated"), listed("common"))))
    winners = stored(winning_paths(pages, url, html).select("host", told.alias("told")), "paths")
    size = winners.agg(F.sum(F.length("host") + F.length("told") + 16)).first()[0] or 0
    kept = [c for c in pages.columns if c.lower() not in ("text", "path")] if keep is None else keep
    # The input row is one column, so no name of its own can clash.
    rows = pages.select(F.struct(*[F.col(quoted(c)) for c in kept]).alias("row") if kept else F.struct(F.lit(0)).alias("row"), host_of(quoted(url)).alias("host"), F.col(quoted(html)).alias("html"))
    rows = rows.join(F.broadcast(winners) if size <= BROADCAST_BYTES else winners, "host", "left")
    # One column carries both values to the task; what is told of a host has no line end.
    joined = rows.select("row", F.concat(F.coalesce("told", F.lit("")), F.lit("\n"), F.coalesce("html", F.lit(""))).alias("both"))

    def make():
        hosts = Generations(10_000)

        def work(batch):
            texts, paths = [], []
            for both in batch:
                line, _, raw = both.partition(b"\n")
                host = hosts.get(line)
                if host is None:
                    path, *keys = line.decode().split("\t")
                    agreed = Agreement(*[frozenset(map(int, k.split(",") if k else ())) for k in keys]) if keys else None
                    host = path or None, path_key(path) if path else None, agreed
                    hosts.put(line, host)
                texts.append(Page(raw.decode()).text(*host[1:]) if raw else "")
                paths.append(host[0])
            return [texts, paths]

        return work

    found = map_texts(joined, "both", "text string, path string", make, ["row"])
    return found.select(*(["row.*"] if kept else []), "text", "path")
