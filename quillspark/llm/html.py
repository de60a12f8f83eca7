"""Main-text extraction by consensus host paths.

Every page's containers are scored by the text that they hold; a container is named by its generalised path of
tags and classes (digits and hashes removed, positions ignored). Pages vote for paths, and Spark sums the votes by
host, with how many different texts a path holds on how many different pages. Paths whose text stays the same from
page to page are boilerplate of the host: they win nothing and are left out. Every page is then extracted again by
the best path of its host that it has. A page that has no path of its host's consensus falls back on its own best container.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillspark.llm.common import stash

#: A host's consensus are the paths with this share of its votes; there cannot be more than its inverse.
LEAST_SHARE = 1 / 64
#: A path is boilerplate where it holds at most this share as many texts as there are different pages, of which there are enough.
SAME_TEXT, ENOUGH_PAGES = 0.34, 6

#: HTML elements without content, raw text, blocks, and parts that are never main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
DROP = frozenset(
    "script style textarea title noscript template iframe xmp noembed noframes head nav footer aside form button "
    "select option input menu dialog svg canvas object audio video search fieldset".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINER = frozenset("article main section div body td center blockquote".split())
CLOSED_BY = {
    "p": BLOCK - frozenset(("body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr")),
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "option": frozenset(("option", "optgroup")),
    "tr": frozenset(("tr", "tbody", "tfoot")),
    "td": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "th": frozenset(("td", "th", "tr", "tbody", "tfoot")),
}

UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|comments?|commentlist|disqus|replies|respond|"
    r"sidebar|side|widget|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|foot|cookies?|consent|gdpr|"
    r"notice|alert|popup|modal|overlay|newsletter|subscribe|signup|social|share|sharing|related|recommended|"
    r"toolbar|pagination|pager|skip|login|search|form)(?:$|[\s_-]|\d)",
    re.I,
)
WANTED = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body|text|page)(?:$|[\s_-]|\d)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PLAIN = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without)[-_]\S*", re.I)
SPACES = re.compile(r"\s+")
NUMBERS = re.compile(r"[0-9a-f]*\d[0-9a-f]*", re.I)


def traits(tag: str, rest: str) -> tuple[str, bool, bool]:
    """The generalised step of an element, whether it is never main text, and whether its name speaks for main text."""
    if not rest.strip(" /"):
        return tag, tag in DROP, tag in ("article", "main")
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}
    names = PLAIN.sub("", " ".join(x for x in (found.get("class", ""), found.get("id", "")) if x))
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    hidden = hidden or "display:none" in found.get("style", "").replace(" ", "").lower()
    whole = tag in ("body", "html", "article", "main")
    bad = tag in DROP or hidden or found.get("role", "").lower() in ROLES or (not whole and bool(UNWANTED.search(names)))
    classes = sorted({NUMBERS.sub("", c).strip("-_").lower() for c in found.get("class", "").split()} - {""})
    return ".".join([tag, *classes]), bad, tag in ("article", "main") or bool(WANTED.search(names))


class Page:
    """A page's containers and its blocks of text in page order."""

    def __init__(self, source: str):
        self.paths: list[str] = [""]  # of each container
        self.parents: list[int] = [-1]
        self.wanted: list[bool] = [False]
        self.blocks: list[tuple[int, str, bool, int]] = []  # container, text, whether a heading, characters in links
        self.text: list[str] = []
        self.links = 0
        self.read(source)

    def flush(self, box: int, heading: bool) -> None:
        if self.text:
            text = SPACES.sub(" ", entities.unescape("".join(self.text))).strip()
            if text:
                self.blocks.append((box, text, heading, min(self.links, len(text))))
            self.text, self.links = [], 0

    def read(self, source: str) -> None:
        open_: list[tuple[str, str, int, int, int, int]] = []  # tag, step, and what held outside it
        box = drop = link = head = pos = 0
        n = len(source)
        while pos < n:
            m = TOKEN.search(source, pos)
            end = m.start() if m else n
            if end > pos and not drop:
                self.text.append(source[pos:end])
                self.links += (end - pos) * bool(link)
            if not m:
                break
            pos = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                if not drop and m[0].startswith("<![CDATA["):
                    self.text.append(m[0][9:].removesuffix("]]>"))
                continue
            if m[1] or m[4]:
                if tag == "br":
                    self.text.append(" ") if not drop else None
                    continue
                at = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == tag), None)
                if tag in BLOCK and not drop:
                    self.flush(box, bool(head))
                if at is not None:
                    _, _, box, drop, link, head = open_[at]
                    del open_[at:]
                continue
            rest = m[3] or m[6] or ""
            while open_ and tag in CLOSED_BY.get(open_[-1][0], ()):
                if not drop:
                    self.flush(box, bool(head))
                _, _, box, drop, link, head = open_.pop()
            if tag in BLOCK:
                # inline elements left open do not keep a paragraph from ending
                k = len(open_) - 1
                while k >= 0 and open_[k][0] not in BLOCK:
                    k -= 1
                if k >= 0 and tag in CLOSED_BY.get(open_[k][0], ()):
                    if not drop:
                        self.flush(box, bool(head))
                    _, _, box, drop, link, head = open_[k]
                    del open_[k:]
                if not drop:
                    self.flush(box, bool(head))
            if tag == "br" or tag == "hr":
                self.text.append(" ") if not drop else None
            if tag in VOID:
                continue
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, pos)
                pos = close.end() if close else n
                continue
            if rest.endswith("/") and tag not in BLOCK:
                continue
            step, bad, good = traits(tag, rest)
            open_.append((tag, step, box, drop, link, head))
            if bad:
                if not drop:
                    self.flush(box, bool(head))
                drop += 1
            if tag == "a":
                link += 1
            if tag in HEADING:
                head += 1
            if tag in CONTAINER and not drop:
                self.paths.append("/".join(x[1] for x in open_ if x[0] in CONTAINER or x[0] == "html"))
                self.parents.append(box)
                self.wanted.append(good)
                box = len(self.paths) - 1
        if not drop:
            self.flush(box, bool(head))

    def scores(self) -> list[float]:
        """Of each container: own text and half of what its children hold, less link text; more for a telling name."""
        own = [0.0] * len(self.paths)
        for box, text, heading, links in self.blocks:
            own[box] += max(0, len(text) - 2 * links) * (0.5 if heading else 1.0)
        held = list(own)
        for k in range(len(held) - 1, 0, -1):
            held[self.parents[k]] += held[k] * (0.9 if self.wanted[k] else 1.0)
        scores = []
        for k, path in enumerate(self.paths):
            inner = held[k]
            under = sum(held[j] for j in self.children(k) if self.wanted[j])
            score = own[k] + 0.5 * (inner - own[k]) if not under else own[k] + 0.4 * (inner - own[k])
            scores.append(score * (2.0 if self.wanted[k] else 1.0) if path else score * 0.25)
        return scores

    def children(self, k: int) -> list[int]:
        if not hasattr(self, "_children"):
            self._children: list[list[int]] = [[] for _ in self.paths]
            for j in range(1, len(self.paths)):
                self._children[self.parents[j]].append(j)
        return self._children[k]

    def votes(self) -> dict[str, float]:
        """The shares of the paths in the page's score, best first."""
        by: dict[str, float] = {}
        for path, score in zip(self.paths, self.scores()):
            if score > 0:
                by[path] = by.get(path, 0.0) + score
        whole = sum(by.values())
        return {p: s / whole for p, s in sorted(by.items(), key=lambda x: (-x[1], x[0]))}

    def texts(self) -> dict[str, str]:
        """What each path holds itself, without the containers in it."""
        by: dict[str, list[str]] = {}
        for box, text, _, _ in self.blocks:
            by.setdefault(self.paths[box], []).append(text)
        return {path: "\n".join(found) for path, found in by.items()}

    def extract(self, winners: list[str], same: frozenset[str] = frozenset()) -> str:
        """The text of the first of the winning paths that the page has with text, else of its own best container.

        Containers in it with a path of `same` are left out.
        """
        for path in [*winners, *self.votes()]:
            inside = [False] * len(self.paths)
            for k in range(len(self.paths)):
                inside[k] = self.paths[k] == path or (k > 0 and inside[self.parents[k]] and self.paths[k] not in same)
            text = "\n".join(b[1] for b in self.blocks if inside[b[0]])
            if text:
                return text
        return ""


def with_host(pages: DataFrame) -> DataFrame:
    """pages with __host, the lower-case host of the url; null where there is none."""
    host = F.regexp_extract(F.lower("url"), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return pages.withColumn("__host", F.when(host != "", host))


def host_paths(pages: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, paths, same): of every host the paths of its consensus, best first, ties by name, and its boilerplate paths."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for host, source in zip(rows["__host"], rows["html"]):
                if source:
                    page = Page(source)
                    texts, whole = page.texts(), xxh64_intdigest(source.encode("utf-8", "replace")) >> 1
                    held = {p: xxh64_intdigest(t.encode("utf-8", "replace")) >> 1 for p, t in texts.items()}
                    votes = page.votes()
                    found += [(host, p, votes.get(p, 0.0), held.get(p), whole) for p in votes.keys() | held.keys()]
            yield pd.DataFrame(found, columns=["host", "path", "share", "held", "page"]).astype({"held": "Int64"})

    some = pages.where("__host is not null and html is not null").select("__host", "html")
    votes = some.mapInPandas(vote, "host string, path string, share double, held long, page long")
    votes = votes.groupBy("host", "path").agg(
        F.round(F.sum("share"), 6).alias("votes"),
        F.approx_count_distinct("held", 0.02).alias("texts"),
        F.approx_count_distinct(F.when(F.col("held").isNotNull(), F.col("page")), 0.02).alias("pages"),
    )
    votes = stash(votes.withColumn("same", (F.col("pages") >= ENOUGH_PAGES) & (F.col("texts") <= F.col("pages") * SAME_TEXT)))
    cast = votes.groupBy("host").agg(F.sum("votes").alias("cast"), F.max("pages").alias("most"))
    votes = votes.join(cast, "host")
    wins = ~F.col("same") & (F.col("votes") >= F.col("cast") * least_share)
    common = F.col("same") & (F.col("pages") >= F.col("most") * least_share)
    ranked = F.struct((-F.col("votes")).alias("v"), "path")
    best = votes.where(wins | common).groupBy("host").agg(
        F.array_sort(F.collect_list(F.when(wins, ranked))).alias("best"), F.array_sort(F.collect_list(F.when(common, F.col("path")))).alias("same")
    )
    return best.select("host", F.col("best.path").alias("paths"), "same")


def extract_pages(pages: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, by the consensus paths of its host.

    A null or empty html gives an empty text; a page without a host stands for itself. Repeated rows vote and
    are extracted each, but count as one page where it is told which texts stay the same; columns other than page_id, url
    and html are not read.
    """
    hosted = with_host(pages.select("page_id", "url", "html"))
    paths = stash(host_paths(hosted, least_share))
    joined = hosted.join(paths, hosted["__host"] == paths["host"], "left").select("page_id", "url", "html", "paths", "same")

    @F.pandas_udf("string")
    def text(sources: pd.Series, best: pd.Series, same: pd.Series) -> pd.Series:
        listed = lambda p: list(p) if p is not None else []
        return pd.Series([Page(s).extract(listed(p), frozenset(listed(d))) if s else "" for s, p, d in zip(sources, best, same)], dtype=object)

    found = joined.select("page_id", "url", text("html", "paths", "same").alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
