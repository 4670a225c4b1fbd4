"""Main text of web pages by consensus host paths.

Every page's containers are scored by their text outside links, menus and other furniture; from the body down, the page
follows the container that holds most of the score and votes for its path of tags and classes (digits removed).
The votes are counted per host in Spark, and every page is extracted again at its host's winning path. A page that hasn't
that path, or has no text there, uses its own choice.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewell.functions.joins import lookup, materialise
from linewell.llm.common import slices
from linewell.llm.url_filter import split

MARKUP = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
NAMES = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math canvas object select".split())  # left out with all inside
CONTAINERS = frozenset("html body main article section div center table tbody thead tfoot tr td th form fieldset details blockquote figure ul ol dl header footer aside nav dialog".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address hr figcaption summary caption legend".split())
FURNITURE = frozenset("nav footer aside form head button dialog menu label".split())
# class, id and role words of furniture
FURNITURE_WORDS = frozenset("ad ads advert advertisement adbox banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer menu modal nav navbar navigation newsletter notice "
                            "popup promo promoted related respond search share sharing sidebar skip social sponsor sponsored subscribe widget".split())
SAME_CLOSES = frozenset("p li dt dd tr td th option".split())
DOMINANT = 0.8


class Page:
    """Elements (parent, path, last descendant, score) and text blocks (element, text) of one page, furniture left out."""

    def __init__(self, html: str):
        self.parent, self.path, self.last, self.score, self.tag = [-1], [""], [0], [0], [""]
        self.blocks: list[tuple[int, str]] = []
        self._stack: list[tuple[str, int, bool]] = [("", 0, False)]  # open elements: tag, nearest container, furniture
        self._text: list[str] = []
        self._linked = self._links = 0
        at = 0
        while m := MARKUP.search(html, at):
            self._add(html[at:m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                if not m[3].endswith("/"):
                    at = end.end() if end else len(html)
            else:
                self._open(tag, m[3])
        self._add(html[at:])
        self._flush()
        for e in range(len(self.parent) - 1, 0, -1):
            p = self.parent[e]
            self.last[p] = max(self.last[p], self.last[e])
            self.score[p] += max(0, self.score[e])

    def _add(self, text: str) -> None:
        if text and not self._stack[-1][2]:
            self._text.append(text)
            if self._links:
                self._linked += len(text)

    def _flush(self) -> None:
        if self._text:
            block = " ".join(unescape("".join(self._text)).split())
            self._text.clear()
            if block:
                e = self._stack[-1][1]
                self.blocks.append((e, block))
                self.score[e] += len(block) - 2 * min(self._linked, len(block))
        self._linked = 0

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            return self._add(" ")
        if tag in BLOCKS:
            self._flush()
            if tag in SAME_CLOSES or tag in CONTAINERS or tag[0] == "h":
                self._implied(tag)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            return None
        _, inside, furniture = self._stack[-1]
        names = [(k.lower(), v.strip("\"'").lower()) for k, v in NAMES.findall(attributes)] if attributes else []
        words = {w for k, v in names if k != "hidden" for w in re.findall(r"[a-z]+", v)}
        if tag not in ("html", "body", "article", "main"):
            furniture = furniture or tag in FURNITURE or tag == "header" and not any(t in ("article", "main") for t, *_ in self._stack) or bool(words & FURNITURE_WORDS) or any(k == "hidden" for k, _ in names)
        if tag in CONTAINERS:
            classes = "".join("." + re.sub(r"\d+", "", c) for k, v in names if k == "class" for c in sorted(v.split()))
            self.parent.append(inside)
            self.path.append(f"{self.path[inside]}>{tag}{classes}")
            self.tag.append(tag)
            self.score.append(0)
            inside = len(self.parent) - 1
            self.last.append(inside)
        self._links += tag == "a"
        self._stack.append((tag, inside, furniture))
        return None

    def _implied(self, tag: str) -> None:
        """An open paragraph ends at any block, an open item, row or cell at the next of its kind in the same list or table."""
        kinds = {"p", tag} if tag in SAME_CLOSES else {"p"}
        for k in range(len(self._stack) - 1, 0, -1):
            open_tag = self._stack[k][0]
            if open_tag in kinds:
                self._pop(k)
                return
            if open_tag in CONTAINERS and not (tag in ("tr", "td", "th") and open_tag in ("tr", "td", "th")):
                return

    def _close(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] == tag:
                self._pop(k)
                return
            if self._stack[k][0] in CONTAINERS and tag not in CONTAINERS:
                return

    def _pop(self, k: int) -> None:
        if any(t in BLOCKS for t, *_ in self._stack[k:]):
            self._flush()
        self._links -= sum(t == "a" for t, *_ in self._stack[k:])
        del self._stack[k:]

    def choice(self) -> int:
        """Follows the child that holds most of the score; an article or main element is taken whole."""
        here = 0
        while self.tag[here] not in ("article", "main"):
            best = max((e for e in range(here + 1, self.last[here] + 1) if self.parent[e] == here), key=lambda e: self.score[e], default=0)
            if not best or self.score[best] <= 0 or self.score[best] < DOMINANT * self.score[here]:
                break
            here = best
        return here

    def at(self, path: str | None) -> int | None:
        """The element of that path with the highest score (ties: the first)."""
        return max((e for e in range(1, len(self.path)) if self.path[e] == path), key=lambda e: (self.score[e], -e), default=None)

    def text(self, element: int) -> str:
        return "\n".join(b for e, b in self.blocks if element <= e <= self.last[element])


def votes(pages: DataFrame) -> DataFrame:
    """(host, path) of every page with text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hosts, paths = [], []
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page(html)
                chosen = page.choice()
                if page.blocks:
                    hosts.append(split(url)[0])
                    paths.append(page.path[chosen])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], ["host", "path"])

    return pages.filter("html IS NOT NULL").select("url", "html").mapInArrow(run, "host string, path string")


def winners(pages: DataFrame) -> DataFrame:
    """(host, path): the path with most votes of each host, ties to the first in order."""
    counted = votes(pages).groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("n"), "path")).alias("best")).select("host", F.col("best.path").alias("path"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Null and empty html, and pages without text, give the empty text. Pages without a host vote together. Null ids and
    repeated rows stay (repeated pages vote each); an empty table gives no rows. Only the three named columns are read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    best = materialise(winners(rows), "paths")
    # the host as split() has it
    rest = F.expr("substring(url, locate('://', url) + 3)")
    host = F.when(F.coalesce(F.locate("://", "url"), F.lit(0)) > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for path, html in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                page = Page(html or "")
                at = page.at(path)
                texts.append((page.text(at) if at is not None else "") or page.text(page.choice()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return (lookup(rows.withColumn("host", host), best, ["host"], "left").select("page_id", "url", "path", "html")
            .mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"))
