"""HTML extraction by site template removal: subtrees that recur across a host's pages go.

Pass 1 parses every whole page, hashes its element subtrees (tag, text and the hashes of
what is inside) and sends (host, page digest, hashes).  Spark counts, for each host, the
distinct pages of every subtree; those on at least ``MIN_PAGES`` pages and a share ``SHARE`` of
the host's pages are its template.  A host can have at most 1 / SHARE times as many
template subtrees as a page has on average, so a host's list is small; all lists go to
every task while they hold at most ``BROADCAST_HASHES`` hashes, beyond that pages and
lists are joined on the host.  Pass 2 parses again, drops template subtrees and what its
element names or class words mark as not the article, and writes the blocks.

What a recurring subtree may not be: an element that holds an article, prose inside an
article (copies of articles and passages that many articles share are text), or a passage
of more than ``PASSAGE`` words that are not links.  Where a page marks its article (``article``,
``main``, ``role=main``, ``itemprop=articleBody``) only that is kept, an ``article`` inside a ``main``
before the rest of it, else what is left of the body.

Defined results: a null or empty page, or one without an article's text, gives an empty text of
0 characters; unclosed, misnested and cut-off markup is read as browsers do in the cases that
matter for text (implied ends of paragraphs, items and cells, raw text of scripts); repeated
rows are each extracted and count once for the template; pages without a host share the host '';
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import arrow_batches
from flowlens.session import materialize

MIN_PAGES = 5
SHARE = 0.05
PASSAGE = 50
#: Share of linked characters from which a subtree is a list of links.
LINKS = 0.6
BROADCAST_HASHES = 1_000_000
BATCH_BYTES = "8m"

# Names of HTML elements by their role, and class words of what is not an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr caption ul".split())
NEVER = frozenset(
    "script style noscript template head title textarea iframe noembed noframes object embed svg canvas audio video map "
    "nav aside footer form button select datalist dialog menu search".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: Elements that an implied end of a paragraph does not cross.
SCOPE = frozenset("html body table td th caption button object template article section div main aside nav header footer li blockquote".split())
HINTS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promoted promotion banner "
    "cookie cookies consent gdpr notice notices alert popup popups modal overlay newsletter subscribe subscription signup login paywall "
    "menu menus nav navbar navigation breadcrumb breadcrumbs masthead footer sidebar sidebars aside widget widgets toolbar "
    "share sharing social related recommended recommendations teaser teasers comment comments commentlist reply replies respond "
    "disqus pagination pager search skip outbrain taboola hidden".split())
#: Of these, what an element that marks an article may still be.
NOT_ARTICLES = frozenset("comment comments reply replies teaser teasers related recommended ad ads advert promo sponsored".split())
NEGATED = frozenset("no has with without is not".split())

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z]+")
SPACED = re.compile(r"\S+")


class Element:
    """An open element: its blocks so far, what its hash is made of, and how much of it is linked."""

    __slots__ = ("tag", "out", "digest", "drop", "marks", "linked", "chars", "words", "holds", "prose")

    def __init__(self, tag: str, drop: bool = False, marks: bool = False):
        self.tag, self.drop, self.marks = tag, drop, marks
        self.out: list[str | None] = []  # texts; None is the border of a block
        self.digest: list[bytes] = []
        self.linked = self.chars = self.words = 0
        self.holds = False  # holds an article that was kept
        self.prose = False  # holds a block with a passage that is not links


def _traits(tag: str, attrs: str) -> tuple[bool, bool]:
    """(not part of any article, marks an article)."""
    marks = tag in ("article", "main")
    if tag in NEVER:
        return True, False
    if not attrs or attrs.isspace():
        return False, marks
    found: set[str] = set()
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role", "itemprop"):
            marks |= (name == "role" and value in ("main", "article")) or (name == "itemprop" and value == "articlebody")
            for one in re.split(r"\s+", value):
                parts = WORDS.findall(one)
                if parts and parts[0] not in NEGATED:
                    found.update(parts)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return tag not in ("html", "body"), False
    if tag in ("html", "body"):
        return False, marks
    return not found.isdisjoint(NOT_ARTICLES if marks else HINTS), marks


class Page:
    """One parse of a page; with the host's ``template`` its text, without it the hashes to count."""

    def __init__(self, html: str, template: frozenset[int] = frozenset()):
        self.template, self.hashes = template, set()
        self.articles: list[list[str | None]] = []
        self.stack = [Element("")]
        self.inside = self.inside_article = 0  # open elements that mark an article; of these, <article>
        at, n, html = 0, len(html), html.replace("\x00", "")
        n = len(html)
        while at < n:
            token = TOKEN.search(html, at)
            if token is None:
                self._text(html[at:])
                break
            if token.start() > at:
                self._text(html[at : token.start()])
            at = token.end()
            name = (token["name"] or token["name2"] or "").lower()
            if not name:
                continue
            if token["end"] or token["end2"]:
                self._end(name)
                continue
            attrs = token["attrs"] if token["name"] else token["attrs2"]
            self._start(name, attrs or "")
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(html, at)
                at = close.start() if close else n
        while len(self.stack) > 1:
            self._close()

    def _text(self, text: str) -> None:
        top = self.stack[-1]
        if "&" in text:
            text = entities.unescape(text)
        top.out.append(text)
        words = SPACED.findall(text)
        if words:
            size = sum(map(len, words))
            top.chars += size
            top.words += len(words)
            top.digest.append(" ".join(words).encode("utf-8", "surrogatepass"))

    def _start(self, tag: str, attrs: str) -> None:
        if tag in CLOSES:
            ends, scope = CLOSES[tag]
            self._implied(ends, scope)
        if tag in BLOCKS:
            self._implied({"p"}, SCOPE)
        if tag == "br" or tag == "hr":
            self.stack[-1].out.append(None if tag == "hr" else " ")
        elif tag in ("td", "th"):
            self.stack[-1].out.append(" ")
        if tag in VOID:
            return
        drop, marks = _traits(tag, attrs)
        if tag == "header" and not self.inside:
            drop = True
        self.stack.append(Element(tag, drop, marks and not drop))
        self.inside += self.stack[-1].marks
        self.inside_article += self.stack[-1].marks and tag == "article"

    def _implied(self, ends: set[str], scope: frozenset[str] | set[str]) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in ends:
                while len(self.stack) > k:
                    self._close()
                return
            if self.stack[k].tag in scope:
                return

    def _end(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                while len(self.stack) > k:
                    self._close()
                return
            if tag not in BLOCKS and self.stack[k].tag in BLOCKS:
                return  # a stray inline end does not close blocks

    def _close(self) -> None:
        e, above = self.stack.pop(), self.stack[-1]
        self.inside -= e.marks
        self.inside_article -= e.marks and e.tag == "article"
        if e.digest:
            mark = hashlib.blake2b(b"\x1f".join([e.tag.encode("utf-8", "replace"), *e.digest]), digest_size=8).digest()
            above.digest.append(mark)
        if e.tag == "a":
            e.linked = e.chars
        above.linked, above.chars = above.linked + e.linked, above.chars + e.chars
        above.words += e.words
        above.holds |= e.holds
        links = e.chars > 0 and e.linked >= LINKS * e.chars
        e.prose |= e.tag in BLOCKS and e.tag != "form" and e.words > PASSAGE and not links
        if e.drop and not e.holds and not (e.tag == "form" and e.prose):  # some sites put the whole page into a form
            above.chars, above.linked, above.words = above.chars - e.chars, above.linked - e.linked, above.words - e.words
            above.out.append(None if e.tag in BLOCKS or e.tag in NEVER else " ")
            return
        if e.tag in BLOCKS and e.digest and not e.holds and not e.marks:
            if links or (not self.inside and e.words <= PASSAGE):
                name = int.from_bytes(mark, "little", signed=True)
                self.hashes.add(name)
                if name in self.template:
                    above.out.append(None)
                    return
        above.prose |= e.prose
        if e.marks and not self.inside_article and (e.tag == "article" or not self.inside):
            above.holds = True
            if e.tag == "article" or not e.holds:  # an article inside goes before what is around it
                self.articles.append(e.out)
            return
        if e.tag in BLOCKS:
            above.out.append(None)
            above.out += e.out
            above.out.append(None)
        else:
            above.out += e.out

    def text(self) -> str:
        """The blocks of the article, each with single spaces, one to a line."""
        parts = [p for article in self.articles for p in (None, *article)]
        if not any(p and not p.isspace() for p in parts):
            parts = [] if any(self.articles) else self.stack[0].out
        blocks, now = [], []
        for part in [*parts, None]:
            if part is not None:
                now.append(part)
            elif now:
                block = " ".join("".join(now).split())
                if block:
                    blocks.append(block)
                now = []
        return "\n".join(blocks)


def host_of(url):
    """The lower-cased host of a URL column, '' where there is none."""
    found = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(found)


def subtrees(pages: DataFrame) -> DataFrame:
    """host, page (digest of its html), hashes of its subtrees: one row per page."""
    names = ["host", "page", "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, hashes = [], []
            for html in batch["html"]:
                html = html.as_py() or ""
                digests.append(hashlib.blake2b(html.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                hashes.append(np.fromiter(Page(html).hashes, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch["host"], pa.array(digests, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], names=names)

    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, page binary, hashes array<long>")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """host, template (hashes of the subtrees that recur on many of its distinct pages)."""
    rows = materialize(subtrees(pages), "page-subtrees")
    distinct = rows.groupBy("host", "page").agg(F.first("hashes").alias("hashes"))
    every = distinct.select("host", F.explode(F.concat("hashes", F.array(F.lit(None).cast("long")))).alias("hash"))
    counts = every.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))  # the null hash counts the host's pages
    of_host = counts.filter(F.col("hash").isNull()).select("host", F.col("n").alias("pages"))
    many = counts.filter(F.col("hash").isNotNull() & (F.col("n") >= min_pages)).join(of_host, "host")
    return many.filter(F.col("n") >= F.col("pages") * share).groupBy("host").agg(F.collect_list("hash").alias("template"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    with arrow_batches(pages.sparkSession, BATCH_BYTES):
        found = materialize(templates(pages, min_pages, share), "page-templates")
    held = found.agg(F.sum(F.size("template"))).first()[0] or 0
    if held <= BROADCAST_HASHES:
        found = F.broadcast(found)
    slim = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    names = ["page_id", "url", "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, frozenset[int]] = {}
        for batch in batches:
            texts = []
            for host, html, hashes in zip(batch["host"].to_pylist(), batch["html"], batch["template"]):
                if host not in known:
                    known = {} if len(known) > 1000 else known
                    known[host] = frozenset(hashes.as_py() or ())
                texts.append(Page(html.as_py() or "", known[host]).text())
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), sizes], names=names)

    kind = dict(slim.dtypes)
    return slim.join(found, "host", "left").select("page_id", "url", "html", "host", "template").mapInArrow(
        run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
