"""Main text of web pages by site template removal.

A page is a tree of elements.  Each subtree is hashed, the hashes are counted per host by
Spark, and subtrees that recur on pages of different content of their host are deleted as its template.  What
HTML itself names as no part of an article (menus, forms, scripts, adverts, comments) goes with them, also on hosts of
one page.  Of the rest, the text of the article elements is kept, or all of it where there are none.

Passages that many articles of a site share are no template: inside an article only containers can be one,
not paragraphs, headings or other prose, and only if articles of other texts hold them too.
"""

from __future__ import annotations

import html as references
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, materialize

_TAG = r"<(/?)([A-Za-z][^\s/>]*+)"
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|{_TAG}((?:"[^"]*+"|'[^']*+'|[^>"']++)*+)>|{_TAG}([^>]*+)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PIECES = re.compile(r"[a-z]+")

_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("iframe noembed script style textarea title xmp".split())
_HEAD = frozenset("base link meta noscript script style template title".split())
#: Prose: what an article consists of.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figcaption summary address tr".split())
#: Elements that are never part of an article's text, and those that hold whole pages.
_NEVER = frozenset("head script style noscript template iframe noembed xmp svg math object canvas audio video button select datalist textarea dialog menu".split())
_CHROME = frozenset("nav header footer aside form".split())
_FRAMES = frozenset("html body article main".split())
#: Words in class or id that name parts around an article, and roles that do.
_PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar sidenav menu menus nav navbar navigation breadcrumb breadcrumbs header footer masthead related recommended share sharing social newsletter subscribe subscription signup login search widget toolbar pagination pager".split()
)
_REPLIES = frozenset("comment comments disqus respond replies".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: An element of the key closes open elements of the first set, as far as the next of the second.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}

_PLAIN, _PART, _REPLY = 0, 1, 2


def _kind(tag: str, attrs: str) -> tuple[int, bool]:
    """What an element is by its name, class, id and role, and whether it is the page's main element by its role."""
    if tag in _NEVER:
        return _REPLY, False
    kind, main = (_PART if tag in _CHROME else _PLAIN), tag in ("article", "main")
    if attrs:
        for name, value in _NAMED.findall(attrs):
            value = value.strip("\"'").lower()
            if name.lower() == "role":
                main = main or value == "main"
                kind = max(kind, _PART) if value in _ROLES else kind
            elif tag not in ("html", "body"):
                words = set(_PIECES.findall(value))
                if words & _REPLIES:
                    return _REPLY, False
                if words & _PARTS and tag not in _FRAMES:
                    kind = _PART
    return kind, main


class Page:
    """A page's elements in order of their start: tag, kind, whether it is a main element, its parent, and its range in ``parts``.

    ``parts`` holds decoded text, and for each border of a block a mark that starts with a zero character.
    """

    def __init__(self, source: str):
        self.parts: list[str] = []
        self.tag, self.kind, self.main, self.parent, self.lo, self.hi = [], [], [], [], [], []
        open_: list[int] = []
        count: dict[str, int] = {}
        parts, tags = self.parts, self.tag

        def close(depth: int) -> None:
            while len(open_) > depth:
                e = open_.pop()
                count[tags[e]] -= 1
                self.hi[e] = len(parts)

        at, size = 0, len(source)
        while at < size:
            m = _TOKEN.search(source, at)
            if m is None or m.start() > at:
                text = source[at : m.start() if m else size]
                parts.append((references.unescape(text) if "&" in text else text).replace("\0", "�"))
            if m is None:
                break
            at = m.end()
            end, tag, attrs = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
            if tag is None:
                continue
            tag = tag.lower()
            block = tag not in _INLINE
            if block:
                parts.append("\0" + end + tag)
            if end:
                if count.get(tag):
                    depth = len(open_) - 1
                    while tags[open_[depth]] != tag and (block or tags[open_[depth]] in _INLINE):
                        depth -= 1
                    if tags[open_[depth]] == tag:
                        close(depth)
                continue
            if count.get("head") and tag not in _HEAD:
                close(next(i for i, e in enumerate(open_) if tags[e] == "head"))
            if block and count.get("p"):
                depth = len(open_)
                while depth and tags[open_[depth - 1]] in _INLINE:
                    depth -= 1
                if depth and tags[open_[depth - 1]] == "p":
                    close(depth - 1)
            if tag in _CLOSES and any(count.get(t) for t in _CLOSES[tag][0]):
                shut, stop = _CLOSES[tag]
                found = depth = len(open_)
                while depth and tags[open_[depth - 1]] not in stop:
                    depth -= 1
                    found = depth if tags[open_[depth]] in shut else found
                close(found)
            if tag in _VOID:
                continue
            kind, main = _kind(tag, attrs)
            if tag == "header" and (count.get("article") or count.get("main")):
                kind = _kind("div", attrs)[0]  # the article's own title
            if tag in _RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
                at = stop.start() if stop else size
                kind = _REPLY
            e = len(tags)
            for column, value in ((tags, tag), (self.kind, kind), (self.main, main), (self.parent, open_[-1] if open_ else -1), (self.lo, len(parts) - 1 if block else len(parts)), (self.hi, -1)):
                column.append(value)
            open_.append(e)
            count[tag] = count.get(tag, 0) + 1
        close(0)
        self._settle()

    def _settle(self) -> None:
        """Which elements go by their kind, which hold main elements, and which lie in one."""
        n = len(self.tag)
        self.chars = np.cumsum([0] + [0 if p[0] == "\0" else len(p) - p.count(" ") for p in self.parts])
        up = self.parent
        reply = [False] * n
        for e in range(n):
            reply[e] = self.kind[e] == _REPLY or (up[e] >= 0 and reply[up[e]])
        mains = [e for e in range(n) if self.main[e] and not reply[e] and self.size(e)]
        best = max((e for e in mains if self.tag[e] == "article"), key=self.size, default=None)
        best = max(mains, key=self.size, default=None) if best is None else best
        around = set()
        while best is not None and best >= 0:
            around.add(best)
            best = up[best]
        self.gone = [reply[e] or (self.kind[e] == _PART and e not in around) for e in range(n)]
        for e in range(n):
            self.gone[e] = self.gone[e] or (up[e] >= 0 and self.gone[up[e]])
        mains = [e for e in mains if not self.gone[e]]
        kept = [e for e in mains if self.tag[e] == "article"] or mains
        self.holds, self.inside = [False] * n, [False] * n
        for e in kept:
            self.inside[e] = True
        for e in range(n):
            self.inside[e] = self.inside[e] or (up[e] >= 0 and self.inside[up[e]])
        for e in reversed(range(n)):
            if up[e] >= 0 and (self.holds[e] or e in kept):
                self.holds[up[e]] = True
        self.kept = [e for e in kept if up[e] < 0 or not self.inside[up[e]]]

    def size(self, e: int) -> int:
        """Characters of text in an element, without spaces."""
        return int(self.chars[self.hi[e]] - self.chars[self.lo[e]])

    def text(self, without: list[int] = ()) -> str:
        """The text that is kept, in one line, without the given elements."""
        on = bytearray(len(self.parts)) if self.kept else bytearray(b"\1") * len(self.parts)
        for e in self.kept:
            on[self.lo[e] : self.hi[e]] = b"\1" * (self.hi[e] - self.lo[e])
        for e in [*without, *(e for e, gone in enumerate(self.gone) if gone)]:
            on[self.lo[e] : self.hi[e]] = bytes(self.hi[e] - self.lo[e])
        return " ".join("".join(" " if not x or p[0] == "\0" else p for p, x in zip(self.parts, on)).split())

    def subtrees(self) -> list[tuple[int, int, bool]]:
        """``(element, hash, prose)`` of all elements that can be of the site's template.

        None holds an article; inside one, none is prose or has half of its text or more. Attributes count for nothing.
        """
        out, whole = [], sum(self.size(e) for e in self.kept)
        for e, tag in enumerate(self.tag):
            if tag in _INLINE or tag in _FRAMES or tag in _NEVER or self.holds[e] or not self.size(e):
                continue
            if self.inside[e] and (tag in _PROSE or 2 * self.size(e) >= whole):
                continue
            parts = ("".join(p if p[0] == "\0" else " ".join(p.split()) for p in self.parts[self.lo[e] : self.hi[e]])).encode("utf-8", "replace")
            out.append((e, xxhash.xxh64_intdigest(parts), tag in _PROSE))
        return out


def _host(url: str | None) -> str:
    """What stands between the first :// and the next /, ? or #, in lower case; empty without one."""
    return re.split(r"[/?#]", url.split("://", 1)[1], maxsplit=1)[0].lower() if url and "://" in url else ""


def _long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _keys(host: str, page: Page) -> list[tuple[int, int, bool]]:
    """``(element, key, prose)``: a subtree of a host by one number, which is never 0."""
    salt = xxhash.xxh64_intdigest(host.encode("utf-8", "replace"))
    return [(e, _long(((h ^ salt) * 0x9E3779B97F4A7C15 + prose) & (2**64 - 1)) or 1, prose) for e, h, prose in page.subtrees()]


def _pages(batches, url: str = "url", source: str = "html"):
    """``(slice, [(host, Page), ...])`` of batches, some text at a time."""
    for whole in batches:
        for batch in by_bytes(whole, source, 1 << 22):
            yield batch, [(_host(u), Page(h or "")) for u, h in zip(batch.column(url).to_pylist(), batch.column(source).to_pylist())]


def occurrences(pages: DataFrame) -> DataFrame:
    """``(host, key, prose, content)``: a host's subtrees and the texts of the pages that hold them, each once a batch; key 0 stands for the page itself."""

    def run(batches):
        for _, found in _pages(batches):
            rows = set()
            for host, page in found:
                if not host:
                    continue
                site, content = _long(xxhash.xxh64_intdigest(host.encode("utf-8", "replace"))), _long(xxhash.xxh64_intdigest(page.text().encode("utf-8", "replace")))
                rows.update((site, key, prose, content) for _, key, prose in _keys(host, page))
                rows.add((site, 0, False, content))
            columns = zip(*rows) if rows else ([], [], [], [])
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.int64()))], names=["host", "key", "prose", "content"])

    return pages.select("url", "html").mapInArrow(run, "host long, key long, prose boolean, content long")


def templates(pages: DataFrame, least: int = 3, share: float = 0.01, prose_share: float = 0.5, parts: int = 16) -> DataFrame:
    """``(key)``: subtrees that recur on pages of their host.

    A subtree recurs if ``least`` or more different page texts of the host hold it, and ``share`` of all its texts (prose outside of
    articles: ``prose_share``). Copies of a page count once. A host's keys are dealt to ``parts`` tasks when they meet its total.
    """
    counts = materialize(occurrences(pages).distinct().groupBy("host", "key", "prose").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) | (F.col("key") == 0)), "subtrees")
    total = counts.where("key = 0").select("host", F.col("n").alias("total"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    some = counts.where((F.col("key") != 0) & (F.col("n") >= least)).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    enough = F.col("n") >= F.col("total") * F.when(F.col("prose"), F.lit(float(prose_share))).otherwise(F.lit(float(share)))
    return some.join(total, ["host", "part"]).where(enough).select("key").distinct()


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_sent: int = 1 << 20, **options) -> DataFrame:
    """``(page_id, url, text)`` for every row: the text of a page's article, without what recurs on its host.

    Character references are decoded, white space is one space, and blocks are joined by one; headings and paragraphs of the article stay, as do
    passages that articles share. Null or empty html gives an empty text; pages without a host in their url take no part in the counts; rows that
    repeat are judged alike, and as copies of one page; ties there are none. Broken markup (elements left open or cut off, stray ends, quotes never closed)
    is read as far as it goes. Very long pages are read whole. An empty table gives no rows; other columns are not read.

    The keys of templates are sent to the tasks while they are at most ``most_sent`` (8 bytes each); beyond, keys and pages meet by joins.
    Other options are those of :func:`templates`. Subtrees, hosts and page texts are told apart by 64-bit hashes.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = f"page_id {dict(rows.dtypes)['page_id']}, url string, text string"
    keys = materialize(templates(rows, **options), "templates")

    def extracted(batch, found, known):
        text = [page.text([e for e, key, _ in _keys(host, page) if key in mine]) for (host, page), mine in zip(found, known)]
        return pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    if keys.count() <= most_sent:
        sent = pages.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in keys.collect()], np.int64)))

        def run(batches):
            known = frozenset(sent.value.tolist())
            for batch, found in _pages(batches):
                yield extracted(batch, found, [known] * len(found))

        return rows.mapInArrow(run, schema)

    def held(batches):
        for batch, found in _pages(batches):
            pairs = [(r, key) for r, (host, page) in zip(batch.column("row").to_pylist(), found) for key in {k for _, k, _ in _keys(host, page)}]
            columns = zip(*pairs) if pairs else ([], [])
            yield pa.record_batch([pa.array(list(c), pa.int64()) for c in columns], names=["row", "key"])

    def run_joined(batches):
        for batch, found in _pages(batches):
            yield extracted(batch, found, [frozenset(k or ()) for k in batch.column("keys").to_pylist()])

    # a key of a large host is held by many pages: both sides are dealt to 16 parts of it
    named = rows.withColumn("row", F.xxhash64("url", "html"))
    salted = keys.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15))))
    each = named.mapInArrow(held, "row long, key long").distinct().withColumn("part", F.pmod(F.xxhash64("row"), F.lit(16)).cast("int"))
    mine = each.join(salted, ["key", "part"]).groupBy("row").agg(F.collect_list("key").alias("keys"))
    return named.join(mine, "row", "left").mapInArrow(run_joined, schema)


#: The same rows in SQL, for pages whose articles hold paragraphs, headings, bold text and line breaks only, and whose references are these.
ORACLE = r"""
    WITH article AS (SELECT page_id, url, coalesce(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '') AS body FROM pages),
    plain AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS body FROM article),
    decoded AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(body, '&quot;', '"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM plain)
    SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM decoded"""
