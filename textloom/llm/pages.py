"""HTML extraction by site style trees.

The DOMs of a host's pages are merged into one tree, whose nodes are element paths (tags with their class or id).  For each
node the tree counts which texts stand below it on the host's pages (content) and which sequences of children it has
(presentation).  Their entropies, as shares of what they could be, tell how much a branch varies from page to page; the
importance of a branch is the larger one of its content's and, for branches that hold other elements, a part of its
presentation's.  Branches of low importance (menus, notices and adverts repeat) are removed from each page, as are elements
whose role is named (nav, footer, class "cookie" ...): readers' comments and changing adverts vary as articles do.  Names that
an article's own parts have too (header, alert, legal) are only a prior inside one: such a branch has to vary much to stay.
``article`` and ``main`` are never removed for low importance.  Copies of a page count once.  A branch that is on one page
only gives no evidence; there the named roles decide alone.

Text: character references are decoded run by run, white space within a block becomes one space, blocks are joined by a blank line.

Defined results: a null or empty page has an empty text; broken markup is read as browsers do in the main (unclosed and
crossed elements, raw scripts, references without semicolons); a null or unparsable URL counts as the host ""; repeated
rows give repeated rows; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import urls
from textloom.llm.store import written
from textloom.llm.words import slices

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|[^<]++|<""", re.S)
_NAME = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "object", "noembed", "xmp"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements and names of roles that aren't part of an article.
_ROLES = set("nav footer aside form head script style noscript template iframe button select option menu dialog svg canvas audio video object fieldset".split())
#: What a class, id or role calls parts that go wherever they stand.
_SURE = set(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsors promo promos banner banners cookie cookies consent gdpr menu menus nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead comment comments "
    "disqus reply replies share sharing social newsletter subscribe popup modal overlay notice notices login toolbar pagination pager copyright dialog contentinfo complementary".split()
)
#: What goes outside of an article; inside, only a branch that hardly varies from page to page does.
_MAYBE = set("header side aside alert search widget widgets skip legal".split())
#: Words that say of what kind a part is, if they come first, and words that say nothing about it, if they come last.
_KIND = set("related recommended sponsored promoted advertising".split())
_PLAIN = set("bar box list wrap wrapper container block section area inner outer content body links link items item button buttons unit slot text panel holder group message form col row".split())
_KEEP = {"article", "main"}
_DEEP = 128  # levels of elements
_SALTS = 32  # parts of a host's pages, where they have to be dealt by host
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}


def _named(value: str) -> int:
    """2 if a class, id or role names a part that isn't an article's, 1 if it may, else 0."""
    found = 0
    for name in re.sub("([a-z])([A-Z])", r"\1-\2", value).lower().split():
        parts = [x for x in re.split(r"[-_0-9]+", name) if x]
        if parts and parts[0] in _KIND:
            return 2
        while len(parts) > 1 and parts[-1] in _PLAIN:
            parts.pop()
        if parts and parts[-1] in _SURE:
            return 2
        found = max(found, int(bool(parts) and parts[-1] in _MAYBE))
    return found


class Page:
    """A page's elements and its blocks of text in order.

    ``elements`` has, for each, its path, its parent, whether a named role is around it, whether it is in an article, and
    whether its own name may be a role.  ``blocks`` are (text, element).  An element below ``_DEEP`` levels counts as one
    of that level, as browsers take it; nothing of its text is lost, and work stays linear in the page's length.
    """

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int]] = []
        self.elements: list[tuple[int, int, bool, bool, bool]] = [(0, -1, False, False, False)]
        self.children: dict[int, list[str]] = {}
        self._open: list[tuple[str, int]] = [("", 0)]
        self._count: Counter = Counter()
        self._text: list[str] = []
        self._read(html)

    def around(self, element: int) -> Iterator[int]:
        """The element and those around it, innermost first."""
        while element > 0:
            yield element
            element = self.elements[element][1]

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.blocks.append((text, self._open[-1][1]))
        self._text = []

    def _label(self, tag: str, attributes: str) -> tuple[str, int]:
        label, noise = tag, 2 if tag in _ROLES else 1 if tag == "header" else 0
        if attributes:
            for m in _NAME.finditer(attributes):
                key, value = m[1].lower(), (m[2] or "").strip("\"'")
                if key in ("class", "id", "role"):
                    if tag not in _KEEP and tag not in ("html", "body"):
                        noise = max(noise, _named(value))
                    label += f"{'#' if key == 'id' else '.'}{re.sub('[0-9]+', '0', value.lower())}" if key != "role" else ""
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    noise = 2
        return label, noise

    def _pop(self) -> str:
        tag = self._open.pop()[0]
        self._count[tag] -= 1
        return tag

    def _push(self, tag: str, attributes: str) -> None:
        if self._open[-1][0] in _CLOSES.get(tag, {"p"}):
            self._pop()
        label, noise = self._label(tag, attributes)
        parent = self._open[min(len(self._open), _DEEP) - 1][1]
        path, _, hidden, inside, _ = self.elements[parent]
        self.children.setdefault(path, []).append(label)
        inside = inside or tag in _KEEP
        own = xxhash.xxh64_intdigest(label, path & (2**63 - 1)) >> 1
        self.elements.append((own, parent, hidden or noise == 2 or noise == 1 and not inside, inside, noise == 1))
        self._open.append((tag, len(self.elements) - 1))
        self._count[tag] += 1

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        closed: dict[str, bool] = {}
        while at < end:
            m = _TOKEN.match(html, at)
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                if m[0][0] != "<" or m[0] == "<":
                    self._text.append(unescape(m[0]))  # each run on its own: a reference doesn't go on behind a tag
                continue
            tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
            if tag in _RAW:
                if not closing and not attributes.endswith("/"):
                    stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at) if closed.get(tag, True) else None
                    closed[tag] = stop is not None  # none from here on: not searched for again
                    at = stop.end() if stop else end
                continue
            if tag in _VOID:
                if tag == "hr":
                    self._flush()
                else:
                    self._text.append(" " if tag == "br" else "")
                continue
            if tag in _INLINE and not (attributes and self._label(tag, attributes)[1] == 2) and not (closing and self._count[tag] > 0):
                continue
            self._flush()
            if not closing:
                self._push(tag, attributes)
            elif self._count[tag] > 0:
                while self._pop() != tag:
                    pass
        self._flush()


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, content?, feature, n, pages, lo, hi) of this task's pages, added up by slices; lo and hi of the pages' hashes."""
    for part in slices(batches, "html", 8 << 20):
        counts: Counter = Counter()
        on: Counter = Counter()
        ends: dict = {}
        for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
            page = Page(html or "")
            paths: dict[int, bool] = {}
            for text, element in page.blocks:
                if page.elements[element][2]:
                    continue  # goes anyway
                feature = xxhash.xxh64_intdigest(text) >> 1
                for e in page.around(element):
                    path, _, _, _, named = page.elements[e]
                    counts[host, path, True, feature] += 1
                    paths[path] = named
            of = xxhash.xxh64_intdigest("\0".join(text for text, e in page.blocks if not page.elements[e][2])) >> 1
            for path, named in paths.items():
                on[host, path] += 1
                lo, hi, _ = ends.get((host, path), (of, of, named))
                ends[host, path] = min(lo, of), max(hi, of), named
                if path in page.children:
                    counts[host, path, False, xxhash.xxh64_intdigest("|".join(page.children[path])) >> 1] += 1
        if counts:
            keys = list(counts)
            given: set = set()
            pages = [0 if k[:2] in given else given.add(k[:2]) or on[k[:2]] for k in keys]  # the pages of a path go with one of its rows
            columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64()), pa.array(pages, pa.int64()), *(pa.array([ends[k[:2]][i] for k in keys], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_())))], names=["host", "path", "content", "feature", "n", "pages", "lo", "hi", "named"])


def importance(pages: DataFrame) -> DataFrame:
    """(host, path, pages, named, differ, content, presentation): whether its pages aren't all the same one, and entropies of every node of the site style trees, as shares of log n."""
    rows = pages.mapInArrow(_tree, "host string, path long, content boolean, feature long, n long, pages long, lo long, hi long, named boolean")
    features = rows.groupBy("host", "path", "content", "feature").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("named").alias("named"))
    kinds = features.groupBy("host", "path").agg(
        F.sum("pages").alias("pages"), F.max("named").alias("named"), (F.min("lo") < F.max("hi")).alias("differ"), *(F.sum(F.when(F.col("content") == c, x)).alias(f"{name}_{k}") for c, name in ((True, "c"), (False, "p")) for k, x in (("n", F.col("n")), ("s", F.col("n") * F.log("n"))))
    )
    share = lambda k: F.when(F.col(f"{k}_n") > 1, (F.log(f"{k}_n") - F.col(f"{k}_s") / F.col(f"{k}_n")) / F.log(f"{k}_n")).otherwise(0.0)
    return kinds.select("host", "path", "pages", "named", "differ", share("c").alias("content"), share("p").alias("presentation"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html", 4 << 20):
        texts = []
        for html, drop in zip(part.column("html").to_pylist(), part.column("drop").to_pylist(), strict=True):
            page, low = Page(html or ""), set(drop or ())
            gone = [False]
            for path, parent, noise, inside, _ in page.elements[1:]:
                first = inside and not page.elements[parent][3]  # an article or main: what is around it doesn't count
                gone.append(noise or not first and (gone[parent] or path in low))
            keep = [text for text, e in page.blocks if not gone[e]]
            texts.append("\n\n".join(keep))
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _once(pages: DataFrame) -> DataFrame:
    """(host, html) of every different page of a host: copies of one page say nothing about what varies."""
    pages = pages.select("page_id", "host", "html", F.xxhash64("html").alias("h"))
    copies = pages.groupBy("host", "h").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1")
    copies = written(copies, "copies")  # few, as a rule: then they are sent out
    single = pages.join(copies, ["host", "h"], "left_anti")
    first = pages.join(copies, ["host", "h"]).where(F.col("page_id").eqNullSafe(F.col("first"))).groupBy("host", "h").agg(F.min("html").alias("html"))
    return single.select("host", "html").unionAll(first.select("host", "html"))


def extract(pages: DataFrame, low: float = 0.4, named: float = 0.9) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html).

    A branch goes if its importance is below ``low``, one inside an article whose name may be a role below ``named``.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.coalesce(urls.host(F.col("url")), F.lit("")).alias("host"))
    tree = importance(_once(pages))
    weak = tree.where(F.col("differ") & (F.greatest("content", F.col("presentation") * 0.5) < F.when(F.col("named"), named).otherwise(low)))
    drop = weak.groupBy("host").agg(F.collect_set("path").alias("drop"))  # as many as a site has kinds of branches
    # written first, so that its size is known: if it is small the optimiser sends it out, else a large host's pages are dealt by a salt
    drop = written(drop.select("host", "drop", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")), "branches")
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(_SALTS)).cast("int"))
    return salted.join(drop, ["host", "salt"], "left").select("page_id", "url", "html", "drop").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
