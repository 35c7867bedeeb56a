"""Web: URL parts, HTML to text, DOM tables, CSS selectors, links, and a crawl over a table of pages."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence
from html.parser import HTMLParser
from urllib.parse import parse_qsl, unquote, urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window


def url_parts(c: str) -> Column:
    """(protocol, username, password, domain, port, path, page, query, anchor) of a URL column."""
    u = F.col(c)
    rest = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    pieces = F.split(rest, "/")
    login = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*)@", 1)
    pairs = F.filter(F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&"), lambda p: p != "")
    plain = lambda s: F.url_decode(F.when(s.rlike("%(?![0-9A-Fa-f]{2})"), F.regexp_replace(s, "%", "%25")).otherwise(s))
    entry = F.transform(pairs, lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("k"), F.nullif(plain(F.regexp_extract(p, "=(.*)$", 1)), F.lit("")).alias("v")))
    return F.struct(
        F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)).alias("protocol"), F.substring_index(login, ":", 1).alias("username"), F.regexp_extract(login, ":(.*)$", 1).alias("password"),
        F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("domain"), F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*:(\d+)", 1).try_cast("int").alias("port"),
        F.filter(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: p != "").alias("path"), F.element_at(pieces, -1).alias("page"), entry.alias("query"), F.regexp_extract(u, "#(.*)$", 1).alias("anchor"),
    )


def typed_query(query: str) -> dict:
    """A query string as a dict: empty and None are null, numbers are numbers."""
    out = {}
    for k, v in parse_qsl(query, keep_blank_values=True):
        v = None if v in ("", "None") else v
        out[k] = int(v) if v and re.fullmatch(r"-?\d+", v) else float(v) if v and re.fullmatch(r"-?\d+\.\d*", v) else v
    return out


@F.pandas_udf(T.StringType())
def absolute(url: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if u is None else urljoin(b or "", u) for u, b in zip(url, base, strict=True)])


#: Fixed separators that take the place of block elements: (before, after).
BLOCKS = {**dict.fromkeys("h1 h2 h3 h4 h5 h6 p div table form article section header footer nav ul ol dl blockquote pre".split(), ("", "\n\n")), "center": ("", "\n"), "li": ("* ", "\n"), "dt": ("", "\n"), "dd": ("", "\n"), "br": ("", "\n"), "tr": ("", "\n"), "td": ("", "\t"), "th": ("", "\t")}
_DROP = re.compile(r"<(script|style|form)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)


def strip_element(text: str, tag: str) -> str:
    """Without any element of the tag, nested ones and all."""
    out, depth, at = [], 0, 0
    for m in re.finditer(rf"<(/?){tag}\b[^>]*?(/?)>", text, re.I):
        if depth == 0:
            out.append(text[at : m.start()])
        if m[1]:
            depth = max(0, depth - 1)
        elif not m[2]:
            depth += 1
        at = m.end()
    return "".join(out) + (text[at:] if depth == 0 else "")


class _Stripper(HTMLParser):
    """Takes text in which every & is written &amp;, as the parser loses or completes references that aren't closed."""

    def __init__(self, keep: Sequence[str]):
        super().__init__(convert_charrefs=False)
        self.keep, self.out = set(keep), []

    def handle_starttag(self, tag, attrs):
        self.out.append(self.get_starttag_text() if tag in self.keep else BLOCKS.get(tag, ("", ""))[0])
        if tag == "br" and tag not in self.keep:
            self.out.append("\n")

    def handle_startendtag(self, tag, attrs):
        self.out.append(self.get_starttag_text() if tag in self.keep else BLOCKS.get(tag, ("", ""))[1])

    def handle_endtag(self, tag):
        self.out.append(f"</{tag}>" if tag in self.keep else BLOCKS.get(tag, ("", ""))[1])

    def handle_data(self, data):
        self.out.append(data)

    def handle_entityref(self, name):
        self.out.append(f"&{name};")


def strip_tags(text: str, keep: Sequence[str] = ()) -> str:
    s = _Stripper(keep)
    s.feed(text.replace("&", "&amp;"))
    s.close()
    return "".join(s.out).replace("&amp;", "&")


def to_plaintext(text: str | None, keep: Sequence[str] = (), linebreaks: int = 2) -> str:
    """HTML as text: no scripts, styles, forms or comments; blocks on lines of their own; references decoded."""
    s = html.unescape(strip_tags(_DROP.sub("", text or ""), keep))
    s = "\n".join(re.sub(r"[  ]+", " ", re.sub(r"\t+", "\t", line)).strip() for line in re.split(r"\r\n?|\n", s))
    return re.sub("\n{%d,}" % (linebreaks + 1), "\n" * linebreaks, s).strip()


@F.pandas_udf(T.StringType())
def plaintext(c: pd.Series) -> pd.Series:
    return c.map(to_plaintext, na_action="ignore")


def strip_between(a: str, b: str, c: Column) -> Column:
    return F.regexp_replace(c, rf"(?is)\Q{a}\E.*?\Q{b}\E", "")


def strip_javascript(c: Column) -> Column:
    return F.regexp_replace(c, r"(?is)<script\b.*?</script\s*>", "")


def strip_css(c: Column) -> Column:
    return F.regexp_replace(c, r"(?is)<style\b.*?</style\s*>", "")


def strip_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!--.*?-->", "")


def strip_forms(c: Column) -> Column:
    return F.regexp_replace(c, r"(?is)<form\b.*?</form\s*>", "")


NODE = T.ArrayType(T.StructType([T.StructField("node", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("attributes", T.MapType(T.StringType(), T.StringType())), T.StructField("text", T.StringType())]))
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Dom(HTMLParser):
    """Elements in document order: (node, parent, tag, attributes, text below)."""

    def __init__(self, text: str | None):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.feed(text or "")
        self.close()
        for n in self.nodes:
            n["text"] = " ".join("".join(n["text"]).split())

    def handle_starttag(self, tag, attrs):
        self.nodes.append({"node": len(self.nodes), "parent": self.open[-1] if self.open else None, "tag": tag, "attributes": {k: v or "" for k, v in attrs}, "text": []})
        if tag not in _VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[k]]["tag"] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        for i in self.open:
            self.nodes[i]["text"].append(data)


@F.pandas_udf(NODE)
def dom(c: pd.Series) -> pd.Series:
    return c.map(lambda t: Dom(t).nodes)


class Selector:
    """tag, #id, .class, [attr op= value], :first-child, :contains("..."), * and combinators " ", ">", "+", "<" (parent), ","."""

    _PART = re.compile(r"""(?P<tag>^[\w*-]+)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)\s*(?:(?P<op>[*^$~|]?=)\s*["']?(?P<val>[^"'\]]*)["']?)?\]|:contains\(["']?(?P<contains>.*?)["']?\)|:(?P<pseudo>first-child)""")

    def __init__(self, text: str):
        self.chains = [self._chain(x.strip()) for x in re.split(r",(?![^(\[]*[)\]])", text)]

    def _chain(self, text: str) -> list[tuple[str, list[dict]]]:
        out, how = [], " "
        for piece in re.findall(r"""[>+<]|(?:\[[^\]]*\]|\([^)]*\)|[^\s>+<])+""", text):
            if piece in "><+":
                how = piece
                continue
            out.append((how, [m.groupdict() for m in self._PART.finditer(piece)]))
            how = " "
        return out

    @staticmethod
    def _fits(n: dict, parts: list[dict], first: bool) -> bool:
        for p in parts:
            a = n["attributes"]
            if p["tag"] and p["tag"] != "*" and p["tag"].lower() != n["tag"]:
                return False
            if p["id"] and a.get("id") != p["id"] or p["cls"] and p["cls"] not in a.get("class", "").split():
                return False
            if p["attr"]:
                v = a.get(p["attr"])
                w = p["val"] or ""
                if v is None or p["op"] and not {"=": v == w, "^=": v.startswith(w), "$=": v.endswith(w), "*=": w in v, "~=": w in v.split(), "|=": v == w or v.startswith(w + "-")}[p["op"]]:
                    return False
            if p["contains"] and p["contains"].lower() not in n["text"].lower() or p["pseudo"] and not first:
                return False
        return True

    def search(self, nodes: list[dict]) -> list[dict]:
        children: dict = {}
        for n in nodes:
            children.setdefault(n["parent"], []).append(n["node"])
        first = {c[0] for c in children.values()}
        found = set()
        for chain in self.chains:
            now = set()
            for k, (how, parts) in enumerate(chain):
                hit = {n["node"] for n in nodes if self._fits(n, parts, n["node"] in first)}
                if k == 0:
                    now = hit
                elif how == "<":
                    now = {nodes[i]["parent"] for i in now} & hit
                elif how == ">":
                    now = {i for i in hit if nodes[i]["parent"] in now}
                elif how == "+":
                    after = {b for c in children.values() for a, b in zip(c, c[1:], strict=False) if a in now}
                    now = hit & after
                else:
                    below = set()
                    for n in nodes:  # parents come before their children
                        if n["parent"] in now or n["parent"] in below:
                            below.add(n["node"])
                    now = hit & below
            found |= now
        return [n for n in nodes if n["node"] in found]


def select(selector: str):
    """A UDF from HTML to the elements that a CSS selector finds."""
    s = Selector(selector)

    @F.pandas_udf(NODE)
    def run(c: pd.Series) -> pd.Series:
        return c.map(lambda t: s.search(Dom(t).nodes))

    return run


LINK = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("url", "text", "title", "relation")]))


#: Pages that a task has as Python objects at a time.
FEW = 64


@F.arrow_udf(LINK)
def links(c: pa.Array, base: pa.Array) -> pa.Array:
    """Absolute links of pages."""

    def one(text, url):
        return [{"url": urljoin(url or "", n["attributes"]["href"]), "text": n["text"], "title": n["attributes"].get("title", ""), "relation": n["attributes"].get("rel", "")} for n in Dom(text).nodes if n["tag"] == "a" and "href" in n["attributes"]]

    kind = to_arrow_type(LINK)
    # pages and links as Python objects only of a few pages at a time
    parts = [pa.array([one(t.as_py(), u.as_py()) for t, u in zip(c.slice(i, FEW), base.slice(i, FEW), strict=True)], kind) for i in range(0, len(c), FEW)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def normalize(c: Column) -> Column:
    """Without anchor and trailing slash, host in lower case."""
    s = F.regexp_replace(F.regexp_replace(c, "#.*$", ""), "/+$", "")
    return F.concat(F.lower(F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)), F.regexp_replace(s, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", ""))


def crawl(pages: DataFrame, seeds: DataFrame, steps: int = 3, per_domain: int = 100, domains: Sequence[str] = (), method: str = "depth") -> DataFrame:
    """(url, step, priority) visited from the seeds over a table of pages (url, html).

    A step takes, of each domain, the ``per_domain`` links of highest priority that weren't visited; links to the page's
    own domain have priority 0.80, to others 0.75 depth first and 0.85 breadth first.
    """
    external = 0.75 if method == "depth" else 0.85
    host = lambda c: F.regexp_extract(c, r"://([^/?#]*)", 1)
    out = pages.select(normalize(F.col("url")).alias("page"), F.explode(links("html", "url")).alias("l")).select("page", normalize(F.col("l.url")).alias("url"))
    out = out.where("page <> url").withColumn("priority", F.when(host(F.col("page")) == host(F.col("url")), 0.80).otherwise(external))
    if domains:
        out = out.where(F.lower(host(F.col("url"))).isin(*domains))
    edges = out.groupBy("page", "url").agg(F.max("priority").alias("priority")).persist()
    frontier = seeds.select(normalize(F.col("url")).alias("url"), F.lit(1.0).alias("priority")).distinct()
    visited = frontier.limit(0).withColumn("step", F.lit(0))
    for step in range(steps):
        order = Window.partitionBy(host(F.col("url"))).orderBy(F.desc("priority"), "url")
        now = frontier.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_domain).select("url", "priority", F.lit(step).alias("step"))
        visited = visited.unionByName(now)
        later = frontier.join(now.select("url"), "url", "left_anti")
        new = edges.join(now.select(F.col("url").alias("page")), "page").select("url", "priority")
        frontier = later.unionByName(new).groupBy("url").agg(F.max("priority").alias("priority")).join(visited.select("url"), "url", "left_anti")
    return visited.select("url", "step", "priority")


def share_of_totals(df: DataFrame, total: str) -> DataFrame:
    """Rows with ``share``: each total as a part of all."""
    whole = df.agg(F.sum(total).alias("_all"))
    return df.crossJoin(F.broadcast(whole)).withColumn("share", F.col(total) / F.col("_all")).drop("_all")  # one row


def decode_url(s: str) -> str:
    return unquote(s.replace("+", " "))


def oauth_signature(url: str, data: dict, method: str = "GET", secret: str = "", token: str = "") -> str:
    """HMAC-SHA1 signature of a request, as OAuth 1.0 (RFC 5849) defines it."""
    import base64
    import hashlib
    import hmac
    from urllib.parse import quote

    q = lambda s: quote(str(s), safe="~")
    u = urlsplit(url)
    pairs = sorted((q(k), q(v)) for k, v in [*parse_qsl(u.query), *data.items()])
    base = "&".join([method.upper(), q(f"{u.scheme}://{u.netloc}{u.path}".rstrip("?")), q("&".join(f"{k}={v}" for k, v in pairs))])
    return base64.b64encode(hmac.new(f"{q(secret)}&{q(token)}".encode(), base.encode(), hashlib.sha1).digest()).decode()
