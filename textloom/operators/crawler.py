"""A crawl over a table of pages that is kept in a folder, can be stopped and resumed, and ends when nothing is left.

The frontier is a table of links with their priority: each round takes, of every host, the links of highest priority for
which the host has a slot, fetches them, and adds the links that it finds.  A host's slots are ``delay`` seconds apart; a
round is ``pace`` seconds long, so a host gives pace / delay pages a round at most, and no fetch of a host is
nearer than the delay to the one before, over rounds and restarts.

``follow`` and ``priority`` are expressions over page, url, page_host, host, depth, text, title and relation of a link.
A link's priority is the highest of the places where it was found; of equal ones the one found earlier, then the
smaller address, comes first.

Each round writes what it fetched and found to folders of its own, which are renamed when complete: a round that was cut
off is done anew and leaves no trace.  Addresses are compared by ``web.normalize``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import lineage
from textloom.operators import web

DEPTH, BREADTH = "depth", "breadth"
_FOUND = "url string, priority double, depth int, page string, found int"
_VISITED = "url string, host string, priority double, depth int, step int, fetched_at double, found boolean"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))


def default_priority(method: str = DEPTH) -> Column:
    """Links to the page's own host have 0.80; to others 0.75 depth first, 0.85 breadth first."""
    if method not in (DEPTH, BREADTH):
        raise ValueError("depth or breadth")
    return F.when(F.col("host") == F.col("page_host"), 0.80).otherwise(0.75 if method == DEPTH else 0.85)


def links_of(pages: DataFrame) -> DataFrame:
    """(page, url, text, title, relation) of all links in pages (url, html)."""
    out = pages.select(F.col("url").alias("page"), F.explode(web.links("html", "url")).alias("l"))
    return out.select("page", "l.url", "l.text", "l.title", "l.relation")


class Crawl:
    """pages: (url, ...) that can be fetched; links: (page, url, ...), cut out of pages' html if not given."""

    def __init__(self, spark: SparkSession, path: str, pages: DataFrame, links: DataFrame | None = None, follow: Column | None = None, priority: Column | None = None, delay: float = 10.0, pace: float = 100.0):
        if delay <= 0 or pace < delay:
            raise ValueError("a round has to be as long as the delay at least")
        self.spark, self.path, self.delay, self.pace = spark, path.rstrip("/"), delay, pace
        self.pages = lineage.cut(pages.select(web.normalize(F.col("url")).alias("url")).distinct())
        links = links_of(pages) if links is None else links
        for c in ("text", "title", "relation"):
            if c not in links.columns:
                links = links.withColumn(c, F.lit(None).cast("string"))
        # once: each round joins them, and they may have to be cut out of html
        self.links = lineage.cut(links.withColumns({"page": web.normalize(F.col("page")), "url": web.normalize(F.col("url"))}).where("page <> url"))
        self.follow = F.lit(True) if follow is None else follow
        self.priority = default_priority() if priority is None else priority
        self._jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jvm_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- folders

    def _steps(self, kind: str) -> list[int]:
        at = self._jvm_path(f"{self.path}/{kind}")
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _publish(self, rows: DataFrame, kind: str, step: int) -> None:
        """The folder appears whole, by one rename; one that is there already stays."""
        draft, final = f"{self.path}/_drafts/{kind}-{step}-{uuid.uuid4().hex}", f"{self.path}/{kind}/{step}"
        rows.write.parquet(draft)
        self._fs.mkdirs(self._jvm_path(f"{self.path}/{kind}"))
        if self._fs.exists(self._jvm_path(final)) or not self._fs.rename(self._jvm_path(draft), self._jvm_path(final)):
            raise RuntimeError(f"another crawl has written {final}")

    def _read(self, kind: str, schema: str, steps: list[int]) -> DataFrame:
        if not steps:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{kind}/{s}" for s in steps))

    # -- tables

    def push(self, urls: DataFrame) -> None:
        """Add links (url[, priority]) to the frontier, as of the next round; seeds have priority 1."""
        if "priority" not in urls.columns:
            urls = urls.withColumn("priority", F.lit(1.0))
        step = self._next()
        rows = urls.where(F.col("url").isNotNull()).select(web.normalize(F.col("url")).alias("url"), F.col("priority").cast("double"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("page"), F.lit(step).alias("found"))
        self._publish(rows.distinct(), f"pushed/{step}", len(self._steps(f"pushed/{step}")))

    def _next(self) -> int:
        done = self._steps("found")
        return done[-1] + 1 if done else 0

    def visited(self) -> DataFrame:
        """(url, host, priority, depth, step, fetched_at, found): what was fetched, or looked for in vain."""
        done = set(self._steps("found"))
        return self._read("visited", _VISITED, [s for s in self._steps("visited") if s in done])

    def frontier(self) -> DataFrame:
        """(url, priority, depth, found): links that are still to be visited."""
        rows = self._read("found", _FOUND, self._steps("found"))
        for step in self._steps("pushed"):
            rows = rows.unionAll(self._read(f"pushed/{step}", _FOUND, self._steps(f"pushed/{step}")))
        best = rows.groupBy("url").agg(F.max("priority").alias("priority"), F.min("depth").alias("depth"), F.min("found").alias("found"))
        return best.join(self.visited().select("url"), "url", "left_anti")

    # -- rounds

    def _chosen(self, step: int) -> DataFrame:
        """Links of this round with the time of their fetch."""
        now = step * self.pace
        order = [F.desc("priority"), "found", "url"]
        most = int(self.pace // self.delay) + 1
        queue = self.frontier().withColumn("host", host(F.col("url"))).withColumn("_part", F.pmod(F.xxhash64("url"), F.lit(32)))
        # the best of parts of a host first, so a host that has most of the frontier isn't one task's
        some = queue.withColumn("_r", F.row_number().over(Window.partitionBy("host", "_part").orderBy(*order))).where(F.col("_r") <= most)
        ranked = some.withColumn("_r", F.row_number().over(Window.partitionBy("host").orderBy(*order))).where(F.col("_r") <= most)
        free = self.visited().groupBy("host").agg((F.max("fetched_at") + self.delay).alias("_free"))
        timed = ranked.join(free, "host", "left").withColumn("fetched_at", F.greatest(F.lit(now), F.coalesce("_free", F.lit(now))) + (F.col("_r") - 1) * self.delay)
        return timed.where(F.col("fetched_at") < now + self.pace).select("url", "host", "priority", "depth", F.lit(step).alias("step"), "fetched_at")

    def step(self) -> int:
        """One round; the number of links it visited. 0 if the frontier is empty."""
        step = self._next()
        if step not in self._steps("visited"):  # else a run was cut off after it, and goes on here
            known = self.pages.withColumn("found", F.lit(True))
            self._publish(self._chosen(step).join(known, "url", "left").withColumn("found", F.coalesce("found", F.lit(False))), "visited", step)
        now = self._read("visited", _VISITED, [step])
        n = now.count()
        if not n and self.frontier().isEmpty():
            return 0
        fetched = now.where("found").select(F.col("url").alias("page"), F.col("host").alias("page_host"), (F.col("depth") + 1).alias("depth"))
        out = self.links.join(fetched, "page").withColumn("host", host(F.col("url"))).where(self.follow)
        new = out.groupBy("url").agg(F.max(self.priority).cast("double").alias("priority"), F.min("depth").alias("depth"), F.min("page").alias("page"))
        self._publish(new.select("url", "priority", "depth", "page", F.lit(step).alias("found")), "found", step)
        return n

    def run(self, rounds: int | None = None) -> DataFrame:
        """Rounds until the frontier is empty, or so many; what was visited in all."""
        while rounds is None or rounds > 0:
            if not self.step() and self.done():
                break
            rounds = None if rounds is None else rounds - 1
        return self.visited()

    def done(self) -> bool:
        return self.frontier().isEmpty()
