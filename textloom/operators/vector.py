"""Vector space over documents: counts, weights, similarity, search, feature selection, frequent sets.

A corpus is a long table of postings (doc_id, term, n), made by ``postings``; everything else is joins and aggregations on
it.  Natural logarithms stand for the base 2.71828 that term weights use, except in ``idf``, which keeps that base.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import lineage
from textloom.functions.stats import chi2p_column
from textloom.functions.strings import strip

BASE = 2.71828
TF, TFIDF, BINARY = "tf", "tf-idf", "binary"
COSINE, EUCLIDEAN, MANHATTAN, CHEBYSHEV, HAMMING = "cosine", "euclidean", "manhattan", "chebyshev", "hamming"
IG, GR, X2, DF = "infogain", "gainratio", "chisquared", "df"


def words(c: str | Column) -> Column:
    """Alphanumeric words: contractions are split off, punctuation at both ends is stripped."""
    c = F.col(c) if isinstance(c, str) else c
    mark = "\u0001"  # stands for an apostrophe that belongs to the word, while punctuation is stripped
    s = F.regexp_replace(c, r"(?<=[A-Za-z])'(?=(?:m|s|ve|re|ll|d)\b)", f" {mark}")
    s = F.regexp_replace(s, r"\b(b|c|d|gl|j|l|m|n|s|t|v)'(?=[A-Za-z])", f"$1{mark} ")
    split = F.transform(F.split(F.trim(F.regexp_replace(s, r"\s+", " ")), " "), lambda w: F.replace(strip(w), F.lit(mark), F.lit("'")))
    return F.filter(split, lambda w: F.regexp_replace(w, "^'+|'+$", "").rlike(r"^[\p{L}\p{N}]+$"))


def postings(docs: DataFrame, text: str = "text", stopwords: Sequence[str] = (), exclude: Sequence[str] = (), stem: Column | None = None, threshold: int = 0, top: int | None = None, tokens: Column | None = None) -> DataFrame:
    """(doc_id, term, n): lower-cased words that occur more than ``threshold`` times, the ``top`` ones by count, then word."""
    exploded = docs.select("doc_id", F.explode(words(F.lower(F.col(text))) if tokens is None else tokens).alias("term"))
    out = [*stopwords, *exclude]
    if out:
        exploded = exploded.where(~F.col("term").isin(out))
    if stem is not None:
        exploded = exploded.withColumn("term", stem)
    counts = exploded.groupBy("doc_id", "term").agg(F.count("*").alias("n")).where(F.col("n") > threshold)
    if top is not None:
        counts = counts.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "term"))).where(F.col("_r") <= top).drop("_r")
    return counts


def tf(p: DataFrame) -> DataFrame:
    """(doc_id, term, tf): counts as shares of their document's."""
    return p.select("doc_id", "term", (F.col("n") / F.sum("n").over(Window.partitionBy("doc_id"))).alias("tf"))


def document_frequency(p: DataFrame) -> DataFrame:
    """(term, df, idf): shares of documents, and ln(1 / df) / ln 2.71828, which is 0 for df 1."""
    n = p.agg(F.count_distinct("doc_id").alias("docs"))
    df = p.groupBy("term").agg(F.count("*").alias("d")).crossJoin(F.broadcast(n)).select("term", (F.col("d") / F.col("docs")).alias("df"))  # one row
    return df.withColumn("idf", F.when(F.col("df") == 1, 0.0).otherwise(F.log(1 / F.col("df")) / F.log(F.lit(BASE))))


def weights(p: DataFrame, scheme: str = TFIDF) -> DataFrame:
    """(doc_id, term, w) without zeros."""
    if scheme == BINARY:
        return p.select("doc_id", "term", F.lit(1.0).alias("w"))
    t = tf(p)
    if scheme == TF:
        return t.withColumnRenamed("tf", "w")
    return t.join(document_frequency(p), "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("w")).where("w <> 0")


def norms(v: DataFrame) -> DataFrame:
    return v.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def keywords(p: DataFrame, top: int = 10, normalized: bool = True, scheme: str = TF) -> DataFrame:
    """(doc_id, rank, term, w): each document's heaviest terms, ties by term; normalised weights sum to 1."""
    v = weights(p, scheme)
    if normalized:
        v = v.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("doc_id")))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("w"), "term"))
    return v.withColumn("rank", rank).where(F.col("rank") <= top).select("doc_id", "rank", "term", "w")


def corpus_keywords(p: DataFrame, top: int = 10) -> DataFrame:
    """(term, w): terms by their share of documents."""
    return document_frequency(p).orderBy(F.desc("df"), "term").limit(top).select("term", F.col("df").alias("w"))


#: Documents and terms of a block of ``neighbors``; a pair of blocks is one step of a task.
BLOCK_DOCS, BLOCK_TERMS = 6000, 1 << 21
#: Queries that meet a block at a time, terms that are dense columns at most, and products of weights that are added up at a time.
STRIPE, DENSE, PRODUCTS = 128, 1 << 11, 1 << 16


def neighbors(v: DataFrame, queries: DataFrame, top: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, similarity): the documents most like each query vector (doc_id, term, w), by cosine > 0.

    Vectors are dealt into blocks of a bounded size, and each block of queries meets each block of documents, some queries
    at a time: terms that many documents of both have are a product of dense matrices in single precision, others are added
    up by their postings.  Whatever may be among the best, by more than the products can be off, is summed again term by
    term in double precision, so equal vectors have equal similarities.
    """
    ids = lineage.cut(queries.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()))
    columns = [F.col(f"q.{x}") for x in ("block", "docs")] + [F.col("v.docs").alias("others")]
    # a task has few blocks of queries and up to six of documents, which it holds: the best of one spare candidates of the next
    pairs = _blocks(queries, ids, lambda n: min(n, 64)).alias("q").hint("shuffle_replicate_nl").crossJoin(_blocks(v, ids, lambda n: max(min(n, 4), -(-n // 6))).alias("v")).select(*columns)
    kinds = queries.schema["doc_id"].dataType.simpleString(), v.schema["doc_id"].dataType.simpleString()
    sim = pairs.mapInArrow(_nearest(top), f"query_id {kinds[0]}, doc_id {kinds[1]}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id"))
    return sim.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "doc_id", "similarity")


def _blocks(v: DataFrame, ids: DataFrame, parts: Callable[[int], int]) -> DataFrame:
    """(block, docs) of vectors, in ``parts`` of their number: documents by id with their norm, and numbers and weights of the terms that are in ``ids``."""
    found = v.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    rows = v.join(ids, "term").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("tid", "w"))).alias("e")).join(found, "doc_id")
    rows = rows.select("doc_id", "norm", F.col("e.tid").alias("tids"), F.col("e.w").alias("ws"))
    n, terms = v.agg(F.count_distinct("doc_id"), F.count("*")).first()
    blocks = max(-(-n // BLOCK_DOCS), -(-terms // BLOCK_TERMS), min(8, -(-n // 250)), 1)
    dealt = rows.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "norm", "tids", "ws"))).alias("docs"))
    return lineage.cut(dealt).coalesce(parts(blocks))


class _Vectors:
    """Sparse vectors one after another: ids, norms, and of all entries the row, term and weight."""

    def __init__(self, docs: pa.StructArray, same: int | None = None):
        tids, lists = docs.field("tids"), docs.field("ws")
        sizes = pc.list_value_length(tids).to_numpy(zero_copy_only=False)
        ids, norms = docs.field("doc_id").to_pylist(), docs.field("norm").to_numpy(zero_copy_only=False)
        tids, ws = tids.flatten().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
        if same is not None:  # of equal vectors only those with the smallest ids can be among the best
            at, seen, keep = np.concatenate([[0], np.cumsum(sizes)]), {}, np.ones(len(ids), bool)
            for i in range(len(ids)):
                key = (norms[i], tids[at[i] : at[i + 1]].tobytes(), ws[at[i] : at[i + 1]].tobytes())
                seen[key] = seen.get(key, 0) + 1
                keep[i] = seen[key] <= same
            inside = np.repeat(keep, sizes)
            ids, norms, tids, ws, sizes = [x for x, k in zip(ids, keep, strict=True) if k], norms[keep], tids[inside], ws[inside], sizes[keep]
        self.ids, self.norms, self.tids, self.ws, self.sizes = ids, norms, tids, ws, sizes
        self.rows = np.repeat(np.arange(len(ids)), sizes)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each stretch, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _dots(q: _Vectors, v: _Vectors, qk: np.ndarray, vk: np.ndarray, order: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, float]]:
    """(first query, cosines of some queries with all documents, how far they may be off); ``qk`` and ``vk`` are the terms, below n, ``order`` is by those of v."""
    qw, vw = (x.ws * np.divide(1.0, x.norms, out=np.zeros(len(x.norms)), where=np.isfinite(x.norms) & (x.norms > 0))[x.rows] for x in (q, v))
    qw, vw = (np.where(np.isfinite(x), x, 0.0) for x in (qw, vw))  # vectors without a norm are like none
    dq, dv = np.bincount(qk, minlength=n), np.bincount(vk, minlength=n)
    both, cells = dq * dv, len(q.ids) * len(v.ids)
    many = np.flatnonzero(both > cells / 600)
    if len(many) > DENSE:
        many = np.sort(many[np.argsort(both[many])[-DENSE:]])
    place = np.full(n, -1)
    place[many] = np.arange(len(many))
    a, b = np.zeros((len(q.ids), len(many)), np.float32), np.zeros((len(v.ids), len(many)), np.float32)
    for x, m, at, ws in ((q, a, place[qk], qw), (v, b, place[vk], vw)):
        m[x.rows[at >= 0], at[at >= 0]] = ws[at >= 0]
    b = np.ascontiguousarray(b.T)
    to, ws = v.rows[order], vw[order]
    first = np.concatenate([[0], np.cumsum(dv)])
    counts = np.where(place[qk] < 0, dv[qk], 0)
    before = np.concatenate([[0], np.cumsum(counts)])
    for begin in range(0, len(q.ids), STRIPE):
        end = min(begin + STRIPE, len(q.ids))
        sim = np.zeros((end - begin, len(v.ids)))
        flat, i, last = sim.ravel(), q.starts[begin], q.starts[end]
        while i < last:  # a bounded number of products, of one entry at least
            j = min(last, max(i + 1, int(np.searchsorted(before, before[i] + PRODUCTS, "right")) - 1))
            met = i + np.flatnonzero(counts[i:j])
            some = counts[met]
            entries = _expand(first[qk[met]], some)
            np.add.at(flat, np.repeat((q.rows[met] - begin) * len(v.ids), some) + to[entries], np.repeat(qw[met], some) * ws[entries])
            i = j
        if len(many):
            sim += a[begin:end] @ b
        yield begin, sim, (len(many) + 8) * 1.2e-7


def _best(q: _Vectors, v: _Vectors, best: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, document, similarity) by place: whatever may be among each query's best; ``best`` has their similarities so far, the least first."""
    top = best.shape[1]
    tids = np.concatenate([q.tids, v.tids])
    order = np.argsort(tids, kind="stable")
    k = np.empty(len(tids), np.int64)
    k[order] = np.cumsum(np.diff(tids[order], prepend=tids[order[:1]]) != 0)
    qk, vk, terms = k[: len(q.tids)], k[len(q.tids) :], int(k.max(initial=-1)) + 1
    at = {x: i for i, x in enumerate(v.ids)}
    own = np.array([at.get(x, -1) for x in q.ids], np.int64)
    number, signed = np.zeros(terms), min(q.ws.min(initial=0), v.ws.min(initial=0)) < 0
    for begin, sim, off in _dots(q, v, qk, vk, order[order >= len(q.tids)] - len(q.tids), terms):
        end = begin + len(sim)
        here = np.flatnonzero(own[begin:end] >= 0)
        sim[here, own[begin:end][here]] = -1
        floor = best[begin:end, 0].copy()
        likely = sim >= np.maximum(floor - off - 1e-9, -off if signed else np.nextafter(0.0, 1.0))[:, None]
        more = np.flatnonzero(np.count_nonzero(likely, axis=1) > top)
        if len(more):  # as far as is certain
            floor[more] = np.maximum(floor[more], np.partition(sim[more], len(v.ids) - top, axis=1)[:, len(v.ids) - top] - off)
            likely[more] &= sim[more] >= (floor[more] - off - 1e-9)[:, None]
        row, col = np.nonzero(likely)
        exact = np.empty(len(row))
        # candidates are in order of queries: a query's weights are laid out once
        edges = np.searchsorted(row, np.arange(len(sim) + 1))
        for i in np.unique(row):
            mine = slice(q.starts[begin + i], q.starts[begin + i + 1])
            number[qk[mine]] = q.ws[mine]
            docs = col[edges[i] : edges[i + 1]]
            entries = _expand(v.starts[docs], v.sizes[docs])
            sums = np.add.reduceat(number[vk[entries]] * v.ws[entries], np.concatenate([[0], np.cumsum(v.sizes[docs])[:-1]]))
            exact[edges[i] : edges[i + 1]] = sums = sums / (v.norms[docs] * q.norms[begin + i])
            number[qk[mine]] = 0
            best[begin + i] = np.sort(np.concatenate([best[begin + i], sums]))[-top:]
        good = (exact > 0) & (exact >= best[begin + row, 0] - 1e-9)
        yield row[good] + begin, col[good], exact[good]


def _nearest(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, q, found = None, None, {}
        for b in batches:
            for r in range(b.num_rows):
                if b.column("block")[r].as_py() != block or q is None:
                    block, q = b.column("block")[r].as_py(), _Vectors(b.column("docs").slice(r, 1).flatten())
                    best = found.setdefault(block, np.zeros((len(q.ids), top)))
                others = b.column("others").slice(r, 1).flatten()
                v = _Vectors(others, top + 1)
                for row, col, sim in _best(q, v, best):
                    ids = pa.array([q.ids[i] for i in row], b.schema.field("docs").type.value_type.field("doc_id").type), pa.array([v.ids[i] for i in col], others.type.field("doc_id").type)
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(sim)], names=["query_id", "doc_id", "similarity"])

    return run


def search(p: DataFrame, terms: Sequence[str], top: int = 10) -> DataFrame:
    """Documents for query words, as a document of its own with the corpus' idf."""
    spark = p.sparkSession
    q = spark.createDataFrame([(-1, t.lower()) for t in terms], "doc_id long, term string").groupBy("doc_id", "term").agg((F.count("*") / len(terms)).alias("tf"))
    q = q.join(document_frequency(p), "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    return neighbors(weights(p), q, top).drop("query_id")


def distances(v: DataFrame, pairs: DataFrame, method: str = COSINE) -> DataFrame:
    """pairs (a, b) with ``distance``; Euclidean is squared, Hamming a share of the longer vector's terms."""
    x = pairs.join(v.select(F.col("doc_id").alias("a"), "term", F.col("w").alias("x")), "a")
    y = pairs.join(v.select(F.col("doc_id").alias("b"), "term", F.col("w").alias("y")), "b")
    both = x.join(y, ["a", "b", "term"], "full")
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    norm = F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))
    measure = {
        COSINE: 1 - F.sum(x * y) / F.when(norm == 0, 1).otherwise(norm), EUCLIDEAN: F.sum((x - y) * (x - y)), MANHATTAN: F.sum(F.abs(x - y)), CHEBYSHEV: F.max(F.abs(x - y)),
        HAMMING: F.count_if(F.col("x").isNull() | F.col("y").isNull() | (x != y)) / F.greatest(F.count("x"), F.count("y"), F.lit(1)),
    }[method]
    return both.groupBy("a", "b").agg(measure.alias("distance"))


def centroid(v: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, term, w): means over the documents of each label; a missing term counts as 0."""
    n = labels.groupBy("label").agg(F.count("*").alias("docs"))
    return v.join(labels, "doc_id").groupBy("label", "term").agg(F.sum("w").alias("s")).join(n, "label").select("label", "term", (F.col("s") / F.col("docs")).alias("w"))


def inverted_index(p: DataFrame) -> DataFrame:
    """(term, docs): sorted documents of each term."""
    return p.groupBy("term").agg(F.sort_array(F.collect_set("doc_id")).alias("docs"))


def posterior(p: DataFrame, labels: DataFrame) -> DataFrame:
    """(term, label, p): share of a term's documents that have the label."""
    c = p.join(labels, "doc_id").groupBy("term", "label").agg(F.count("*").alias("c"))
    return c.select("term", "label", (F.col("c") / F.sum("c").over(Window.partitionBy("term"))).alias("p"))


def _classes(labels: DataFrame) -> DataFrame:
    c = labels.groupBy("label").agg(F.count("*").alias("nc"))
    total = labels.agg(F.count("*").alias("total"), F.count_distinct("label").alias("k"))
    return c.crossJoin(F.broadcast(total))  # one row


def chi_squared(p: DataFrame, labels: DataFrame) -> DataFrame:
    """(term, x2, p): presence against class; cells with nothing observed or nothing expected are passed over."""
    classes = _classes(labels)
    present = p.join(labels, "doc_id").groupBy("term", "label").agg(F.count("*").alias("o"))
    terms = present.groupBy("term").agg(F.sum("o").alias("d"))
    cells = terms.crossJoin(F.broadcast(classes)).join(present, ["term", "label"], "left").fillna(0, ["o"])  # a row a class
    cell = lambda o, e: F.when((o == 0) | (e == 0), 0.0).otherwise(F.pow(o - e, 2) / e)
    d, nc, n, o = (F.col(x) for x in ("d", "nc", "total", "o"))
    x2 = cells.groupBy("term").agg(F.sum(cell(o, d * nc / n) + cell(nc - o, (n - d) * nc / n)).alias("x2"), (F.first("k") - 1).alias("free"))
    return x2.withColumn("p", chi2p_column("x2", "free")).select("term", "x2", "p")


def _entropy(share: Column, base: Column) -> Column:
    return F.when(share > 0, -share * F.log(share) / F.log(base)).otherwise(0.0)


def information_gain(v: DataFrame, labels: DataFrame) -> DataFrame:
    """(term, ig, gr): gain over weights in buckets of one decimal, with a bucket 0 of the documents without the term."""
    classes = _classes(labels)
    base = F.greatest(F.col("k"), F.lit(2)).cast("double")
    whole = classes.groupBy("total", "k").agg(F.sum(_entropy(F.col("nc") / F.col("total"), base)).alias("h"))
    seen = v.join(labels, "doc_id").groupBy("term", F.round("w", 1).alias("b"), "label").agg(F.count("*").alias("c"))
    rest = seen.select("term").distinct().crossJoin(F.broadcast(classes)).join(seen.groupBy("term", "label").agg(F.sum("c").alias("c")), ["term", "label"], "left")  # a row a class
    rest = rest.select("term", F.lit(0.0).alias("b"), "label", (F.col("nc") - F.coalesce("c", F.lit(0))).alias("c")).where("c > 0")
    cells = seen.unionAll(rest).groupBy("term", "b", "label").agg(F.sum("c").alias("c")).withColumn("nb", F.sum("c").over(Window.partitionBy("term", "b"))).crossJoin(F.broadcast(whole))  # one row
    buckets = cells.groupBy("term", "b").agg(F.first("nb").alias("nb"), F.first("total").alias("total"), F.first("h").alias("h"), F.sum(_entropy(F.col("c") / F.col("nb"), base)).alias("hb"))
    share = F.col("nb") / F.col("total")
    out = buckets.groupBy("term").agg((F.first("h") - F.sum(share * F.col("hb"))).alias("ig"), F.sum(_entropy(share, F.lit(2.0))).alias("si"))
    return out.select("term", "ig", (F.col("ig") / F.when(F.col("si") == 0, 1).otherwise(F.col("si"))).alias("gr"))


def feature_selection(p: DataFrame, labels: DataFrame, top: int = 100, method: str = X2, threshold: float = 0.0) -> DataFrame:
    """(term, score): the ``top`` terms with df >= threshold, by score, ties by term."""
    score = {
        X2: lambda: chi_squared(p, labels).select("term", (1 - F.col("p")).alias("score")), IG: lambda: information_gain(weights(p, BINARY), labels).select("term", F.col("ig").alias("score")),
        GR: lambda: information_gain(weights(p, BINARY), labels).select("term", F.col("gr").alias("score")), DF: lambda: document_frequency(p).select("term", F.col("df").alias("score")),
    }[method]()
    return score.join(document_frequency(p).where(F.col("df") >= threshold).select("term"), "term").orderBy(F.desc("score"), "term").limit(top)


def filter_terms(p: DataFrame, terms: DataFrame) -> DataFrame:
    return p.join(terms.select("term"), "term", "left_semi")


def frequent_sets(sets: DataFrame, support: float = 0.5, most: int | None = None) -> DataFrame:
    """(items, support) of item sets in at least ``support`` of the baskets (doc_id, term), level by level.

    A set can only be frequent if all its subsets are, so each level joins what the one before it left; the last level is
    the one that leaves nothing, or sets of ``most`` items if that is given.
    """
    items = sets.select("doc_id", "term").distinct()
    n = items.agg(F.count_distinct("doc_id").alias("total"))
    enough = lambda df: df.crossJoin(F.broadcast(n)).where(F.col("c") >= support * F.col("total")).select("items", (F.col("c") / F.col("total")).alias("support"))  # noqa: E731  one row
    found = kept = lineage.cut(enough(items.groupBy(F.array("term").alias("items")).agg(F.count("*").alias("c"))))
    singles = items.join(kept.select(F.col("items")[0].alias("term")), "term", "left_semi").persist()
    grown = singles.select("doc_id", F.array("term").alias("items"))
    size = 1
    while (most is None or size < most) and not kept.isEmpty():
        nxt = singles.withColumnRenamed("doc_id", "d")
        grown = grown.join(nxt, (F.col("doc_id") == F.col("d")) & (F.element_at("items", -1) < F.col("term"))).select("doc_id", F.concat("items", F.array("term")).alias("items"))
        kept = lineage.cut(enough(grown.groupBy("items").agg(F.count("*").alias("c"))))
        grown = lineage.cut(grown.join(kept.select("items"), "items", "left_semi").select("doc_id", "items"))
        found = found.unionAll(kept)
        size += 1
    singles.unpersist()
    return found


def cooccurrence(docs: DataFrame, tokens: Column, window: tuple[int, int] = (-1, 1), term1: Column | None = None, term2: Column | None = None) -> DataFrame:
    """(term1, term2, n) of tokens within a window of relative positions around each anchor, itself if 0 is inside.

    Each anchor looks at a slice of its own document, so positions are never joined.
    """
    left, right = window
    words_ = docs.select(tokens.alias("t"))
    anchors = words_.select("t", F.posexplode("t").alias("i", "term1"))
    begin = F.greatest(F.col("i") + left, F.lit(0))
    length = F.least(F.col("i") + right, F.size("t") - 1) - begin + 1
    around = F.when(length > 0, F.slice("t", begin + 1, F.greatest(length, F.lit(0)))).otherwise(F.slice("t", 1, 0))
    pairs = anchors.where(F.lit(True) if term1 is None else term1).select("term1", F.explode(around).alias("term2"))
    return pairs.where(F.lit(True) if term2 is None else term2).groupBy("term1", "term2").agg(F.count("*").alias("n"))


def intertextuality(grams: DataFrame) -> DataFrame:
    """(a, b, weight): share of a's n-gram occurrences (doc_id, gram) that are of distinct n-grams shared with b, at most 1."""
    counts = grams.groupBy("doc_id", "gram").agg(F.count("*").alias("c"))
    total = counts.groupBy("doc_id").agg(F.sum("c").alias("total"))
    # n-grams of one document meet nothing: they go before the join
    several = counts.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram")
    met = counts.join(several, "gram", "left_semi")
    a, b = met.select(F.col("doc_id").alias("a"), "gram"), met.select(F.col("doc_id").alias("b"), "gram")
    shared = a.join(b, "gram").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("s"))
    return shared.join(total.withColumnRenamed("doc_id", "a"), "a").select("a", "b", F.least(F.lit(1.0), F.col("s") / F.col("total")).alias("weight"))


#: Documents and entries of a block of ``overlaps``, and entries that are met at a time.
OVERLAP_DOCS, OVERLAP_ENTRIES, MET = 1 << 15, 1 << 19, 1 << 18


def overlaps(docs: DataFrame) -> DataFrame:
    """The rows of ``intertextuality`` of documents (doc_id, grams, n_grams), all pairs, without a shuffle of pairs.

    Documents are dealt into blocks of a bounded size; each two blocks meet in one step of a task, which gives the pairs of
    both directions a bounded number at a time.  Rows and work grow with the pairs, memory and tables with the n-grams.
    """
    known = docs.where("doc_id is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    totals = known.groupBy("doc_id").agg(F.sum("n_grams").alias("total"))
    tables = lineage.Scratch(docs.sparkSession, "overlaps")
    found = tables.put("found", _shared(known).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("x", "n"))).alias("e")))
    n, size = found.agg(F.count("*"), F.coalesce(F.sum(F.size("e")), F.lit(0))).first()
    blocks = max(-(-n // OVERLAP_DOCS), -(-size // OVERLAP_ENTRIES), min(6, -(-n // 1000)), 1)
    rows = F.sort_array(F.collect_list(F.struct("doc_id", "total", F.col("e.x").alias("x"), F.col("e.n").alias("n"))))
    blocked = lineage.cut(found.join(totals, "doc_id").groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block")).agg(rows.alias("rows")).coalesce(min(blocks, 64)))
    met = blocked.alias("a").hint("shuffle_replicate_nl").crossJoin(blocked.alias("b")).where("a.block <= b.block").select(*(F.col(f"{t}.{c}").alias(t + c) for t in "ab" for c in ("block", "rows")))
    return met.mapInArrow(_pairs, f"a {kind}, b {kind}, weight double")


def _shared(docs: DataFrame) -> DataFrame:
    """(doc_id, x, n, k): documents (doc_id, grams) and how many of their n-grams are those that the same k documents have, more than one; x stands for these."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = docs.select("doc_id", F.array_distinct(F.transform("grams", lambda g: F.xxhash64(g))).alias("hs")).where("hs is not null")
    dealt = hashed.mapInArrow(_deal, f"bucket int, docs array<{kind}>, counts array<int>, hs binary")
    met = dealt.groupBy("bucket").applyInArrow(_met, f"doc_id {kind}, x long, k int")
    return met.repartition("doc_id").groupBy("doc_id", "x").agg(F.count("*").alias("n"), F.max("k").alias("k"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, a = None, None
    for batch in batches:
        for r in range(batch.num_rows):
            one, other = batch.column("ablock")[r].as_py(), batch.column("bblock")[r].as_py()
            if one != block:
                block, a = one, _Entries(batch.column("arows").slice(r, 1).flatten(), "doc_id", "total")
            b = _Entries(batch.column("brows").slice(r, 1).flatten(), "doc_id", "total")
            for i, j, n in _meetings(a, b):
                if one == other:  # both directions are among the meetings
                    i, j, n = (x[i != j] for x in (i, j, n))
                for left, right, x, y in ((a, b, i, j),) if one == other else ((a, b, i, j), (b, a, j, i)):
                    yield pa.RecordBatch.from_arrays([left.ids.take(pa.array(x)), right.ids.take(pa.array(y)), pa.array(np.minimum(1.0, n / left.m[x]))], names=["a", "b", "weight"])


def _meetings(a: _Entries, b: _Entries) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, n-grams that both have), of some rows of a at a time."""
    width = len(b.ids)
    order = np.argsort(b.x, kind="stable")
    sets, first, held = np.unique(b.x[order], return_index=True, return_counts=True)
    to = b.rows[order]
    place = np.minimum(np.searchsorted(sets, a.x), len(sets) - 1)
    hit = np.flatnonzero(sets[place] == a.x)
    place, rows, n = place[hit], a.rows[hit], a.n[hit]
    counts = held[place]
    ends, before = np.searchsorted(rows, np.arange(1, len(a.ids) + 1)), np.concatenate([[0], np.cumsum(counts)])
    begin = 0
    while begin < len(a.ids):
        i = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(before[ends], before[i] + MET, "right")))
        j = ends[end - 1]
        if i < j:
            cells = np.repeat(rows[i:j] * width, counts[i:j]) + to[_expand(first[place[i:j]], counts[i:j])]
            by = np.argsort(cells)
            cells, met = cells[by], np.repeat(n[i:j], counts[i:j])[by]
            starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
            yield *np.divmod(cells[starts], width), np.add.reduceat(met, starts)
        begin = end


#: Classes and entries of a block of ``reuse``, and cells that are added up at a time.
BLOCK_CLASSES, BLOCK_ENTRIES, CELLS = 16_000, 1 << 19, 1 << 17


def reuse(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_grams, n_links, closest, weight, weights): what ``intertextuality`` says of each document (doc_id, grams), without a row for each pair.

    A link of a document is another that has one of its distinct n-grams as well; a weight is the share of its ``n_grams``
    occurrences, and ``weights`` the sum over all its links.  Documents that have the same n-grams of those that are shared
    at all are a class, named by its smallest id: their links and what they share with each are the same.  ``closest`` is
    the class that has most of the document's n-grams, by another of its documents, the smallest one among equals, and
    ``weight`` its share.  Documents without links are classes of their own; closest is null then.

    N-grams that the same documents have are added up as one.  Classes are dealt into blocks of a bounded size and each
    block meets each: work grows with the pairs of classes, tables with the n-grams.  N-grams, sets of documents and
    classes are known by 64 bits of a hash (10**9 n-grams would have 0.03 pairs of equal hashes).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    totals = docs.groupBy("doc_id").agg(F.sum(F.coalesce(F.size("grams"), F.lit(0))).alias("n_grams"))
    found = _shared(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("x", "n"))).alias("e"), F.sum(F.col("n") * (F.col("k") - 1)).alias("shared"))
    tables = lineage.Scratch(docs.sparkSession, "reuse")
    found = tables.put("found", found.withColumn("sig", F.xxhash64("e")))
    classes = tables.put("classes", found.groupBy("sig").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("m"), F.any_value("e").alias("e")))
    n, size = classes.agg(F.count("*"), F.coalesce(F.sum(F.size("e")), F.lit(0))).first()
    blocks = max(-(-n // BLOCK_CLASSES), -(-size // BLOCK_ENTRIES), min(6, -(-n // 1000)), 1)
    members = F.sort_array(F.collect_list(F.struct("class_id", "m", F.col("e.x").alias("x"), F.col("e.n").alias("n"))))
    blocked = lineage.cut(classes.groupBy(F.pmod(F.xxhash64("class_id"), F.lit(blocks)).alias("block")).agg(members.alias("rows")).coalesce(min(blocks, 64)))
    pairs = blocked.alias("a").hint("shuffle_replicate_nl").crossJoin(blocked.alias("b")).select(*(F.col(f"{t}.{c}").alias(t + c) for t in "ab" for c in ("block", "rows")))
    part = pairs.mapInArrow(_overlaps, f"class_id {kind}, links long, most long, closest {kind}")
    best = part.groupBy("class_id").agg((F.sum("links") - 1).alias("n_links"), F.min(F.when(F.col("most") > 0, F.struct((-F.col("most")).alias("less"), "closest"))).alias("best"))
    of = found.select("doc_id", "sig", "shared").join(classes.select("sig", "class_id"), "sig").join(best, "class_id")
    share = lambda c: F.coalesce(c / F.col("n_grams"), F.lit(0.0))
    columns = [F.coalesce("class_id", "doc_id").alias("class_id"), "n_grams", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("best.closest").alias("closest")]
    return totals.join(of, "doc_id", "left").select("doc_id", *columns, share(F.when(F.col("n_grams") > 0, -F.col("best.less"))).alias("weight"), share(F.when(F.col("n_grams") > 0, F.col("shared"))).alias("weights"))


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes by their first byte, for each the documents, how many each has, and the other seven bytes: a shuffle of rows takes half as much again."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("hs")), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + (1 << 20), "right")))
            part = batch.slice(begin, end - begin)
            begin = end
            lists = part.column("hs")
            h = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(h):
                continue
            bucket = (h >> np.uint64(56)).astype(np.uint8)
            order = np.argsort(bucket, kind="stable")
            bucket, doc = bucket[order], np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[order]
            runs = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])]))
            found, first = np.unique(bucket, return_index=True)
            edges = pa.array(np.searchsorted(runs, [*first, len(h)]).astype(np.int32))
            docs, counts = part.column("doc_id").take(pa.array(doc[runs])), pa.array(np.diff([*runs, len(h)]).astype(np.int32))
            rest = np.ascontiguousarray(h[order].view(np.uint8).reshape(-1, 8)[:, :7])
            places = (np.array([*first, len(h)]) * 7).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(places), pa.py_buffer(rest)])
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.ListArray.from_arrays(edges, docs), pa.ListArray.from_arrays(edges, counts), data], names=["bucket", "docs", "counts", "hs"])


def _met(t: pa.Table) -> pa.Table:
    """(doc_id, x, k) of the hashes that k documents have, more than one; x stands for the set of these documents."""
    ids = pc.dictionary_encode(pa.chunked_array([c.flatten() for c in t.column("docs").chunks]).combine_chunks(), null_encoding="encode")
    codes = np.repeat(ids.indices.to_numpy(zero_copy_only=False), np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("counts").chunks]))
    h = np.zeros((len(codes), 8), np.uint8)
    h[:, :7] = np.frombuffer(b"".join(t.column("hs").to_pylist()), np.uint8).reshape(-1, 7)
    h = h.view(np.uint64).ravel()
    order = np.argsort(h)
    h, codes = h[order], codes[order].astype(np.int64)
    run = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
    several = np.bincount(run)[run] > 1
    pairs = np.unique(run[several] * len(ids.dictionary) + codes[several])  # rows of one id are one document
    run, codes = np.divmod(pairs, len(ids.dictionary))
    k = np.bincount(run)[run] if len(run) else run
    run, codes, k = run[k > 1], codes[k > 1], k[k > 1]
    if len(run):
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        sets = np.bitwise_xor.reduceat(hash_array(ids.dictionary.to_numpy(zero_copy_only=False), categorize=False)[codes], first)
        x = np.repeat(sets, np.diff([*first, len(run)])).view(np.int64)
    else:
        x = run
    return pa.table([ids.dictionary.take(pa.array(codes)), pa.array(x), pa.array(k.astype(np.int32))], names=["doc_id", "x", "k"])


class _Entries:
    """Classes or documents one after another: ids, a number of each, and of all entries the row, set of documents and n-grams."""

    def __init__(self, rows: pa.StructArray, ids: str = "class_id", number: str = "m"):
        sizes = pc.list_value_length(rows.field("x")).to_numpy(zero_copy_only=False)
        self.ids, self.m = rows.field(ids), rows.field(number).to_numpy(zero_copy_only=False)
        self.x, self.n = (rows.field(c).flatten().to_numpy(zero_copy_only=False) for c in ("x", "n"))
        self.rows = np.repeat(np.arange(len(rows)), sizes)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])


def _meet(a: _Entries, b: _Entries, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each class of a: documents of b that share an n-gram with it, itself included, the most shared ones, and with which."""
    width, weight = len(b.ids), b.m.astype(float)
    order = np.argsort(b.x, kind="stable")
    sets, first, held = np.unique(b.x[order], return_index=True, return_counts=True)
    to = b.rows[order]
    place = np.minimum(np.searchsorted(sets, a.x), len(sets) - 1)
    hit = np.flatnonzero(sets[place] == a.x)
    place, rows, n = place[hit], a.rows[hit], a.n[hit].astype(float)
    counts = held[place]
    before = np.concatenate([[0], np.cumsum(counts)])
    links, most, closest = np.zeros(len(a.ids), np.int64), np.zeros(len(a.ids), np.int64), np.zeros(len(a.ids), np.int64)
    step = max(1, CELLS // width)
    for begin in range(0, len(a.ids), step):
        end = min(begin + step, len(a.ids))
        i, last = np.searchsorted(rows, [begin, end])
        if i == last:
            continue
        acc = np.zeros((end - begin) * width)
        while i < last:  # so many entries that their cells are bounded, one at least
            j = min(last, max(i + 1, int(np.searchsorted(before, before[i] + 4 * CELLS, "right")) - 1))
            cells = np.repeat((rows[i:j] - begin) * width, counts[i:j]) + to[_expand(first[place[i:j]], counts[i:j])]
            acc += np.bincount(cells, np.repeat(n[i:j], counts[i:j]), len(acc))
            i = j
        acc = acc.reshape(-1, width)
        links[begin:end] = np.minimum(acc, 1) @ weight
        if same:  # a class of one document isn't near itself
            own = np.arange(begin, end)[b.m[begin:end] == 1]
            acc[own - begin, own] = 0
        closest[begin:end] = acc.argmax(1)
        most[begin:end] = acc[np.arange(end - begin), closest[begin:end]]
    return links, most, closest


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, a = None, None
    for batch in batches:
        for r in range(batch.num_rows):
            one, other = batch.column("ablock")[r].as_py(), batch.column("bblock")[r].as_py()
            if one != block:
                block, a = one, _Entries(batch.column("arows").slice(r, 1).flatten())
            b = _Entries(batch.column("brows").slice(r, 1).flatten())
            links, most, closest = _meet(a, b, one == other)
            met = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([a.ids.take(pa.array(met)), pa.array(links[met]), pa.array(most[met]), b.ids.take(pa.array(closest[met]))], names=["class_id", "links", "most", "closest"])


def folds(docs: DataFrame, k: int = 10, seed: int = 0) -> DataFrame:
    """docs with ``fold``, 0 to k - 1, by a hash of the id."""
    return docs.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(k)).cast("int"))


def resample(labels: DataFrame, n: int | None = None) -> DataFrame:
    """At most n documents of each label (as many as the rarest has, if n isn't given), by a hash of the id."""
    if n is None:
        least = labels.groupBy("label").count().agg(F.min("count").alias("least"))
        ranked = labels.crossJoin(F.broadcast(least))  # one row
    else:
        ranked = labels.withColumn("least", F.lit(n))
    return ranked.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))).where("_r <= least").drop("_r", "least")
