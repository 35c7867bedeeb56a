"""N-gram Jaccard join by a token-group matrix: exact links between documents, as connected components.

Documents are sets of distinct ``width``-word shingles.  Two link when 100 * intersection >= threshold * union.

1. Equal sets form a class; one text of each goes on, so copies never meet pair by pair.
2. Tokens are ordered (common ones last), and a set is indexed under its first n - ceil(t n) + 1 tokens: sets that link
   share one of these.  Tokens of a single set are dropped.
3. Each document is compared with one pivot for each of ``rounds`` key tokens (its most common one, then the smallest by
   a hash); what links is one class from then on, so a large group of near copies costs one comparison a copy.
4. The matrix: documents are partitioned by their most common token and a band of sizes.  For each token and group it
   holds whether any member is indexed under it (the group's token union), how many are, and the members' sizes.  The
   tokens that a document shares with the union, of members outside its own class, bound its overlap with every one.
5. Only groups that reach the bound are opened.  Of s shared tokens, of which d are needed, every partner has one of
   any s - d + 1: members are looked up at the rarest ones only, so thousands of texts just below the threshold of each
   other, which share the same common passage, don't meet pair by pair.
6. One pair of each two classes is compared first; for what then still is apart, all pairs, by their whole texts.

The order of tokens comes from a bitmap of common shingles, which an eighth of the classes fills.  Any order gives the
same links; this one keeps passages that many documents share out of the index where a text has rarer shingles.

Defined results: a null, empty or wordless text has n_shingles 0 and links with nothing; with fewer than ``width`` words the
whole sequence is the one shingle; every input row gives one output row; rows that share a doc_id are one document of the
graph, with all its texts; rows with a null doc_id are documents without an id: they link with others, and where nobody in
a component has an id, component_id is null; other columns are ignored (by ``survivors`` kept); an empty table gives no row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType
from pyspark.sql.window import Window

from textloom.llm.graph import components
from textloom.llm.store import bucketed, written
from textloom.llm.words import distinct, mix, shingles_of, signed, slices, words_of

_BITS = 26  # the bitmap of common shingles: 8 MB whatever the corpus
_COMMON = 2  # classes of the sampled eighth that make a shingle common
_PIVOT_TEXTS = 512  # comparisons with one pivot in one piece of work
_STEP = 1.08  # sizes in one band of a group differ by this factor at most


def _set_sizes(owner: np.ndarray, texts: int) -> np.ndarray:
    return np.bincount(owner, minlength=texts).astype(np.int64)


def _classes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            values, owner = distinct(*shingles_of(words_of(part.column("text")), width))
            sums = [np.zeros(part.num_rows, np.uint64) for _ in range(2)]
            for s, salt in zip(sums, (0x243F6A8885A308D3, 0x13198A2E03707344), strict=True):
                np.add.at(s, owner, mix(values ^ np.uint64(salt)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(_set_sizes(owner, part.num_rows)), *(pa.array(signed(s)) for s in sums)], names=["doc_id", "h", "n", "s1", "s2"])

    return run


def _sampled(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            values, _ = distinct(*shingles_of(words_of(part.column("text")), width))
            yield pa.RecordBatch.from_arrays([pa.array(signed(values))], names=["value"])

    return run


def _prefix(n: np.ndarray, threshold: int) -> np.ndarray:
    return n - -(-n * threshold // 100) + 1


def _index(width: int, threshold: int, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.unpackbits(np.frombuffer(common.value, np.uint8), bitorder="little")
        for part in slices(batches, "text"):
            values, owner = distinct(*shingles_of(words_of(part.column("text")), width))
            order = (values >> np.uint64(2)) | (bitmap[values >> np.uint64(64 - _BITS)].astype(np.uint64) << np.uint64(62))
            order, owner = distinct(order, owner)  # within a text, 62 bits may fall together; that only drops equal tokens
            n = _set_sizes(owner, part.num_rows)
            p = np.where(n > 0, _prefix(n, threshold), 0)
            begin = np.concatenate([[0], np.cumsum(n)[:-1]])
            keep = np.arange(len(order)) - begin[owner] < p[owner]
            offsets = np.concatenate([[0], np.cumsum(p)]).astype(np.int32)
            tokens = signed(order[keep])
            yield pa.RecordBatch.from_arrays([part.column("rid"), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens))], names=["rid", "n", "tokens"])

    return run


def _compare(width: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivots = None, []
        for part in slices(batches, "text"):
            values, owner = distinct(*shingles_of(words_of(part.column("text")), width))
            at = np.searchsorted(owner, np.arange(part.num_rows + 1))
            a, b, salt, kind = (part.column(c).to_pylist() for c in ("a", "b", "salt", "kind"))
            found: list[tuple[int, int]] = []
            for i in range(part.num_rows):
                own = values[at[i] : at[i + 1]]
                if (b[i], salt[i]) != key:
                    key, pivots = (b[i], salt[i]), []
                if kind[i] == 0:
                    pivots.append(own)
                    continue
                for p in pivots:
                    where = np.searchsorted(p, own)
                    shared = int(np.count_nonzero(p[np.minimum(where, len(p) - 1)] == own)) if len(p) and len(own) else 0
                    if shared and 100 * shared >= threshold * (len(p) + len(own) - shared):
                        found.append((a[i], b[i]))
                        break
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole texts link. The text of b goes once to each piece of work, those of a pass by."""
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / _PIVOT_TEXTS).alias("pieces"))
    salted = written(pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), "pieces").alias("salt")), "pairs")
    asked = salted.select(F.col("a").alias("rid"), "b", "salt", F.lit(1).alias("kind"))
    met = salted.select(F.col("b").alias("rid"), "b", "salt", F.lit(0).alias("kind")).distinct()
    dealt = asked.unionAll(met).join(texts, "rid").select(F.col("rid").alias("a"), "b", "salt", "kind", "text").repartition("b", "salt").sortWithinPartitions("b", "salt", "kind")
    return dealt.mapInArrow(_compare(width, threshold), "a long, b long")


def _need(n: Column, m: Column, threshold: int) -> Column:
    """Of the indexed tokens of a set of n that links with one of m, so many at least are in the other set."""
    overlap = F.ceil(F.lit(threshold) * (n + m) / F.lit(100 + threshold))
    return n - F.ceil(n * threshold / 100) + 1 - (n - overlap)


def _least_need(n: Column, low: Column, high: Column, threshold: int) -> Column:
    """Of the indexed tokens that a set of n shares with one that links, so many at least, whatever size from low to high that has.

    By the first set's index this grows with the other's size.  By the other's index it falls by t * t / (1 + t) a token, but
    two ceilings make it rise and fall by less than 1 around that, so the least is among the last few sizes.
    """
    last = -(-2 * 100 * (100 + threshold) // threshold**2)
    return F.least(_need(n, low, threshold), *(_need(F.greatest(high - i, low), n, threshold) for i in range(last + 1)))


def _near(n: Column, m: Column, threshold: int) -> Column:
    """Whether the sizes allow a link."""
    return (n * 100 >= m * threshold) & (m * 100 >= n * threshold)


def _common(texts: DataFrame, width: int):
    """A bitmap of the shingles that are common in an eighth of the texts, sent to all executors."""
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(8)) == 0).mapInArrow(_sampled(width), "value long")
    often = some.groupBy("value").count().where(F.col("count") >= _COMMON)
    slot = F.expr(f"shiftrightunsigned(value, {64 - _BITS})")
    words = often.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(value, {64 - _BITS}) & 63 as int))")).alias("bits"))
    bitmap = np.zeros(1 << (_BITS - 6), np.uint64)  # so many rows come at most
    for chunk in words.toArrow().to_batches():
        bitmap[chunk.column(0).to_numpy()] = chunk.column(1).to_numpy().view(np.uint64)
    return texts.sparkSession.sparkContext.broadcast(bitmap.tobytes())


def _labelled(docs: DataFrame, groups: DataFrame, by: str = "rid") -> DataFrame:
    """docs with ``grp``: the label of ``by``, itself if it has no link yet."""
    return docs.join(groups.select(F.col("node").alias(by), "label"), by, "left").withColumn("grp", F.coalesce("label", by)).drop("label")


def _starred(index: DataFrame, texts: DataFrame, width: int, threshold: int, rounds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their key tokens, links, groups): every document is compared with one pivot for each key token."""
    own = F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1
    # in the middle of a group of near copies is the text most of whose tokens others have too
    order = F.struct(F.floor(-20 * F.count("*") / F.first(own)).alias("x"), F.xxhash64("rid").alias("y")).alias("order")
    least = [F.min_by("token", F.xxhash64("token", F.lit(r))).alias(f"key{r}") for r in range(1, rounds)]
    keys = written(index.groupBy("rid", "n").agg(order, F.max_by("token", F.struct("docs", "token")).alias("key0"), *least), "keys")
    links = keys.select(F.col("rid").alias("a"), F.col("rid").alias("b")).limit(0)
    groups = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    for r in range(rounds):
        grouped = keys.select("rid", "n", "order", F.col(f"key{r}").alias("token"))
        if r == 0:  # a document of its own each
            one = grouped.select("token", F.col("rid").alias("grp"), F.struct("rid", "n").alias("x"))
            pivot = grouped.groupBy("token").agg(F.min_by(F.struct("rid", "n", F.col("rid").alias("grp")), "order").alias("p"))
        else:
            sizes = groups.groupBy(F.col("label").alias("grp")).agg(F.count("*").alias("docs"))
            grouped = _labelled(grouped, groups).join(sizes, "grp", "left").withColumn("order", F.struct(-F.coalesce("docs", F.lit(1)), "order"))
            one = grouped.groupBy("token", "grp").agg(F.min_by(F.struct("rid", "n"), "order").alias("x"))
            pivot = grouped.groupBy("token").agg(F.min_by(F.struct("rid", "n", "grp"), "order").alias("p"))
        star = one.join(pivot, "token").where("grp <> p.grp").where(_near(F.col("x.n"), F.col("p.n"), threshold))
        links = links.unionAll(written(_verified(star.select(F.col("x.rid").alias("a"), F.col("p.rid").alias("b")).distinct(), texts, width, threshold), "links"))
        if r == 0:  # each document has one pivot, which has none: labels already
            groups = links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        else:
            groups = written(components(links), "groups")
    return keys, links, groups


def _asked(index: DataFrame, keys: DataFrame, groups: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(asks, members) of the groups that reach the bound; both by token, home and band.

    The matrix has a column for each home (the token of a document that most documents have) and band of sizes.  A document
    that shares s tokens with a column and needs d to link with one of its members shares one of any s - d + 1 of them with
    that member; it asks only at the rarest ones.
    """
    known = _labelled(keys.select("rid", F.col("key0").alias("home")), groups)
    cells = index.select("token", "rid", "n").join(known, "rid").withColumn("band", F.floor(F.log("n") / F.log(F.lit(_STEP))).cast("int"))
    between = cells.groupBy("token").agg(F.min("grp").alias("x"), F.max("grp").alias("y")).where("x <> y").select("token")
    cells = written(cells.join(between, "token"), "cells")
    matrix = cells.groupBy("token", "home", "band").agg(F.min("grp").alias("low"), F.max("grp").alias("high"), F.count("*").alias("docs"), F.min("n").alias("least"), F.max("n").alias("most"))
    q, g, t = cells.select("token", "rid", "n", "grp", F.col("band").alias("own")), matrix, threshold
    # the smaller one of a pair asks, and only where others than its own group are
    met = q.join(g, "token").where((F.col("band") >= F.col("own")) & (F.col("most") >= F.col("n")) & (F.col("n") * 100 >= F.col("least") * t) & ((F.col("low") != F.col("high")) | (F.col("low") != F.col("grp"))))
    column = Window.partitionBy("rid", "home", "band")
    low = F.greatest(F.min("least").over(column), F.col("n"))
    high = F.least(F.max("most").over(column), F.floor(F.col("n") * 100 / t))
    spare = F.count("*").over(column) - F.greatest(F.lit(1), _least_need(F.col("n"), low, high, t))
    met = met.withColumn("spare", spare).withColumn("rank", F.row_number().over(column.orderBy("docs", "token"))).where(F.col("rank") <= F.col("spare") + 1)
    asks = written(met.select("token", "home", "band", F.col("rid").alias("a"), F.col("n").alias("na")), "asks")
    return asks, written(cells.join(asks.select("token", "home", "band").distinct(), ["token", "home", "band"], "left_semi").drop("grp"), "asked")


def _candidates(asks: DataFrame, members: DataFrame, groups: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(one pair of documents for each two groups, all pairs of documents of different groups) that share a token asked for."""
    at = ["token", "home", "band"]
    asks = _labelled(asks, groups, "a").withColumnRenamed("grp", "own")
    members = _labelled(members, groups)
    columns = members.groupBy(*at, "grp").agg(F.min_by(F.struct("rid", "n"), F.xxhash64("rid")).alias("b"))
    opened = asks.join(columns, at).where("own <> grp")
    fits = _near(F.col("na"), F.col("b.n"), threshold)
    one = opened.where(fits).groupBy("own", "grp", "a", "b").agg(F.count("*").alias("shared"))
    one = one.groupBy(F.least("own", "grp").alias("x"), F.greatest("own", "grp").alias("y")).agg(F.max_by(F.struct("a", F.col("b.rid").alias("b")), F.struct("shared", "a", "b.rid")).alias("p")).select("p.a", "p.b")
    inside = opened.select(*at, "grp", "a", "na").join(members.select(*at, "grp", F.col("rid").alias("b"), F.col("n").alias("nb")), [*at, "grp"])
    every = inside.where(_near(F.col("na"), F.col("nb"), threshold) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))).select("a", "b").distinct()
    return one, every


def _classified(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(rows of docs with their class, classes with ``rid`` and the row that stands for each)."""
    members = written(docs.mapInArrow(_classes(width), "doc_id long, h long, n long, s1 long, s2 long"), "members")
    some = members.where("n > 0")
    twice = some.groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("x"), F.max(F.struct("s1", "s2")).alias("y")).where("x <> y").select("doc_id", F.lit(True).alias("twice"))
    rows = some.groupBy("doc_id", "h", "s1", "s2").agg(F.count("*").alias("rows")).join(twice, "doc_id", "left")
    first = F.struct(F.coalesce("twice", F.col("doc_id").isNull()).alias("odd"), "doc_id", "h", "rows")
    # a class goes by its smallest id; where that id has other texts too, or there is none, by a hash
    return members, rows.groupBy("s1", "s2").agg(F.min(first).alias("r")).select("s1", "s2", "r.*", F.when(F.col("r.odd"), F.xxhash64("s1", "s2")).otherwise(F.col("r.doc_id")).alias("rid"))

def _components(docs: DataFrame, width: int, threshold: int, rounds: int) -> DataFrame:
    """(doc_id, h, n, component_id, stands) for every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    members, reps = _classified(docs, width)
    reps = written(reps, "classes")
    # a row that occurs several times gives its text once
    chosen = docs.alias("d").join(reps.alias("r"), F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.h") == F.col("r.h"))).select("r.rid", "d.text", "r.rows")
    # dealt once by rid: the texts are looked up by it several times
    texts = bucketed(chosen.where("rows = 1").select("rid", "text").unionAll(chosen.where("rows > 1").groupBy("rid").agg(F.min("text").alias("text"))), "texts", "rid")

    index = written(texts.mapInArrow(_index(width, threshold, _common(texts, width)), "rid long, n long, tokens array<long>"), "sets").select("rid", "n", F.explode("tokens").alias("token"))
    often = index.groupBy("token").agg(F.count("*").alias("docs")).where("docs > 1")
    index = written(index.join(often, "token"), "index")

    keys, links, groups = _starred(index, texts, width, threshold, rounds)
    asks, asked = _asked(index, keys, groups, threshold)
    one, _ = _candidates(asks, asked, groups, threshold)
    links = links.unionAll(written(_verified(one, texts, width, threshold), "links"))
    _, every = _candidates(asks, asked, written(components(links), "groups"), threshold)
    links = links.unionAll(written(_verified(every, texts, width, threshold), "links"))

    # a doc_id whose rows have different texts ties their classes together
    of = members.where("n > 0").join(reps.select("s1", "s2", "rid", F.col("h").alias("first")), ["s1", "s2"])
    ties = of.groupBy("doc_id").agg(F.min("rid").alias("b"), F.max("rid").alias("a")).where("doc_id is not null and a <> b")
    ties = of.join(ties.select("doc_id", "b"), "doc_id").select(F.col("rid").alias("a"), "b")
    label = _labelled(reps.select("s1", "s2", "rid", F.col("h").alias("first")), components(links.unionAll(ties.distinct())))
    found = written(members.join(label, ["s1", "s2"], "left"), "labelled")
    least = found.where("n > 0").groupBy("grp").agg(F.min("doc_id").alias("least"))
    stands = F.when(F.col("n") == 0, True).when(F.col("least").isNull(), (F.col("rid") == F.col("grp")) & (F.col("h") == F.col("first"))).otherwise(F.coalesce(F.col("doc_id") == F.col("least"), F.lit(False)))
    return found.join(least, "grp", "left").select("doc_id", "h", "n", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), stands.alias("stands"))


def survivors(docs: DataFrame, width: int = 5, threshold: int = 75, rounds: int = 2) -> DataFrame:
    """The rows of docs, all columns, of one document of each component; of rows equal in id and text one."""
    name, columns = f"_{uuid.uuid4().hex}", docs.columns
    keep = _components(docs, width, threshold, rounds).where("stands").groupBy("doc_id", "h").agg(F.count("*").alias("rows"))
    keep = written(keep.select(F.col("doc_id").alias(f"{name}d"), F.col("h").alias(f"{name}h"), F.col("rows").alias(f"{name}n")), "kept")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{name}d")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(f"{name}h"))
    once = docs.join(keep.where(F.col(f"{name}n") == 1), same, "left_semi")
    plain = [f.name for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))]
    first = F.row_number().over(Window.partitionBy(f"{name}d", f"{name}h").orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in plain))))
    more = docs.join(keep.where(F.col(f"{name}n") > 1), same).withColumn(f"{name}r", first).where(F.col(f"{name}r") == 1)
    return once.unionAll(more.select(*(F.col(f"`{c}`") for c in columns)))


def link_components(docs: DataFrame, width: int = 5, threshold: int = 75, rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text)."""
    return _components(docs, width, threshold, rounds).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
