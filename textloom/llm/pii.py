"""PII by weak-supervision aggregation, with DataFrame functions only.

Base spans are what four expressions find (emails, IPv4 addresses, payment cards that pass Luhn, international phone
numbers), leftmost and non-overlapping for each kind; matches that fail their check are dropped.  They always stay.

Further candidates (secrets, national phone numbers, identity numbers, spelled-out emails) are voted on by a regex, a
gazetteer, a context and a shape labeler: 1 for, -1 against, 0 abstains.  Expectation-maximisation over the counts of vote
expressions estimates how reliable each labeler is, without any labelled row, and gives each expression a probability; on these
a logistic span classifier over votes and features is trained, which decides.  All counts cover the whole corpus; they are
as many as there are expressions (``_KINDS_OF_VOTES`` at most), so models are fitted on the driver whatever the corpus' size.

Spans are kind:start:end in code points, end exclusive.  The expressions use possessive loops, so that long runs of one kind
of character take linear time and no deep stack; they match what the plain ones in ``BASE`` match.

Defined results: a null or empty text has no spans; every input row gives one row; a null doc_id stays null; other columns
are ignored, by ``redact`` kept; an empty table gives no row and all-abstaining models keep no candidate.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed expressions of the base spans.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_FAST = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": BASE["phone"],
}
_HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_CANDIDATES = {
    "email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+ (?:at|\[at\]|\(at\)) [A-Za-z0-9-]{1,64}+ (?:dot|\[dot\]|\(dot\)) [A-Za-z]{2,24}+",
    "phone": r"(?<![0-9+.(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "identity": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{12,}+",
}
KINDS = [*BASE, "identity", "secret"]
LABELERS = ["regex", "gazetteer", "context", "shape"]
_STRONG = {
    "email": r" (?:at|\[at\]|\(at\)) [A-Za-z0-9-]+ (?:dot|\[dot\]|\(dot\)) (?:com|org|net|edu|gov|de|fr|es|uk|eu|io)$",
    "phone": r"^\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}$",
    "identity": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "secret": r"^(?:AKIA[0-9A-Z]{16}|(?:[0-9a-f]{2}){8,64}|gh[pousr]_[A-Za-z0-9]{36}|sk_(?:live|test)_[A-Za-z0-9]{16,})$",
}
_GAZETTEER = r"^(?:AKIA|ASIA|ghp_|gho_|xoxb|xoxp|sk_live|sk_test|rk_live|AIza|eyJ)"
_CONTEXT = r"(?i)(?:token|passw(?:or)?d|pwd|secret|api.?key|access.?key|credential|bearer|auth|phone|tel|call|mobile|fax|ssn|social|identity|passport|mail|contact)[^\n]{0,14}$"
_KINDS_OF_VOTES = 3 ** len(LABELERS) * 4 * 4 * 3


_BLOCK = 64  # elements that are gone through one by one


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; inside a lambda an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _block_numbers(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))


def _running(values: Column, pick: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of numbers from 0 on, what those before it give; by blocks, so that long arrays don't take the square of their length."""
    upto = lambda v, i, base: F.aggregate(F.slice(v, (i - i % _BLOCK + 1).cast("int"), (i % _BLOCK).cast("int")), base, pick)
    block = lambda v: F.transform(_block_numbers(v), lambda b: F.aggregate(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), pick))
    bases = lambda sums: F.transform(sums, lambda _, b: F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0), pick))
    return _let(values, lambda v: _let(_let(block(v), bases), lambda at: F.transform(v, lambda _, i: upto(v, i, F.get(at, F.floor(i / _BLOCK).cast("int"))))))


def _found(text: Column, expression: str, hint: str | None) -> Column:
    """All matches of a expression as an array of (start, hit, before), the last of what stands between the match before and this one."""
    both = F.struct(F.regexp_extract_all(text, F.lit(expression), F.lit(0)).alias("hits"), F.split(text, expression, -1).alias("gaps"))
    gap = lambda p, i: F.get(p["gaps"], i)
    steps = lambda p: F.transform(p["hits"], lambda h, i: F.char_length(gap(p, i)) + F.char_length(h))
    one = lambda p, at, h, i: F.struct((F.get(at, i) + F.char_length(gap(p, i))).alias("start"), h.alias("hit"), F.right(gap(p, i), F.lit(24)).alias("before"))
    spans = _let(both, lambda p: _let(_running(steps(p), lambda a, x: a + x), lambda at: F.transform(p["hits"], lambda h, i: one(p, at, h, i))))
    none = F.array().cast("array<struct<start:int,hit:string,before:string>>")
    maybe = text.rlike("[0-9]") if hint is None else F.contains(text, F.lit(hint))
    return F.when(maybe, spans).otherwise(none)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    twice = lambda d: d - F.when(d > 9, 9).otherwise(0)
    each = F.transform(F.split(F.reverse(_digits(s)), ""), lambda c, i: F.when(i % 2 == 1, twice(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    n = F.char_length(_digits(hit))
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(hit, r"\."), lambda p: (F.char_length(part(p)) <= 3) & (F.lpad(part(p), 3, "0") <= "255"))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(hit)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _span(kind: str, x: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.char_length(x["hit"])).alias("end"))


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end), kinds in the order of ``BASE``, then by start."""

    def of(k: str) -> Column:
        return F.transform(F.filter(_found(text, _FAST[k], _HINT[k]), lambda x: _valid(k, x["hit"])), lambda x: _span(k, x))

    return F.concat(*map(of, BASE))


def _candidates(text: Column, base: Column) -> Column:
    """Array of candidates that don't overlap a base span, with votes and features."""

    def judged(kind: str, x: Column) -> Column:
        hit, before = x["hit"], x["before"]
        vote = lambda yes, no=None: F.when(yes, 1).otherwise(F.when(no, -1).otherwise(0) if no is not None else F.lit(0))
        n, digits = F.char_length(hit), F.char_length(_digits(hit))
        shaped = (digits * 5 >= n) & (n >= 16) if kind == "secret" else digits.isin(9, 10)
        return F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + n).alias("end"), vote(hit.rlike(_STRONG[kind])).alias("regex"),
            vote(hit.rlike(_GAZETTEER), hit.rlike("(?i)^(?:version|chapter|section|figure|table|http|isbn)")).alias("gazetteer"), vote(before.rlike(_CONTEXT)).alias("context"),
            vote(shaped, ~shaped).alias("shape"), F.least(n / 12, F.lit(3)).cast("int").alias("size"), F.least(digits * 3 / n, F.lit(2)).cast("int").alias("share"),
        )

    hints = {"email": F.contains(text, F.lit("dot")), "phone": text.rlike("[0-9]"), "identity": text.rlike("[0-9]"), "secret": text.rlike("[0-9]")}
    kind = "array<struct<kind:string,start:int,end:int,regex:int,gazetteer:int,context:int,shape:int,size:int,share:int>>"

    def of(k: str) -> Column:
        found = _found(text, _CANDIDATES[k], "dot" if k == "email" else None)
        return F.when(hints[k], F.transform(found, lambda x: judged(k, x))).otherwise(F.array().cast(kind))

    def blocks(spans: Column) -> Column:
        part = lambda b: F.slice(spans, b * _BLOCK + 1, F.lit(_BLOCK))
        return F.transform(_block_numbers(spans), lambda b: _let(part(b), lambda x: F.struct(F.array_min(x["start"]).alias("start"), F.array_max(x["end"]).alias("end"), x.alias("of"))))

    own = map(of, _CANDIDATES)
    meets = lambda c, b: (c["start"] < b["end"]) & (c["end"] > b["start"])
    sorted_ = F.array_sort(F.transform(base, lambda b: F.struct(b["start"], b["end"])))
    apart = lambda all_, base_: F.filter(all_, lambda c: ~F.exists(base_, lambda b: meets(c, b) & F.exists(b["of"], lambda x: meets(c, x))))
    return _let(F.concat(*own), lambda all_: F.when(F.size(all_) == 0, all_).otherwise(_let(_let(sorted_, blocks), lambda base_: apart(all_, base_))))


@dataclass
class Reliability:
    """P(vote | truth) of each labeler, and the share of true candidates."""

    votes: np.ndarray  # labeler, truth, vote + 1
    share: float


def estimate(votes: np.ndarray, count: np.ndarray, rounds: int = 50) -> tuple[Reliability, np.ndarray]:
    """Expectation-maximisation over vote expressions (a row each); the probability of each expression's being true.

    It begins with the majority of the votes, and labelers are held to be no worse than chance.
    """
    p = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))
    r = Reliability(np.zeros((votes.shape[1], 2, 3)), 0.5)
    for _ in range(rounds):
        r.share = float(np.clip((count @ p + 1) / (count.sum() + 2), 0.01, 0.99))
        for j in range(votes.shape[1]):
            for truth, w in ((1, p), (0, 1 - p)):
                seen = np.array([(count * w)[votes[:, j] == v].sum() for v in (-1, 0, 1)]) + 0.5
                r.votes[j, truth] = seen / seen.sum()
            good, bad = r.votes[j, 1], r.votes[j, 0]
            if good[2] * bad[0] < bad[2] * good[0]:
                r.votes[j] = (good + bad) / 2
        logit = np.full(len(votes), np.log(r.share / (1 - r.share)))
        for j in range(votes.shape[1]):
            logit += np.log(r.votes[j, 1, votes[:, j] + 1] / r.votes[j, 0, votes[:, j] + 1])
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return r, p


def _design(votes: np.ndarray, kind: np.ndarray, size: np.ndarray, share: np.ndarray) -> np.ndarray:
    hot = lambda x, n: np.eye(n)[x]
    return np.hstack([np.ones((len(votes), 1)), votes == 1, votes == -1, hot(kind, len(_CANDIDATES)), hot(size, 4), hot(share, 3)]).astype(float)


def fit_classifier(x: np.ndarray, p: np.ndarray, count: np.ndarray, penalty: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Logistic regression on probabilistic labels, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (count * (q - p)) + penalty * w
        w -= np.linalg.solve((x.T * (count * q * (1 - q))) @ x + penalty * np.eye(len(w)), grad)
    return w


def train(docs: DataFrame) -> np.ndarray:
    """Weights of the span classifier from the candidates of all documents; all zero if there are none."""
    text = F.coalesce("text", F.lit(""))
    found = docs.where(F.length("text") > 0).select(F.explode(_candidates(text, base_spans(text))).alias("c")).select("c.*")
    kinds = list(_CANDIDATES)
    counts = found.groupBy("kind", *LABELERS, "size", "share").count().limit(_KINDS_OF_VOTES).collect()  # no more rows than expressions
    if not counts:
        return np.zeros(1 + 2 * len(LABELERS) + len(kinds) + 7)
    counts.sort()
    votes = np.array([[r[x] for x in LABELERS] for r in counts])
    n = np.array([r["count"] for r in counts], float)
    _, p = estimate(votes, n)
    return fit_classifier(_design(votes, np.array([kinds.index(r["kind"]) for r in counts]), np.array([r["size"] for r in counts]), np.array([r["share"] for r in counts])), p, n)


def _accepts(c: Column, w: np.ndarray) -> Column:
    kinds, n = list(_CANDIDATES), len(LABELERS)
    terms = [F.lit(float(w[0]))]
    for j, name in enumerate(LABELERS):
        terms.append(F.when(c[name] == 1, float(w[1 + j])).when(c[name] == -1, float(w[1 + n + j])).otherwise(0.0))
    at = 1 + 2 * n
    for values, field in ((kinds, "kind"), (range(4), "size"), (range(3), "share")):
        pick = reduce(lambda e, iv: e.when(c[field] == iv[1], float(w[at + iv[0]])), enumerate(values), F.when(F.lit(False), 0.0))
        terms.append(pick.otherwise(0.0))
        at += len(values)
    return reduce(lambda a, b: a + b, terms) > 0


def with_spans(docs: DataFrame, weights: np.ndarray, base: str = "base", spans: str = "spans") -> DataFrame:
    """docs with columns ``base`` and ``spans``: arrays of (kind, start, end), by kind as listed in ``KINDS``, then by start."""
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn(base, base_spans(text))
    if not weights.any():
        return out.withColumn(spans, F.col(base))
    more = F.transform(F.filter(_candidates(text, F.col(base)), lambda c: _accepts(c, weights)), lambda c: F.struct(c["kind"], c["start"], c["end"]))
    ordered = lambda all_, k: F.array_sort(F.filter(all_, lambda s: s["kind"] == k))
    every = lambda m: F.when(F.size(m) == 0, F.col(base)).otherwise(_let(F.concat(F.col(base), m), lambda all_: F.concat(*(ordered(all_, k) for k in KINDS))))
    return out.withColumn(spans, _let(more, every))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    found = with_spans(docs, train(docs))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = map(number, BASE)
    return found.select("doc_id", *counts, F.sha2(F.encode(_joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _hidden(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind.  Spans that overlap hide all they cover; blocks of spans have their own part of the text cut out first."""
    substr = lambda x, begin, end: F.substr(x, begin + 1, end - begin)

    def piece(s: Column, reach: Column, part: Column) -> Column:
        # a span that begins inside an earlier one only adds what lies beyond it to what is hidden
        return F.when(s["start"] >= reach, F.concat(substr(part["text"], reach - part["at"], s["start"] - part["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

    def block(o: Column, reach: Column, last: Column, b: Column) -> Column:
        at = F.get(reach, b * _BLOCK)
        part = F.struct(at.alias("at"), substr(text, at, F.coalesce(F.get(reach, b * _BLOCK + _BLOCK), last)).alias("text"))
        return _let(part, lambda p: F.array_join(F.transform(F.slice(o, b * _BLOCK + 1, F.lit(_BLOCK)), lambda s, i: piece(s, F.get(reach, b * _BLOCK + i), p)), ""))

    def all_(o: Column, reach: Column) -> Column:
        last = F.array_max(o["end"])
        return F.concat(F.array_join(F.transform(_block_numbers(o), lambda b: block(o, reach, last, b)), ""), F.substr(text, last + 1))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    clean = _let(ordered, lambda o: _let(_running(o["end"], lambda a, x: F.greatest(a, x)), lambda reach: all_(o, reach)))
    return F.when(F.size(spans) > 0, clean).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """docs, all columns, with every span of ``text`` replaced by its kind, such as [EMAIL]; n_chars follows the text."""
    columns, name = docs.columns, f"_{uuid.uuid4().hex}"
    found = with_spans(docs, train(docs), f"{name}b", f"{name}s").withColumn("text", _hidden(F.col("text"), F.col(f"{name}s")))
    if "n_chars" in columns:
        found = found.withColumn("n_chars", F.char_length("text").cast("long"))
    return found.select(*(F.col(f"`{c}`") for c in columns))
