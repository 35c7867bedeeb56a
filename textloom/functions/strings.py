"""Strings: similarity, n-grams, readability, whitespace, entities, e-mail and URL extraction, codecs.

Expressions on columns, compiled with the rest of the plan; what SQL can't express is an Arrow UDF.
"""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed set of punctuation that is stripped from both ends of words.
PUNCTUATION = ".,;:!?()[]{}`'\"@#$^&*+-|=~_"
_ENDS = r"^[.,;:!?()\[\]{}`'\"@#$^&*+\-|=~_]+|[.,;:!?()\[\]{}`'\"@#$^&*+\-|=~_]+$"


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: str | Column, default: str = "") -> Column:
    """As a string; empty and null give the default."""
    return F.coalesce(F.nullif(_column(c).cast("string"), F.lit("")), F.lit(default))


def boolean(c: str | Column) -> Column:
    """1 / True / true and 0 / False / false; anything else is null."""
    s = _column(c).cast("string")
    return F.when(s.isin("1", "True", "true"), True).when(s.isin("0", "False", "false"), False)


def integer(c: str | Column) -> Column:
    """Rounded number of a string, null if it isn't one."""
    return F.round(F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.try_cast("double")).cast("long")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _ENDS, "")


def tokens(c: str | Column) -> Column:
    """Words split at white space, without punctuation at their ends."""
    split = F.split(F.trim(F.regexp_replace(_column(c), r"[\t\n\x0b\f\r ]+", " ")), " ")
    return F.filter(F.transform(split, strip), lambda w: w != "")


def similarity(a: str | Column, b: str | Column) -> Column:
    """1 - edit distance / longer length."""
    a, b = _column(a), _column(b)
    return 1 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b), F.lit(1)).cast("double")


def _pairs(c: Column) -> Column:
    n = F.char_length(c) - 1
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))))


def dice(a: str | Column, b: str | Column) -> Column:
    """2 |shared bigrams| / (|bigrams| + |bigrams|) over distinct letter pairs."""
    x, y = _pairs(_column(a)), _pairs(_column(b))
    return 2.0 * F.size(F.array_intersect(x, y)) / F.greatest(F.size(x) + F.size(y), F.lit(1))


def ngrams(words: Column, n: int = 3) -> Column:
    """Runs of n of an array's elements, as arrays."""
    count = F.size(words) - n + 1
    none = F.slice(F.array(words), F.lit(1), F.lit(0))
    return F.when(count < 1, none).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.slice(words, i, n)))


def sentence_ngrams(sentences: Column, n: int = 3) -> Column:
    """n-grams of an array of sentences (arrays of words) that don't run across their ends."""
    return F.flatten(F.transform(sentences, lambda s: ngrams(s, n)))


def character_ngrams(c: str | Column, n: int = 3) -> Column:
    c = _column(c)
    count = F.char_length(c) - n + 1
    return F.when(count < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))


def type_token_ratio(c: str | Column, n: int = 100) -> Column:
    """Mean share of distinct words over all windows of n words (one window if there are fewer)."""
    words = tokens(F.lower(_column(c)))
    count = F.greatest(F.size(words) - n + 1, F.lit(1))
    shares = F.transform(F.sequence(F.lit(1), count), lambda i: F.size(F.array_distinct(F.slice(words, i, n))) / F.greatest(F.least(F.size(words), F.lit(n)), F.lit(1)))
    return F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) / count


def readability(c: str | Column) -> Column:
    """0 (hard) to 1 (easy): 0.01 (1.599 * 100 * one-syllable words / words - 1.015 words / sentences - 31.517), clamped.

    Sentences end with a full stop, an exclamation or a question mark.
    """
    c = _column(c)
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    plain = F.transform(words, lambda w: F.lower(strip(w)))
    vowels = lambda w: F.regexp_count(F.regexp_replace(w, "e$", ""), F.lit("[aeiouy]+"))
    single = F.size(F.filter(plain, lambda w: vowels(w) <= 1))
    sentences = F.greatest(F.size(F.filter(F.split(c, r"[.!?]"), lambda s: F.char_length(F.trim(s)) > 2)), F.lit(1))
    n = F.greatest(F.size(words), F.lit(1))
    score = 0.01 * (159.9 * single / n - 1.015 * n / sentences - 31.517)
    return F.when((F.char_length(c) < 3) | (F.size(words) <= 1), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def deflood(c: str | Column, n: int = 3) -> Column:
    """No character more than n times in a row."""
    return F.regexp_replace(_column(c), rf"(.)\1{{{n},}}", "$1" * n)


def decamel(c: str | Column, separator: str = "_") -> Column:
    s = F.regexp_replace(_column(c), r"([a-z0-9])([A-Z])", rf"$1{separator}$2")
    return F.lower(F.regexp_replace(s, r"([A-Z])([A-Z][a-z])", rf"$1{separator}$2"))


def collapse_spaces(c: str | Column, by: str = " ") -> Column:
    """Runs of blanks within each line become one, without blanks at a line's ends."""
    return F.array_join(F.transform(F.split(_column(c), "\n"), lambda s: F.trim(F.regexp_replace(s, "[ \\u00a0]+", by))), "\n")


def collapse_tabs(c: str | Column, by: str = " ") -> Column:
    return F.array_join(F.transform(F.split(_column(c), "\n"), lambda s: F.trim(F.regexp_replace(s, "\t+", by))), "\n")


def collapse_lines(c: str | Column, most: int = 1) -> Column:
    """At most ``most`` line feeds in a row."""
    unix = F.regexp_replace(_column(c), "\r\n?", "\n")
    return F.regexp_replace(unix, r"(?:[ \t]*\n){" + str(most + 1) + ",}", "\n" * most)


def encode_entities(c: str | Column) -> Column:
    """& (unless of a numeric reference), <, > and double quotes."""
    s = F.regexp_replace(_column(c), "&(?!#[0-9]+;|#x[0-9A-Fa-f]+;)", "&amp;")
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


@F.pandas_udf(T.StringType())
def decode_entities(c: pd.Series) -> pd.Series:
    return c.map(html.unescape, na_action="ignore")


_URL = r"""(?:https?://|www\.)[^\s<>"'\])]+"""


def urls(c: str | Column, unique: bool = True) -> Column:
    found = F.transform(F.regexp_extract_all(_column(c), F.lit(_URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))
    return F.array_distinct(found) if unique else found


def emails(c: str | Column, unique: bool = True) -> Column:
    found = F.regexp_extract_all(_column(c), F.lit(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))
    return F.array_distinct(found) if unique else found


def between(a: str, b: str, c: str | Column) -> Column:
    """All shortest strings between a and b."""
    q = lambda s: "\\Q" + s + "\\E"
    return F.regexp_extract_all(_column(c), F.lit(f"(?s){q(a)}(.*?){q(b)}"), F.lit(1))


def hashtags(c: str | Column) -> Column:
    return F.regexp_extract_all(_column(c), F.lit(r"(?:^|\s)(#\w+)"), F.lit(1))


def mentions(c: str | Column) -> Column:
    return F.regexp_extract_all(_column(c), F.lit(r"(?:^|\s)(@\w+)"), F.lit(1))


def retweets(c: str | Column) -> Column:
    return F.regexp_extract_all(_column(c), F.lit(r"(?i)\bRT\s+(@\w+)"), F.lit(1))


def latin(c: str | Column) -> Column:
    """Only characters of Latin-1 and extended Latin scripts."""
    return ~_column(c).rlike(r"[^\x00-ɏḀ-ỿ -⁯₠-₿]")


@F.pandas_udf(T.StringType())
def repair(c: pd.Series) -> pd.Series:
    """Undo UTF-8 that was read as Windows-1252 or Latin-1, where that gives valid text."""

    def one(s: str) -> str:
        for code in ("cp1252", "latin-1"):
            try:
                return s.encode(code).decode("utf-8")
            except UnicodeError:
                continue
        return s

    return c.map(one, na_action="ignore")


def split_document(c: str | Column, delimiters: str = "[.,!?;: ]", least: int = 1, stopwords: Sequence[str] = ()) -> Column:
    """Lower-cased words at delimiters; words broken at a line's end are joined."""
    s = F.lower(F.regexp_replace(_column(c), r"-\n", ""))
    words = F.transform(F.split(F.regexp_replace(s, r"\n", " "), delimiters), F.trim)
    kept = F.filter(words, lambda w: F.char_length(w) >= least)
    return F.filter(kept, lambda w: ~w.isin(*stopwords)) if stopwords else kept


def base62(c: str | Column) -> Column:
    """Base 62 with digits, capitals, small letters."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    n = _column(c).cast("long")
    # a remainder is taken off first, so the quotient is whole and decimals have it exactly
    quotient = lambda p: ((n - n % F.lit(p)).cast("decimal(19,0)") / F.lit(p).cast("decimal(19,0)")).cast("long")
    places = F.array(*(F.substring(F.lit(digits), (quotient(62**i) % 62 + 1).cast("int"), F.lit(1)) for i in range(10, -1, -1)))
    return F.when(n < 0, None).otherwise(F.coalesce(F.nullif(F.regexp_replace(F.array_join(places, ""), "^0+", ""), F.lit("")), F.lit("0")))


def encrypt(c: str | Column, key: str) -> Column:
    """Reversible with the key, as base64 text. The key is hashed to 16 bytes."""
    return F.base64(F.aes_encrypt(F.encode(_column(c), "UTF-8"), F.unhex(F.substring(F.sha2(F.lit(key).cast("binary"), 256), 1, 32))))


def decrypt(c: str | Column, key: str) -> Column:
    return F.decode(F.aes_decrypt(F.unbase64(_column(c)), F.unhex(F.substring(F.sha2(F.lit(key).cast("binary"), 256), 1, 32))), "UTF-8")


def truncated(c: str | Column, length: int = 100) -> Column:
    """(head, tail) cut at the last blank within ``length``."""
    c = _column(c)
    head = F.when(F.char_length(c) <= length, c).otherwise(F.coalesce(F.nullif(F.regexp_extract(F.substring(c, 1, length + 1), r"(?s)^(.*)\s", 1), F.lit("")), F.substring(c, 1, length)))
    return F.struct(head.alias("head"), F.trim(F.substr(c, F.char_length(head) + 1)).alias("tail"))
