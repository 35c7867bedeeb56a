"""Password hashes, templates and codes of languages and regions."""

from __future__ import annotations

import hashlib
import hmac
import os
import re
from collections.abc import Mapping
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def pbkdf2(password: Column, salt: Column, rounds: int = 10_000, size: int = 32, digest: str = "sha256") -> Column:
    """Hexadecimal PBKDF2 keys; no built-in function derives keys, so batches go through Arrow."""

    @F.pandas_udf("string")
    def run(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else hashlib.pbkdf2_hmac(digest, a.encode(), b.encode(), rounds, size).hex() for a, b in zip(s, t, strict=True)])

    return run(password, salt)


def encode_password(password: str, rounds: int = 10_000) -> str:
    """pbkdf2$rounds$salt$key with a salt of its own."""
    salt = os.urandom(16).hex()
    return f"pbkdf2${rounds}${salt}${hashlib.pbkdf2_hmac('sha256', password.encode(), salt.encode(), rounds, 32).hex()}"


def verify_password(password: str, encoded: str) -> bool:
    kind, rounds, salt, key = encoded.split("$")
    own = hashlib.pbkdf2_hmac("sha256", password.encode(), salt.encode(), int(rounds), 32).hex()
    return kind == "pbkdf2" and hmac.compare_digest(own, key)


_HOLE = re.compile(r"\$(?:\{([^}]+)\}|([A-Za-z_][A-Za-z0-9_]*))")


def template(text: str) -> Column:
    """A template as a column: $name stands for a column, ${...} for an SQL expression over columns, $$ for $; nulls are empty."""
    parts, at = [], 0
    text = text.replace("$$", "\0")
    for m in _HOLE.finditer(text):
        parts += [F.lit(text[at : m.start()].replace("\0", "$")), F.coalesce(F.expr(m[1] or f"`{m[2]}`").cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(text[at:].replace("\0", "$")))


#: ISO 639-1 and ISO 3166-1 codes of a few languages and regions; whole tables are parameters.
LANGUAGES = {"en": "English", "de": "German", "fr": "French", "es": "Spanish", "it": "Italian", "nl": "Dutch", "ru": "Russian", "pt": "Portuguese", "zh": "Chinese", "ja": "Japanese", "ar": "Arabic"}
REGIONS = {"US": "United States", "GB": "United Kingdom", "DE": "Germany", "FR": "France", "ES": "Spain", "IT": "Italy", "NL": "Netherlands", "RU": "Russia", "BR": "Brazil", "CN": "China", "JP": "Japan", "EG": "Egypt", "CA": "Canada", "IN": "India", "SA": "Saudi Arabia"}
SPOKEN = {"US": ["en"], "GB": ["en"], "DE": ["de"], "FR": ["fr"], "ES": ["es"], "IT": ["it"], "NL": ["nl"], "RU": ["ru"], "BR": ["pt"], "CN": ["zh"], "JP": ["ja"], "EG": ["ar"], "CA": ["en", "fr"], "IN": ["en"], "SA": ["ar"]}


def _looked_up(key: Column, table: Mapping) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)) for x in chain.from_iterable(table.items()))), key)


def language_name(code: Column, table: Mapping[str, str] = LANGUAGES) -> Column:
    return _looked_up(F.lower(code), table)


def language_code(name: Column, table: Mapping[str, str] = LANGUAGES) -> Column:
    return _looked_up(F.lower(name), {v.lower(): k for k, v in table.items()})


def region_name(code: Column, table: Mapping[str, str] = REGIONS) -> Column:
    return _looked_up(F.upper(code), table)


def region_code(name: Column, table: Mapping[str, str] = REGIONS) -> Column:
    return _looked_up(F.lower(name), {v.lower(): k for k, v in table.items()})


def languages_of(region: Column, table: Mapping[str, list[str]] = SPOKEN) -> Column:
    return _looked_up(F.upper(region), table)


def regions_of(language: Column, table: Mapping[str, list[str]] = SPOKEN) -> Column:
    turned: dict[str, list[str]] = {}
    for region, spoken in table.items():
        for x in spoken:
            turned.setdefault(x, []).append(region)
    return _looked_up(F.lower(language), {k: sorted(v) for k, v in turned.items()})


def regionalized(language: Column, table: Mapping[str, list[str]] = SPOKEN) -> Column:
    """All codes of a language with its regions, such as de and de-DE."""
    regions = F.coalesce(regions_of(language, table), F.array().cast("array<string>"))
    return F.concat(F.array(F.lower(language)), F.transform(regions, lambda r: F.concat_ws("-", F.lower(language), r)))
