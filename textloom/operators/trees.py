"""Renderings of parsed sentences (arrays of words with tag, chunk and pnp): XML both ways, brackets, graphs and tables."""

from __future__ import annotations

from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIELDS = ("word", "tag", "chunk", "pnp")


def _chunks(sentence) -> list[tuple[str | None, list]]:
    """Runs of words of one chunk; words outside of chunks stand alone."""
    out: list[tuple[str | None, list]] = []
    for w in sentence:
        kind = w["chunk"]
        if kind in (None, "", "O"):
            out.append((None, [w]))
        elif kind.startswith("B-") or not out or out[-1][0] != kind[2:]:
            out.append((kind[2:], [w]))
        else:
            out[-1][1].append(w)
    return out


def to_xml(sentences) -> str:
    """<text><sentence><chunk type><word type pnp>...: an element for each."""
    lines = ["<text>"]
    for i, s in enumerate(sentences):
        lines.append(f'<sentence id="{i}">')
        for kind, words in _chunks(s):
            own = [f"<word type={quoteattr(w['tag'] or '')} pnp={quoteattr(w['pnp'] or '')} value={quoteattr(w['word'])}/>" for w in words]
            lines += own if kind is None else [f"<chunk type={quoteattr(kind)}>", *own, "</chunk>"]
        lines.append("</sentence>")
    return "\n".join([*lines, "</text>"])


def from_xml(text: str) -> list[list[dict]]:
    """The sentences that ``to_xml`` wrote."""
    out = []
    for s in ElementTree.fromstring(text):
        words = []
        for x in s:
            inside = [x] if x.tag == "word" else list(x)
            for i, w in enumerate(inside):
                chunk = "O" if x.tag == "word" else f"{'B' if i == 0 else 'I'}-{x.get('type')}"
                words.append({"word": w.get("value"), "tag": w.get("type"), "chunk": chunk, "pnp": w.get("pnp")})
        out.append(words)
    return out


def brackets(sentence) -> str:
    """(S (NP (DT the) (NN cat)) (. .)): nested brackets."""
    leaf = lambda w: f"({w['tag']} {w['word'].replace('(', '-LRB-').replace(')', '-RRB-')})"
    parts = [leaf(words[0]) if kind is None else f"({kind} {' '.join(map(leaf, words))})" for kind, words in _chunks(sentence)]
    return f"(S {' '.join(parts)})"


def dot(sentence) -> str:
    """A directed graph of the sentence, its chunks and words in the dot language."""
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    lines, n = ["digraph sentence {", '  s [label="S"];'], 0
    for i, (kind, words) in enumerate(_chunks(sentence)):
        above = "s"
        if kind is not None:
            above = f"c{i}"
            lines += [f"  {above} [label={quote(kind)}];", f"  s -> {above};"]
        for w in words:
            lines += [f"  w{n} [label={quote(w['word'] + '/' + (w['tag'] or ''))}];", f"  {above} -> w{n};"]
            n += 1
    return "\n".join([*lines, "}"])


def table(sentence, placeholder: str = "-") -> str:
    """A row a word, columns padded to one width."""
    cell = lambda x: x if x not in (None, "", "O") else placeholder
    rows = [[f.upper() for f in _FIELDS], *([cell(w[f]) for f in _FIELDS] for w in sentence)]
    width = [max(len(r[k]) for r in rows) for k in range(len(_FIELDS))]
    return "\n".join("  ".join(x.ljust(n) for x, n in zip(r, width, strict=True)).rstrip() for r in rows)


def rendering(f, each: bool = True):
    """A column function over ``parsed``: one string for the whole text, sentences apart by a blank line if ``each``."""

    @F.pandas_udf(T.StringType())
    def run(parsed: pd.Series) -> pd.Series:
        return parsed.map(lambda p: None if p is None else ("\n\n".join(f(s) for s in p) if each else f(p)))

    return run


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in _FIELDS]))))
def parsed_xml(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else from_xml(t))
