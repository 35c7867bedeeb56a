"""Articles in wikitext: their sections as a tree, with plain text.

One pass over the marks of a text with a stack of what is open: templates, tables, references and comments are left out,
links give their label, headings begin sections.  Marks nest to any depth; work is linear in the text, but for
links within the labels of links.  What is never
closed is no mark, so its text stays.  Links to files, images and categories are left out with their captions.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: ``parent`` is the number of the section around, -1 for those at the top and for what stands before the first heading.
SECTION = T.StructType([T.StructField("number", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])

#: Articles that a task has as Python objects at a time.
FEW = 64
_MARK = re.compile(r"<!--|-->|<nowiki>|</nowiki>|<ref\b[^<>/]*/>|<ref\b[^<>/]*>|</ref>|\{\{|\}\}|\{\||\|\}|\[\[|\]\]|\||\[https?://[^\s\]]+ ?|\]|'{2,5}|\n+|^(?=[=*#:;])", re.I)
_HEADING = re.compile(r"(={1,6})[ \t]*(.+?)[ \t]*\1[ \t]*(?=\n|\Z)")
_LIST = re.compile(r"[*#:;]+[ \t]*")
_APART = re.compile(r"\s*(?:file|image|category)\s*:", re.I)
_CLOSES = {"}}": "{{", "|}": "{|", "]]": "[[", "</ref>": "<ref", "-->": "<!--", "</nowiki>": "<nowiki>", "]": "["}


class _Open:
    def __init__(self, mark: str, raw: str):
        self.mark, self.raw, self.parts = mark, raw, [[]]

    def add(self, text: str) -> None:
        self.parts[-1].append(text)

    def text(self) -> str:
        """What is seen of it once it is closed."""
        if self.mark == "[[":
            inner = ["".join(p) for p in self.parts]
            return "" if _APART.match(inner[0]) else inner[-1].strip() if len(inner) > 1 else inner[0].lstrip(":").strip()
        return "".join("".join(p) for p in self.parts) if self.mark in ("[", "<nowiki>") else ""

    def unclosed(self) -> str:
        return self.raw + "|".join("".join(p) for p in self.parts)


def parse(wikitext: str) -> list[dict]:
    """Sections in order; the first has level 0 and no title, and is what stands before all headings."""
    sections = [{"number": 0, "parent": -1, "level": 0, "title": "", "parts": []}]
    stack: list[_Open] = []
    above: list[tuple[int, int]] = []  # (level, number) of the sections that are open
    opened: dict[str, int] = {}

    def put(text: str) -> None:
        if text:
            (stack[-1].add if stack else sections[-1]["parts"].append)(text)

    def close(mark: str) -> None:
        """Close the innermost of a kind; what is open inside it is no mark."""
        first = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].mark == mark)
        for inner in stack[first + 1 :]:
            opened[inner.mark] -= 1
            stack[first].add(inner.unclosed())
        del stack[first + 1 :]
        done = stack.pop()
        opened[mark] -= 1
        put(done.text())

    def push(mark: str, raw: str) -> None:
        stack.append(_Open(mark, raw))
        opened[mark] = opened.get(mark, 0) + 1

    at = 0
    while at < len(wikitext):
        m = _MARK.search(wikitext, at)
        if m is None:
            put(wikitext[at:])
            break
        put(wikitext[at : m.start()])
        raw, at = m.group(), m.end()
        mark = raw.lower()
        if opened.get("<!--") or opened.get("<nowiki>"):  # nothing else is a mark in there
            own = "-->" if opened.get("<!--") else "</nowiki>"
            close(_CLOSES[own]) if mark == own else put(raw)
        elif mark.startswith("<ref"):
            if not mark.endswith("/>"):
                push("<ref", raw)
        elif mark.startswith("[http"):
            push("[", raw)
        elif mark in ("{{", "{|", "[[", "<!--", "<nowiki>"):
            push(mark, raw)
        elif mark in _CLOSES and opened.get(_CLOSES[mark]):
            close(_CLOSES[mark])
        elif mark == "|" and stack and stack[-1].mark == "[[":
            stack[-1].parts.append([])
        elif mark.startswith("''"):
            pass
        elif not mark.strip():  # a line ends, or the text begins
            if not stack:
                put(raw)
                h = _HEADING.match(wikitext, at)
                if h:
                    level = len(h.group(1))
                    while above and above[-1][0] >= level:
                        above.pop()
                    sections.append({"number": len(sections), "parent": above[-1][1] if above else -1, "level": level, "title": _plain(h.group(2)), "parts": []})
                    above.append((level, len(sections) - 1))
                    at = h.end()
                else:
                    item = _LIST.match(wikitext, at)
                    at = item.end() if item else at
                if not raw and m.end() == at:  # an empty match at the beginning, and no heading or list
                    put(wikitext[at : at + 1])
                    at += 1
            else:
                put(raw)
                if not raw:
                    put(wikitext[at : at + 1])
                    at += 1
        else:
            put(raw)
    for left in stack:
        sections[-1]["parts"].append(left.unclosed())
    out = []
    for s in sections:
        text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", "".join(s.pop("parts")))).strip()
        out.append({**s, "text": text})
    return out


def _plain(title: str) -> str:
    return parse(title)[0]["text"] if re.search(r"[\[{<']", title) else title


@F.arrow_udf(T.ArrayType(SECTION))
def sections(wikitext: pa.Array) -> pa.Array:
    """Sections of articles; a null or empty article has one, without text."""
    kind = to_arrow_type(T.ArrayType(SECTION))
    # sections as Python objects only of a few articles at a time
    parts = [pa.array([parse(t.as_py() or "") for t in wikitext.slice(i, FEW)], kind) for i in range(0, len(wikitext), FEW)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
