"""HTML as a sequence of text blocks, each with the path of tags above it.

A small tolerant tokenizer: comments, declarations, raw-text elements, attributes quoted as HTML quotes them (a stray quote is no
delimiter: the tag ends at the next '>'), tags cut off at the end of the
input (they and what would be inside them go). Blocks end at block-level tags and line breaks; inline tags only take part
in the path. Character references are decoded, white space becomes one space, empty blocks go.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

# fixed values of the HTML standard
_RAW = frozenset("script style title textarea noscript template svg iframe noembed noframes xmp math".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_CLOSED_BY = {"p": "p h1 h2 h3 h4 h5 h6 ul ol dl table div section article aside nav header footer main form blockquote pre hr figure fieldset address details", "li": "li", "td": "td th tr", "th": "td th tr", "tr": "tr", "dt": "dt dd", "dd": "dt dd", "option": "option"}
_ENDS = {t: {k for k, v in _CLOSED_BY.items() if t in v.split()} for t in {t for v in _CLOSED_BY.values() for t in v.split()}}
_SCOPE = frozenset("ul ol table td th div section article main body form".split())
# an attribute as HTML reads it: a quote delimits only right after "=", anywhere else it is a character of a name or a value
_VALUE = r"""\s*+=\s*+("[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s"'>][^\s>]*+)?+"""
_NAME = r"[^\s/>][^\s/>=]*+"
_TOKEN = re.compile(rf"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|{_NAME}(?:{_VALUE.replace('(', '(?:', 1)})?+)*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:{_VALUE})?+")
_MARKED = frozenset(("class", "id", "role"))
_PART = re.compile(r"[a-z0-9]+")
_WHITE = "[ \t\n\r\f\v]"


def _marks(name: str, attrs: str) -> tuple[str, ...]:
    """The element's tokens: its tag, and the words of its class, id and role."""
    if "=" not in attrs:
        return (name,)
    parts = [p for k, v in _ATTRIBUTE.findall(attrs) if k.lower() in _MARKED for p in _PART.findall(v.lower())]
    return (name, *("." + p for p in parts))


class Path:
    """An element's marks and the path above it. Blocks share the parts of their paths, at any depth."""

    __slots__ = ("above", "marks")

    def __init__(self, marks: tuple[str, ...], above: Path | None):
        self.marks, self.above = marks, above

    def __iter__(self) -> Iterator[tuple[str, ...]]:
        """The marks of the elements, innermost first."""
        at: Path | None = self
        while at is not None:
            yield at.marks
            at = at.above


def blocks(source: str | None) -> list[tuple[Path | tuple[()], str, int]]:
    """(path, text, characters of the text inside links) of each block with text, in page order."""
    out: list = []
    path: list[Path] = []
    within: Counter = Counter()  # open elements by tag
    parts: list[str] = []
    state = {"path": (), "links": 0, "said": False}
    source = source or ""
    at, end = 0, len(source)

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((state["path"], text, min(state["links"], len(text))))
            parts.clear()
        state["links"], state["said"] = 0, False

    def leave(keep: int) -> None:
        """Close the elements from `keep` inward."""
        within.subtract(p.marks[0] for p in path[keep:])
        del path[keep:]

    def enter(marks: tuple[str, ...]) -> None:
        path.append(Path(marks, path[-1] if path else None))
        within[marks[0]] += 1

    def say(text: str) -> None:
        if text:
            if not state["said"]:
                state["path"] = path[-1] if path else ()
                state["said"] = not text.isspace()
            if within["a"]:
                state["links"] += len(text)
            parts.append(text)

    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            say(source[at:])
            break
        say(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name not in _INLINE:
            flush()
        if m[4] != ">":
            break
        if m[1]:
            if within[name]:
                keep = len(path) - 1
                while path[keep].marks[0] != name:
                    keep -= 1
                inner = [p.marks for p in path[keep + 1 :]] if name in _INLINE else []
                leave(keep)
                for marks in inner:
                    enter(marks)
            continue
        if name in _RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            at = close.end() if close else end
            continue
        if name in _VOID or m[3].endswith("/"):
            continue
        if (drop := _ENDS.get(name)) and any(within[d] for d in drop):
            for k in range(len(path) - 1, -1, -1):
                if path[k].marks[0] in drop:
                    leave(k)
                    break
                if path[k].marks[0] in _SCOPE:
                    break
        enter(_marks(name, m[3]))
    flush()
    return out
