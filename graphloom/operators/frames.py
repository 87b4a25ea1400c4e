"""Source text of many languages as nested frames: what stands in each pair of brackets, item by item.

One pass over the text, linear in its length whatever it holds: no token is read twice, and literals that do not end
within ``LONGEST`` characters are taken for stray quotes.  Brackets that do not match close what is open up to theirs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

LONGEST = 400
#: Words ahead of a name that a frame knows.
AHEAD = 12
_TOKEN = re.compile(rf"""(?P<word>[A-Za-z_$][\w$]*)|"(?P<double>(?:[^"\\\n]|\\.){{0,{LONGEST}}})"|'(?P<single>(?:[^'\\\n]|\\.){{0,{LONGEST}}})'|`(?P<back>[^`]{{0,{LONGEST}}})`|(?P<mark>[^\s\w])|(?P<line>\n)""")
_OPEN = {"(": ")", "[": "]", "{": "}", "<": ">"}
_CLOSE = {v: k for k, v in _OPEN.items()}


@dataclass
class Item:
    """Between two separators: words, marks, literals, frames and names of decorators in order, the key if it is ``key: value`` or
    ``key = value``, and the separator that ends it."""

    words: list[str] = field(default_factory=list)
    decorators: list[str] = field(default_factory=list)
    marks: list[str] = field(default_factory=list)
    literals: list[str] = field(default_factory=list)
    frames: list[Frame] = field(default_factory=list)
    key: str | None = None
    end: str = ""

    def __bool__(self) -> bool:
        return bool(self.words or self.marks or self.literals or self.frames)


@dataclass
class Frame:
    """``kind`` is the opening bracket ('' for the whole text); ``name`` the dotted name right before it; ``at`` whether a decorator's
    mark stands before that; ``chained`` the name of the frame that closed right before the name; ``before`` the words ahead of the
    name in its item; ``mark`` the mark ahead of the bracket or name."""

    kind: str
    name: tuple[str, ...] = ()
    at: bool = False
    chained: str = ""
    before: tuple[str, ...] = ()
    mark: str = ""
    items: list[Item] = field(default_factory=lambda: [Item()])

    def literals(self) -> Iterator[str]:
        """Those of its own items, not of frames inside."""
        for item in self.items:
            yield from item.literals

    def value(self, *keys: str) -> Item | None:
        return next((i for i in self.items if i.key in keys), None)

    def all(self) -> Iterator[Frame]:
        """This frame and those inside, in order of their opening brackets."""
        todo = [self]
        while todo:
            one = todo.pop()
            yield one
            todo += [f for item in reversed(one.items) for f in reversed(item.frames)]


def read(text: str, separators: str = ",;", angles: bool = False) -> Frame:
    """The frame of the whole text; ``separators`` part items ('\\n' may be one); ``angles`` makes brackets of < and >."""
    top = Frame("")
    stack = [top]
    name: list[str] = []  # the dotted name that is being read
    dotted = at = False  # a dot has just been read; a decorator's mark stands before the name
    linked = False  # a dot has been read after the frame that closed last
    mark = chained = ""

    def forget() -> None:
        nonlocal dotted, at, linked, mark, chained
        name.clear()
        dotted = at = linked = False
        mark = chained = ""

    for m in _TOKEN.finditer(text):
        kind, token = m.lastgroup, m[m.lastgroup]
        item = stack[-1].items[-1]
        if kind == "word":
            if not dotted:
                keep = (at, mark) if not name else (False, "")
                name.clear()
                chained = chained if linked else ""
                linked = False
                at, mark = keep
            if at:
                item.decorators[len(item.decorators) - dotted :] = [token]
            name.append(token)
            dotted = False
            item.words.append(token)
        elif kind == "line":
            if "\n" in separators and item:
                item.end = "\n"
                stack[-1].items.append(Item())
                forget()
        elif kind == "mark":
            if token in _OPEN and (token != "<" or angles):
                recent = item.words[-AHEAD - len(name) :]
                frame = Frame(token, tuple(name), at, chained, tuple(recent[: len(recent) - len(name)]), mark)
                item.frames.append(frame)
                stack.append(frame)
                forget()
            elif token in _CLOSE and (token != ">" or angles):
                while len(stack) > 1 and stack[-1].kind != _CLOSE[token]:
                    if all(f.kind != _CLOSE[token] for f in stack[-8:]):
                        break
                    stack.pop()
                closed = stack.pop() if len(stack) > 1 and stack[-1].kind == _CLOSE[token] else None
                forget()
                chained = closed.name[-1] if closed and closed.name else ""
                if closed and closed.kind == "{" and ";" in separators and stack[-1].kind in ("", "{"):  # a body ends its item
                    stack[-1].items[-1].end = "}"
                    stack[-1].items.append(Item())
            elif token in separators:
                item.end = token
                stack[-1].items.append(Item())
                forget()
            elif token == "." and (name or chained):
                dotted, linked = bool(name), not name
            else:
                if token in ":=" and item.key is None and item.words and not item.literals and all(f.kind == "<" for f in item.frames):
                    item.key = item.words[-1]
                item.marks.append(token)
                forget()
                at, mark = token == "@", token
        else:
            item.literals.append(token)
            forget()
    return top
