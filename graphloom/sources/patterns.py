"""Symbols and relations of languages without a parser here, by patterns of declarations, line by line.

A declaration's block reaches to its closing brace (strings and comments aside, braces are counted), so members know
their parents.  What patterns cannot see (types of calls, overloads, macros) is not in the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_NAME = r"(?P<name>[A-Za-z_]\w*)"
_JAVA = r"(?:(?:public|protected|private|internal|static|final|abstract|sealed|partial|readonly|virtual|override|async|synchronized|default)\s+)*"
#: By language: (type of symbol, pattern of its declaration); the first that fits a line holds.  ``bases`` are what it extends.
DECLARATIONS: dict[str, list[tuple[str, re.Pattern]]] = {
    "java": [
        (kind, re.compile(rf"^\s*{_JAVA}{word}\s+{_NAME}(?P<bases>[^{{;]*)")) for kind, word in (("class", "class"), ("interface", "@?interface"), ("enum", "enum"), ("class", "record"))
    ] + [("constant", re.compile(rf"^\s*(?=[^(]*\bstatic\b)(?=[^(]*\bfinal\b){_JAVA}[\w<>\[\],.? ]+\s{_NAME}\s*=")), ("method", re.compile(rf"^\s*{_JAVA}(?!return\b|new\b|else\b|throw\b)[\w<>\[\],.?]+(?:\s+[\w<>\[\],.?]+)*\s+{_NAME}\s*\([^;]*(?:\{{|$)"))],
    "csharp": [
        (kind, re.compile(rf"^\s*{_JAVA}{word}\s+{_NAME}(?P<bases>[^{{;]*)")) for kind, word in (("class", "class"), ("interface", "interface"), ("struct", "struct"), ("enum", "enum"), ("class", "record"), ("namespace", "namespace"))
    ] + [("constant", re.compile(rf"^\s*{_JAVA}const\s+\S+\s+{_NAME}\s*=")), ("method", re.compile(rf"^\s*{_JAVA}(?!return\b|new\b|else\b|throw\b)[\w<>\[\],.?]+\s+{_NAME}\s*\([^;]*(?:\{{|=>|$)"))],
    "typescript": [
        (kind, re.compile(rf"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?{word}\s+{_NAME}(?P<bases>[^{{;]*)")) for kind, word in (("class", "class"), ("interface", "interface"), ("enum", r"(?:const\s+)?enum"), ("function", r"(?:async\s+)?function\s*\*?"))
    ] + [
        ("type_alias", re.compile(rf"^\s*(?:export\s+)?type\s+{_NAME}\b[^=]*=")),
        ("function", re.compile(rf"^\s*(?:export\s+)?const\s+{_NAME}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>")),
        ("constant", re.compile(rf"^(?:export\s+)?const\s+{_NAME}\s*(?::[^=]+)?=")),
        ("method", re.compile(rf"^\s+(?:(?:public|protected|private|static|async|readonly|get|set|override)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b){_NAME}\s*(?:<[^>]*>)?\([^;]*\)\s*(?::\s*[^{{]+)?\{{")),
    ],
    "go": [
        ("struct", re.compile(rf"^type\s+{_NAME}\s+struct\b")),
        ("interface", re.compile(rf"^type\s+{_NAME}\s+interface\b")),
        ("type_alias", re.compile(rf"^type\s+{_NAME}\s+=?")),
        ("method", re.compile(rf"^func\s*\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*{_NAME}\s*\(")),
        ("function", re.compile(rf"^func\s+{_NAME}\s*[\[(]")),
        ("constant", re.compile(rf"^const\s+{_NAME}\b")),
    ],
    "rust": [
        (kind, re.compile(rf"^\s*(?:pub(?:\([^)]*\))?\s+)?{word}\s+{_NAME}(?P<bases>)")) for kind, word in (("struct", "struct"), ("enum", "enum"), ("trait", r"(?:unsafe\s+)?trait"), ("module", "mod"), ("type_alias", "type"), ("constant", r"(?:const|static)(?:\s+mut)?"))
    ] + [("impl", re.compile(r"^\s*impl(?:<[^>]*>)?\s+(?:(?P<bases>[\w:]+)(?:<[^>]*>)?\s+for\s+)?(?P<name>\w+)")), ("macro", re.compile(rf"^\s*macro_rules!\s+{_NAME}")), ("function", re.compile(rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern\s+\"[^\"]*\")\s+)*fn\s+{_NAME}"))],
    "cpp": [
        (kind, re.compile(rf"^\s*(?:template\s*<[^>]*>\s*)?{word}\s+{_NAME}(?!\s*;)(?P<bases>[^{{;]*)(?:\{{|$)")) for kind, word in (("class", "class"), ("struct", "struct"), ("enum", r"enum(?:\s+class)?"), ("namespace", "namespace"))
    ] + [
        ("macro", re.compile(rf"^\s*#\s*define\s+{_NAME}")),
        ("type_alias", re.compile(rf"^\s*using\s+{_NAME}\s*=")),
        ("type_alias", re.compile(rf"^\s*typedef\s.*\b{_NAME}\s*;")),
        ("method", re.compile(rf"^[\w:<>*&~ ]+\b(?P<owner>\w+)::~?{_NAME}\s*\([^;]*$")),
        ("function", re.compile(rf"^\s*(?!return\b|else\b|new\b|delete\b)[\w:<>*&]+(?:\s+[\w:<>*&]+)*[\s*&]+{_NAME}\s*\([^;]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?(?:\{{|$)")),
    ],
}
DECLARATIONS["javascript"], DECLARATIONS["c"], DECLARATIONS["c_sharp"], DECLARATIONS["kotlin"] = DECLARATIONS["typescript"], DECLARATIONS["cpp"], DECLARATIONS["csharp"], DECLARATIONS["java"]
_IMPORT = re.compile(r"^\s*(?:import\s+(?:static\s+)?(?:[^'\"\n]*from\s+)?['\"]?([\w./@-]+)|using\s+([\w.]+)\s*;|use\s+([\w:]+)|#\s*include\s*[<\"]([^>\"]+)|(?:const|let|var)\s+[^=]+=\s*require\(\s*['\"]([^'\"]+))")
_CALL = re.compile(r"\b(new\s+)?([A-Za-z_]\w*)\s*\(")
_WORDS = frozenset("if for while switch catch return function sizeof match loop else do try super this self new throw await typeof delete assert defer go select case default in of".split())
_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|`(?:\\.|[^`\\])*`", re.S)


def _bare(text: str) -> str:
    """The text with strings and comments as blanks, line for line."""
    return _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _parents_named(bases: str) -> list[tuple[str, str]]:
    out = []
    for word, names in re.findall(r"\b(extends|implements)\s+([\w.,<>\s]+?)(?=\bextends\b|\bimplements\b|$)", bases):
        out += [("implementation" if word == "implements" else "inheritance", n) for n in re.findall(r"[A-Za-z_][\w.]*", re.sub(r"<[^<>]*>", "", names))]
    if not out and (m := re.match(r"\s*(?:<[^>]*>)?\s*:\s*(.+)", bases)):
        out = [("inheritance", n) for n in re.findall(r"[A-Za-z_][\w.:]*", re.sub(r"<[^<>]*>", "", m[1])) if n not in ("public", "private", "protected", "virtual", "where")]
    return out


def symbols(path: str, text: str, language: str) -> Iterator[tuple]:
    """Rows of (item, id, name, kind, start_line, end_line, docstring, target), as of parsed Python."""
    table = DECLARATIONS.get(language)
    if not table:
        return
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    prefix = f"{language}::{stem}"
    lines = text.split("\n")
    bare = _bare(text).split("\n")
    depth, open_blocks, waiting = 0, [], None  # blocks: (depth before, id, qualified name, kind, line)
    ends: dict[int, int] = {}
    found: list[tuple[str, str, str, int, str]] = []
    edges: list[tuple] = []
    for i, line in enumerate(bare):
        hit = None
        for kind, pattern in table:
            if m := pattern.match(line):
                if m["name"] not in _WORDS:
                    hit = (kind, m)
                break
        inside = next((b for b in reversed(open_blocks) if b[3] != "block"), None)
        if hit:
            kind, m = hit
            groups = m.groupdict()
            owner = groups.get("owner")
            parent = owner or (inside[2] if inside else "")
            own = f"{parent}.{m['name']}" if parent and kind != "impl" else m["name"]
            if kind == "function" and parent and (owner or inside[3] in ("class", "struct", "interface", "trait", "impl", "enum")):
                kind = "method"
            ident = f"{prefix}::{own}"
            if kind != "impl":
                doc = lines[i - 1].strip(" /*#!") if i and re.match(r"\s*(///|//|\*|/\*|#)", lines[i - 1]) else ""
                found.append((ident, m["name"], kind, i, doc))
                if parent:
                    edges.append(("edge", f"{prefix}::{parent}", own, "defines", i + 1, None, None, ident))
            named = [("implementation", groups["bases"])] if kind == "impl" and groups.get("bases") else _parents_named(groups.get("bases") or "")
            edges += [("edge", ident, n.rsplit("::", 1)[-1], rel, i + 1, None, None, None) for rel, n in named]
            waiting = (ident, own, kind, len(found) - 1 if kind != "impl" else -1)
        elif m := _IMPORT.match(lines[i]):
            edges.append(("edge", prefix, next(filter(None, m.groups())), "imports", i + 1, None, None, None))
        elif inside and inside[3] in ("function", "method"):
            for new, name in _CALL.findall(line):
                if name not in _WORDS:
                    edges.append(("edge", inside[1], name, "creates" if new or name[0].isupper() else "calls", i + 1, None, None, None))
        for c in line:
            if c == "{":
                open_blocks.append((depth, *(waiting if waiting else ("", "", "block", -1))))
                waiting, depth = None, depth + 1
            elif c == "}" and open_blocks:
                depth -= 1
                if (block := open_blocks.pop())[4] >= 0:
                    ends[block[4]] = i + 1
            elif c == ";" and waiting and waiting[2] != "impl":
                waiting = None
    for k, (ident, name, kind, i, doc) in enumerate(found):
        yield ("symbol", ident, name, kind, i + 1, ends.get(k, i + 1), doc, None)
    yield from edges


def parsed(source: DataFrame) -> DataFrame:
    """Symbols and relations of ``source(rel_path, language, content)`` in the languages above, a row each."""
    fields = "item string, id string, name string, kind string, start_line int, end_line int, docstring string, target string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in fields.split(", ")]
        for frame in frames:
            rows = [(p, *s) for p, lang, t in zip(frame.rel_path, frame.language, frame.content, strict=True) for s in symbols(p, t or "", lang)]
            yield pd.DataFrame(rows, columns=["rel_path", *names]).astype({"start_line": "Int32", "end_line": "Int32"})

    return source.where(source["language"].isin(*DECLARATIONS)).select("rel_path", "language", "content").mapInPandas(run, f"rel_path string, {fields}")


def code_chunks(path: str, text: str, language: str, most: int = 1000) -> list[tuple[str, int, int, str]]:
    """(symbol, first line, last line, content): a text cut before each declaration, and wherever a piece grows beyond ``most``."""
    table = DECLARATIONS.get(language) or [("any", re.compile(r"^\s*(?:class|(?:async\s+)?def)\s+(?P<name>\w+)"))]
    out, held, name, first = [], [], "", 1
    lines = text.split("\n")
    for i, line in enumerate(lines, 1):
        m = next((m for _, p in table if (m := p.match(line))), None)
        if held and (m or sum(map(len, held)) + len(held) > most):
            out.append((name, first, i - 1, "\n".join(held)))
            held, first, name = [], i, ""
        if m:
            name = m["name"]
        held.append(line)
    return [x for x in [*out, (name, first, len(lines), "\n".join(held))] if x[3].strip()]
