"""Facts of source texts by a lexical scanner: references, exports, declarations, mock keys, occurrences of names.

Comments and literals are blanked out first, position by position, so patterns can't match inside them and offsets hold.
The scanner is not a compiler: it knows shapes of statements, not symbols or types. It runs where the texts are, one
file after another.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

NAME = r"[A-Za-z_$][\w$]*"
_LITERAL = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_FROM = re.compile(rf"\b(import|export)\s+(type\s+)?((?:\*(?:\s*as\s+{NAME})?|{NAME}|\{{[^}}]*\}})(?:\s*,\s*(?:\*\s*as\s+{NAME}|\{{[^}}]*\}}))?)\s*from\s*(\"\s*\"|'\s*')")
_BARE = re.compile(r"\bimport\s*(\"\s*\"|'\s*')")
_EQUALS = re.compile(rf"\bimport\s+({NAME})\s*=\s*require\s*\(\s*(\"\s*\"|'\s*')")
_CALL = re.compile(r"(?<![\w$.])(import|require(?:\.resolve)?|(?:jest|vi|vitest)\.(?:mock|doMock|unmock|requireActual|importActual))\s*(?:<[^>(]*>)?\(\s*(\"\s*\"|'\s*')")
_EXPORT = re.compile(rf"\bexport\s+(default\s+)?((?:declare\s+|abstract\s+|async\s+)*)(const|let|var|function\s*\*?|class|interface|type|enum|namespace)\s*({NAME})?")
_EXPORT_LIST = re.compile(r"\bexport\s+(type\s+)?\{([^}]*)\}(?!\s*from)")
_DEFAULT = re.compile(r"\bexport\s+default\b")
_FUNCTION = re.compile(rf"(?m)^(export\s+)?(default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*({NAME})[^{{;]*\{{")
_ARROW = re.compile(rf"(?m)^(export\s+)?(?:const|let|var)\s+({NAME})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)|{NAME}|function\s*\*?\s*{NAME}?\s*\([^)]*\))\s*(?::\s*[^={{]+)?(?:=>)?\s*\{{")
_TYPE = re.compile(rf"(?m)^(export\s+)?(?:declare\s+)?(interface|type)\s+({NAME})([^{{=;]*)(=\s*)?\{{")

REFS = "src string, specifier string, ref_type string, line int, col int, is_type_only boolean, bindings array<struct<name:string,alias:string,is_type:boolean>>, seq bigint"
EXPORTS = "file string, name string, export_type string, is_type boolean, kind string, line int, seq bigint"


def blanked(text: str) -> str:
    """The text with comments and the insides of literals as blanks, of the same length."""

    def blank(m: re.Match) -> str:
        s = m[0]
        inner = re.sub(r"[^\n]", " ", s)
        return inner if s[0] == "/" else s[0] + inner[1:-1] + s[-1]

    return _LITERAL.sub(blank, text)


@lru_cache(2)
def _line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def _place(text: str, at: int) -> tuple[int, int]:
    starts = _line_starts(text)
    line = bisect_right(starts, at)
    return line, at - starts[line - 1] + 1


def _named(inside: str, type_only: bool) -> list[dict]:
    out = []
    for part in inside.split(","):
        words = part.split()
        if not words:
            continue
        is_type = type_only or (words[0] == "type" and len(words) > 1 and words[1] != "as")
        words = words[1:] if is_type and not type_only else words
        out.append({"name": words[0], "alias": words[2] if len(words) > 2 and words[1] == "as" else None, "is_type": is_type})
    return out


def scan_references(text: str) -> list[tuple]:
    """(specifier, ref_type, line, col, is_type_only, bindings), by position."""
    flat, found = blanked(text), []

    def add(m: re.Match, quoted: int, kind: str, bindings=(), type_only=False) -> None:
        found.append((m.start(), text[m.start(quoted) + 1 : m.end(quoted) - 1], kind, type_only, list(bindings)))

    for m in _FROM.finditer(flat):
        clause, type_only = m[3].strip(), bool(m[2])
        braces = re.search(r"\{([^}]*)\}", clause)
        star = re.search(rf"\*(?:\s*as\s+({NAME}))?", clause)
        if m[1] == "export":
            if star:
                add(m, 4, "export-all-as" if star[1] else "export-all", [{"name": "*", "alias": star[1], "is_type": type_only}] if star[1] else [], type_only)
            elif braces:
                add(m, 4, "export-from", _named(braces[1], type_only), type_only)
            continue
        head = re.match(rf"({NAME})", clause)
        default = [{"name": "default", "alias": head[1], "is_type": type_only}] if head else []
        if star:
            add(m, 4, "import-namespace", [*default, {"name": "*", "alias": star[1], "is_type": type_only}], type_only)
        elif braces:
            add(m, 4, "import-named", [*default, *_named(braces[1], type_only)], type_only)
        else:
            add(m, 4, "import", default, type_only)
    for m in _BARE.finditer(flat):
        add(m, 1, "import-side-effect")
    for m in _EQUALS.finditer(flat):
        add(m, 2, "import-namespace", [{"name": "*", "alias": m[1], "is_type": False}])
    taken = {m.start(): m for m in _EQUALS.finditer(flat)}
    for m in _CALL.finditer(flat):
        if not any(e.start() <= m.start() < e.end() for e in taken.values()):
            add(m, 2, {"import": "import-dynamic", "require": "require", "require.resolve": "require-resolve"}.get(m[1], "jest-mock"))
    return [(s, kind, *_place(text, at), type_only, bindings) for at, s, kind, type_only, bindings in sorted(found, key=lambda x: x[0])]


def scan_exports(text: str) -> list[tuple]:
    """(name, export_type, is_type, kind, line), by position; a named default keeps its name."""
    flat, found = blanked(text), []
    for m in _EXPORT.finditer(flat):
        kind = m[3].rstrip("* \t\n")
        if m[4] or m[1]:
            found.append((m.start(), m[4] or "default", "default" if m[1] else "named", kind in ("interface", "type"), kind))
    spans = {m.start() for m in _EXPORT.finditer(flat) if m[1]}
    found += [(m.start(), "default", "default", False, "value") for m in _DEFAULT.finditer(flat) if m.start() not in spans]
    for m in _EXPORT_LIST.finditer(flat):
        found += [(m.start(), b["alias"] or b["name"], "default" if b["alias"] == "default" else "named", b["is_type"], "value") for b in _named(m[2], bool(m[1]))]
    for m in _FROM.finditer(flat):
        if m[1] == "export" and (space := re.match(rf"\*\s*as\s+({NAME})", m[3].strip())):
            found.append((m.start(), space[1], "namespace", bool(m[2]), "namespace"))
    return [(n, t, is_type, kind, _place(text, at)[0]) for at, n, t, is_type, kind in sorted(found)]


def _closing(flat: str, at: int, open_: str = "{", shut: str = "}") -> int:
    """Where the bracket at a position closes, or the end."""
    depth = 0
    for m in re.compile(f"[{re.escape(open_ + shut)}]").finditer(flat, at):
        depth += 1 if m[0] == open_ else -1
        if not depth:
            return m.end()
    return len(flat)


def scan_declarations(text: str) -> list[dict]:
    """Top-level functions, function constants with a block body, interfaces and object types."""
    flat, out = blanked(text), []
    for pattern, kind in ((_FUNCTION, "function"), (_ARROW, "function"), (_TYPE, None)):
        for m in pattern.finditer(flat):
            begin = m.end() - 1
            end = _closing(flat, begin)
            name = m[3] if pattern is not _ARROW else m[2]
            body = text[begin:end]
            heads = re.findall(NAME, (m[4] or "").partition("extends")[2]) if pattern is _TYPE else []
            members = re.findall(rf"(?m)^\s*(?:readonly\s+)?({NAME})\??\s*[:(]", flat[begin + 1 : end]) if pattern is _TYPE else []
            statements = [s for s in re.split(r";|\n", flat[begin + 1 : end - 1]) if s.strip()]
            out.append(
                {
                    "name": name, "kind": kind or m[2], "line": _place(text, m.start())[0], "is_exported": bool(m[1]), "body": body, "start": m.start(), "end": end,
                    "body_length": len(body), "body_lines": body.count("\n") + 1, "has_directive": bool(re.match(r"\{\s*[\"']use \w+[\"']", body)),
                    "is_wrapper": kind == "function" and len(statements) == 1 and bool(re.match(r"\s*(return\s+)?[\w$.]+\s*\(", statements[0])),
                    "is_type_guard": bool(re.search(r"\)\s*:\s*(?:asserts\s+)?\w+\s+is\s", flat[m.start() : m.end()])), "extends_names": heads, "member_names": members,
                }
            )
    return sorted(out, key=lambda d: d["start"])


def scan_mock_keys(text: str) -> list[dict]:
    """specifier, key, start, end, line of mock factories, or specifier and skip: why a factory can't be read."""
    flat, out = blanked(text), []
    for m in _CALL.finditer(flat):
        if not m[1].endswith((".mock", ".doMock")):
            continue
        specifier = text[m.start(2) + 1 : m.end(2) - 1]
        rest = re.compile(r"\s*,\s*(async\s*)?(\([^)]*\)|function\s*\([^)]*\)|[\w$]+)\s*(=>)?\s*").match(flat, m.end())
        if not rest:
            continue
        at = rest.end()
        if flat.startswith("(", at):
            at += 1 + len(re.match(r"\s*", flat[at + 1 :])[0])
        elif flat.startswith("{", at) and (back := re.compile(r"\{\s*return\s*").match(flat, at)):
            at = back.end()
        skip = "async" if rest[1] else "unsupported" if not rest[3] and not rest[2].startswith("function") else None if flat.startswith("{", at) else "non-object"
        if skip:
            out.append({"specifier": specifier, "skip": skip})
            continue
        end, k, keys = _closing(flat, at), at + 1, []
        while k < end - 1:
            item = re.compile(r"\s*(?:(\.\.\.)|(\[)|(?:async\s+)?(?:get\s+|set\s+)?([\w$]+|[\"'][^\"']*[\"'])?)").match(flat, k)
            stop, depth = k, 0
            while stop < end - 1 and (depth or flat[stop] != ","):
                depth += (flat[stop] in "({[") - (flat[stop] in ")}]")
                stop += 1
            if item[1] or item[2]:
                out.append({"specifier": specifier, "skip": "spread" if item[1] else "computed"})
                keys = []
                break
            if item[3]:
                name = text[item.start(3) : item.end(3)].strip("\"'")
                keys.append({"specifier": specifier, "key": name, "start": item.start(3), "end": stop, "line": _place(text, item.start(3))[0]})
            k = stop + 1
        out += keys
    return out


def scan_occurrences(text: str) -> list[tuple[str, str]]:
    """(name, role) of every name: declaration, member, export or use."""
    flat, out = blanked(text), []
    lists = [m.span() for m in _EXPORT_LIST.finditer(flat)]
    begins = [a for a, _ in lists]
    last = -1  # the last character before a name that isn't white space
    at = 0
    for m in re.finditer(NAME, flat):
        while at < m.start():
            if not flat[at].isspace():
                last = at
            at += 1
        before = flat[max(0, last - 19) : last + 1]
        k = bisect_right(begins, m.start()) - 1
        if k >= 0 and m.start() < lists[k][1]:
            role = "export"
        elif before.endswith(".") and not before.endswith("..."):
            role = "member"
        elif re.search(r"\b(?:function|class|const|let|var|interface|type|enum|namespace)\s*\*?$", before):
            role = "declaration"
        else:
            role = "use"
        out.append((m[0], role))
    return out


def _over(texts: DataFrame, rows_of, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", schema)]
        for pdf in batches:
            yield pd.DataFrame([r for path, text in zip(pdf["path"], pdf["content"]) for r in rows_of(path, text or "")], columns=names)

    return texts.select("path", "content").mapInPandas(run, schema)


def references(texts: DataFrame) -> DataFrame:
    return _over(texts, lambda p, t: [(p, *r, k) for k, r in enumerate(scan_references(t))], REFS)


def exports(texts: DataFrame) -> DataFrame:
    return _over(texts, lambda p, t: [(p, *r, k) for k, r in enumerate(scan_exports(t))], EXPORTS)


def declarations(texts: DataFrame) -> DataFrame:
    """As rows of facts with their body; functions.scalars turns bodies into tokens."""
    fields = ["name", "kind", "line", "is_exported", "body", "body_length", "body_lines", "has_directive", "is_wrapper", "is_type_guard", "extends_names", "member_names"]
    schema = "file string, name string, kind string, line int, is_exported boolean, body string, body_length int, body_lines int, has_directive boolean, is_wrapper boolean, is_type_guard boolean, extends_names array<string>, member_names array<string>"
    return _over(texts, lambda p, t: [(p, *(d[f] for f in fields)) for d in scan_declarations(t)], schema)


def mock_keys(texts: DataFrame) -> DataFrame:
    return _over(texts, lambda p, t: [(p, x["specifier"], x.get("key"), x.get("line"), x.get("start"), x.get("end"), x.get("skip")) for x in scan_mock_keys(t)], "mock_file string, specifier string, key string, line int, start int, end int, skip string")


def occurrences(texts: DataFrame) -> DataFrame:
    return _over(texts, lambda p, t: [(p, *o) for o in scan_occurrences(t)], "file string, name string, role string")


def to_json(rows: DataFrame) -> str:
    """One JSON document of a report's rows."""
    return json.dumps([json.loads(x) for x in rows.toJSON().collect()])
