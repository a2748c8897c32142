"""Splitting source text into chunks: (chunk_type, name, content, start_line, end_line, parent), lines from 1.

No parser is available, so code is read by scanners that know strings, comments and brackets and split at
top-level items; what they can't read goes to the line windows of ``fallback``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

WINDOW_BYTES, OVERLAP, LONG_COMPONENT = 1000, 4, 50


@dataclass
class Chunk:
    chunk_type: str
    name: str | None
    content: str
    start_line: int
    end_line: int
    parent: int | None = None


@dataclass
class Import:
    source: str
    specifiers: list[tuple[str, str | None, str]] = field(default_factory=list)  # (name, alias, kind)


def lines_of(source: str) -> list[str]:
    """Lines end at a line feed, with a carriage return before it or without."""
    lines = source.split("\n")
    return [x.removesuffix("\r") for x in (lines if lines[-1] else lines[:-1])]


def fallback(source: str) -> list[Chunk]:
    """Windows of whole lines up to 1000 bytes, each starting four lines before the last one's end, but always
    further on than the last one's start."""
    lines, out, start = lines_of(source), [], 0
    while start < len(lines):
        end, size = start, 0
        while end < len(lines) and size < WINDOW_BYTES:
            size += len(lines[end].encode()) + 1
            end += 1
        text = "\n".join(lines[start:end])
        if text.strip():
            out.append(Chunk("other", None, text, start + 1, end))
        if end >= len(lines):
            break
        start = max(end - OVERLAP, start + 1)
    return out


HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]+(.*))?$")


def markdown(source: str) -> list[Chunk]:
    """One chunk for each heading's section, outside fences; what stands before the first is ``other``."""
    lines, heads, fenced = lines_of(source), [], False
    for k, line in enumerate(lines):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and (m := HEADING.match(line)):
            title = re.sub(r"(^|[ \t]+)#+[ \t]*$", "", (m[1] or "").strip()).strip()
            heads.append((k, title or None))
    out = []
    bounds = [(0, None, "other")] * (not heads or heads[0][0] > 0) + [(k, t, "md_section") for k, t in heads]
    for (k, title, kind), after in zip(bounds, [*(b[0] for b in bounds[1:]), len(lines)], strict=True):
        text = "\n".join(lines[k:after])
        if text.strip():
            out.append(Chunk(kind, title, text, k + 1, after))
    return out


class _Top(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.spans: list[tuple[int, int]] = []
        self.open: list[tuple[str, int]] = []
        self.starts = [0]
        for line in source.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)

    def at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def handle_decl(self, decl):
        if not self.open:
            self.spans.append((self.at(), self.at() + len(decl) + 3))

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            if not self.open:
                self.spans.append((self.at(), self.at() + len(self.get_starttag_text() or "")))
        else:
            self.open.append((tag, self.at()))

    def handle_startendtag(self, tag, attrs):
        if not self.open:
            self.spans.append((self.at(), self.at() + len(self.get_starttag_text() or "")))

    def handle_endtag(self, tag):
        if tag in (t for t, _ in self.open):
            while self.open:
                last, start = self.open.pop()
                if last == tag:
                    break
            if not self.open:
                self.spans.append((start, self.at() + len(tag) + 3))


def _lines(source: str, spans: list[tuple[int, int]], kind: str) -> list[Chunk]:
    return [Chunk(kind, None, source[a:b], source.count("\n", 0, a) + 1, source.count("\n", 0, b) + 1) for a, b in spans if source[a:b].strip()]


def html(source: str) -> list[Chunk]:
    """Top-level elements and declarations; an element that never ends runs to the end."""
    top = _Top(source)
    top.feed(source)
    top.close()
    spans = top.spans + ([(top.open[0][1], len(source))] if top.open else [])
    return _lines(source, spans, "html_element") or fallback(source)


STRINGS = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
RUST_STRINGS = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|r(#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"|'(?:\\.[^']*|[^'\\])'", re.S)
CSS_STRINGS = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)


def blanked(source: str, strings: re.Pattern) -> str:
    """``source`` with comments and the insides of strings as blanks, so that brackets count."""
    return strings.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def items(code: str, line_ends: bool) -> list[tuple[int, int]]:
    """Top-level items: up to a semicolon or a closing brace outside all brackets (with ``line_ends``, also up
    to a line's end before a new statement)."""
    out, depth, start, k, size = [], 0, None, 0, len(code)
    while k < size:
        c = code[k]
        if start is None and not c.isspace():
            start = k
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
        ends = depth == 0 and start is not None and (c == ";" or c == "}" and not re.match(r"\s*[;,)\]=.]|\s*(?:from|else|catch|finally|while|as)\b|\s*=>", code[k + 1 :][:40]))
        if line_ends and depth == 0 and start is not None and c == "\n" and re.match(r"\s*(?:import|export|const|let|var|function|async|class|interface|type|enum|describe|it|test)\b", code[k + 1 :][:80]):
            ends = True
        if ends:
            out.append((start, k + 1))
            start = None
        k += 1
    if start is not None:
        out.append((start, size))
    return out


def css(source: str) -> list[Chunk]:
    found = [(a, b) for a, b in items(blanked(source, CSS_STRINGS), False) if "{" in source[a:b] or source[a:b].startswith("@")]
    return _lines(source, found, "css_rule") or fallback(source)


def _with_comments(source: str, code: str, start: int) -> int:
    """Where the run of comments directly before an item begins."""
    before = len(code[:start].rstrip())
    between = source[before:start]
    first = re.search(r"\S", between)
    return before + first.start() if first else start


NAME = r"([A-Za-z_$][\w$]*)"
DECLARED = re.compile(rf"(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?\s+{NAME}|class\s+{NAME}|(?:const|let|var)\s+{NAME})")
TYPED = re.compile(rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:interface|type|enum)\s+{NAME}")
TESTED = re.compile(r"(?:describe|it|test)(?:\.\w+)*\s*\(\s*(?:\"([^\"]*)\"|'([^']*)'|`([^`]*)`)?")
INNER = re.compile(rf"(?:(?:async\s+)?function\s+{NAME}|(?:const|let)\s+{NAME}\s*=\s*(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*=>|(?:const|let)\s+{NAME}\s*=\s*(?:React\.)?(?:useCallback|useMemo)\b|(?:React\.)?(useEffect|useMemo|useCallback)\s*\()")


def _kind(name: str | None) -> str:
    if name and re.match(r"use[A-Z]", name):
        return "hook"
    return "component" if name and name[0].isupper() else "other"


def script(source: str, texts: list[str] | None = None) -> tuple[list[Chunk], list[Import]]:
    """TypeScript and JavaScript: top-level statements and imports; import statements are added to ``texts``."""
    code, chunks, imports = blanked(source, STRINGS), [], []
    for a, b in items(code, True):
        text = source[a:b]
        if re.match(r"import\b(?!\s*\()", text):
            if texts is not None:
                texts.append(text.strip())
            if parsed := script_import(text):
                imports.append(parsed)
            continue
        if m := TYPED.match(text):
            kind, name = "type_def", m[1]
        elif m := DECLARED.match(text):
            name = next((g for g in m.groups() if g), None)
            function = m[1] is not None or m[3] is not None and re.search(r"=>|\bfunction\b|\b(?:memo|forwardRef)\s*\(", code[a:b]) is not None
            kind = _kind(name) if function or m[2] is None else "other"
        elif m := TESTED.match(text):
            kind, name = "test_case", next((g for g in m.groups() if g is not None), None)
        else:
            kind, name = "other", None
        if not text.strip(" \t\r\n;"):
            continue
        first = _with_comments(source, code, a)
        at = len(chunks)
        chunks.append(Chunk(kind, name, source[first:b], source.count("\n", 0, first) + 1, source.count("\n", 0, b) + 1))
        if kind == "component" and source.count("\n", a, b) + 1 > LONG_COMPONENT and (body := code.find("{", a, b)) >= 0:
            for c, d in items(code[body + 1 : b - 1], True):
                c, d = c + body + 1, d + body + 1
                if m := INNER.match(source[c:d]):
                    inner = next((g for g in m.groups() if g), None)
                    chunks.append(Chunk("inner_fn", inner, source[c:d], source.count("\n", 0, c) + 1, source.count("\n", 0, d) + 1, at))
    return (chunks or fallback(source)), imports


def script_import(text: str) -> Import | None:
    m = re.match(r"import\s+(type\s+)?(?:(.*?)\s+from\s+)?[\"']([^\"']+)[\"']", text, re.S)
    if m is None:
        return None
    out, typed, clause = Import(m[3]), bool(m[1]), (m[2] or "").strip()
    kind = lambda plain, inline=False: "type_only" if typed or inline else plain
    if braces := re.search(r"\{(.*?)\}", clause, re.S):
        for part in filter(None, (p.strip() for p in braces[1].split(","))):
            inline = part.startswith("type ")
            name, _, alias = (part[5:] if inline else part).partition(" as ")
            out.specifiers.append((name.strip(), alias.strip() or None, kind("named", inline)))
        clause = (clause[: braces.start()] + clause[braces.end() :]).strip(" ,")
    if star := re.search(rf"\*\s+as\s+{NAME}", clause):
        out.specifiers.append(("*", star[1], kind("namespace")))
        clause = (clause[: star.start()] + clause[star.end() :]).strip(" ,")
    if clause:
        out.specifiers.insert(0, (clause, None, kind("default")))
    return out


def reexports(source: str) -> list[tuple[str | None, str]]:
    """(symbol, source) of ``export … from``; a star has no symbol."""
    out = []
    for m in re.finditer(r"export\s+(?:type\s+)?(?:(\*)(?:\s+as\s+\w+)?|\{(.*?)\})\s*from\s*[\"']([^\"']+)[\"']", source, re.S):
        out += [(None, m[3])] if m[1] else [(p.split(" as ")[0].strip(), m[3]) for p in m[2].split(",") if p.strip()]
    return out


ITEM = re.compile(r"(?:#!?\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|unsafe\s+|async\s+|const\s+(?=fn|unsafe|async|extern)|extern\s+(?:\"[^\"]*\"\s+)?)*(fn|struct|enum|trait|impl|use|mod)\b\s*([A-Za-z_]\w*)?")


def rust(source: str, crate: str | None = None, texts: list[str] | None = None) -> tuple[list[Chunk], list[Import]]:
    """Top-level items and the functions of impls, and imports from within the crate; all use statements are added to
    ``texts``."""
    code, chunks, imports = blanked(source, RUST_STRINGS), [], []
    for a, b in items(code, False):
        text = source[a:b]
        m = ITEM.match(code[a:b])
        word = m[1] if m else None
        if word == "use":
            if texts is not None:
                texts.append(text.strip())
            imports += rust_use(text[text.index("use") + 3 :].strip().rstrip(";"), crate)
            continue
        if word == "mod" and text.rstrip().endswith(";"):
            imports.append(Import(f"self::{m[2]}", [(m[2], None, "mod_decl")]))
            continue
        kind = f"rust_{word}" if word in ("fn", "struct", "enum", "trait", "impl") else "other"
        name = m[2] if m and word != "impl" else None
        if word == "impl":
            head = code[a:b].split("{")[0]
            head = re.sub(r"^.*?\bimpl\b\s*(?:<[^{]*?>\s*(?=[A-Z(&]))?", "", head, count=1, flags=re.S)
            name = " ".join(head.split(" where ")[0].split()) or None
        first = _with_comments(source, code, a)
        at = len(chunks)
        chunks.append(Chunk(kind, name, source[first:b], source.count("\n", 0, first) + 1, source.count("\n", 0, b) + 1))
        if word == "impl" and (body := code.find("{", a, b)) >= 0:
            for c, d in items(code[body + 1 : b - 1], False):
                c, d = c + body + 1, d + body + 1
                inner = ITEM.match(code[c:d])
                if inner and inner[1] == "fn":
                    chunks.append(Chunk("rust_fn", inner[2], source[c:d], source.count("\n", 0, c) + 1, source.count("\n", 0, d) + 1, at))
    return (chunks or fallback(source)), imports


def _split_list(text: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            out, part = out + [part], ""
        else:
            part += c
    return [x.strip() for x in [*out, part] if x.strip()]


def rust_use(path: str, crate: str | None) -> list[Import]:
    """Imports of a use tree that starts inside the crate; a bare name refers to nothing in it. In a list, names are of
    the list's path, as is a star, wherever it stands; renamed ones and ``self`` refer to nothing more."""
    path = path.strip()
    head = path.partition("::")[0].strip()
    if "::" not in path or head not in ("crate", "super", "self", *([crate] if crate else [])):
        return []
    if "{" not in path:
        whole, _, alias = path.partition(" as ")
        base, _, last = whole.strip().rpartition("::")
        return [Import(base, [("*", None, "namespace")])] if last == "*" else [Import(base, [(last.strip(), alias.strip() or None, "named")])]
    base, inner = path[: path.index("{")].rstrip().removesuffix("::"), path[path.index("{") + 1 : path.rindex("}")]
    out, own = [], Import(base)
    for part in _split_list(inner):
        if "{" in part:
            out += rust_use(f"{base}::{part}", crate)
        elif part.endswith("*"):
            own.specifiers.append(("*", None, "namespace"))
        elif " as " in part or part == "self":
            continue
        elif "::" in part:
            out += rust_use(f"{base}::{part}", crate)
        else:
            own.specifiers.append((part, None, "named"))
    return ([own] if own.specifiers else []) + out


def chunk_file(source: str, extension: str, crate: str | None = None, texts: list[str] | None = None) -> tuple[list[Chunk], list[Import]]:
    """By extension; what can't be read falls back to line windows. Import statements are added to ``texts``."""
    try:
        if extension in ("ts", "tsx", "js", "jsx", "mjs"):
            return script(source, texts)
        if extension == "rs":
            return rust(source, crate, texts)
        if extension in ("css", "html", "md"):
            return {"css": css, "html": html, "md": markdown}[extension](source), []
    except (ValueError, IndexError, AssertionError):
        pass
    return fallback(source), []
