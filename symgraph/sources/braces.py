"""Entities and uses of Java, C#, JavaScript and Kotlin files, found by patterns over text without comments and strings."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from .code import register_analyzer

#: Characters between a declaration and its comment at most (annotations and modifiers stand there).
DOC_GAP = 4000
_HIDDEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_KEYWORDS = frozenset("if for while switch catch synchronized return new else do try using lock foreach when throw typeof sizeof nameof super this function await case assert".split())
_MORE_KEYWORDS = {"java": frozenset(), "cs": frozenset(("where",)), "js": frozenset(), "kt": frozenset("in is as fun class interface object constructor init".split())}
_TYPE_KIND = {"class": "class", "record": "class", "interface": "interface", "enum": "enum", "struct": "struct", "object": "object"}
_GENERIC = r"(?:<[^<>{}();]*(?:<[^<>{}();]*>[^<>{}();]*)*>)?"
_TYPES = {
    "java": re.compile(rf"\b(class|interface|enum|record)\s+(\w+)\s*{_GENERIC}\s*(?:\([^()]*\))?([^{{}};()]{{0,2000}})(?=\{{)"),
    "cs": re.compile(rf"\b(class|interface|enum|struct|record)\s+(\w+)\s*{_GENERIC}\s*(?:\([^()]*\))?([^{{}};()]{{0,2000}})(?=\{{)"),
    "js": re.compile(r"\b(class)\s+(\w+)([^{};()]{0,2000})(?=\{)"),
    "kt": re.compile(rf"\b(class|interface|object)\s+(\w+)\s*{_GENERIC}\s*(?:\([^()]*\))?((?:\s*:\s*[\w.]+{_GENERIC}(?:\([^()]*\))?(?:\s*,\s*[\w.]+{_GENERIC}(?:\([^()]*\))?)*)?)"),
}
_METHOD = re.compile(rf"(?:(?<=[{{}};\n)])|^)[ \t]*(?:@\w+(?:\([^()]*\))?\s*)*((?:[\w.?]+{_GENERIC}(?:\[\])*\s+){{0,12}})(\w+)\s*\(([^()]*)\)\s*(?:throws\s+[\w., ]+)?\s*(?:=>|[{{;])", re.M)
_JS_METHOD = re.compile(r"(?:(?<=[{};\n])|^)[ \t]*(?:static\s+|async\s+|get\s+|set\s+|\*\s*)*(#?\w+)\s*\(([^()]*)\)\s*\{", re.M)
_JS_FUNCTION = re.compile(r"\bfunction\s*\*?\s*(\w+)\s*\(([^()]*)\)\s*\{")
_FUN = re.compile(rf"\bfun\s+{_GENERIC}\s*(?:[\w.]+\.)?(\w+)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?::\s*([\w.]+{_GENERIC}\??))?")
_CALL = re.compile(r"(?:((?:this|super|[\w\])]+(?:\s*\.\s*\w+){0,50}))\s*\??\.\s*)?\b(\w+)\s*(?:<[\w, ]+>)?\(")
_FIELD = re.compile(rf"(?:(?<=[{{}};(,\n])|^)[ \t]*(?:(?:public|private|protected|static|final|readonly|volatile)\s+)*([A-Z][\w.]*{_GENERIC}(?:\[\])*)\s+(\w+)\s*(?==[^=]|;|:)", re.M)
_IMPORT = re.compile(r"^[ \t]*import\s+(static\s+)?([\w.]+?)(\.\*)?\s*;", re.M)
_PACKAGE = re.compile(r"^[ \t]*package\s+([\w.]+)\s*;", re.M)
_MODIFIERS = frozenset("public private protected static final abstract default native synchronized strictfp virtual override sealed async extern unsafe new partial readonly internal".split())


def type_name(text: str) -> str:
    """A type without type arguments, brackets and question mark."""
    return text.split("<", 1)[0].replace("[]", "").rstrip("?").strip()


def _parents(language: str, kind: str, head: str) -> list[tuple[str, str]]:
    """(kind of use, type) for what a type's head names."""
    names = lambda part: [type_name(x) for x in re.split(r",(?![^<(]*[>)])", part) if x.strip()]
    if language in ("java", "js"):
        found = {k: names(part) for k, part in re.findall(r"\b(extends|implements)\s+(.*?)(?=\bextends\b|\bimplements\b|\bpermits\b|$)", head, re.S)}
        return [("base", x) for x in found.get("extends", [])] + [("implements", x) for x in found.get("implements", [])]
    listed = head.split(":", 1)[1].split(" where ")[0] if ":" in head else ""
    if language == "kt":
        given = [x.strip() for x in re.split(r",(?![^<(]*[>)])", listed) if x.strip()]
        return [("base" if "(" in x and kind == "class" else "implements", type_name(x.split("(")[0])) for x in given]
    return [("base" if kind == "interface" or (i == 0 and kind == "class") else "implements", x) for i, x in enumerate(names(listed))]


def _parameters(language: str, given: str) -> list[tuple[str, str]]:
    """(name, type) of typed parameters."""
    out = []
    for part in re.split(r",(?![^<(]*[>)])", given):
        part = re.sub(r"@\w+\s*|\b(?:final|val|var|vararg|ref|out|in|params|this)\s+", "", part).split("=")[0].strip()
        if language == "kt" and ":" in part:
            name, _, kind = part.partition(":")
            out.append((name.strip(), kind.strip()))
        elif language != "kt" and len(words := part.rsplit(None, 1)) == 2:
            out.append((words[1], words[0]))
    return out


def brace_file(language: str):
    """The analyser of one language: (path, text) -> rows."""

    keywords = _KEYWORDS | _MORE_KEYWORDS[language]

    def rows(path: str, text: str) -> list[tuple]:
        comments = [(m.start(), m.end(), m[0]) for m in _HIDDEN.finditer(text) if m[0].startswith("/")]
        plain = _HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0].startswith("/") else '"' + re.sub(r"[^\n]", " ", m[0][1:-1]) + '"', text)
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        line = lambda at: bisect_right(starts, at)
        close, open_at = {}, []
        for m in re.finditer("[{}]", plain):
            if m[0] == "{":
                open_at.append(m.start())
            elif open_at:
                close[open_at.pop()] = m.start()
        opens, outer_of, open_now = sorted(close), {}, []
        for a in opens:
            while open_now and close[open_now[-1]] < a:
                open_now.pop()
            outer_of[a] = open_now[-1] if open_now else None
            open_now.append(a)

        def braces_around(at: int) -> Iterator[int]:
            """The opening braces around a place, the innermost first."""
            i = bisect_left(opens, at) - 1
            a = opens[i] if i >= 0 else None
            while a is not None:
                if close[a] > at:
                    yield a
                a = outer_of[a]

        def around(at: int) -> int | None:
            """The innermost opening brace around a place."""
            return next(braces_around(at), None)

        ends = [c[1] for c in comments]

        def doc(at: int) -> str | None:
            """The comment (C#: all comments) right before a declaration, by the language's rule.

            Only the nearest comment can be right before it; what is too far away for annotations is not read.
            """
            before, found = at, []
            while (i := bisect_right(ends, before) - 1) >= 0:
                start, end, comment = comments[i]
                gap = plain[end:before] if before - end <= DOC_GAP else ";"
                if "\n\n" in gap or re.sub(r"@\w+(?:\([^()]*\))?|[\w<>,.?&\[\]]+", "", gap).strip():
                    break
                found.insert(0, comment)
                before = start
                if language != "cs":
                    break
            if not found or (language == "java" and not found[0].startswith("/*")) or (language == "kt" and not found[0].startswith("/**")):
                return None
            return "\n".join(found)

        out, owners = [], {}  # opening brace -> (full name, kind)

        def owner(at: int) -> tuple[str | None, str | None]:
            return next((owners[a] for a in braces_around(at) if a in owners), (None, None))

        def body(end: int) -> int | None:
            m = re.compile(r"[^{};]*?\{").match(plain, end)
            return m.end() - 1 if m else None

        def declare(kind: str, name: str, at: int, brace: int | None, end: int) -> str:
            outer, _ = owner(at)
            full = f"{outer}.{name}" if outer else name
            last = close.get(brace, end) if brace is not None else end
            out.append((path, kind, name, outer, full, line(at), line(last), doc(at)))
            if brace is not None:
                owners[brace] = (full, kind)
            return full

        if language == "java":
            if m := _PACKAGE.search(plain):
                out.append((path, "package", m[1], None, m[1], line(m.start(1)), line(m.start(1)), None))
            for m in _IMPORT.finditer(plain):
                how = ("static " if m[1] else "") + ("all" if m[3] else "one")
                out.append((path, "import", m[2].rpartition(".")[2], how, m[2], line(m.start(2)), line(m.start(2)), None))
        for m in _TYPES[language].finditer(plain):
            kind = _TYPE_KIND[m[1]]
            brace = m.end() if plain[m.end() : m.end() + 1] == "{" else (body(m.end()) if language == "kt" and re.compile(r"\s*\{").match(plain, m.end()) else None)
            full = declare(kind, m[2], m.start(), brace, m.end())
            out += [(path, k, x.rpartition(".")[2], full, x, line(m.start()), line(m.start()), None) for k, x in _parents(language, kind, m[3])]
        found = []  # name, parameters, result, place, end of the head
        if language == "kt":
            found = [(m[1], m[2], m[3], m.start(), m.end()) for m in _FUN.finditer(plain)]
        elif language == "js":
            found = [(m[1], m[2], None, m.start(1), m.end() - 1) for m in (*_JS_FUNCTION.finditer(plain), *_JS_METHOD.finditer(plain))]
        else:
            for m in _METHOD.finditer(plain):
                result = [w for w in m[1].split() if w not in _MODIFIERS]
                found.append((m[2], m[3], " ".join(result), m.start(2), m.end() - 1))
        seen = set()
        for name, given, result, at, end in sorted(found, key=lambda x: x[3]):
            inside = around(at)
            direct = inside in owners and owners[inside][1] not in ("method", "constructor", "function")
            free = language in ("js", "kt") and re.search(r"(function\s*\*?|fun\b[^\n]*)\s*$", plain[max(0, at - 80) : at if language == "js" else at + 3]) is not None
            if name in keywords or at in seen or not (direct or free):
                continue
            seen.add(at)
            if language in ("java", "cs"):
                outer = owners[inside][0].rpartition(".")[2]
                if not result and name != outer:
                    continue
                kind = "constructor" if not result else "method"
            else:
                kind = "method" if direct else "function"
            brace = end if plain[end : end + 1] == "{" else body(end) if language == "kt" and re.compile(r"\s*\{").match(plain, end) else None
            stop = end if brace is not None else (plain.find("\n", end) if language == "kt" else plain.find(";", end))
            full = declare(kind, name, at, brace, end if stop < 0 else stop)
            typed = _parameters(language, given) if language != "js" else []
            if kind != "constructor" or language == "cs":
                out += [(path, "parameters", type_name(t).rpartition(".")[2], full, type_name(t), line(at), line(at), None) for _, t in typed]
            out += [(path, "local", n, full, type_name(t), line(at), line(at), None) for n, t in typed]
            if result and kind != "constructor":
                out.append((path, "return_type", type_name(result).rpartition(".")[2], full, type_name(result), line(at), line(at), None))
        callable_at = {a for a, (_, k) in owners.items() if k in ("method", "constructor", "function")}
        for m in _FIELD.finditer(plain):
            full, kind = owner(m.start(2))
            if full and m[2] not in keywords:
                out.append((path, "local" if kind in ("method", "constructor", "function") else "field", m[2], full, type_name(m[1]), line(m.start(2)), line(m.start(2)), None))
        declared = {x[3] for x in found}
        for m in _CALL.finditer(plain):
            around_call = next((a for a in braces_around(m.start(2)) if a in callable_at), None)
            before = plain[max(0, m.start() - 12) : m.start()]
            if around_call is None or m[2] in keywords or m.start(2) in declared and m.start(2) in seen or re.search(r"\bnew\s+[\w.]*$", before + (m[1] or "")):
                continue
            out.append((path, "call", m[2], owners[around_call][0], re.sub(r"\s", "", m[1]) if m[1] else None, line(m.start(2)), line(m.start(2)), None))
        return out

    return rows


for _extension, _language in (("java", "java"), ("cs", "cs"), ("js", "js"), ("kt", "kt"), ("kts", "kt")):
    register_analyzer(_extension, brace_file(_language))
