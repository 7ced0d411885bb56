"""A declaration scanner for languages with braces.

Comments and strings are blanked first, keeping every position. Declarations are found by
pattern, their bodies by matching braces, their owners by nesting. Bodies of functions are
searched for calls. This covers the usual forms of each language, not its whole grammar:
macros, templates with braces in arguments and conditional compilation are beyond it.
"""

from __future__ import annotations

import re

from graphloom.extract.common import concept, imported, module, module_path, one_line, slugify, utf16

_ID = r"[A-Za-z_$][\w$]*"
_MODS = r"(?P<mods>(?:(?:{})\s+)*)"
_JAVA = _MODS.format("public|private|protected|static|final|abstract|sealed|synchronized|native|default|async|override|virtual|readonly|partial|internal|extern|unsafe|new|strictfp|required")
_KT = _MODS.format("public|private|protected|internal|open|abstract|sealed|data|inner|override|suspend|inline|operator|enum|annotation|companion|tailrec|infix|final|lateinit|value|fun")
_SWIFT = _MODS.format(r"public|open|private|fileprivate|internal|final|static|class|override|mutating|convenience|required|@\w+|indirect|async")
_RUST = r"(?P<mods>(?:pub(?:\s*\([^)]*\))?\s+)?)(?:(?:async|const|unsafe|default|extern(?:\s+\"[^\"]*\")?)\s+)*"
_PHP = _MODS.format("public|private|protected|static|final|abstract|readonly")

#: (kind, pattern) with groups mods, name and perhaps receiver; a type owns what it nests
_DECLS: dict[str, list[tuple[str, str]]] = {
    "Rust": [("Struct", _RUST + rf"struct\s+(?P<name>{_ID})"), ("Enum", _RUST + rf"enum\s+(?P<name>{_ID})"), ("Trait", _RUST + rf"trait\s+(?P<name>{_ID})"), ("Impl", r"(?P<mods>)(?:unsafe\s+)?impl\b(?P<name>[^{;]*)"), ("Function", _RUST + rf"fn\s+(?P<name>{_ID})")],
    "TypeScript": [("Class", rf"(?P<mods>(?:(?:export|default|abstract|declare)\s+)*)class\s+(?P<name>{_ID})"), ("Interface", rf"(?P<mods>(?:export\s+)?)interface\s+(?P<name>{_ID})"), ("Function", rf"(?P<mods>(?:(?:export|default|async)\s+)*)function\s*\*?\s*(?P<name>{_ID})"), ("Function", rf"(?P<mods>(?:export\s+)?)(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:\([^()]*\)|{_ID})\s*(?::[^=;{{]+)?=>"), ("Member", rf"(?P<mods>(?:(?:public|private|protected|static|async|get|set|override|readonly)\s+)*)(?P<name>#?{_ID})\s*(?:<[^>()]*>)?\([^;{{}}]*\)\s*(?::[^;{{}}]+)?(?={{)")],
    "Go": [("Struct", rf"(?P<mods>)type\s+(?P<name>{_ID})(?:\[[^\]]*\])?\s+struct\b"), ("Interface", rf"(?P<mods>)type\s+(?P<name>{_ID})(?:\[[^\]]*\])?\s+interface\b"), ("Function", rf"(?P<mods>)func\s+(?:\(\s*(?:{_ID}\s+)?\*?\s*(?P<receiver>{_ID})[^)]*\)\s*)?(?P<name>{_ID})\s*(?:\[[^\]]*\])?\(")],
    "Java": [("Class", _JAVA + rf"(?:class|record)\s+(?P<name>{_ID})"), ("Interface", _JAVA + rf"@?interface\s+(?P<name>{_ID})"), ("Enum", _JAVA + rf"enum\s+(?P<name>{_ID})"), ("Member", _JAVA + rf"(?:<[^>]*>\s*)?(?:[\w.$]+(?:<[^;{{}}()]*>)?(?:\[\])*\s+)?(?P<name>{_ID})\s*\([^;{{}}]*\)\s*(?:throws\s+[\w.,\s]+)?(?=[{{;])")],
    "C#": [("Class", _JAVA + rf"(?:class|record)\s+(?P<name>{_ID})"), ("Struct", _JAVA + rf"struct\s+(?P<name>{_ID})"), ("Interface", _JAVA + rf"interface\s+(?P<name>{_ID})"), ("Enum", _JAVA + rf"enum\s+(?P<name>{_ID})"), ("Member", _JAVA + rf"(?:[\w.?]+(?:<[^;{{}}()]*>)?(?:\[\])*\??\s+)?(?P<name>{_ID})\s*(?:<[^>()]*>)?\([^;{{}}]*\)\s*(?::\s*(?:base|this)\s*\([^)]*\)\s*)?(?:where[^{{;]*)?(?=[{{;]|=>)")],
    "PHP": [("Class", _PHP + rf"class\s+(?P<name>{_ID})"), ("Interface", _PHP + rf"interface\s+(?P<name>{_ID})"), ("Trait", _PHP + rf"trait\s+(?P<name>{_ID})"), ("Function", _PHP + rf"function\s+&?\s*(?P<name>{_ID})\s*\(")],
    "Kotlin": [("Interface", _KT + rf"interface\s+(?P<name>{_ID})"), ("Enum", r"(?P<mods>(?:\w+\s+)*)" + rf"enum\s+class\s+(?P<name>{_ID})"), ("Class", _KT + rf"(?:class|object)\s+(?P<name>{_ID})"), ("Function", _KT.replace("|fun", "") + rf"fun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?(?P<name>{_ID})\s*\(")],
    "C++": [("Class", rf"(?P<mods>)\bclass\s+(?P<name>{_ID})(?=[^;(){{}}]*{{)"), ("Struct", rf"(?P<mods>)\bstruct\s+(?P<name>{_ID})(?=[^;(){{}}]*{{)"), ("Member", rf"(?P<mods>)(?:[\w:<>,*&~]+[\s*&]+)*(?:(?P<receiver>{_ID})::)?(?P<name>~?{_ID})\s*\([^;{{}}]*\)\s*(?:const|noexcept|override|final|\s)*(?::[^;{{}}]*)?(?={{)")],
    "Swift": [("Class", _SWIFT.replace("|class", "") + rf"(?:class|actor)\s+(?P<name>(?!func\b|var\b){_ID})"), ("Struct", _SWIFT + rf"struct\s+(?P<name>{_ID})"), ("Enum", _SWIFT + rf"enum\s+(?P<name>{_ID})"), ("Interface", _SWIFT + rf"protocol\s+(?P<name>{_ID})"), ("Extension", _SWIFT + r"extension\s+(?P<name>[\w.]+)"), ("Function", _SWIFT + rf"func\s+(?P<name>{_ID})")],
}
_DECLS["JavaScript"] = [d for d in _DECLS["TypeScript"] if d[0] != "Interface"]
_COMPILED = {lang: [(k, re.compile(r"(?<![\w$.])" + p, re.M)) for k, p in ps] for lang, ps in _DECLS.items()}
_IMPORTS = {
    "Rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)",
    "TypeScript": r"""(?:import|export)\s[^;'"]*?from\s*['"]([^'"]+)['"]|import\s*['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]""",
    "Go": r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\n]+)"\s*$',
    "Java": r"^\s*import\s+(?:static\s+)?([\w.*]+)",
    "C#": r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;",
    "PHP": r"^\s*use\s+([\w\\]+)",
    "Kotlin": r"^\s*import\s+([\w.*]+)",
    "C++": r'^\s*#\s*include\s*[<"]([^>"]+)[>"]',
    "Swift": r"^\s*(?:@\w+\s+)?import\s+([\w.]+)",
}
_IMPORTS["JavaScript"] = _IMPORTS["TypeScript"]
_NO_CALL = frozenset("if for while switch catch return sizeof match loop when guard foreach using lock fn func function fun super this typeof await throw do else defer assert def elif with synchronized".split())
_OWNERS = ("Class", "Struct", "Enum", "Interface", "Trait", "Impl", "Extension")
_BLANK = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])*'""", re.S)
_BLANK_HASH = re.compile(_BLANK.pattern + r"|\#(?!\[)[^\n]*", re.S)
_RUST_TICK = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|'(?:\\.[^']*|[^'\\\n])'""", re.S)


def blank(text: str, language: str) -> str:
    """The text with comments and strings as spaces, line ends kept."""
    pattern = _BLANK_HASH if language == "PHP" else _RUST_TICK if language == "Rust" else _BLANK
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _body(code: str, start: int) -> tuple[int, int] | None:
    """The braces after a declaration's head; None where it ends without a body."""
    depth = 0
    for m in re.compile(r"[{};()\[\]]").finditer(code, start):
        c = m[0]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth <= 0 and c == ";":
            return None
        elif depth <= 0 and c == "}":
            return None
        elif depth <= 0 and c == "{":
            level = 0
            for b in re.compile(r"[{}]").finditer(code, m.start()):
                level += 1 if b[0] == "{" else -1
                if level == 0:
                    return m.start(), b.end()
            return m.start(), len(code)
    return None


def _public(language: str, kind: str, mods: str, name: str, access: bool) -> bool:
    words = set(mods.split())
    if language == "Rust":
        return mods.strip().startswith("pub")
    if language == "Go":
        return name[:1].isupper()
    if language in ("Java", "C#"):
        return "public" in words
    if language == "PHP":
        return not words & {"private", "protected"}
    if language == "Kotlin":
        return not words & {"private", "protected", "internal"}
    if language == "Swift":
        return bool(words & {"public", "open"})
    if language == "C++":
        return kind == "Struct" or kind == "Function" or (kind == "Method" and access)
    return not name.startswith(("_", "#"))


def _access(code: str, start: int, at: int, struct: bool) -> bool:
    """Whether a place in a C++ type is in a public section."""
    last = None
    for m in re.compile(r"\b(public|private|protected)\s*:").finditer(code, start, at):
        last = m[1]
    return struct if last is None else last == "public"


def _impl(head: str) -> tuple[str, str | None]:
    """Type and trait of an impl block's head."""
    flat = re.sub(r"^\s*<[^>]*>", "", head)
    parts = re.split(r"\bfor\b", re.split(r"\bwhere\b", flat)[0])
    name = lambda x: (re.findall(r"[A-Za-z_]\w*", re.sub(r"<.*", "", x)) or ["_"])[-1]
    return (name(parts[1]), slugify(parts[0])) if len(parts) > 1 else (name(parts[0]), None)


def extract(path: str, language: str, text: str) -> tuple[list[dict], list[dict], list[dict]]:
    top = module(path, language, text)
    concepts, calls, imports = [top], [], []
    if language not in _COMPILED:
        return concepts, calls, imports
    code = blank(text, language)
    base = module_path(path)
    line_of = lambda at: text.count("\n", 0, at) + 1

    found: list[tuple[int, int, int, int, str, re.Match]] = []  # start, head end, body start, body end, kind
    taken: set[int] = set()
    for kind, pattern in _COMPILED[language]:
        for m in pattern.finditer(code):
            if m.start("name") in taken or m["name"].strip() in _NO_CALL:
                continue
            if kind == "Member" and code[: m.start()].rstrip().endswith(("new", "return", "=", "throw")):
                continue
            body = _body(code, m.start("name") + len(m["name"]))
            if body is None and (language == "C++" or kind in ("Impl", "Extension")):
                continue
            taken.add(m.start("name"))
            stop = body[1] if body else min(x for x in (code.find(";", m.end() - 1), code.find("\n", m.end() - 1), len(code)) if x >= 0)
            found.append((m.start(), body[0] if body else stop, body[0] if body else stop, stop, kind, m))
    found.sort(key=lambda f: (f[0], -f[3]))

    spans: list[tuple[int, int, str]] = []
    declared: set[int] = set()
    for start, head, inside, stop, kind, m in found:
        around = [f for f in found if f[2] < m.start("name") and m.start("name") < f[3] and f[4] in _OWNERS]
        nested = any(f[2] < m.start("name") < f[3] for f in found if f[4] in ("Function", "Member"))
        owner = around[-1] if around else None
        name = m["name"].strip()
        receiver = m.groupdict().get("receiver")
        if kind == "Member":
            if owner is None and receiver is None and language != "C++":
                continue
            if nested and language != "C++":
                continue
            kind = "Method" if owner or receiver else "Function"
        elif kind == "Function" and (owner or receiver) and not nested:
            kind = "Method"
        if kind in ("Impl", "Extension"):
            continue
        scope = []
        for f in around:
            if f[4] == "Impl":
                target, trait = _impl(f[5]["name"])
                scope += [target] + ([trait] if trait else [])
            else:
                scope.append(f[5]["name"].strip())
        if receiver:
            scope.append(receiver)
        inner = owner is not None and language == "C++"
        public = _public(language, kind, m["mods"] or "", name, inner and _access(code, owner[2], m.start("name"), owner[4] == "Struct"))
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        made = concept(path, language, kind, "/".join([base, *scope, name]), name, line_of(begin), line_of(max(begin, stop - 1)), one_line(text[begin:head]), public)
        concepts.append(made)
        declared.add(m.start("name"))
        if kind in ("Function", "Method"):
            spans.append((inside, stop, made["id"]))

    for m in re.finditer(rf"({_ID})\s*(?:::<[^>]*>)?\(", code):
        name = m[1]
        around = [s for s in spans if s[0] < m.start() < s[1]]
        if not around or name in _NO_CALL or m.start() in declared:
            continue
        owner = min(around, key=lambda s: s[1] - s[0])[2]
        line_start = code.rfind("\n", 0, m.start()) + 1
        calls.append({"caller_id": owner, "callee_name": name, "language": language, "file": path, "line": line_of(m.start()) - 1, "character": utf16(text[line_start : m.start()])})
    for m in re.finditer(_IMPORTS.get(language, r"(?!)"), text, re.M):
        imports.append(imported(top["id"], next(g for g in m.groups() if g)))
    return concepts, calls, imports
