"""Names, positions and rows shared by all extractors."""

from __future__ import annotations

import re

from graphloom.schema import KIND_DIRS

_FOLDED = ("mod", "lib", "main", "__init__", "index")


def module_path(path: str) -> str:
    """The file without extension; module files stand for their folder."""
    parts = path.rsplit(".", 1)[0].split("/")
    if parts[-1] in _FOLDED and len(parts) > 1:
        parts.pop()
    return "/".join(parts)


def slugify(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")


def utf16(text: str) -> int:
    """Length in UTF-16 units, as editors count."""
    return len(text.encode("utf-16-le")) // 2


def one_line(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def concept(path: str, language: str, kind: str, qualified: str, name: str, start: int, end: int, signature: str | None, public: bool) -> dict:
    return {
        "id": f"{KIND_DIRS[kind]}/{qualified.replace('::', '/').replace('.', '/')}",
        "kind": kind,
        "language": language,
        "name": name,
        "qualified_name": qualified.replace("/", "::"),
        "file": path,
        "start_line": start,
        "end_line": end,
        "signature": signature,
        "is_public": public,
    }


def module(path: str, language: str, text: str) -> dict:
    base = module_path(path)
    return concept(path, language, "Module", base, base.rsplit("/", 1)[-1], 1, max(1, text.count("\n") + (not text.endswith("\n"))), None, True)


def imported(src: str, name: str) -> dict:
    return {"src": src, "target": f"external/{slugify(name)}"}
