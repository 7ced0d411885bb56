"""Python through its own parser; a file with syntax errors gives its module only."""

from __future__ import annotations

import ast

from graphloom.extract.common import concept, imported, module, module_path, one_line, utf16


def extract(path: str, language: str, text: str) -> tuple[list[dict], list[dict], list[dict]]:
    concepts, calls, imports = [module(path, language, text)], [], []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return concepts, calls, imports
    lines = text.split("\n")
    base = module_path(path)

    def signature(node) -> str:
        first = node.body[0]
        end = (first.lineno, first.col_offset)
        part = lines[node.lineno - 1 : end[0]]
        if end[0] == node.lineno:
            part[-1] = lines[end[0] - 1].encode()[: end[1]].decode(errors="ignore")
        elif part:
            part = part[:-1]
        whole = one_line(" ".join(part))
        return whole[: whole.rfind(":")] if ":" in whole else whole

    def call_name(f) -> str | None:
        return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None

    def visit(node, scope: list[str], owner: str | None, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "Class" if isinstance(child, ast.ClassDef) else "Method" if in_class else "Function"
                start = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                made = concept(path, language, kind, "/".join([base, *scope, child.name]), child.name, start, child.end_lineno, signature(child), not child.name.startswith("_"))
                concepts.append(made)
                visit(child, [*scope, child.name], made["id"] if kind != "Class" else owner, kind == "Class")
                continue
            if isinstance(child, ast.Import):
                imports.extend(imported(concepts[0]["id"], a.name) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                imports.append(imported(concepts[0]["id"], "." * child.level + (child.module or "")))
            elif isinstance(child, ast.Call) and owner and (name := call_name(child.func)):
                f = child.func
                line = f.end_lineno - 1
                at = lines[line].encode()[: f.end_col_offset].decode(errors="ignore")
                calls.append({"caller_id": owner, "callee_name": name, "language": language, "file": path, "line": line, "character": utf16(at) - utf16(name)})
            visit(child, scope, owner, False)

    visit(tree, [], None, False)
    return concepts, calls, imports
