"""Imports of a Python source by its syntax tree."""

from __future__ import annotations

import ast
import importlib.util

DYNAMIC = ("import_module", "__import__")  # names of calls that import by a value


def imports(source: bytes, package: str) -> tuple[list[str], bool]:
    """Dotted names that the source imports, and whether some call imports dynamically. A source that doesn't parse has neither.

    Of ``from a import b`` the name is ``a``; relative ones are resolved against ``package`` and dropped where that can't be.
    """
    try:
        tree = ast.parse(source.decode("utf-8", errors="replace"))
    except (SyntaxError, ValueError, RecursionError):
        return [], False
    names: dict[str, None] = {}
    dynamic = False
    for node in ast.walk(tree):
        match node:
            case ast.Import(names=aliases):
                names.update((a.name, None) for a in aliases)
            case ast.ImportFrom(level=level, module=module) if level:
                try:
                    names[importlib.util.resolve_name("." * level + (module or ""), package)] = None
                except (ImportError, ValueError):
                    continue
            case ast.ImportFrom(module=str(module)):
                names[module] = None
            case ast.Call(func=ast.Name(id=name)) | ast.Call(func=ast.Attribute(attr=name)):
                dynamic |= name in DYNAMIC
    return list(names), dynamic


def aliases(source: bytes, package: str) -> list[str]:
    """Names as ``a.b`` for each ``from a import b``: submodules that ``imports`` leaves out."""
    try:
        tree = ast.parse(source.decode("utf-8", errors="replace"))
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: dict[str, None] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.ImportFrom):
            try:
                base = importlib.util.resolve_name("." * node.level + (node.module or ""), package) if node.level else node.module
            except (ImportError, ValueError):
                continue
            out.update((f"{base}.{a.name}", None) for a in node.names if a.name != "*")
    return list(out)
