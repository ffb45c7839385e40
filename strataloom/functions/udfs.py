"""The few functions that built-ins can't express, over Arrow batches: Unicode forms, canonical JSON, parsing of sources."""

from __future__ import annotations

import ast
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strataloom.functions.endpoints import endpoints


def _text(f):
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else f(v))

    return run


nfc = _text(lambda v: unicodedata.normalize("NFC", v))
fold_diacritics = _text(lambda v: unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", v) if not unicodedata.combining(c))))


def _canonical(v: str) -> str | None:
    try:
        return json.dumps(json.loads(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return None


canonical_json = _text(_canonical)


def python_facts(source: str) -> list[tuple[str, str, str, int, int]]:
    """(fact, name, qualified name, first line, last line): declarations, imports, bases and calls; none if it can't be parsed."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[tuple[str, str, str, int, int]] = []

    def dotted(node: ast.AST) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute) and (head := dotted(node.value)):
            return f"{head}.{node.attr}"
        return None

    def walk(node: ast.AST, scope: list[str], in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            at = (getattr(child, "lineno", 0), getattr(child, "end_lineno", 0) or 0)
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if in_class else "function"
                name = ".".join([*scope, child.name])
                out.append((kind, child.name, name, *at))
                for base in getattr(child, "bases", []):
                    if b := dotted(base):
                        out.append(("extends", b, name, *at))
                walk(child, [*scope, child.name], kind == "class")
                continue
            if isinstance(child, ast.Import):
                out.extend(("import", a.name, ".".join(scope), *at) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.append(("import", "." * child.level + (child.module or ""), ".".join(scope), *at))
            elif isinstance(child, ast.Call) and (called := dotted(child.func)):
                out.append(("call", called, ".".join(scope), *at))
            walk(child, scope, in_class)

    walk(tree, [], False)
    return out


def owned(found: list[tuple], facts: list[tuple]) -> list[tuple]:
    """Endpoints, those without an owner given to the innermost function around them."""
    around = sorted((last - first, first, last, qualified) for fact, _, qualified, first, last in facts if fact in ("function", "method"))
    inner = lambda line: next((q for _, a, b, q in around if a <= line <= b), None)
    return [(*e[:4], e[4] or inner(e[5]), e[5]) for e in found]


def extract(files: DataFrame, what: str) -> DataFrame:
    """Facts or endpoints of ``files(path, language, content)``, many files a batch; one row each."""
    if what == "facts":
        names, schema = ["fact", "name", "qualified", "first", "last"], "path string, fact string, name string, qualified string, first int, last int"
    else:
        names = ["protocol", "role", "operation", "resource", "owner", "line"]
        schema = "path string, protocol string, role string, operation string, resource string, owner string, line int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, language, content in zip(b["path"], b["language"], b["content"], strict=True):
                facts = python_facts(content or "") if language == "python" else []
                found = facts if what == "facts" else owned(endpoints(content or "", language), facts)
                rows += [(path, *r) for r in found]
            yield pd.DataFrame(rows, columns=["path", *names])

    return files.select("path", "language", "content").mapInPandas(run, schema)
