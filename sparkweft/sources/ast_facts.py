"""Facts of Python files: imports, classes, functions and calls, one row each."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = (
    "path string, kind string, ord long, name string, qualified_name string, parent string, owner string, is_method boolean, is_async boolean, parameters array<string>, return_type string,"
    " docstring string, decorators array<string>, bases array<struct<name:string,line:int,col:int>>, module string, symbol string, alias string, is_wildcard boolean,"
    " start_line int, end_line int, start_column int, end_column int"
)
_ARROW = pa.schema([
    ("path", pa.string()), ("kind", pa.string()), ("ord", pa.int64()), ("name", pa.string()), ("qualified_name", pa.string()), ("parent", pa.string()), ("owner", pa.string()), ("is_method", pa.bool_()), ("is_async", pa.bool_()),
    ("parameters", pa.list_(pa.string())), ("return_type", pa.string()), ("docstring", pa.string()), ("decorators", pa.list_(pa.string())), ("bases", pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32()), ("col", pa.int32())]))),
    ("module", pa.string()), ("symbol", pa.string()), ("alias", pa.string()), ("is_wildcard", pa.bool_()),
    ("start_line", pa.int32()), ("end_line", pa.int32()), ("start_column", pa.int32()), ("end_column", pa.int32()),
])


@dataclass(frozen=True)
class Scope:
    """Where a piece of code stands: the names around it, the class it is in the body of, the function that runs it."""

    names: tuple[str, ...] = ()
    in_class: bool = False
    function: str | None = None  # the identifier's beginning and qualified name
    kind: str = "file"


def _span(node: ast.AST) -> dict:
    return {"start_line": node.lineno, "end_line": node.end_lineno, "start_column": node.col_offset, "end_column": node.end_col_offset}


def _described(node) -> dict:
    return {"docstring": ast.get_docstring(node), "decorators": [ast.unparse(d) for d in node.decorator_list], **_span(node)}


def facts(path: str, source: bytes | str) -> list[dict]:
    """The file's facts in the order of its text; none of a file that doesn't parse.

    A function is a method where it stands in a class that no function is around. Calls belong to the
    innermost function, those in class bodies and elsewhere to the file. Parameters are the plain ones.
    """
    try:
        tree = ast.parse(source.decode("utf-8") if isinstance(source, bytes) else source, filename=path)
    except (SyntaxError, ValueError, RecursionError):
        return []
    rows: list[dict] = []
    todo: list[tuple[ast.AST, Scope]] = [(tree, Scope())]
    while todo:
        node, scope = todo.pop()
        inner = scope
        if isinstance(node, ast.Import):
            rows += [{"kind": "import", "module": a.name, "alias": a.asname, "is_wildcard": False, **_span(node)} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            rows += [{"kind": "import", "module": module, "symbol": None if a.name == "*" else a.name, "alias": a.asname, "is_wildcard": a.name == "*", **_span(node)} for a in node.names]
        elif isinstance(node, ast.ClassDef):
            inner = Scope((*scope.names, node.name), True, scope.function, "class")
            bases = [{"name": ast.unparse(b), "line": b.lineno, "col": b.col_offset} for b in node.bases]
            rows.append({"kind": "class", "name": node.name, "qualified_name": ".".join(inner.names), "bases": bases, **_described(node)})
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            method = bool(scope.names) and scope.function is None
            qualified = ".".join((*scope.names, node.name))
            inner = Scope((*scope.names, node.name), False, f"{'method' if method else 'func'}:{path}:{qualified}", "function")
            returns = None if node.returns is None else ast.unparse(node.returns)
            rows.append({"kind": "function", "name": node.name, "qualified_name": qualified, "parent": ".".join(scope.names) or None, "is_method": method, "is_async": isinstance(node, ast.AsyncFunctionDef), "parameters": [a.arg for a in node.args.args], "return_type": returns, **_described(node)})
        elif isinstance(node, ast.Call):
            rows.append({"kind": "call", "name": ast.unparse(node.func), "owner": scope.function or f"file:{path}", **_span(node)})
        todo += [(child, inner) for child in reversed(list(ast.iter_child_nodes(node)))]
    for i, row in enumerate(rows):
        row["path"], row["ord"] = path, i
    return rows


def parse_files(files: DataFrame) -> DataFrame:
    """facts of files (path, content), file by file on the executors."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = facts(path, content or b"")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return files.select("path", "content").mapInArrow(run, SCHEMA)
