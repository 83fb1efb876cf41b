"""Scalar functions on columns: paths, lines, identifiers, chunk texts and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalize_rel_path(path: str | Column) -> Column:
    """Forward slashes, none at either end; an empty path is a dot."""
    bare = F.regexp_replace(F.regexp_replace(_text(path), r"\\", "/"), "^/+|/+$", "")
    return F.when(bare == "", ".").otherwise(bare)


def module_name(path: str | Column) -> Column:
    """The dotted module of a Python file; a package's own name for its __init__ file, empty at the root."""
    dotted = F.regexp_replace(F.regexp_replace(normalize_rel_path(path), r"\.py$", ""), "/", ".")
    return F.regexp_replace(dotted, r"(^|\.)__init__$", "")


def base_name(path: str | Column) -> Column:
    return F.element_at(F.split(_text(path), "/"), -1)


def dir_name(path: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_text(path), "[^/]*$", ""), "/$", "")


def unix_lines(text: str | Column) -> Column:
    return F.regexp_replace(_text(text), "\r\n?", "\n")


def line_count(text: str | Column) -> Column:
    """Lines of a text with any line ends; a last line end adds none."""
    t = unix_lines(text)
    return (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + F.when((F.length(t) > 0) & ~F.endswith(t, F.lit("\n")), 1).otherwise(0)).cast("long")


def line_slice(text: str | Column, start: str | Column, end: str | Column) -> Column:
    """Lines start to end, from 1 and both included, cut to those there are; the whole text without both bounds."""
    t, a, b = unix_lines(text), F.greatest(_text(start), F.lit(1)), _text(end)
    lines = F.split(t, "(?<=\n)")
    some = F.array_join(F.slice(lines, a, F.greatest(b - a + 1, F.lit(0))), "")
    return F.when(_text(start).isNull() | _text(end).isNull(), t).otherwise(some)


def id_part(identifier: str | Column, number: int) -> Column:
    """Part 0 (kind), 1 (path) or 2 (qualified name) of an identifier; null if it has fewer."""
    return F.get(F.split(_text(identifier), ":", 3), F.lit(number))


def file_of_id(identifier: str | Column) -> Column:
    """The file that an entity lies in; null for repositories, directories and references out of the code."""
    i = _text(identifier)
    return F.when(F.startswith(i, F.lit("file:")), F.substr(i, F.lit(6))).when(id_part(i, 0).isin("class", "func", "method"), id_part(i, 1))


def without_prefix(value: str | Column, prefix: str = "unresolved:") -> Column:
    v = _text(value)
    return F.when(F.startswith(v, F.lit(prefix)), F.substr(v, F.lit(len(prefix) + 1))).otherwise(v)


def blank_to_null(value: str | Column) -> Column:
    return F.nullif(_text(value), F.lit(""))


def qualified_name(given: str | Column, identifier: str | Column, name: str | Column) -> Column:
    """The name given, else the identifier's third part, else the plain name."""
    return F.coalesce(blank_to_null(given), id_part(identifier, 2), _text(name))


def signature(explicit: Column, kind: Column, name: Column, arguments: Column, bases: Column) -> Column:
    """The signature given, or one made of the parameters or bases; a file has its name."""
    listed = lambda x: F.array_join(F.coalesce(x, F.array().cast("array<string>")), ", ")
    made = (
        F.when(kind.isin("function", "method"), F.concat(name, F.lit("("), listed(arguments), F.lit(")")))
        .when((kind == "class") & (F.size(F.coalesce(bases, F.array().cast("array<string>"))) > 0), F.concat(F.lit("class "), name, F.lit("("), listed(bases), F.lit(")")))
        .when(kind == "class", F.concat(F.lit("class "), name))
        .when(kind == "file", name)
    )
    return F.coalesce(blank_to_null(explicit), made)


# The labels of a chunk's lines.
CHUNK_LABELS = ("Entity Type", "Name", "Qualified Name", "File", "Signature", "Docstring", "Source Code")


def chunk_text(kind: Column, name: Column, qualified: Column, path: Column, sign: Column, doc: Column, source: Column) -> Column:
    """What a chunk says of its entity, a line each; parts that are missing or empty are left out."""
    of_type, of_name, of_qualified, of_file, of_signature, of_doc, of_source = CHUNK_LABELS
    line = lambda label, value, link=" ": F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}:{link}"), value))
    return F.concat_ws(
        "\n", F.concat(F.lit(f"{of_type}: "), F.initcap(kind)), F.concat(F.lit(f"{of_name}: "), name), F.when(qualified != name, line(of_qualified, qualified)),
        F.concat(F.lit(f"{of_file}: "), path), line(of_signature, sign), line(of_doc, doc), line(of_source, source, "\n"),
    )


def contains_ignoring_case(value: str | Column, part: str) -> Column:
    return F.contains(F.lower(_text(value)), F.lower(F.lit(part)))


def node_label(synthetic: Column, kind: Column, name: Column, raw_call: Column, identifier: Column, longest: int = 18) -> Column:
    """A short label: placeholders with a question mark before their call, functions and methods with parentheses.

    What is longer than `longest` is cut; the question mark doesn't count. Without a name it is the identifier's last part.
    """
    short = lambda c: F.when(F.length(c) > longest, F.concat(F.substr(c, F.lit(1), F.lit(longest - 3)), F.lit("..."))).otherwise(c)
    plain = F.coalesce(blank_to_null(name), F.element_at(F.split(identifier, ":"), -1))
    called = F.when(kind.isin("Function", "Method") & ~F.contains(plain, F.lit("(")), F.concat(plain, F.lit("()"))).otherwise(plain)
    placeholder = F.coalesce(synthetic, F.lit(False)) | F.coalesce(kind == "UnresolvedReference", F.lit(False))
    return F.when(placeholder, F.concat(F.lit("? "), short(F.coalesce(blank_to_null(raw_call), plain)))).otherwise(short(called))


def dot(a: str | Column, b: str | Column) -> Column:
    """The inner product of two arrays, in double precision."""
    pairs = F.zip_with(_text(a), _text(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: str | Column) -> Column:
    """The vector with length one; a zero vector stays."""
    return F.transform(_text(v), lambda x: x.cast("double") / F.when(norm(v) == 0, 1.0).otherwise(norm(v)))


def cosine(a: str | Column, b: str | Column) -> Column:
    """The inner product of the unit vectors; 0 with a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)
