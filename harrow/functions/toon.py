"""A line-oriented text form of nested records, written and read by Column expressions that follow a schema.

One entry a line, keys joined by dots; scalar lists behind their count, joined by bars; lists of flat records as a table that names its columns
once; other lists as one path for each index. Null fields are left out, and read as null. In a table, a null cell is empty; an empty cell is read
as the empty string, or null where the column isn't text; in a table of one column they are written as null and "". Lines that fit nothing, rows of the wrong width and values of the wrong type are
skipped or null: no text is an error. Numbers have Spark's form. Texts may be fenced by three backquotes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions.values import let

#: The first line, and what is quoted lest it be read as something else.
BANNER = "#toon/v2"
RESERVED = "^(?:true|false|null|[+-]?[0-9]+(?:_[0-9]+)*|[+-]?(?:[0-9_]+\\.[0-9_]*|\\.[0-9_]+)(?:[eE][+-]?[0-9]+)?)$"


def _flat(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and not any(isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) for f in kind.fields)


def _quoted(x: Column) -> Column:
    for part, by in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        x = F.replace(x, F.lit(part), F.lit(by))
    return F.concat(F.lit('"'), x, F.lit('"'))


def _scalar(x: Column, kind: T.DataType, apart: str) -> Column:
    """A value as text; strings are quoted if they hold what ends a value, blanks around them, or look like another type."""
    if not isinstance(kind, T.StringType):
        return F.coalesce(x.cast("string"), F.lit(""))
    odd = x.rlike(f'[{apart}\\n\\\\"]') | x.rlike("^\\s|\\s\\z") | x.rlike(RESERVED)
    return F.when(x.isNull(), "").when(odd | (F.lit(apart == "|") & (x == "")), _quoted(x)).otherwise(x)


def _lines(path: Column, x: Column, kind: T.DataType) -> Column:
    none = F.array().cast("array<string>")
    key = lambda *parts: F.concat(path, *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    if isinstance(kind, T.StructType):
        fields = [_lines(F.when(path == "", F.lit(f.name)).otherwise(key("." + f.name)), x[f.name], f.dataType) for f in kind.fields]
        return F.when(x.isNull(), none).otherwise(F.flatten(F.array(*fields)))
    if not isinstance(kind, T.ArrayType):
        return F.when(x.isNull(), none).otherwise(F.array(key(": ", _scalar(x, kind, "|"))))
    item = kind.elementType
    if _flat(item):
        alone = len(item.fields) == 1  # a row mustn't be an empty line
        cell = lambda c, kind: F.when(c.isNull(), "null").when(c.cast("string") == "", '""').otherwise(_scalar(c, kind, ",")) if alone else _scalar(c, kind, ",")
        cells = F.transform(x, lambda r: F.concat(F.lit("  "), F.concat_ws(",", *[cell(r[f.name], f.dataType) for f in item.fields])))
        full = F.concat(F.array(key("[", F.size(x), "]{" + ",".join(f.name for f in item.fields) + "}:")), cells)
    elif isinstance(item, (T.StructType, T.ArrayType)):
        full = F.flatten(F.transform(x, lambda e, i: _lines(key(".", i), e, item)))
    else:
        full = F.array(key("[", F.size(x), "]: ", F.array_join(F.transform(x, lambda e: _scalar(e, item, "|")), "|")))
    return F.when(x.isNull(), none).when(F.size(x) == 0, F.array(key("[0]:"))).otherwise(full)


def encode(record: Column, schema: T.StructType) -> Column:
    """The text of a record (a struct of the schema)."""
    return F.array_join(F.concat(F.array(F.lit(BANNER)), _lines(F.lit(""), record, schema)), "\n")


def _value(raw: Column, kind: T.DataType) -> Column:
    """A value of the schema's type; null if it isn't one. The value is looked for once, however often it is asked about."""
    return let(raw, lambda x: _typed(x, kind))


def _typed(raw: Column, kind: T.DataType) -> Column:
    whole = raw.rlike('(?s)^".*"\\z') & (F.length(raw) >= 2)
    inner = F.substring(raw, F.lit(2), F.length(raw) - 2)
    for part, by in (("\\\\", "\u0000"), ("\\n", "\n"), ('\\"', '"'), ("\u0000", "\\")):
        inner = F.replace(inner, F.lit(part), F.lit(by))
    if isinstance(kind, T.StringType):
        return F.when(whole, inner).when(raw == "null", None).otherwise(raw)
    return F.when(~whole, raw.try_cast(kind))


def _cells(row: Column, apart: str) -> Column:
    """What lies between the marks outside quotes."""
    return F.regexp_extract_all(F.concat(row, F.lit(apart)), F.lit(f'((?:"(?:[^"\\\\]|\\\\.)*"|[^{apart}"])*)[{apart}]'), F.lit(1))


def _read(told: Column, path: Column, kind: T.DataType) -> Column:
    """The part of a text at a path. ``told`` holds its entries and tables."""
    if isinstance(kind, T.StructType):
        return F.struct(*[_read(told, F.when(path == "", F.lit(f.name)).otherwise(F.concat(path, F.lit("." + f.name))), f.dataType).alias(f.name) for f in kind.fields])
    last = lambda found: F.try_element_at(found, F.lit(-1))
    if not isinstance(kind, T.ArrayType):
        return _value(last(F.filter(told["entries"], lambda e: e["path"] == path))["value"], kind)
    item, empty = kind.elementType, F.array().cast(kind)
    none = F.exists(told["entries"], lambda e: e["path"] == F.concat(path, F.lit("[0]")))
    if _flat(item):
        table = last(F.filter(told["tables"], lambda t: t["key"] == path))
        cell = lambda c, at: F.trim(F.get(c, at))
        place = lambda names: F.struct(F.size(names).alias("n"), *[(F.array_position(names, F.lit(f.name)).cast("int") - 1).alias(f"at{k}") for k, f in enumerate(item.fields)])

        def made(table: Column) -> Column:
            lines = F.filter(F.split(table["block"], "\n"), lambda r: F.trim(r) != "")
            read = lambda at: F.transform(F.filter(F.transform(lines, lambda r: _cells(F.trim(r), ",")), lambda c: F.size(c) == at["n"]), lambda c: F.struct(*[_value(cell(c, at[f"at{k}"]), f.dataType).alias(f.name) for k, f in enumerate(item.fields)]))
            return F.when(table.isNotNull(), let(let(F.transform(F.split(table["columns"], ","), lambda c: F.trim(c)), place), read))

        return F.when(none, empty).otherwise(let(table, made))
    if isinstance(item, (T.StructType, T.ArrayType)):
        below = F.concat(path, F.lit("."))
        paths = F.concat(F.transform(told["entries"], lambda e: e["path"]), F.transform(told["tables"], lambda t: t["key"]))
        numbers = F.transform(F.filter(paths, lambda p: p.startswith(below)), lambda p: F.regexp_extract(F.substring(p, F.length(below) + 1, F.length(p)), "^[0-9]+", 0).try_cast("int"))
        most = F.array_max(numbers)
        return F.when(none, empty).when(most.isNotNull(), F.transform(F.sequence(F.lit(0), most), lambda i: _read(told, F.concat(below, i.cast("string")), item)))
    counted = last(F.filter(told["entries"], lambda e: F.regexp_extract(e["path"], "^(.*)\\[[0-9]+\\]$", 1) == path))
    made = lambda e: F.when(e.isNotNull(), F.transform(_cells(e["value"], "|"), lambda c: _value(F.trim(c), item)))
    return F.when(none, empty).otherwise(let(counted, made))


def decode(text: Column, schema: T.StructType) -> Column:
    """The record of a text, as a struct of the schema."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "\\A\\s*```(?:toon)?|```\\s*\\z", "")
    entry = lambda line: F.struct(F.trim(F.split_part(line, F.lit(":"), F.lit(1))).alias("path"), F.trim(F.substring(line, F.length(F.split_part(line, F.lit(":"), F.lit(1))) + 2, F.length(line))).alias("value"))
    table = "(?m)^([^\\s:\\[][^\\n:\\[]*)\\[[0-9]+\\]\\{([^}\\n]*)\\}:[ \\t]*(?:\\n|\\z)((?:[ \\t][^\\n]*(?:\\n|\\z))*)"
    part = lambda x, k: F.regexp_extract_all(x, F.lit(table), F.lit(k))

    def told(x: Column) -> Column:
        lines = F.filter(F.split(x, "\n"), lambda line: line.contains(":") & ~line.rlike("^\\s"))
        tables = F.arrays_zip(part(x, 1).alias("key"), part(x, 2).alias("columns"), part(x, 3).alias("block"))
        return F.struct(F.transform(lines, entry).alias("entries"), tables.alias("tables"))

    return F.get(F.transform(F.transform(F.array(bare), told), lambda t: _read(t, F.lit(""), schema)), F.lit(0))
