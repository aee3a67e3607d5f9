"""Directories named by an expression, such as ``${year}/${status}``, and a reader that inverts it.

Each part between slashes is text and placeholders. A placeholder is a column of the data or a
name with an expression of its own. Values are written as in a URL, so a slash in a value is no
directory and any two different values have different names; what would hide a directory or
mean another one (a leading dot or underscore, nothing at all, null) has a name of its own.
Spark writes each part as a column, and the finished directories are then renamed, which
moves no data.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .publish import exists, filesystem, publish

NULL, EMPTY = "%null", "%empty"  # no value is written so: % stands before two hex digits
_PLACEHOLDER = re.compile(r"\$\{(\w+)\}")
# Values hold none of these, as they are written with a percent sign.
_BETWEEN = "=,@~!"
_SAFE_TEXT = re.compile(r"[A-Za-z0-9._=,@~!-]*")


def compiled(template: str) -> list[list[tuple[str, str | None]]]:
    """Per part of the path a list of (text, name of the placeholder after it or None)."""
    parts = []
    for part in template.strip("/").split("/"):
        pieces = _PLACEHOLDER.split(part)
        texts, names = pieces[::2], pieces[1::2]
        if not names and not part:
            raise ValueError(f"the expression {template!r} has an empty part")
        if any(not _SAFE_TEXT.fullmatch(text) for text in texts) or part.startswith((".", "_")):
            raise ValueError(f"part {part!r} may hold letters, digits and . _ = , @ ~ ! - and not begin with . or _")
        if any(not set(text) & set(_BETWEEN) for text in texts[1:-1]):
            raise ValueError(f"placeholders of part {part!r} need one of {_BETWEEN} between them")
        parts.append(list(zip(texts, [*names, None])))
    names = [name for part in parts for _, name in part if name]
    if not names or len(set(names)) != len(names):
        raise ValueError(f"the expression {template!r} needs placeholders, each once")
    return parts


def placeholders(template: str) -> list[str]:
    return [name for part in compiled(template) for _, name in part if name]


def escaped(value: Column) -> Column:
    """The value as a part of a path."""
    # What url_encode leaves and a path or a pattern for paths does not: spaces, stars, leading dots.
    text = F.regexp_replace(F.url_encode(value.cast("string")), r"\+", "%20")
    text = F.regexp_replace(F.regexp_replace(text, r"\*", "%2A"), r"^\.", "%2E")
    text = F.regexp_replace(text, "^_", "%5F")
    return F.when(value.isNull(), NULL).when(text == "", EMPTY).otherwise(text)


def unescaped(text: Column) -> Column:
    return F.when(text == EMPTY, "").when(text != NULL, F.url_decode(text))


def write_directories(
    df: DataFrame, path: str, template: str, write: Callable[[DataFrame, str, Sequence[str]], None],
    *, expressions: Mapping[str, str] | None = None, keep_columns: bool = False, tmp_path: str | None = None,
) -> None:
    """Write ``df`` to ``path/<template>/`` with ``write(df, folder, partition columns)``.

    ``path`` is replaced as a whole once all directories are complete. Columns that are
    placeholders are left out of the files unless ``keep_columns``.
    """
    expressions = expressions or {}
    parts = compiled(template)
    spark = df.sparkSession
    columns = [f"part_{i}_{uuid.uuid4().hex[:8]}" for i in range(len(parts))]
    own = [n for n in placeholders(template) if n not in expressions]
    if missing := [n for n in own if n not in df.columns]:
        raise ValueError(f"no column or expression for {', '.join(missing)}")

    def part(pieces: Sequence[tuple[str, str | None]]) -> Column:
        values = []
        for text, name in pieces:
            values.append(F.lit(text))
            if name:
                values.append(escaped(F.expr(expressions[name]) if name in expressions else F.col(f"`{name}`")))
        return F.concat(*values)

    named = df.withColumns(dict(zip(columns, map(part, parts))))
    if not keep_columns:
        named = named.drop(*own)
    staging = tmp_path or path.rstrip("/").rsplit("/", 1)[0]
    flat = f"{staging.rstrip('/')}/.written-{uuid.uuid4().hex[:12]}"
    target = f"{staging.rstrip('/')}/.staged-{uuid.uuid4().hex[:12]}"
    try:
        write(named, flat, columns)
        _move(spark, flat, target, len(parts))
        publish(spark, target, path)
    finally:
        for folder in (flat, target):
            fs, place = filesystem(spark, folder)
            fs.delete(place, True)


def _move(spark: SparkSession, flat: str, target: str, depth: int) -> None:
    """Rename ``a=x/b=y`` to ``x/y`` for every directory of that depth."""
    fs, base = filesystem(spark, flat)
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    new_path = spark._jvm.org.apache.hadoop.fs.Path

    def directories(folder: Any, left: int, names: list[str]) -> None:
        if not left:
            place = new_path(f"{target}/{'/'.join(names)}")
            fs.mkdirs(place.getParent())
            if not fs.rename(folder, place):
                raise OSError(f"could not move {folder} to {place}")
            return
        for status in fs.listStatus(folder):
            if status.isDirectory():
                value = unescape(status.getPath().getName().split("=", 1)[1])
                directories(status.getPath(), left - 1, [*names, value])

    fs.mkdirs(new_path(target))
    directories(base, depth, [])
    _, mark = filesystem(spark, f"{target}/_SUCCESS")
    fs.create(mark, True).close()


def read_directories(
    spark: SparkSession, path: str, template: str, schema: str | T.StructType, fmt: str = "parquet",
    *, types: Mapping[str, str] | None = None, only: Mapping[str, Any] | None = None, **options: str,
) -> DataFrame:
    """The rows below ``path`` with the template's placeholders as columns.

    ``schema`` is that of the files, ``types`` those of placeholders that are no texts. ``only``
    opens just the directories with the given values (None for null).
    """
    parts, types = compiled(template), dict(types or {})
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    only = dict(only or {})
    if unknown := [name for name in only if name not in placeholders(template)]:
        raise ValueError(f"the expression {template!r} has no {', '.join(unknown)}")
    names = [name for name in placeholders(template) if name not in schema.names]
    # One row with the wanted names, as the writer would make them.
    values = {name: spark.range(1).select(escaped(F.lit(value))).first()[0] for name, value in only.items()}
    globs, patterns = [], []
    for pieces in parts:
        globs.append("".join(text + (values.get(name, "*") if name else "") for text, name in pieces))
        patterns.append("".join(re.escape(text) + ("([^/]*)" if name else "") for text, name in pieces))
    folder = "/".join(globs)
    rows = spark.read.format(fmt).schema(schema).options(**options).option("recursiveFileLookup", "true")
    fs, pattern = filesystem(spark, f"{path.rstrip('/')}/{folder}")
    found = fs.globStatus(pattern)
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if not found:
        empty = T.StructType([*schema.fields, *[T.StructField(n, T.StringType()) for n in names]])
        loaded = spark.createDataFrame([], empty)
        return loaded.withColumns({n: F.col(n).cast(types[n]) for n in names if n in types})
    loaded = rows.load(f"{path.rstrip('/')}/{folder}")
    # The path is given as a URI, in which a percent sign is written %25.
    where = F.regexp_replace(F.col("_metadata.file_path"), "%25", "%")
    pattern = "/" + "/".join(patterns) + "/[^/]*$"
    every = placeholders(template)
    columns = {
        name: unescaped(F.regexp_extract(where, pattern, every.index(name) + 1)).cast(types.get(name, "string"))
        for name in names
    }
    return loaded.select(*[f"`{c}`" for c in schema.names], *[v.alias(n) for n, v in columns.items()])

