"""Delimited text and Parquet, with column roles."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eigenframe.functions.parsing import NA_TOKENS, strict_number, to_number
from eigenframe.operators.profile import infer_roles
from eigenframe.roles import Roles


@dataclass(frozen=True)
class Dialect:
    sep: str = ","
    decimal: str = "."
    header: bool = True


# The two regional presets.
EUROPEAN = Dialect(";", ",")
TABBED = Dialect("\t", ".")


def detect_dialect(spark: SparkSession, path: str) -> Dialect:
    """Separator by count in the first five lines, decimal comma with ``;``, header if row 1 has fewer numbers."""
    lines = [r["value"] for r in spark.read.text(path).limit(5).collect()]
    if len(lines) < 2:
        raise ValueError("at least two lines are needed to tell a dialect")
    text = "\n".join(lines)
    n = {s: text.count(s) for s in (",", ";", "\t")}
    if n[";"] > n[","] and n[";"] > n["\t"]:
        out = Dialect(";", "," if n[","] else ".")
    else:
        out = Dialect("\t" if n["\t"] > n[","] and n["\t"] > n[";"] else ",")
    numbers = [sum(_parses(c, out.decimal) for c in line.split(out.sep)) for line in lines[:2]]
    return replace(out, header=numbers[0] < numbers[1])


def _parses(cell: str, decimal: str) -> bool:
    try:
        float(cell.strip().replace(decimal, "."))
    except ValueError:
        return False
    return True


def read_text(
    spark: SparkSession, path: str, dialect: Dialect = Dialect(), header_row: int = 0, ragged: str = "FAILFAST"
) -> DataFrame:
    """Every cell as text. A row whose width differs from the header fails the read.

    ``header_row`` > 0 skips the lines above the header (one file only).
    """
    options = {"sep": dialect.sep, "mode": ragged, "columnPruning": "false", "ignoreLeadingWhiteSpace": "true"}
    first = [r["value"] for r in spark.read.text(path).limit(header_row + 1).collect()]
    if len(first) <= header_row:
        raise ValueError(f"no line {header_row} to take the header from")
    cells = next(csv.reader([first[header_row]], delimiter=dialect.sep, skipinitialspace=True))
    names = _unique([c.strip() for c in cells]) if dialect.header else [f"V{i + 1}" for i in range(len(cells))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if header_row == 0:
        return spark.read.schema(schema).options(**options, header=str(dialect.header).lower()).csv(path)
    raw = spark.read.text(path)
    if len(raw.inputFiles()) != 1:
        raise ValueError("a header below the first line is looked for in one file only")
    body = raw.withColumn("_line", F.monotonically_increasing_id()).filter(
        F.col("_line") > header_row if dialect.header else F.col("_line") >= header_row
    )
    ddl = ", ".join(f"`{n}` string" for n in names)
    return body.filter(F.trim("value") != "").select(F.from_csv("value", ddl, options).alias("r")).select("r.*")


def _unique(names: list[str]) -> list[str]:
    out: list[str] = []
    for i, n in enumerate(names):
        base = n or f"V{i + 1}"
        new, k = base, 2
        while new in out:
            new, k = f"{base}_{k}", k + 1
        out.append(new)
    return out


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    dialect: Dialect = Dialect(),
    mode: str = "mixed",
    id_col: str | None = None,
    na: Sequence[str] = NA_TOKENS,
    targets: Sequence[str] = (),
    header_row: int = 0,
    columns: Sequence[str] | None = None,
    limit: int | None = None,
) -> tuple[DataFrame, Roles]:
    """A table and the roles of its columns.

    ``mode``: ``numeric`` (every cell a number or missing, else the job fails),
    ``mixed`` (features and targets numeric, the rest text) or ``text``.
    """
    if fmt == "parquet":
        return read_parquet(spark, path, id_col, targets, columns)
    df = read_text(spark, path, dialect, header_row)
    if columns is not None:
        df = df.select(*[f"`{c}`" for c in dict.fromkeys([*([id_col] if id_col else []), *columns])])
    if limit is not None:
        df = df.limit(limit)
    cols = [c for c in df.columns if c != id_col]
    if mode == "text":
        return df, Roles((), tuple(cols), (), id_col, None, tuple(df.columns))
    if mode == "numeric":
        roles = Roles(tuple(cols), (), (), id_col, None, tuple(df.columns))
        return df.withColumns({c: strict_number(F.col(f"`{c}`"), c, dialect.decimal, na) for c in cols}), roles
    roles = infer_roles(df, id_col, targets, dialect.decimal)
    numeric = [*roles.features, *roles.targets]
    return df.withColumns({c: to_number(F.col(f"`{c}`"), dialect.decimal, na) for c in numeric}), roles


def read_parquet(
    spark: SparkSession,
    path: str,
    id_col: str | None = None,
    targets: Sequence[str] = (),
    columns: Sequence[str] | None = None,
) -> tuple[DataFrame, Roles]:
    """Typed columns keep their types; bytes become text; numbers are features, the rest categories."""
    df = spark.read.parquet(path)
    if columns is not None:
        df = df.select(*dict.fromkeys([*([id_col] if id_col else []), *columns]))
    binary = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BinaryType)]
    if binary:
        df = df.withColumns({c: F.decode(F.col(c), "UTF-8") for c in binary})
    return df, Roles.from_schema(df.schema, id_col, targets)


def as_text(c: Column, kind: T.DataType, decimal: str = ".", precision: int | None = None) -> Column:
    """A cell as it is written: ``Inf``, ``-Inf``, ``NaN``, fixed precision, decimal comma."""
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.cast("string")
    plain = F.format_string(f"%.{precision}f", c.cast("double")) if precision is not None else c.cast("string")
    if decimal != ".":
        plain = F.replace(plain, F.lit("."), F.lit(decimal))
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(c), "NaN")
        .when(c == float("inf"), "Inf")
        .when(c == float("-inf"), "-Inf")
        .otherwise(plain)
    )


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    dialect: Dialect = Dialect(),
    precision: int | None = None,
    null: str = NA_TOKENS[0],
    mode: str = "errorifexists",
) -> None:
    """Delimited text (a folder of part files) or Parquet."""
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
        return
    cells = df.select(
        *[as_text(F.col(f"`{f.name}`"), f.dataType, dialect.decimal, precision).alias(f.name) for f in df.schema.fields]
    )
    cells.write.mode(mode).options(sep=dialect.sep, header=str(dialect.header).lower(), nullValue=null, emptyValue="").csv(path)
