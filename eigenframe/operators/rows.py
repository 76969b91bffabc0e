"""Choosing, ordering and reshaping rows and columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eigenframe.functions.parsing import is_blank, to_number, trimmed
from eigenframe.plans.ranges import cuts_before, dense_index
from eigenframe.roles import Roles

WIDE_LIMIT = 1000  # columns a transposed table may get
ID_LIST = 10_000  # ids passed as a Python list


def filter_condition(df: DataFrame, col: str, op: str, value: str | float | None = None) -> Column:
    """True where the cell satisfies the comparison, false (or NULL for a missing number) elsewhere.

    A numeric column against a number keeps the plain comparison, so it reaches
    the scan. Text is compared as a number if both sides are numbers, else
    without regard to case; a blank cell satisfies ``is_empty`` only.
    """
    c, text = F.col(col), trimmed(F.col(col))
    if op == "is_empty":
        return is_blank(c)
    if op == "is_not_empty":
        return ~is_blank(c)
    wanted = str(value).strip()
    number = _as_number(wanted)
    if isinstance(df.schema[col].dataType, T.NumericType) and number is not None and "contains" not in op:
        plain = {
            "equals": c == number,
            "not_equals": c != number,
            ">": c > number,
            ">=": c >= number,
            "<": c < number,
            "<=": c <= number,
        }
        return _pick(plain, op)
    cell = to_number(c)
    if number is None:
        same, order = F.lower(text) == wanted.lower(), F.lit(False)
        compare = {">": order, ">=": order, "<": order, "<=": order}
    else:
        same = F.when(cell.isNotNull(), cell == number).otherwise(F.lower(text) == wanted.lower())
        compare = {">": cell > number, ">=": cell >= number, "<": cell < number, "<=": cell <= number}
    held = F.contains(F.lower(text), F.lit(wanted.lower()))
    table = {"equals": same, "not_equals": ~same, "contains": held, "not_contains": ~held, **compare}
    return F.coalesce(_pick(table, op) & ~is_blank(c), F.lit(False))


def _pick(table: dict[str, Column], op: str) -> Column:
    if op not in table:
        raise ValueError(f"unknown comparison {op!r}")
    return table[op]


def _as_number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def filter_rows(df: DataFrame, col: str, op: str, value=None, mode: str = "keep") -> DataFrame:
    cond = filter_condition(df, col, op, value)
    return df.filter(cond if mode == "keep" else ~F.coalesce(cond, F.lit(False)))


def filter_preview(df: DataFrame, col: str, op: str, value=None, mode: str = "keep") -> DataFrame:
    matched = F.count_if(filter_condition(df, col, op, value))
    left = matched if mode == "keep" else F.count("*") - matched
    return df.agg(matched.alias("matched"), F.count("*").alias("total"), left.alias("remaining"))


def parse_spans(spec: str) -> list[tuple[int, int]]:
    """``"1,3-5"`` as 1-based inclusive spans."""
    spans = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        first, _, last = part.partition("-")
        try:
            lo, hi = int(first), int(last or first)
        except ValueError:
            raise ValueError(f"not a position or range: {part!r}") from None
        if lo < 1 or hi < lo:
            raise ValueError(f"positions start at 1 and ranges rise: {part!r}")
        spans.append((lo, hi))
    return spans


def exclude_rows(df: DataFrame, spec: str, order_by: Sequence[str], **kw) -> DataFrame:
    """Drop rows by position in ``order_by`` order (which must identify rows); past the end is an error."""
    spans = parse_spans(spec)
    if not spans:
        return df
    n = df.count()
    if max(hi for _, hi in spans) > n:
        raise ValueError(f"position {max(hi for _, hi in spans)} is past the last of {n} rows")
    merged: list[list[int]] = []
    for lo, hi in sorted(spans):
        if merged and lo - 1 <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo - 1, hi])
    # Edges alternate between entering and leaving a span: an odd count is inside one.
    past = cuts_before(df, order_by, [e for span in merged for e in span], n, **kw)
    return df.filter(past % 2 == 0)


def delete_rows(df: DataFrame, ids: DataFrame | Sequence, id_col: str) -> DataFrame:
    """Drop rows by id: a short list becomes a predicate, a table an anti join."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(id_col), id_col, "left_anti")
    if len(ids) > ID_LIST:
        raise ValueError(f"more than {ID_LIST} ids: pass them as a DataFrame")
    return df.filter(~F.coalesce(F.col(id_col).isin(*ids), F.lit(False)))


def exclude_columns(df: DataFrame, spec: str | Sequence[str]) -> DataFrame:
    """By name, or by 1-based positions such as ``"1,3-5"``."""
    if isinstance(spec, str):
        names = []
        for lo, hi in parse_spans(spec):
            if hi > len(df.columns):
                raise ValueError(f"column {hi} is past the last of {len(df.columns)}")
            names += df.columns[lo - 1 : hi]
    else:
        names = list(spec)
        absent = [c for c in names if c not in df.columns]
        if absent:
            raise ValueError(f"no such column: {', '.join(absent)}")
    return df.drop(*names)


def rename_column(df: DataFrame, roles: Roles, old: str, new: str) -> tuple[DataFrame, Roles]:
    if new in df.columns and new != old:
        raise ValueError(f"column {new!r} exists")
    return df.withColumnRenamed(old, new), roles.renamed(old, new)


def insert_column(df: DataFrame, name: str, at: int | None = None) -> DataFrame:
    """An empty text column, at a 0-based place or at the end."""
    if name in df.columns:
        raise ValueError(f"column {name!r} exists")
    cols = list(df.columns)
    cols.insert(len(cols) if at is None else at, name)
    return df.withColumn(name, F.lit(None).cast("string")).select(*cols)


def reorder(df: DataFrame, order: Sequence[str]) -> DataFrame:
    if sorted(order) != sorted(df.columns):
        raise ValueError("the new order must name every column exactly once")
    return df.select(*order)


def recombine(df: DataFrame, roles: Roles) -> DataFrame:
    """Features, categories and targets back in the order the table came in."""
    return df.select(*[c for c in roles.order if c in df.columns])


def transpose_long(df: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """The transposed table as ``(variable, id, value)``: no limit on rows."""
    return df.select(F.col(id_col), *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        id_col, list(cols), "variable", "value"
    )


def transpose(df: DataFrame, id_col: str, cols: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Variables as rows, row names as columns; only for tables of few rows."""
    placed = dense_index(df, order_by, name="_pos")
    ids = [r[0] for r in placed.orderBy("_pos").select(id_col).limit(WIDE_LIMIT + 1).collect()]
    if len(ids) > WIDE_LIMIT:
        raise ValueError(f"more than {WIDE_LIMIT} rows would become columns: use transpose_long")
    headers: list[str] = []
    for i, v in enumerate(ids):
        base = str(v).strip() if v is not None and str(v).strip() else f"Row_{i + 1}"
        name, n = base, 2
        while name in headers:
            name, n = f"{base}_{n}", n + 1
        headers.append(name)
    numeric = all(isinstance(df.schema[c].dataType, T.NumericType) for c in cols)
    kind = "double" if numeric else "string"
    long = placed.select("_pos", *[F.col(c).cast(kind).alias(c) for c in cols]).unpivot(
        "_pos", list(cols), "variable", "value"
    )
    wide = long.groupBy("variable").pivot("_pos", list(range(len(ids)))).agg(F.first("value"))
    return wide.select("variable", *[F.col(str(i)).alias(h) for i, h in enumerate(headers)])


def sort_keys(col: str) -> list[Column]:
    """Numbers rising, then text; blanks sort as text."""
    text = F.coalesce(F.col(col).cast("string"), F.lit(""))
    return [to_number(F.col(col)).asc_nulls_last(), text]


def sort_rows(df: DataFrame, col: str, descending: bool = False) -> DataFrame:
    number, text = sort_keys(col)
    if descending:
        return df.orderBy(to_number(F.col(col)).desc_nulls_first(), text.desc())
    return df.orderBy(number, text)


def head(df: DataFrame, order_by: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def number_rows(
    df: DataFrame, order_by: Sequence[str], start: int = 1, step: int = 1, name: str = "Sample_ID", **kw
) -> DataFrame:
    """start, start+step, … in ``order_by`` order."""
    if step == 0:
        raise ValueError("step must not be 0")
    return dense_index(df, order_by, name="_pos", **kw).withColumn(
        name, F.lit(start) + F.lit(step) * F.col("_pos")
    ).drop("_pos")


def check_key(df: DataFrame, col: str) -> DataFrame:
    """Blank and repeated names in a candidate id column; usable when both are 0."""
    counted = df.groupBy(trimmed(F.col(col)).alias("k")).count()
    blank = F.coalesce(F.col("k") == "", F.lit(True))
    return counted.agg(
        F.coalesce(F.sum(F.when(blank, F.col("count"))), F.lit(0)).alias("blank"),
        F.coalesce(F.sum(F.when(~blank, F.col("count") - 1)), F.lit(0)).alias("repeated"),
    ).withColumn("usable", (F.col("blank") == 0) & (F.col("repeated") == 0))


def set_row_names(df: DataFrame, roles: Roles, col: str) -> Roles:
    found = check_key(df, col).first()
    if not found["usable"]:
        raise ValueError(f"{col}: {found['blank']} blank and {found['repeated']} repeated names")
    return roles.assign(col, "id")


def demote_row_names(df: DataFrame, roles: Roles) -> Roles:
    """The id column becomes data again: a feature if numeric, else a category."""
    if roles.id_col is None:
        return roles
    numeric = isinstance(df.schema[roles.id_col].dataType, T.NumericType)
    return roles.assign(roles.id_col, "features" if numeric else "categorical")
