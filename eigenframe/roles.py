"""Which column plays which part; the Spark stand-in for header suffixes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffixes a header may carry.
TARGET_SUFFIX = "#target"
CATEGORY_SUFFIX = "#category"
_SUFFIX = re.compile(r"\s*#(target|category)\s*$", re.IGNORECASE)


def stem(name: str) -> str:
    """The header without its role suffix."""
    return _SUFFIX.sub("", name).strip()


def suffix_role(name: str) -> str | None:
    found = _SUFFIX.search(name)
    return found.group(1).lower() if found else None


def unique_name(name: str, taken: Iterable[str]) -> str:
    """A free column name: the stem itself, else ``stem_2``, ``stem_3`` …"""
    used, base = set(taken), stem(name)
    if base not in used:
        return base
    i = 2
    while f"{base}_{i}" in used:
        i += 1
    return f"{base}_{i}"


@dataclass(frozen=True)
class Roles:
    features: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    id_col: str | None = None
    order_col: str | None = None
    order: tuple[str, ...] = ()

    def of(self, col: str) -> str | None:
        if col == self.id_col:
            return "id"
        for role in ("features", "categorical", "targets"):
            if col in getattr(self, role):
                return role
        return None

    def assign(self, col: str, role: str | None) -> Roles:
        """Move ``col`` to ``role`` (``features``, ``categorical``, ``targets``, ``id`` or None)."""
        kept = {r: tuple(c for c in getattr(self, r) if c != col) for r in ("features", "categorical", "targets")}
        id_col = None if self.id_col == col else self.id_col
        if role == "id":
            id_col = col
        elif role is not None:
            kept[role] = kept[role] + (col,)
        return replace(self, id_col=id_col, **kept)

    def without(self, *cols: str) -> Roles:
        out = self
        for c in cols:
            out = out.assign(c, None)
        return replace(
            out,
            order=tuple(c for c in out.order if c not in cols),
            order_col=None if out.order_col in cols else out.order_col,
        )

    def renamed(self, old: str, new: str) -> Roles:
        swap = lambda names: tuple(new if c == old else c for c in names)
        return Roles(
            swap(self.features),
            swap(self.categorical),
            swap(self.targets),
            new if self.id_col == old else self.id_col,
            new if self.order_col == old else self.order_col,
            swap(self.order),
        )

    def eligible(self, *, numeric: bool, targets: bool = False) -> list[str]:
        """Columns a transform may be offered: numeric ones or categories."""
        cols = list(self.features if numeric else self.categorical)
        return cols + list(self.targets) if targets and numeric else cols

    @staticmethod
    def from_schema(schema: T.StructType, id_col: str | None = None, targets: Sequence[str] = ()) -> Roles:
        """Typed columns need no sampling: numbers are features, the rest categories."""
        feats, cats, targs = [], [], []
        for f in schema.fields:
            if f.name == id_col:
                continue
            role = suffix_role(f.name)
            if role == "target" or f.name in targets:
                targs.append(f.name)
            elif role == "category" or not isinstance(f.dataType, T.NumericType):
                cats.append(f.name)
            else:
                feats.append(f.name)
        return Roles(tuple(feats), tuple(cats), tuple(targs), id_col, None, tuple(schema.names))


def toggle_role(df: DataFrame, roles: Roles, col: str, role: str) -> tuple[DataFrame, Roles]:
    """Give ``col`` the role, or take it away if it has it; the column is recast to match."""
    from eigenframe.functions.parsing import to_number

    now = roles.of(col)
    numeric = isinstance(df.schema[col].dataType, T.NumericType)
    if now == role:
        target = "features" if role == "targets" or numeric else None
        if target is None:
            as_number = to_number(F.col(col))
            bad = df.agg(F.count_if(F.col(col).isNotNull() & as_number.isNull()).alias("n")).first()["n"]
            target = "features" if bad == 0 else "categorical"
    else:
        target = role
    if target == "categorical":
        df = df.withColumn(col, F.col(col).cast("string"))
    elif not numeric:
        df = df.withColumn(col, to_number(F.col(col)))
    return df, roles.assign(col, target)
