"""Finding the column that carries a meaning."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.catalog import DATASETS
from shelfline.functions.dates import as_date, date_of

DATE_ROLES = ("date", "snapshot_date")
DATE_TOKENS = ("date", "week", "period", "as_of", "effective")
DATE_SUFFIXES = ("_date", "_dt", "_d")


class ColumnNotFound(LookupError):
    """No column of the dataset carries the role; ``detail`` says what was tried."""

    def __init__(self, dataset: str, role: str, candidates: list[str], actual: list[str]):
        self.detail = {
            "dataset": dataset,
            "role": role,
            "candidates": candidates,
            "actual_columns": actual,
        }
        super().__init__(
            f"{dataset} has no column for {role!r}: tried {candidates}, has {actual}"
        )


def first_present(candidates: Iterable[str], columns: Iterable[str]) -> str | None:
    """The first candidate among ``columns``, ignoring case, as really spelled."""
    spelled = {c.lower(): c for c in columns}
    return next((spelled[c.lower()] for c in candidates if c.lower() in spelled), None)


def find_column(df: DataFrame, dataset: str, role: str,
                extra: Sequence[str] = ()) -> str | None:
    known = DATASETS[dataset].roles.get(role, []) if dataset in DATASETS else []
    return first_present([*known, *extra], df.columns)


def resolve_column(df: DataFrame, dataset: str, role: str,
                   extra: Sequence[str] = ()) -> str:
    """Name of the column of ``df`` that carries ``role``; reads the live schema."""
    hit = find_column(df, dataset, role, extra)
    if hit is None:
        known = DATASETS[dataset].roles.get(role, []) if dataset in DATASETS else []
        tried = list(dict.fromkeys([*known, *extra]))
        raise ColumnNotFound(dataset, role, tried, df.columns)
    return hit


def role_column(df: DataFrame, dataset: str, role: str,
                extra: Sequence[str] = ()) -> Column:
    """The resolved column; date roles come back as DATE."""
    name = resolve_column(df, dataset, role, extra)
    return as_date(df, name) if role in DATE_ROLES else F.col(name)


def conform(df: DataFrame, dataset: str, required: Sequence[str],
            optional: Sequence[str] = (), extra: dict[str, Sequence[str]] | None = None,
            also: Sequence[Column] = ()) -> DataFrame:
    """Project a delivered table to columns named after their roles.

    One projection, so the scan reads only the columns that are used and every
    operator after it sees one schema.  Optional roles without a column are
    left out.  ``also`` adds expressions over the delivered columns.
    """
    extra = extra or {}
    dated = [find_column(df, dataset, r, extra.get(r, ()))
             for r in DATE_ROLES if r in (*required, *optional)]
    texts = [n for n in dated if n and isinstance(df.schema[n].dataType, T.StringType)]
    if texts:
        # Text is read once per row, however often filters and keys use it.
        renamed = {name: f"_{name}_text" for name in texts}
        df = fixed(df.withColumnsRenamed(renamed), **{
            name: date_of(F.col(renamed[name]), T.StringType()) for name in texts})
    picked = [role_column(df, dataset, r, extra.get(r, ())).alias(r) for r in required]
    for role in optional:
        if find_column(df, dataset, role, extra.get(role, ())) is not None:
            picked.append(role_column(df, dataset, role, extra.get(role, ())).alias(role))
    return df.select(*picked, *also)


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that the optimizer does not merge into later expressions.

    A costly expression behind a plain column is copied into every filter and
    key that mentions the column.  ``inline`` over one struct keeps it in one
    place; filters on other columns still pass below it.
    """
    values = [c.alias(n) for n, c in columns.items()]
    return df.select("*", F.inline(F.array(F.struct(*values))))


def detect_date_column(df: DataFrame, dataset: str | None = None) -> str | None:
    """The column that best dates the rows of a table, or None.

    A typed date beats a date-like ending, which beats a date-like word, which
    beats the dataset's own list.  Inside one group the earlier column wins.
    """
    typed = (T.DateType, T.TimestampType, T.TimestampNTZType)
    names = df.columns
    tests = [
        lambda f: isinstance(f.dataType, typed),
        lambda f: f.name.lower().endswith(DATE_SUFFIXES),
        lambda f: any(token in f.name.lower() for token in DATE_TOKENS),
    ]
    for test in tests:
        hit = next((f.name for f in df.schema.fields if test(f)), None)
        if hit:
            return hit
    known = DATASETS[dataset].roles.get("date", []) if dataset in DATASETS else []
    return first_present(known, names)


def between(day: Column, start, end) -> Column:
    """Inclusive range; an open end is None."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (day >= F.lit(str(start)).cast("date"))
    if end is not None:
        inside = inside & (day <= F.lit(str(end)).cast("date"))
    return inside


def one_of(column: Column, values) -> Column:
    """Membership test; no values means no restriction."""
    if not values:
        return F.lit(True)
    return column.isin([int(v) for v in values])

