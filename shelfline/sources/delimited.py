"""Delimited lines to typed rows, in one pass, with a report per file.

Quoting is off in the delivered files, so splitting a line at the delimiter
*is* the parse.  Every rule below is a column expression.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.catalog import NULL_TOKENS
from shelfline.functions.dates import iso_date

# Delimiters in order of preference, and what a column name says
# about its type.
DELIMITERS = ["\t", "|", ","]
DEFAULT_DELIMITER = "|"
DATE_NAMES = ("date", "dt")
DATE_ENDINGS = ("_date", "_dt")
INTEGER_NAMES = (
    "tcin", "location_id", "store_id", "loc_id", "store_nbr", "location_nbr",
    "fiscal_week", "week", "unit", "units", "unit_sold", "units_sold", "count", "on_hand",
)
INTEGER_ENDINGS = ("_qty", "_unit", "_units", "_count", "_nbr")
NUMBER_NAMES = ("gm", "gross_margin")
NUMBER_ENDINGS = (
    "_amt", "_amount", "_dollar", "_dollars", "_sales", "_cost", "_price", "_margin",
    "_pct", "_rate",
)
INTEGER_PATTERN = r"^\s*[-+]?\d+\s*$"
NUMBER_PATTERN = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
REPLACEMENT = "�"

_TYPE_NAMES = {
    T.LongType: "BIGINT", T.IntegerType: "BIGINT", T.ShortType: "BIGINT", T.ByteType: "BIGINT",
    T.DoubleType: "DOUBLE", T.FloatType: "DOUBLE", T.BooleanType: "BOOLEAN", T.DateType: "DATE",
    T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP",
}


def derive_schema(schema: T.StructType) -> dict[str, str]:
    """Column name to type name as the registry stores it."""
    return {f.name: _TYPE_NAMES.get(type(f.dataType), "TEXT") for f in schema.fields}


def sniff_delimiter(line: Column) -> Column:
    """The most frequent delimiter of a header line; the earlier one on a tie."""
    counts = [F.length(line) - F.length(F.replace(line, F.lit(d), F.lit(""))) for d in DELIMITERS]
    most = F.greatest(*counts)
    choice = F.when(most == 0, F.lit(DEFAULT_DELIMITER))
    for delimiter, count in zip(DELIMITERS, counts):
        choice = choice.when(count == most, F.lit(delimiter))
    return choice


def split_line(line: Column, delimiter: str) -> Column:
    return F.split(line, {"\t": "\t", "|": "\\|", ",": ","}[delimiter], -1)


def split_by(line: Column, delimiter: Column) -> Column:
    """Fields of a line whose delimiter is itself a column."""
    fields = F.when(delimiter == DELIMITERS[0], split_line(line, DELIMITERS[0]))
    for d in DELIMITERS[1:]:
        fields = fields.when(delimiter == d, split_line(line, d))
    return fields


def normalize_header(name: Column) -> Column:
    """Lower snake case without the byte order mark; ``col`` when nothing is left."""
    snake = F.regexp_replace(name, "[^0-9A-Za-z]+", "_")
    snake = F.lower(F.regexp_replace(snake, "^_+|_+$", ""))
    return F.when(snake == "", F.lit("col")).otherwise(snake)


def header_names(line: Column, delimiter: Column) -> Column:
    return F.transform(split_by(line, delimiter), normalize_header)


@dataclass(frozen=True)
class Layout:
    """One distinct header: its number, delimiter and column names in order."""

    number: int
    delimiter: str
    names: tuple[str, ...]


def _unique(names: Iterable[str]) -> tuple[str, ...]:
    """Each name once: a repeated one gets the next number that no name has."""
    names, out = list(names), []
    taken = set(names)
    for name in names:
        own, number = name, 1
        while own in out or (number > 1 and own in taken):
            number += 1
            own = f"{name}_{number}"
        out.append(own)
    return tuple(out)


def collect_layouts(members: DataFrame, *by: str) -> list:
    """The distinct headers, with the columns ``by``, of the members that have one.

    One row per distinct header text, not per file, comes to the driver.
    """
    headers = members.filter(F.col("header").isNotNull()).groupBy(*by, "layout").agg(
        F.min("header").alias("line")
    )
    delimiter = sniff_delimiter(F.col("line"))
    found = headers.select(
        *by, "layout", delimiter.alias("delimiter"), header_names("line", delimiter).alias("names")
    ).collect()
    return [(*[r[c] for c in by], Layout(r["layout"], r["delimiter"], _unique(r["names"]))) for r in found]


def column_order(layouts: Sequence[Layout]) -> list[str]:
    """All column names of the layouts, in order of first appearance."""
    return list(dict.fromkeys(n for layout in layouts for n in layout.names))


def text_cells(lines: DataFrame, layouts: Sequence[Layout], keep: Sequence[str]) -> DataFrame:
    """One text column per header name; NULL tokens and missing fields are NULL.

    Files with different headers are read in the same pass: a small literal map
    gives the position of a column in each layout.  Adds ``_width``, ``_fields``
    and ``_garbled`` for the report, and ``_odd``: the line itself, if it has not
    the fields of its header or holds bytes that are no text.
    """
    number = F.col("layout")
    delimiters = {d: [x.number for x in layouts if x.delimiter == d] for d in DELIMITERS}
    used = [d for d in DELIMITERS if delimiters[d]]
    if len(used) == 1:
        fields = split_line(F.col("line"), used[0])
    else:
        fields = F.when(number.isin(delimiters[used[0]]), split_line(F.col("line"), used[0]))
        for d in used[1:]:
            fields = fields.when(number.isin(delimiters[d]), split_line(F.col("line"), d))

    def by_layout(values: Mapping[int, int]) -> Column:
        if len(layouts) == 1:
            return F.lit(values.get(layouts[0].number))
        return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])[number]

    width = by_layout({x.number: len(x.names) for x in layouts})
    data = lines.filter(F.col("line_no") > 0).withColumn("_cells", fields)
    columns = []
    for name in column_order(layouts):
        place = by_layout({x.number: x.names.index(name) for x in layouts if name in x.names})
        cell = F.get(F.col("_cells"), place.cast("int"))
        columns.append(F.when(~cell.isin(NULL_TOKENS), cell).alias(name))
    garbled = F.contains(F.col("line"), F.lit(REPLACEMENT))
    return data.select(
        *keep, width.alias("_width"), F.size("_cells").alias("_fields"), garbled.alias("_garbled"),
        F.when(garbled | (F.size("_cells") != width), F.col("line")).alias("_odd"), *columns,
    )


# -- types ---------------------------------------------------------------------


def hinted_type(name: str) -> T.DataType | None:
    """Type that a column name promises, or None."""
    if name in DATE_NAMES or name.endswith(DATE_ENDINGS):
        return T.DateType()
    if name in INTEGER_NAMES or name.endswith(INTEGER_ENDINGS):
        return T.LongType()
    if name in NUMBER_NAMES or name.endswith(NUMBER_ENDINGS):
        return T.DoubleType()
    return None


def typed(cell: Column, data_type: T.DataType) -> Column:
    """Text as a value of the type; NULL where it is none.  -1 stays -1."""
    if isinstance(data_type, T.DateType):
        return iso_date(cell)
    if isinstance(data_type, T.LongType):
        number = F.when(cell.rlike(NUMBER_PATTERN), cell.try_cast("double"))
        # 5.0 is a whole number, 5.5 is none; it must not lose its fraction.
        return F.coalesce(cell.try_cast("bigint"), F.when(number == F.floor(number), number.try_cast("bigint")))
    if isinstance(data_type, T.DoubleType):
        return F.when(cell.rlike(NUMBER_PATTERN), cell.try_cast("double"))
    if isinstance(data_type, T.BooleanType):
        word = F.lower(F.trim(cell))
        return F.when(word == "true", F.lit(True)).when(word == "false", F.lit(False))
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return cell.try_cast(data_type)
    return cell


_INT, _NUM, _BOOL, _TEXT = 1, 2, 4, 8


def kinds_of(names: Sequence[str]) -> list[Column]:
    """Of one row: the kind of value each column holds, as a bit."""

    def kind(name: str) -> Column:
        c = F.col(name)
        return (
            F.when(c.isNull(), F.lit(0))
            .when(c.rlike(INTEGER_PATTERN) & c.try_cast("bigint").isNotNull(), F.lit(_INT))
            .when(c.rlike(NUMBER_PATTERN) & ~c.rlike(INTEGER_PATTERN), F.lit(_NUM))
            .when(F.lower(F.trim(c)).isin("true", "false"), F.lit(_BOOL))
            .otherwise(F.lit(_TEXT))
        )

    return [kind(n) for n in names]


def value_kinds(names: Sequence[str]) -> list[Column]:
    """Aggregates: a bit mask per column of the kinds of values it holds."""
    return [F.bit_or(kind).alias(n) for n, kind in zip(names, kinds_of(names))]


def observed_kinds(cells: DataFrame, observation: Observation, names: Sequence[str]) -> DataFrame:
    """``cells``, which tell the value kinds of ``names`` as they are read.

    The kinds are columns first, as an observation evaluates its expressions without compiling them.
    """
    own = [f"_kind{i}" for i in range(len(names))]
    told = cells.withColumns(dict(zip(own, kinds_of(names))))
    return told.observe(observation, *[F.bit_or(k).alias(n) for k, n in zip(own, names)]).drop(*own)


def fitting_types(masks: Mapping[str, int]) -> dict[str, T.DataType]:
    """Narrowest type that fits every value: integer, number, boolean or text."""
    fitting = {_INT: T.LongType(), _NUM: T.DoubleType(), _INT | _NUM: T.DoubleType(),
               _BOOL: T.BooleanType()}
    return {n: fitting.get(mask, T.StringType()) for n, mask in masks.items()}


def infer_types(cells: DataFrame, names: Sequence[str]) -> dict[str, T.DataType]:
    """Types that fit the values of all rows, in one aggregate."""
    return fitting_types(cells.agg(*value_kinds(names)).first().asDict()) if names else {}


@dataclass(frozen=True)
class TypeChoice:
    """The table's type where it has the column, else the name's, else the values'.

    With ``evolve`` a whole-number column of the table, typed by its values,
    becomes DOUBLE where the new values have fractions.
    """

    names: tuple[str, ...]
    chosen: Mapping[str, T.DataType | None]
    widen: tuple[str, ...]

    @staticmethod
    def of(names: Sequence[str], table: T.StructType | None = None, evolve: bool = False) -> TypeChoice:
        fixed = {f.name: f.dataType for f in table.fields} if table is not None else {}
        widen = [n for n in names if evolve and hinted_type(n) is None and isinstance(fixed.get(n), T.LongType)]
        return TypeChoice(tuple(names), {n: fixed.get(n) or hinted_type(n) for n in names}, tuple(widen))

    @property
    def open(self) -> list[str]:
        """Columns whose values decide."""
        return [n for n in self.names if self.chosen[n] is None] + list(self.widen)

    def types(self, found: Mapping[str, T.DataType]) -> dict[str, T.DataType]:
        """All types, once those of the open columns are found."""
        kept = {n: t for n, t in found.items() if n not in self.widen or isinstance(t, T.DoubleType)}
        return {**self.chosen, **kept}


def choose_types(cells: DataFrame, names: Sequence[str],
                 table: T.StructType | None = None, evolve: bool = False) -> dict[str, T.DataType]:
    """See TypeChoice."""
    choice = TypeChoice.of(names, table, evolve)
    return choice.types(infer_types(cells, choice.open))


def cast_cells(cells: DataFrame, types: Mapping[str, T.DataType],
               keep: Sequence[str]) -> DataFrame:
    """Typed columns, plus ``_bad`` and ``_lost``.

    ``_lost`` names the values that their column's type cannot hold, as
    ``column=text``; they are NULL.  ``_bad`` counts those that are faults of the
    file: where only the name promised the type, text that is no such value is
    none, but a number that does not fit a whole-number column is one.
    """
    # Each value is typed in a step of its own, as it is named several times below.
    own = {n: f"_typed{i}" for i, (n, t) in enumerate(types.items()) if not isinstance(t, T.StringType)}
    cells = cells.withColumns({own[n]: typed(F.col(n), types[n]) for n in own})
    lost = {n: F.col(n).isNotNull() & F.col(own[n]).isNull() for n in own}
    faults = [
        (gone if hinted_type(n) is None else gone & F.col(n).rlike(NUMBER_PATTERN)).cast("int")
        for n, gone in lost.items() if hinted_type(n) is None or isinstance(types[n], T.LongType)
    ]
    texts = [F.when(gone, F.concat(F.lit(f"{n}="), F.col(n))) for n, gone in lost.items()]
    return cells.select(
        *keep, sum(faults, F.lit(0)).alias("_bad"),
        (F.nullif(F.concat_ws("; ", *texts), F.lit("")) if texts else F.lit(None).cast("string")).alias("_lost"),
        (F.col("_fields") < F.col("_width")).alias("_short"),
        (F.col("_fields") > F.col("_width")).alias("_long"),
        "_garbled", "_odd",
        *[F.col(own.get(n, n)).alias(n) for n in types],
    )


# -- report --------------------------------------------------------------------

METHODS = ("strict", "ignore_errors", "permissive", "failed")


def parse_report(rows: DataFrame, by: str = "file_id") -> DataFrame:
    """How each file was read.

    Long rows lose their surplus fields and stay ``strict``.  Short rows and
    values that do not fit the column type make it ``ignore_errors``.  Bytes
    that are no text make it ``permissive``, and then long rows are skipped, as
    their fields cannot be trusted.
    """
    count = rows.groupBy(by).agg(
        F.count("*").alias("data_lines"),
        F.count_if("_short").alias("short_rows"),
        F.count_if("_long").alias("long_rows"),
        F.count_if("_garbled").alias("garbled_rows"),
        F.sum("_bad").alias("bad_cells"),
    )
    garbled = F.col("garbled_rows") > 0
    tolerant = (F.col("short_rows") > 0) | (F.col("bad_cells") > 0)
    skipped = F.when(garbled, F.col("long_rows")).otherwise(F.lit(0).cast("bigint"))
    error = F.nullif(
        F.concat_ws(
            "; ",
            F.when(garbled, F.concat(F.col("garbled_rows"), F.lit(" lines hold undecodable bytes"))),
            F.when(F.col("short_rows") > 0, F.concat(F.col("short_rows"), F.lit(" short rows"))),
            F.when(F.col("bad_cells") > 0,
                   F.concat(F.col("bad_cells"), F.lit(" values do not fit their column"))),
        ),
        F.lit(""),
    )
    return count.select(
        by, "data_lines", "short_rows", "long_rows", "garbled_rows", "bad_cells",
        F.when(garbled, "permissive").when(tolerant, "ignore_errors").otherwise("strict")
        .alias("method"),
        skipped.alias("skipped_rows"),
        (F.col("data_lines") - skipped).alias("row_count"),
        error.alias("primary_error"),
    )


def untrusted() -> Column:
    """Of a report row: does its file lose its long rows?"""
    return (F.col("garbled_rows") > 0) & (F.col("long_rows") > 0)


def rejects(rows: DataFrame, untrusted_files: DataFrame, by: str = "file_id") -> DataFrame:
    """One row for each line that was not taken over as it stood.

    reasons; values that did not fit; the line, unless only values did not fit;
    and ``dropped``, if the whole row is left out of the table.
    """
    reasons = F.concat_ws(
        "; ", F.when(F.col("_garbled"), "undecodable bytes"), F.when(F.col("_short"), "too few fields"),
        F.when(F.col("_long"), "too many fields"), F.when(F.col("_lost").isNotNull(), "values do not fit"))
    odd = rows.filter(F.col("_odd").isNotNull() | F.col("_lost").isNotNull())
    marked = odd.join(untrusted_files.select(F.col(by), F.lit(True).alias("_cut")), by, "left")
    return marked.select(
        by, "_member", "_line_no", reasons.alias("reasons"), F.col("_lost").alias("lost_values"),
        F.col("_odd").alias("line"), (F.coalesce("_cut", F.lit(False)) & F.col("_long")).alias("dropped"))
