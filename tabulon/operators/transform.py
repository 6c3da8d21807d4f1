"""Rows to payloads: defaults, conversion, child rows, value maps, errors."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.convert import converted, from_number
from tabulon.functions.text import blank, filled, strip
from tabulon.operators.links import mapped
from tabulon.operators.profile import ROW
from tabulon.sources.shared import spread_out


@dataclass(frozen=True)
class Target:
    """Where a column goes: a field, or 'table.field' of a child table."""

    header: str
    path: str
    fieldtype: str = "Data"
    derived: bool = False  # filled in by the target from a linked record

    @property
    def table(self) -> str:
        return self.path.partition(".")[0] if "." in self.path else ""

    @property
    def field(self) -> str:
        return self.path.rpartition(".")[2]


@dataclass(frozen=True)
class Plan:
    """A compiled mapping: what `payloads` selects."""

    targets: tuple[Target, ...]
    defaults: dict[str, str] = field(default_factory=dict)
    value_maps: dict[str, dict[str, str]] = field(default_factory=dict)


def _cell(t: Target) -> Column:
    return F.col(f"`{t.header}`")


def _value(sheet: DataFrame, t: Target) -> Column:
    """Columns that hold numbers are not read as text."""
    return from_number(_cell(t), t.fieldtype) if isinstance(sheet.schema[t.header].dataType, T.NumericType) else converted(_cell(t), t.fieldtype)


def _read(sheet: DataFrame, plan: Plan) -> DataFrame:
    """__row, errors, v0, v1, ... (converted) and f0, f1, ... (whether filled) of the plan's targets, each converted once.

    The cells go through a one-row array, since a filter on the errors would otherwise be pushed below the conversion and
    convert each cell again.
    """
    cells = F.inline(F.array(F.struct(*(_value(sheet, t).alias(f"v{k}") for k, t in enumerate(plan.targets)), *(filled(_cell(t)).alias(f"s{k}") for k, t in enumerate(plan.targets)))))
    sheet = spread_out(sheet)
    read = sheet.select(ROW, cells) if plan.targets else sheet.select(ROW)
    full = [~blank(F.col(f"s{k}")) for k in range(len(plan.targets))]
    wrong = [F.when(full[k] & F.col(f"v{k}").isNull(), F.concat(F.lit(f"{t.header}: not a {t.fieldtype}: "), F.col(f"s{k}"))) for k, t in enumerate(plan.targets) if not t.derived]
    errors = F.array_compact(F.array(*wrong)) if wrong else F.array().cast("array<string>")
    return read.select(ROW, errors.alias("errors"), *(f"v{k}" for k in range(len(full))), *(c.alias(f"f{k}") for k, c in enumerate(full)))


def payload_errors(sheet: DataFrame, plan: Plan) -> DataFrame:
    """__row, errors (in column order) of rows that are left out."""
    return _read(sheet, plan).filter(F.size("errors") > 0).select(ROW, "errors")


def payloads(sheet: DataFrame, plan: Plan) -> DataFrame:
    """__row and the target fields of rows without errors; derived parent fields are left out, blank cells null.

    All columns of one child table make one child row, null where all are blank.
    """
    scalars: dict[str, list[Column]] = {}
    children: dict[str, list[tuple[int, Target, Column]]] = {}
    for k, t in enumerate(plan.targets):
        remap = plan.value_maps.get(t.path) or plan.value_maps.get(t.field)
        value = mapped(F.col(f"v{k}").cast("string"), remap) if remap else F.col(f"v{k}")
        if t.table:
            children.setdefault(t.table, []).append((k, t, value))
        elif not t.derived:
            scalars.setdefault(t.field, []).append(value)
    for name in plan.defaults:
        if "." not in name:
            scalars.setdefault(name, [])
    columns = [F.coalesce(*values, *([F.lit(plan.defaults[name])] if name in plan.defaults else [])).alias(name) for name, values in scalars.items()]
    for table, cells in children.items():
        any_filled = F.lit(False)
        for k, _, _ in cells:
            any_filled = any_filled | F.col(f"f{k}")
        columns.append(F.when(any_filled, F.array(F.struct(*(v.alias(t.field) for _, t, v in cells)))).alias(table))
    return _read(sheet, plan).filter(F.size("errors") == 0).select(ROW, *columns)


def inject_id(payloads: DataFrame, sheet: DataFrame, id_column: str, id_field: str) -> DataFrame:
    """payloads with id_field from a column of the sheet, where that is filled."""
    ids = sheet.select(ROW, F.when(~blank(F.col(f"`{id_column}`")), strip(F.col(f"`{id_column}`"))).alias("__id"))
    joined = payloads.join(ids, ROW, "left")
    value = F.coalesce("__id", F.col(id_field)) if id_field in payloads.columns else F.col("__id")
    return joined.withColumn(id_field, value).drop("__id")


def _field(name: str):
    return lambda row: row[name].cast("string")


def template(payloads: DataFrame, labels: dict[str, str], child_labels: dict[str, str] | None = None) -> DataFrame:
    """The bulk-import sheet: label headers; child columns 'Label (Table)', values of several child rows joined by ', '.

    labels: field to label; child_labels: 'table.field' to label.
    """
    columns = [F.col(f).cast("string").alias(label) for f, label in labels.items() if f in payloads.columns]
    for path, label in (child_labels or {}).items():
        table, _, name = path.partition(".")
        if table in payloads.columns:
            columns.append(F.array_join(F.transform(table, _field(name)), ", ").alias(label))
    return payloads.select(*columns)
