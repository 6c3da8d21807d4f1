"""Target schemas: fields with their kinds and links, kept in a StructType's metadata."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

LAYOUT = frozenset({"Section Break", "Column Break", "Tab Break"})
SPARK_TYPES = {"Int": T.LongType(), "Check": T.IntegerType(), "Float": T.DoubleType(), "Currency": T.DoubleType(), "Percent": T.DoubleType(), "Date": T.DateType()}


@dataclass(frozen=True)
class FieldMeta:
    name: str
    label: str = ""
    fieldtype: str = "Data"
    required: bool = False
    read_only: bool = False
    fetch_from: str = ""
    options: str = ""
    virtual: bool = False

    @property
    def link(self) -> str:
        """The linked table; the options of a dynamic link name a sibling field, not a table."""
        return self.options if self.fieldtype == "Link" else ""

    @property
    def choices(self) -> list[str]:
        return [c for c in self.options.split("\n") if c] if self.fieldtype == "Select" else []


@dataclass(frozen=True)
class TableMeta:
    name: str
    fields: tuple[FieldMeta, ...]
    children: tuple[tuple[str, TableMeta], ...] = ()
    autoname: str | None = None

    def field(self, name: str) -> FieldMeta | None:
        return next((f for f in self.fields if f.name == name), None)

    def with_custom(self, custom: list[FieldMeta]) -> TableMeta:
        """Custom fields added; the base schema wins where names clash."""
        return replace(self, fields=(*self.fields, *(f for f in custom if self.field(f.name) is None)))

    def with_child(self, name: str, child: TableMeta) -> TableMeta:
        return replace(self, fields=(*self.fields, FieldMeta(name, name, "Table", options=child.name)), children=(*self.children, (name, child)))

    def struct(self) -> T.StructType:
        fields = []
        for f in self.fields:
            if f.fieldtype in LAYOUT:
                continue
            child = dict(self.children).get(f.name)
            kind = T.ArrayType(child.struct()) if child else SPARK_TYPES.get(f.fieldtype, T.StringType())
            fields.append(T.StructField(f.name, kind, not f.required, {"label": f.label, "fieldtype": f.fieldtype, "options": f.options, "fetch_from": f.fetch_from, "read_only": f.read_only}))
        return T.StructType(fields)


def from_struct(name: str, schema: T.StructType) -> TableMeta:
    """The schema of a DataFrame as target metadata."""
    kinds = {"bigint": "Int", "int": "Int", "double": "Float", "float": "Float", "date": "Date", "timestamp": "Datetime", "timestamp_ntz": "Datetime", "boolean": "Check"}
    fields, children = [], []
    for f in schema.fields:
        m = f.metadata
        nested = isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)
        kind = m.get("fieldtype") or ("Table" if nested else kinds.get(f.dataType.simpleString(), "Data"))
        fields.append(FieldMeta(f.name, m.get("label", f.name), kind, not f.nullable, m.get("read_only", False), m.get("fetch_from", ""), m.get("options", "")))
        if nested:
            children.append((f.name, from_struct(f.name, f.dataType.elementType)))
    return TableMeta(name, tuple(fields), tuple(children))


DESCRIBED = "path string, label string, fieldtype string, required boolean, read_only boolean, fetch_from string, link string, choices string"


def describe(spark: SparkSession, meta: TableMeta, all_fields: bool = False) -> DataFrame:
    """Required, linked, child, derived and read-only fields (all_fields: every one), children as 'table.field'."""
    rows = []

    def add(prefix: str, table: TableMeta) -> None:
        for f in table.fields:
            if f.fieldtype in LAYOUT:
                continue
            if all_fields or f.required or f.link or f.fetch_from or f.read_only or f.fieldtype in ("Table", "Select", "Dynamic Link"):
                rows.append((prefix + f.name, f.label, f.fieldtype, f.required, f.read_only, f.fetch_from, f.link, ",".join(f.choices)))
            for name, child in table.children:
                if name == f.name and not prefix:
                    add(f"{name}.", child)

    add("", meta)
    return spark.createDataFrame(rows, DESCRIBED)
