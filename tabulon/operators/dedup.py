"""Keys, and what becomes of each payload: created, skipped or failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.text import strip
from tabulon.operators.profile import ROW
from tabulon.sources.shared import written

# Payload fields that stand in for a generated name, and the keys of tables with generated names.
NATURAL_KEYS = ("customer_name", "supplier_name", "item_code", "employee_name", "employee_number", "lead_name", "project_name", "party_name")
DEDUP_KEYS = {
    "Contact": {"source": "email_ids.email_id", "target": "email_id"},
    "Address": {"source": ("address_title", "address_type"), "target": ("address_title", "address_type")},
    "Employee": {"source": "employee_number", "target": "employee_number"},
}

KeySpec = str | tuple[str, ...]


def extract_key(spec: KeySpec) -> Column:
    """The key of a payload: a field, a field of the first row of a child table ('table.field'), or fields joined by |.

    A composite of blank fields is '|', which is not blank.
    """
    if isinstance(spec, tuple):
        return F.concat_ws("|", *(strip(F.col(f)) for f in spec))
    table, dot, field = spec.partition(".")
    return strip(F.get(F.col(table), F.lit(0))[field]) if dot else strip(F.col(spec))


def resolve_key_field(id_field: str, columns: list[str]) -> str:
    """The payload field that is the key: the id field, but for a generated name the first natural key there is."""
    if id_field != "name":
        return id_field
    return next((k for k in NATURAL_KEYS if k in columns), id_field)


def infer_key_column(headers: list[str], targets: dict[str, str], id_field: str, explicit: str | None = None) -> str | None:
    """The key column of a sheet; targets: header to target field, in column order."""
    if explicit:
        if explicit not in headers:
            raise ValueError(f"no column {explicit!r}")
        return explicit
    mapped = next((h for h, t in targets.items() if t == id_field or t in NATURAL_KEYS), None)
    return mapped or next((h for h in ("ID", "Name") if h in headers), None)


def clean_key_column(headers: list[str]) -> str | None:
    return next((h for h in ("ID", "Name") if h in headers), headers[0] if headers else None)


def existing_keys(target: DataFrame, spec: KeySpec) -> DataFrame:
    return target.select(extract_key(spec).alias("key")).distinct()


def dedup_status(payloads: DataFrame, spec: KeySpec, existing: DataFrame) -> DataFrame:
    """payloads with key, status (create, skipped, failed) and reason.

    The first row of a key counts; keys are compared case-sensitively. The first row comes from a hash aggregate,
    so a key with a third of all rows is pre-aggregated.
    """
    keyed = payloads.withColumn("key", extract_key(spec))
    first = keyed.filter("key <> ''").groupBy("key").agg(F.min(ROW).alias("__first"))
    there = existing.select("key").distinct().withColumn("__there", F.lit(True))
    facts = first.join(there, "key", "left")
    joined = keyed.join(facts, "key", "left")
    status = F.when(F.col("key") == "", "failed").when((F.col(ROW) > F.col("__first")) | F.col("__there"), "skipped").otherwise("create")
    reason = F.when(F.col("key") == "", "missing key").when(F.col(ROW) > F.col("__first"), "duplicate within source").when(F.col("__there"), "already exists")
    return joined.select(*payloads.columns, "key", status.alias("status"), reason.alias("reason"))


def to_create(statuses: DataFrame) -> DataFrame:
    return statuses.filter("status = 'create'").drop("status", "reason")


def predicted(statuses: DataFrame) -> DataFrame:
    """status, reason, count: what an import would do."""
    return statuses.groupBy("status", "reason").agg(F.count("*").alias("count"))


def verified(created: DataFrame, target: DataFrame, spec: KeySpec) -> DataFrame:
    """expected, found: keys of created that target holds after loading."""
    keys = created.select("key").distinct()
    found = keys.join(existing_keys(target, spec).withColumn("__found", F.lit(1)), "key", "left")
    return found.agg(F.count("*").alias("expected"), F.count("__found").alias("found"))


def numbered(df: DataFrame, *order: str | Column, name: str = ROW, first: int = 2) -> DataFrame:
    """df with `name` = first, first + 1, ... in the given order: counts of a range-partitioned sort in place of one window.

    The sorted rows are written, since a sort that runs twice may cut its partitions elsewhere.
    """
    spark = df.sparkSession
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    ordered = written(ordered.withColumn("__part", F.shiftright(at, 33)).withColumn("__at", at.bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    starts, total = [], first
    for part, n in sorted(ordered.groupBy("__part").count().collect()):  # one row for each partition
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts, "__part long, __before long")
    return ordered.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")
