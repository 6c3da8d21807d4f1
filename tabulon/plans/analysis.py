"""All conflicts of a sheet as one frame, and the gate before an import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.operators import links, neardup, pair_report, profile, quality
from tabulon.plans.matching import Mapping, required_columns, required_missing
from tabulon.sources.schema import TableMeta
from tabulon.sources.shared import spread_out

CONFLICT = "conflict_key string, kind string, severity string, source string, target string, detail string, count long"


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CONFLICT)


def _frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(f"{k}:{s or t}", k, sev, s, t, d, n) for k, sev, s, t, d, n in rows], CONFLICT)


def conflict(df: DataFrame, kind: str, severity, source, target, detail, count) -> DataFrame:
    """One conflict for each row of df, in the columns of CONFLICT; texts and Columns are taken."""
    lit = lambda x: x if not isinstance(x, str | int | None) else F.lit(x)
    key = F.concat_ws(":", F.lit(kind), F.coalesce(lit(source).cast("string"), lit(target).cast("string")))
    return df.select(key.alias("conflict_key"), F.lit(kind).alias("kind"), lit(severity).alias("severity"), lit(source).cast("string").alias("source"), lit(target).cast("string").alias("target"), lit(detail).cast("string").alias("detail"), lit(count).cast("long").alias("count"))


def clean(sheet: DataFrame, key: str, required: list[str] | None = None, compare: list[str] | None = None) -> DataFrame:
    """Conflicts that need no target: duplicate rows, missing values, possible duplicates."""
    sheet = spread_out(sheet)
    severity = quality.duplicate_facts(sheet, key, compare)
    out = conflict(severity, "duplicate_row", F.col("severity"), key, None, F.concat(F.col("groups").cast("string"), F.lit(" duplicated keys")), F.col("groups"))
    missing = quality.missing_values(sheet, key, required or [])
    out = out.union(conflict(missing, "missing_value", "error", F.col("header"), None, F.col("role"), F.col("count")))
    identifiers = [r["header"] for r in profile.identifier_columns(profile.profile_columns(sheet), key).collect()]  # at most five
    pairs = neardup.pair_count(sheet, key, identifiers).filter("n > 0")
    return out.union(conflict(pairs, "possible_duplicate_row", "warning", key, None, F.concat(F.col("n").cast("string"), F.lit(" pairs")), F.col("n")))


def analyse(sheet: DataFrame, mapping: Mapping, meta: TableMeta, key: str | None, linked: dict[str, DataFrame]) -> DataFrame:
    """Every conflict of a relational sheet; linked: table name to a frame with `name` and perhaps `is_group`.

    Tables that are not in linked couldn't be read; their columns are not judged.
    """
    spark = sheet.sparkSession
    known = []
    for m in mapping.matches:
        c = mapping.candidate(m.path)
        if m.path is None and m.method != "override":
            known.append(("unmapped_column", "info", m.header, None, "no field matches", 1))
        if m.rivals:
            known.append(("ambiguous_mapping", "warning", m.header, m.path, ", ".join(m.rivals), len(m.rivals)))
        if c and c.fetch_from:
            known.append(("fetch_from", "warning", m.header, m.path, c.fetch_from, 1))
    known += [("required_missing", "error", None, path, "no column and no default", 1) for path in required_missing(mapping)]
    out = _frame(spark, known)
    if key:
        out = out.union(clean(sheet, key, required_columns(mapping), [m.header for m in mapping.matches if m.path]))
    else:
        missing = quality.missing_values(sheet, None, required_columns(mapping))
        out = out.union(conflict(missing, "missing_value", "error", F.col("header"), None, F.col("role"), F.col("count")))
    columns = []
    for m in mapping.matches:
        f = meta.field(m.path) if m.path else None
        if f is None or not f.link or f.link not in linked:
            continue
        own = next((x.header for x in mapping.matches if x.path in ("name", f"{meta.name.lower().replace(' ', '_')}_name")), None) if f.link == meta.name else None
        columns.append(links.LinkColumn(m.header, f.link, m.path, m.path if (meta.name, m.path) in links.LEAF_ONLY else "", mapping.value_maps.get(m.path), own))
    return out.union(link_conflicts(sheet, columns, linked))


def link_conflicts(sheet: DataFrame, columns: list[links.LinkColumn], linked: dict[str, DataFrame]) -> DataFrame:
    """The conflicts of all link columns, in the columns of CONFLICT."""
    found = links.link_problems(sheet, columns, linked)
    key = F.concat_ws(":", "kind", "header")
    return found.select(key.alias("conflict_key"), "kind", F.lit("error").alias("severity"), F.col("header").alias("source"), "target", F.array_join("values", ", ").alias("detail"), "count")


def exit_code(conflicts: DataFrame) -> int:
    """2 with an error, else 0."""
    return 2 if conflicts.filter("severity = 'error'").take(1) else 0


DETAIL = "conflict_key string, kind string, place int, rows array<long>, values array<string>, signals array<string>, fields array<string>"


def details(sheet: DataFrame, key: str, required: list[str] | None = None, compare: list[str] | None = None, cap: int = 25) -> DataFrame:
    """What stands behind the conflicts of `clean`: the first `cap` groups of repeated keys, rows with blank cells (one row a column), and near pairs.

    place counts from 1 by rows. rows and values are those of the group or pair, fields what differs in it, signals why a pair is one.
    """
    sheet = spread_out(sheet)
    of = lambda kind, source: (F.concat_ws(":", F.lit(kind), source).alias("conflict_key"), F.lit(kind).alias("kind"))
    place = lambda *order: F.row_number().over(Window.orderBy(*order)).cast("int").alias("place")  # noqa: E731  over at most `cap` rows
    none = F.lit(None).cast("array<string>")
    groups = quality.duplicate_groups(sheet, key, compare, cap).orderBy("first_row").limit(cap)
    out = groups.select(*of("duplicate_row", F.lit(key)), place("first_row"), F.col("rows").cast("array<long>").alias("rows"), "values", none.alias("signals"), F.col("differing_fields").alias("fields"))
    missing = quality.missing_values(sheet, key, required or [], cap)
    out = out.union(missing.select(*of("missing_value", F.col("header")), F.lit(1), "rows", none, none, F.array("header")))
    identifiers = [r["header"] for r in profile.identifier_columns(profile.profile_columns(sheet), key).collect()]  # at most five
    pairs = pair_report.first_pairs(sheet, key, identifiers, compare, cap)
    return out.union(pairs.select(*of("possible_duplicate_row", F.lit(key)), place("a_row", "b_row"), F.array("a_row", "b_row"), F.array("a_value", "b_value"), "signals", "differing_fields"))
