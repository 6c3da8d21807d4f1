"""Flat party sheets: every conflict of a sheet whose rows are a party, a contact and an address at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.text import snake
from tabulon.operators import corrections, links
from tabulon.operators.party import CONTACT, TARGETS, PartySpec, contract
from tabulon.operators.profile import headers
from tabulon.plans import analysis, matching
from tabulon.sources.schema import TableMeta


def columns_of(sheet: DataFrame, spec: PartySpec, extra: dict[str, dict[str, str]] | None = None) -> dict[str, tuple[str, str]]:
    """header: (target, field) of the sheet's columns that are in the contract or mapped."""
    known = contract(spec) | {h: (kind, f) for kind, own in (extra or {}).items() for h, f in own.items()}
    return {h: known[h] for h in headers(sheet) if h in known}


def extra_columns(sheet: DataFrame, spec: PartySpec, metas: dict[str, TableMeta], extra: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """header, advice (extend or create), target of columns outside the contract: the best field of the three tables, or a new one."""
    known, order = columns_of(sheet, spec, extra), [spec.doctype, "Contact", "Address"]
    rows = []
    for header in headers(sheet):
        if header not in known:
            best = matching.best_field(header, [metas[t] for t in order if t in metas])
            kind = next((k for k, t in TARGETS.items() if best and t == best[0]), spec.key)
            rows.append((header, "extend" if best else "create", kind, best[1] if best else None))
    made = sheet.sparkSession.createDataFrame(rows, "header string, advice string, kind string, field string")
    return made.select("header", "advice", F.concat_ws(".", "kind", F.coalesce("field", snake("header"))).alias("target"))


def link_columns(sheet: DataFrame, spec: PartySpec, metas: dict[str, TableMeta], extra: dict[str, dict[str, str]] | None = None) -> dict[tuple[str, str], list[tuple[str, str]]]:
    """(header, linked table): [(target, field)] of the columns that feed links, mirrored ones included."""
    fed = [(h, *to) for h, to in columns_of(sheet, spec, extra).items() if not (to[0] == "contact" and to[1] in CONTACT.values())]
    fed += [(h, spec.key, f) for h, f in spec.mirrored.items() if h in headers(sheet)]
    out: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for header, kind, name in fed:
        meta = metas.get(TARGETS[kind])
        field = meta.field(name) if meta else None
        if field and field.link:
            out.setdefault((header, field.link), []).append((kind, name))
    return out


def link_conflicts(sheet: DataFrame, spec: PartySpec, metas: dict[str, TableMeta], linked: dict[str, DataFrame], extra: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Values of rows with a party name that linked tables lack, or that are groups where a leaf is needed: one row for each column and table, with all its targets."""
    columns = []
    for (header, table), fed in link_columns(sheet, spec, metas, extra).items():
        leaves = sorted(f"{k}.{f}" for k, f in fed if (TARGETS[k], f) in links.LEAF_ONLY)
        columns.append(links.LinkColumn(header, table, ", ".join(sorted({f"{k}.{f}" for k, f in fed})), ", ".join(leaves)))
    return analysis.link_conflicts(sheet.filter(links.importable(spec.name_column)), columns, linked)


def required_columns(sheet: DataFrame, spec: PartySpec, metas: dict[str, TableMeta], extra: dict[str, dict[str, str]] | None = None) -> list[str]:
    """Columns that feed a required field of one of the three tables."""
    out = []
    for header, (kind, name) in columns_of(sheet, spec, extra).items():
        meta = metas.get(TARGETS[kind])
        field = meta.field(name) if meta else None
        if field and field.required and not field.fetch_from:
            out.append(header)
    return out


def data_quality(sheet: DataFrame, spec: PartySpec, metas: dict[str, TableMeta], extra: dict[str, dict[str, str]] | None = None, key: str | None = None) -> DataFrame:
    """Duplicate parties, empty required cells and possible duplicates, compared over the contract's columns."""
    return analysis.clean(sheet, key or spec.name_column, required_columns(sheet, spec, metas, extra), list(columns_of(sheet, spec, extra)))


def analyse(sheet: DataFrame, spec: PartySpec, metas: dict[str, TableMeta], linked: dict[str, DataFrame], extra: dict[str, dict[str, str]] | None = None, key: str | None = None) -> DataFrame:
    """Every conflict of a flat sheet, in the columns of analysis.CONFLICT. A column outside the contract is an error until it is mapped or created."""
    outside = extra_columns(sheet, spec, metas, extra)
    out = analysis.conflict(outside, "unmapped_column", "error", F.col("header"), F.col("target"), F.concat_ws(" ", "advice", "target"), F.lit(1))
    return out.union(link_conflicts(sheet, spec, metas, linked, extra)).union(data_quality(sheet, spec, metas, extra, key))


def gate(conflicts: DataFrame, previous: DataFrame, answers: DataFrame, hash_changed: bool = False) -> tuple[DataFrame, bool]:
    """(conflicts with their status, whether an open error stops the import)."""
    found = corrections.conflict_status(conflicts, previous, answers, hash_changed)
    return found, bool(corrections.blocking(found).take(1))


__all__ = ["analyse", "columns_of", "data_quality", "extra_columns", "gate", "link_conflicts", "required_columns"]
