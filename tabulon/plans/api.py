"""The verbs: map, clean, analyse, correct, import, revert, status. Tables of the target are DataFrames by name."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators import corrections, dedup, employees, journal, party, revert, transform, tree
from tabulon.operators.employees import generate_ids, manager_links
from tabulon.operators.profile import headers
from tabulon.plans import analysis, infer, matching, parties
from tabulon.sources import records, schema, store
from tabulon.sources.schema import FieldMeta, TableMeta


@dataclass
class Import:
    """What an import found and would do; payloads to load are in `create`."""

    mapping: matching.Mapping | None
    conflicts: DataFrame
    blocked: bool
    statuses: DataFrame
    create: DataFrame
    errors: DataFrame | None = None
    verdicts: dict = field(default_factory=dict)
    corrections: list = field(default_factory=list)
    sha256: str = ""
    departments: DataFrame | None = None


def map_sheet(sheet: DataFrame, meta: TableMeta, overrides: dict | None = None) -> matching.Mapping:
    mapping = matching.suggest(headers(sheet), meta)
    mapping, _, _ = matching.with_overrides(mapping, overrides or {})
    return matching.with_employee_rules(mapping) if meta.name == "Employee" else mapping


def clean(sheet: DataFrame, key: str | None = None, required: list[str] | None = None) -> DataFrame:
    return analysis.clean(sheet, key or dedup.clean_key_column(headers(sheet)), required)


def import_sheet(
    sheet: DataFrame, meta: TableMeta, target: DataFrame, linked: dict[str, DataFrame], key: str | None = None,
    overrides: dict | None = None, fixes: list[dict] | None = None, id_field: str = "name", previous: DataFrame | None = None, previous_sha256: str = "",
    id_column: str | None = None, companies: DataFrame | None = None,
) -> Import:
    """Plan from the raw sheet, payloads from the corrected one, conflicts, the gate, and what is new.

    corrections: fixes as they are to be recorded, each with its id, key column, first sighting and the sheet's
    fingerprint (sha256), by which a later import sees that row numbers may no longer hold. previous, previous_sha256:
    the conflicts and the fingerprint of the import before. id_column: a column whose values are the records' ids, also
    where no field takes it. companies: name, abbr of the target's companies, by which an employee sheet's departments get
    their records' names (linked["Department"] has name and department_name); those to be made come in `departments`.
    """
    mapping = map_sheet(sheet, meta, overrides)
    targets = {m.header: m.path for m in mapping.matches if m.path}
    key = dedup.infer_key_column(headers(sheet), targets, id_field, key)
    sha256 = corrections.fingerprint(sheet) if fixes or previous_sha256 else ""
    done = corrections.worked(sheet, key or "", fixes or [], sha256)
    fixed, key = done.sheet, done.key or key
    departments = None
    if meta.name == "Employee" and companies is not None and "Department" in linked:
        departments = employees.departments(fixed, linked["Department"], companies)
    if departments is not None:  # what is about to be made is no missing link
        linked = linked | {"Department": linked["Department"].select("name").union(departments.select("value"))}
    conflicts = analysis.analyse(sheet, mapping, meta, key, linked)
    spark = sheet.sparkSession
    known = previous if previous is not None else spark.createDataFrame([], "conflict_key string, severity string, status string")
    found = corrections.conflict_status(conflicts, known, _answers(spark, done), bool(previous_sha256 and previous_sha256 != sha256))
    plan = mapping.plan()
    payloads = transform.payloads(fixed, plan)
    if id_column and id_column in sheet.columns and id_column not in targets:
        payloads = transform.inject_id(payloads, fixed, id_column, id_field)
    if departments is not None and "department" in payloads.columns:
        payloads = employees.in_departments(payloads, departments)
    if meta.name == "Employee" and "employee_number" in payloads.columns:
        payloads = generate_ids(payloads)
    own = next((f for f in meta.fields if f.link == meta.name and f.name in payloads.columns), None)
    spec = dedup.DEDUP_KEYS.get(meta.name, {}).get("source") or dedup.resolve_key_field(id_field, payloads.columns)
    if own and isinstance(spec, str) and spec in payloads.columns:
        if meta.field("is_group"):
            payloads = tree.mark_groups(payloads, spec, own.name, "is_group" if "is_group" in payloads.columns else None)
        payloads = tree.levels(payloads, spec, own.name)
    existing = dedup.existing_keys(target, dedup.DEDUP_KEYS.get(meta.name, {}).get("target") or spec)
    statuses = dedup.dedup_status(payloads, spec, existing)
    create = dedup.to_create(statuses)
    blocked = bool(corrections.blocking(found).take(1))
    return Import(mapping, found, blocked, statuses, tree.parents_first(create) if "level" in create.columns else create, transform.payload_errors(fixed, plan), done.verdicts, done.corrections, sha256, departments)


def import_parties(sheet: DataFrame, parties: DataFrame, contacts: DataFrame, addresses: DataFrame) -> DataFrame:
    """entity, status, count of a flat party sheet; ValueError for another."""
    return party.upsert_counts(sheet, _party(sheet), parties, contacts, addresses)


def upsert_parties(
    sheet: DataFrame, target: dict[str, DataFrame], metas: dict[str, TableMeta] | None = None, mappings: dict[str, str | None] | None = None,
) -> tuple[party.Upsert, DataFrame]:
    """(parties, contacts, addresses and links after importing a flat sheet, entries that undo it).

    target: party, contact and address to a frame with `key`, the latter two perhaps with `links`.
    """
    spec = _party(sheet)
    done = party.upsert(sheet, spec, target["party"], target["contact"], target["address"], party.extensions(mappings or {}), party.type_maps(spec, metas or {}))
    made = lambda df, doctype: journal.entries(df.filter("status = 'created'").select(F.col("key").alias("name")), doctype, "name", "delete_record")
    entries = made(done.parties, spec.doctype).union(made(done.contacts, "Contact")).union(made(done.addresses, "Address"))
    for rows, doctype, there in ((done.contacts, "Contact", target["contact"]), (done.addresses, "Address", target["address"])):
        pairs = lambda df: df.select("key", "party").distinct()
        added = pairs(rows.filter("status = 'linked'")).join(pairs(rows.filter("status = 'created'")), ["key", "party"], "left_anti")
        if "links" in there.columns:  # only what wasn't linked before is undone
            held = there.select("key", F.explode("links").alias("l")).filter(F.col("l.link_doctype") == spec.doctype).select("key", F.col("l.link_name").alias("party"))
            added = added.join(held, ["key", "party"], "left_anti")
        cut = added.select(F.lit("effect").alias("event"), F.lit("remove_record_link").alias("op"), F.lit(doctype).alias("doctype"), F.col("key").alias("name"), F.lit(spec.doctype).alias("link_doctype"), F.col("party").alias("link_name"))
        entries = entries.unionByName(cut, allowMissingColumns=True)
    return done, entries


def _party(sheet: DataFrame) -> party.PartySpec:
    kind = infer.party_of(headers(sheet))
    if kind is None:
        raise ValueError("not a party sheet")
    return party.PARTIES[kind]


@dataclass
class PartyImport:
    """What an import of a flat sheet found and would do."""

    conflicts: DataFrame
    blocked: bool
    parties: DataFrame
    contacts: DataFrame
    addresses: DataFrame
    verdicts: dict = field(default_factory=dict)
    corrections: list = field(default_factory=list)
    sha256: str = ""


def import_party_sheet(
    sheet: DataFrame, metas: dict[str, TableMeta], linked: dict[str, DataFrame], mappings: dict[str, str | None] | None = None, fixes: list[dict] | None = None, previous: DataFrame | None = None, previous_sha256: str = "",
) -> PartyImport:
    """A flat sheet analysed as it is, corrected, gated, split in three and converted to the fields' types."""
    spec, spark = _party(sheet), sheet.sparkSession
    extra, types = party.extensions(mappings or {}), party.type_maps(_party(sheet), metas)
    sha256 = corrections.fingerprint(sheet) if fixes or previous_sha256 else ""
    done = corrections.worked(sheet, spec.name_column, fixes or [], sha256)
    fixed, conflicts = done.sheet, parties.analyse(sheet, spec, metas, linked, extra, done.key)
    known = previous if previous is not None else spark.createDataFrame([], "conflict_key string, severity string, status string")
    found, blocked = parties.gate(conflicts, known, _answers(spark, done), bool(previous_sha256 and previous_sha256 != sha256))
    of = lambda kind: (extra.get(kind), types.get(kind))
    return PartyImport(found, blocked, party.split_party(fixed, spec, *of(spec.key)), party.split_contact(fixed, *of("contact")), party.split_address(fixed, spec, *of("address")), done.verdicts, done.corrections, sha256)


def _answers(spark, done: corrections.Worked) -> DataFrame:
    rows = [(str(c.get("conflict")), c["action"], done.verdicts[c["id"]]["applicable"]) for c in corrections.active(done.corrections)]
    return spark.createDataFrame(rows, "conflict_key string, action string, applicable boolean")


# Verbs that change something give the journal's entries with it, so that `revert` can undo them.


def create_record(table: DataFrame, new: DataFrame, key: str, doctype: str) -> tuple[DataFrame, DataFrame]:
    """(table with the rows of new that it lacked, entries)."""
    fresh = records.create_if_absent(table, new, key)
    return table.unionByName(fresh, allowMissingColumns=True), journal.entries(fresh, doctype, key, "delete_record")


def update_record(table: DataFrame, patch: DataFrame, key: str, doctype: str) -> tuple[DataFrame, DataFrame]:
    """(table with the patch, entries with what it overwrote)."""
    return records.update_records(table, patch, key), journal.entries(records.before_image(table, patch, key), doctype, key, "restore_record")


def delete_record(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """table without the keys; deletions are not journalled, since a record can't be made again as it was."""
    return records.delete_records(table, keys, key)


def create_field(meta: TableMeta, label: str, fieldtype: str = "Data") -> tuple[TableMeta, dict]:
    """(meta with the field, entry); a field that is there stays as it is."""
    name = re.sub("[^a-z0-9]+", "_", label.strip().lower()).strip("_")
    entry = {"event": "effect", "op": "delete_custom_field", "doctype": meta.name, "name": f"{meta.name}-{name}"}
    return meta.with_custom([FieldMeta(name, label, fieldtype)]), {} if meta.field(name) else entry


def set_mapping(path: str, doctype: str, column: str, target: str | None) -> dict:
    """Records a column's target; the entry."""
    previous = store.set_mapping(path, doctype, column, target)
    return {"event": "effect", "op": "restore_override", "doctype": doctype, "name": column, "fields": {"previous": previous}}


def correct(fixes: list[dict], new: dict) -> tuple[list[dict], dict]:
    """(corrections with a new one, entry); one that is in force already changes nothing."""
    more = corrections.added(fixes, new)
    entry = {"event": "effect", "op": "correction_revoke", "name": more[-1]["id"]} if len(more) > len(fixes) else {}
    return more, entry


def link_managers(sheet: DataFrame, number: str, name: str, manager: str, site: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what becomes of each row's manager, entries of the updates)."""
    links = manager_links(sheet, number, name, manager, site)
    changed = links.filter("status = 'update'").select(F.col("own").alias("employee_number")).join(site, "employee_number")
    return links, journal.entries(changed.select("name", "reports_to"), "Employee", "name", "restore_record")


describe, list_records, get_record = schema.describe, records.list_records, records.get_record
status, revert_plan, revert_run, revert = journal.log_counts, journal.revert_plan, revert.reverted, journal.undone
