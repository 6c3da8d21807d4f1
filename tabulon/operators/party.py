"""Flat party sheets: one row is a party, a contact and an address."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.convert import converted
from tabulon.functions.text import blank, filled, split_name, strip
from tabulon.operators.dedup import dedup_status
from tabulon.operators.links import merge_links
from tabulon.operators.profile import ROW
from tabulon.sources.schema import TableMeta


@dataclass(frozen=True)
class PartySpec:
    doctype: str
    key: str
    name_column: str
    columns: dict[str, str]  # header to party field
    mirrored: dict[str, str] = field(default_factory=dict)  # address header that the party holds, too


# The columns of party sheets and the fields that they feed.
PARTIES = {
    "Customer": PartySpec("Customer", "customer", "Customer Name", {"Customer Name": "customer_name", "Customer Type": "customer_type", "Group": "customer_group", "Territory": "territory"}),
    "Supplier": PartySpec("Supplier", "supplier", "Supplier Name", {"Supplier Name": "supplier_name", "Supplier Type": "supplier_type", "Supplier Group": "supplier_group"}, {"Country": "country"}),
}
CONTACT = {"Contact Name": "contact_name", "Email": "email", "Phone": "phone"}
ADDRESS = {
    "Address Type": "address_type",
    "Address Line 1": "address_line1",
    "Address Line 2": "address_line2",
    "City": "city",
    "State": "state",
    "Postal Code": "pincode",
    "Country": "country",
}
#: What a target like 'customer.tax_id' may name, and its table.
TARGETS = {"customer": "Customer", "supplier": "Supplier", "contact": "Contact", "address": "Address"}


def contract(spec: PartySpec) -> dict[str, tuple[str, str]]:
    """header: (target, field) of the fixed columns; contact fields are read together, not one by one."""
    own = {h: (spec.key, f) for h, f in spec.columns.items()}
    return own | {h: ("contact", f) for h, f in CONTACT.items()} | {h: ("address", f) for h, f in ADDRESS.items()}


def flat_target(target: str | None) -> tuple[str, str] | None:
    """(target, field) of 'customer.field'; None for anything else."""
    kind, dot, name = (target or "").partition(".")
    kind, name = kind.strip().lower(), name.strip()
    return (kind, name) if dot and name and kind in TARGETS else None


def extensions(mappings: dict[str, str | None]) -> dict[str, dict[str, str]]:
    """target: {header: field} of recorded mappings of a flat sheet; what doesn't name a target is left out."""
    out: dict[str, dict[str, str]] = {}
    for header, target in mappings.items():
        if found := flat_target(target):
            out.setdefault(found[0], {})[header] = found[1]
    return out


def type_maps(spec: PartySpec, metas: dict[str, TableMeta]) -> dict[str, dict[str, str]]:
    """target: {field: field type} of the party's, the contact's and the address's table."""
    kinds = {spec.key: spec.doctype, "contact": "Contact", "address": "Address"}
    return {kind: {f.name: f.fieldtype for f in metas[table].fields} for kind, table in kinds.items() if table in metas}


def _cell(sheet: DataFrame, header: str) -> Column:
    return F.when(~blank(F.col(f"`{header}`")), strip(F.col(f"`{header}`"))) if header in sheet.columns else F.lit(None).cast("string")


def _typed(cell: Column, fieldtype: str | None) -> Column:
    """Converted to the field's type as text; what can't be converted stays as it is."""
    return F.coalesce(converted(cell, fieldtype).cast("string"), cell) if fieldtype else cell


def split_party(sheet: DataFrame, spec: PartySpec, extra: dict[str, str] | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """__row and the party's fields; extra: header to party field."""
    types, columns = types or {}, dict(spec.columns) | (extra or {})
    fields = {f: _typed(_cell(sheet, h), types.get(f)) for h, f in columns.items()}
    for header, name in spec.mirrored.items():
        fields.setdefault(name, _typed(_cell(sheet, header), types.get(name)))
    return sheet.select(ROW, *(c.alias(f) for f, c in fields.items()))


def split_contact(sheet: DataFrame, extra: dict[str, str] | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """__row, first_name, last_name, email_ids, phone_nos; null where the sheet has nothing."""
    types = types or {}
    name = split_name(F.coalesce(_cell(sheet, "Contact Name"), F.lit("")))
    email, phone = _cell(sheet, "Email"), _cell(sheet, "Phone")
    some = lambda c: F.when(c != "", c)
    return sheet.select(
        ROW, some(name["first"]).alias("first_name"), some(name["last"]).alias("last_name"),
        F.when(email.isNotNull(), F.array(F.struct(email.alias("email_id"), F.lit(1).alias("is_primary")))).alias("email_ids"),
        F.when(phone.isNotNull(), F.array(F.struct(phone.alias("phone"), F.lit(1).alias("is_primary_phone")))).alias("phone_nos"),
        *(_typed(_cell(sheet, h), types.get(f)).alias(f) for h, f in (extra or {}).items()),
    )


def split_address(sheet: DataFrame, spec: PartySpec, extra: dict[str, str] | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """__row, address_title ('<party> - <type>'), address_type (Billing by default) and the other address fields."""
    types = types or {}
    kind = F.coalesce(_cell(sheet, "Address Type"), F.lit("Billing"))
    rest = {f: _typed(_cell(sheet, h), types.get(f)) for h, f in (ADDRESS | (extra or {})).items() if f != "address_type"}
    title = F.concat(F.coalesce(_cell(sheet, spec.name_column), F.lit("")), F.lit(" - "), kind)
    return sheet.select(ROW, title.alias("address_title"), kind.alias("address_type"), *(c.alias(f) for f, c in rest.items()))


def upsert_counts(sheet: DataFrame, spec: PartySpec, parties: DataFrame, contacts: DataFrame, addresses: DataFrame) -> DataFrame:
    """entity, status, count of importing a flat sheet; the others hold a column `key` of what exists.

    A row without a party name fails, and its contact and address are left out. A contact (by email) or address (by
    title and type) that exists, or that an earlier row makes, is linked. Without an email there is no contact.
    """
    party = dedup_status(split_party(sheet, spec).select(ROW, spec.columns[spec.name_column]), spec.columns[spec.name_column], parties)
    good = party.filter("status <> 'failed'").select(ROW)
    linked = lambda df: df.withColumn("status", F.when(F.col("status") == "skipped", "linked").when(F.col("status") == "create", "created").otherwise(F.col("status")))
    contact = split_contact(sheet).filter("email_ids is not null").join(good, ROW, "left_semi")
    contact = linked(dedup_status(contact, "email_ids.email_id", contacts))
    address = split_address(sheet, spec).filter("address_line1 is not null").join(good, ROW, "left_semi")
    address = linked(dedup_status(address, ("address_title", "address_type"), addresses))
    party = party.withColumn("status", F.when(F.col("status") == "create", "created").otherwise(F.col("status")))
    every = party.select(F.lit("party").alias("entity"), "status").union(contact.select(F.lit("contact"), "status")).union(address.select(F.lit("address"), "status"))
    return every.groupBy("entity", "status").agg(F.count("*").alias("count"))


def new_links(sheet: DataFrame, spec: PartySpec) -> DataFrame:
    """email, link_doctype, link_name: the links that a sheet's contacts get."""
    rows = sheet.select(filled(_cell(sheet, "Email")).alias("email"), _cell(sheet, spec.name_column).alias("link_name"))
    return rows.filter("email <> '' and link_name is not null").select("email", F.lit(spec.doctype).alias("link_doctype"), "link_name").distinct()


@dataclass(frozen=True)
class Upsert:
    """What importing a flat sheet does: each row's party, contact and address with key and status, and the links that
    contacts and addresses have then (key, links), for those that the sheet names."""

    parties: DataFrame
    contacts: DataFrame
    addresses: DataFrame
    contact_links: DataFrame
    address_links: DataFrame


def _links_after(rows: DataFrame, spec: PartySpec, existing: DataFrame) -> DataFrame:
    """key, links of rows (key, party), after those that existing has."""
    new = rows.filter("party is not null").select("key", F.lit(spec.doctype).alias("link_doctype"), F.col("party").alias("link_name")).distinct()
    none = F.array().cast("array<struct<link_doctype:string,link_name:string>>")
    held = existing.select("key", F.col("links") if "links" in existing.columns else none.alias("links")).join(new.select("key").distinct(), "key", "left_semi")
    return merge_links(held, new, "key")


def upsert(sheet: DataFrame, spec: PartySpec, parties: DataFrame, contacts: DataFrame, addresses: DataFrame, extra: dict[str, dict[str, str]] | None = None, types: dict[str, dict[str, str]] | None = None) -> Upsert:
    """The rows behind upsert_counts. The others hold a column `key` of what exists, contacts and addresses perhaps `links`.

    created is to be made, linked gets a link only, skipped is there, failed has no party name.
    """
    extra, types = extra or {}, types or {}
    name = spec.columns[spec.name_column]
    party = dedup_status(split_party(sheet, spec, extra.get(spec.key), types.get(spec.key)), name, parties)
    named = party.filter("status <> 'failed'").select(ROW, F.col("key").alias("party"))
    said = lambda df, again: df.withColumn("status", F.when(F.col("status") == "create", "created").when(F.col("status") == "skipped", again).otherwise(F.col("status")))
    contact = split_contact(sheet, extra.get("contact"), types.get("contact")).filter("email_ids is not null").join(named, ROW)
    contact = said(dedup_status(contact, "email_ids.email_id", contacts), "linked")
    address = split_address(sheet, spec, extra.get("address"), types.get("address")).filter("address_line1 is not null").join(named, ROW)
    address = said(dedup_status(address, ("address_title", "address_type"), addresses), "linked")
    return Upsert(said(party, "skipped"), contact, address, _links_after(contact, spec, contacts), _links_after(address, spec, addresses))
