"""Matters with their saved items and notes, property identities and dossiers, and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import address_key
from corpusmill.operators.operations import compare_and_swap

#: The panel of a dossier for which there is a reviewed source; any other is unavailable.
KNOWN_PANEL = "hpd_violations"


def created(matters: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """``matters`` with new ones at revision 1: matter_id, title, description, tags. A title is required; an id that is there stays as it is."""
    tags = F.aggregate(F.coalesce("tags", F.array().cast("array<string>")), F.array().cast("array<string>"), lambda seen, t: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(t)), seen).otherwise(F.concat(seen, F.array(t))))
    sound = new.filter(F.trim(F.coalesce("title", F.lit(""))) != "").join(matters.select("matter_id"), "matter_id", "left_anti")
    rows = sound.select("matter_id", F.trim("title").alias("title"), F.coalesce("description", F.lit("")).alias("description"), tags.alias("tags"), F.lit(False).alias("archived"), F.lit(1).cast("long").alias("revision"), now.alias("updated_at"))
    return matters.unionByName(rows.select(*matters.columns))


def updated(matters: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes that name the current revision; those made from an older state are refused."""
    return compare_and_swap(matters, changes, "matter_id", "revision")


def saved(items: DataFrame, new: DataFrame, receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and receipts after saving payloads: a key that has a receipt gives its item again and saves nothing.

    ``new``: item_id, payload, save_key; ``receipts``: save_key, item_id. The first of several with one key counts.
    """
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy("save_key").orderBy("item_id"))).filter("_n = 1").drop("_n")
    fresh = first.join(receipts.select("save_key"), "save_key", "left_anti")
    return items.unionByName(fresh.select("item_id", "payload")), receipts.unionByName(fresh.select("save_key", "item_id"))


def linked(links: DataFrame, new: DataFrame, matters: DataFrame, items: DataFrame) -> DataFrame:
    """``links`` (matter_id, item_id, display_order) with new pairs of what exists, each once, numbered on from the last of its matter."""
    known = new.select("matter_id", "item_id").distinct().join(matters.select("matter_id"), "matter_id", "left_semi").join(items.select("item_id"), "item_id", "left_semi")
    fresh = known.join(links.select("matter_id", "item_id"), ["matter_id", "item_id"], "left_anti")
    last = links.groupBy("matter_id").agg(F.max("display_order").alias("_last"))
    place = F.row_number().over(Window.partitionBy("matter_id").orderBy("item_id"))
    numbered = fresh.join(last, "matter_id", "left").withColumn("display_order", (F.coalesce("_last", F.lit(0)) + place).cast(links.schema["display_order"].dataType))
    return links.unionByName(numbered.select(*links.columns))


def deletion_preview(links: DataFrame, asked: DataFrame) -> DataFrame:
    """item_id, affected and remaining matters, and whether the item itself goes. ``asked``: item_id and matter_id, null for all of them."""
    held = links.groupBy("item_id").agg(F.sort_array(F.collect_set("matter_id")).alias("_linked"))
    rows = asked.join(held, "item_id", "left").withColumn("_linked", F.coalesce("_linked", F.array().cast("array<string>")))
    affected = F.when(F.col("matter_id").isNull(), F.col("_linked")).otherwise(F.array_intersect("_linked", F.array("matter_id")))
    remaining = F.array_except("_linked", "affected")
    return rows.withColumn("affected", affected).withColumn("remaining", remaining).select("item_id", "affected", "remaining", (F.col("matter_id").isNull() | (F.size("remaining") == 0)).alias("deleted"))


def deleted(items: DataFrame, links: DataFrame, receipts: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, links and receipts after a deletion; a deleted item's receipt goes with it, so that its key saves anew."""
    plan = deletion_preview(links, asked)
    gone = plan.filter("deleted").select("item_id").distinct()
    unlinked = plan.select("item_id", F.explode("affected").alias("matter_id")).distinct()
    return items.join(gone, "item_id", "left_anti"), links.join(unlinked, ["item_id", "matter_id"], "left_anti"), receipts.join(gone, "item_id", "left_anti")


def notes_of(notes: DataFrame, links: DataFrame) -> DataFrame:
    """matter_id and body of notes on a matter or on an item linked to it, each note once per matter."""
    own = notes.filter(F.col("matter_id").isNotNull()).select("matter_id", "note_id", "body")
    through = notes.filter(F.col("item_id").isNotNull()).select("item_id", "note_id", "body").join(links.select("matter_id", "item_id"), "item_id").select("matter_id", "note_id", "body")
    return own.unionByName(through).distinct()


def put_notes(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """New notes at revision 1, and changes of known ones that name the current revision."""
    fresh = changes.join(notes.select("note_id"), "note_id", "left_anti").withColumn("revision", F.lit(1).cast("long"))
    kept = changes.select("note_id", "body", "revision").join(notes.select("note_id"), "note_id", "left_semi")
    return compare_and_swap(notes, kept, "note_id", "revision").unionByName(fresh.select(*notes.columns))


def summaries(matters: DataFrame, links: DataFrame) -> DataFrame:
    """Matters with the number of their items."""
    counts = links.groupBy("matter_id").agg(F.count("*").alias("item_count"))
    return matters.join(counts, "matter_id", "left").withColumn("item_count", F.coalesce("item_count", F.lit(0)))


def matching(matters: DataFrame, bodies: DataFrame, terms: list[str]) -> DataFrame:
    """Matters in whose title, tags or body every term stands as a word, whatever its case."""
    whole = F.lower(F.concat_ws(" ", "title", F.array_join("tags", " "), "body"))
    rows = matters.join(bodies, "matter_id", "left")
    for t in terms:
        rows = rows.filter(F.array_contains(F.regexp_extract_all(whole, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), t.lower()))
    return rows.select(*(F.col(c) for c in matters.columns))


def exported(matters: DataFrame, items: DataFrame, links: DataFrame, notes: DataFrame) -> DataFrame:
    """matter_id, member, content and checksum: a JSON row for each matter, item and note of it."""
    parts = [
        matters.select("matter_id", F.concat(F.lit("matter/"), "matter_id").alias("member"), F.to_json(F.struct(*matters.columns)).alias("content")),
        links.join(items, "item_id").select("matter_id", F.concat(F.lit("item/"), "item_id").alias("member"), F.to_json(F.struct("item_id", "payload", "display_order")).alias("content")),
        notes_of(notes, links).select("matter_id", F.concat(F.lit("note/"), "note_id").alias("member"), F.to_json(F.struct("note_id", "body")).alias("content")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("checksum", F.sha2("content", 256))


# --- properties


def confirmed(candidates: DataFrame, query: str, confirmations: DataFrame) -> DataFrame:
    """The candidate that a query settles on: the one confirmed, or the only one there is; no row where one must be chosen.

    ``confirmations``: the query's key and building_id, null where nothing was confirmed.
    """
    counts = candidates.groupBy(query).agg(F.count_distinct("building_id").alias("_n"))
    said = confirmations.select(query, F.col("building_id").alias("_confirmed"))
    rows = candidates.join(counts, query).join(said, query, "left")
    settled = rows.filter(F.when(F.col("_confirmed").isNotNull(), F.col("building_id") == F.col("_confirmed")).otherwise(F.col("_n") == 1))
    return settled.dropDuplicates([query, "building_id"]).drop("_n", "_confirmed")


def display_address(*parts: str) -> Column:
    return F.concat_ws(" ", *(F.nullif(F.col(p), F.lit("")) for p in parts))


def resolved(identities: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Identities after candidates were confirmed: a known address gets the new data and its revision grows, a new one starts at 1.

    ``identities``: normalized_address, display_address, building_id, registration_id, revision, updated_at; ``found``:
    house_number, street_name, borough, zip_code, building_id, registration_id, one row per address.
    """
    key = address_key(F.col("house_number"), F.col("street_name"), F.col("borough"), F.col("zip_code"))
    new = found.select(key.alias("normalized_address"), display_address("house_number", "street_name", "borough", "zip_code").alias("display_address"), "building_id", "registration_id")
    new = new.withColumn("_n", F.row_number().over(Window.partitionBy("normalized_address").orderBy("building_id"))).filter("_n = 1").drop("_n")
    old = identities.select("normalized_address", F.col("revision").alias("_revision"))
    merged = new.join(old, "normalized_address", "left").withColumn("revision", F.coalesce(F.col("_revision") + 1, F.lit(1)).cast(identities.schema["revision"].dataType)).withColumn("updated_at", now)
    return identities.join(merged.select("normalized_address"), "normalized_address", "left_anti").unionByName(merged.select(*identities.columns))


def observations(identities: DataFrame, records: DataFrame, panels: list[str], now: Column) -> DataFrame:
    """A dossier for each identity all of whose records are of its building: panels as JSON, the number of records, a hash.

    ``records``: normalized_address, building_id, violation_id and what a panel shows. An identity with a record of
    another building has status mismatch and no panels.
    """
    shown = F.sort_array(F.collect_list(F.to_json(F.struct(*[c for c in records.columns if c != "normalized_address"]))))
    held = records.join(identities.select("normalized_address", F.col("building_id").alias("_expected")), "normalized_address").groupBy("normalized_address").agg(F.bool_and(F.col("building_id").eqNullSafe(F.col("_expected"))).alias("_same"), shown.alias("_records"), F.count("*").alias("records"))
    rows = identities.join(held, "normalized_address", "left").withColumns({"_records": F.coalesce("_records", F.array().cast("array<string>")), "records": F.coalesce("records", F.lit(0)), "status": F.when(F.coalesce("_same", F.lit(True)), "observed").otherwise("mismatch")})
    pieces = [F.concat(F.lit(f'"{p}":{{"status":"complete","records":['), F.array_join("_records", ","), F.lit("]}")) if p == KNOWN_PANEL else F.lit(f'"{p}":{{"status":"unavailable"}}') for p in panels]
    payload = F.when(F.col("status") == "observed", F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}")))
    return rows.withColumn("payload", payload).select("normalized_address", "status", "records", "payload", F.sha2("payload", 256).alias("payload_hash"), now.alias("observed_at"))


def feedback(log: DataFrame, given: DataFrame, rules: list[str], now: Column) -> DataFrame:
    """``log`` with the answers to whether help was helpful; unknown rules are left out of each."""
    known = F.filter("rule_ids", lambda r: r.isin(rules))
    return log.unionByName(given.select(known.alias("rule_ids"), "topic", "helpful", now.alias("created_at")).select(*log.columns))
