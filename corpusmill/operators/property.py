"""Property records: filters, keyset pages, candidates and timelines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import address_part, clean_encoding, first_of, full_address, lenient_date
from corpusmill.operators.relations import latest_per_key


def identity(building: str | None = None, borough: str | None = None, house: str | None = None, street: str | None = None) -> Column:
    """Conjunction of what is given; borough, house and street are compared in upper case."""
    tests = [F.col("building_id") == building] if building is not None else []
    tests += [F.upper(F.col(c)) == v for c, v in (("borough", borough), ("house_number", house), ("street_name", street)) if v is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def page_filter(violation_class: str | None = None, status: str | None = None, start: str | None = None, end: str | None = None) -> Column:
    """Class, status and a range of days, both ends included. A given end of the range leaves out rows without a date."""
    tests = [F.upper("class") == violation_class.upper()] if violation_class else []
    tests += [F.col("status") == status] if status else []
    tests += [F.col("inspection_date") >= F.lit(start).cast("timestamp_ntz")] if start else []
    tests += [F.col("inspection_date") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")] if end else []
    return reduce(lambda a, b: a & b, tests, F.lit(True))


ORDER = (F.desc_nulls_last, F.asc)


def ordered(rows: DataFrame) -> DataFrame:
    """Latest first, rows without a date last, then by id."""
    return rows.orderBy(F.desc_nulls_last("inspection_date"), F.asc("violation_id"))


def after_cursor(date: str | None, violation_id: object) -> Column:
    """What follows the cursor's row in ``ordered``; a cursor without a date stands among the rows without one."""
    if date is None:
        return F.col("inspection_date").isNull() & (F.col("violation_id") > violation_id)
    at = F.lit(date).cast("timestamp_ntz")
    return (F.col("inspection_date") < at) | ((F.col("inspection_date") == at) & (F.col("violation_id") > violation_id)) | F.col("inspection_date").isNull()


def page(rows: DataFrame, size: int, cursor: tuple[str | None, object] | None = None) -> DataFrame:
    """A page and whether more follow: one row more than asked is looked at."""
    wanted = rows if cursor is None else rows.filter(after_cursor(*cursor))
    ahead = ordered(wanted).limit(size + 1)
    place = Window.orderBy(F.desc_nulls_last("inspection_date"), F.asc("violation_id"))
    numbered = ahead.withColumn("position", F.row_number().over(place)).withColumn("has_more", F.count("*").over(Window.partitionBy()) > size)
    return numbered.filter(F.col("position") <= size)


def candidates(rows: DataFrame, *columns: str, most: int = 101) -> DataFrame:
    """Distinct buildings among the rows, in order, one more than may be shown."""
    return rows.select(*columns).distinct().orderBy(*columns).limit(most)


def last_per_building(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each building, by key."""
    return latest_per_key(rows, [key], [F.desc(position)])


def first_across_pages(pages: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each id over all pages."""
    return latest_per_key(pages, [key], [F.col(c) for c in order])


def address_match(house: str, street: str) -> Column:
    """Any of four ways in which an address may be written."""
    h, s = address_part(F.lit(house)), address_part(F.lit(street))
    whole = full_address(F.col("house_number"), F.col("street_name"))
    spaced = F.concat(F.coalesce("house_number", F.lit("")), F.lit(" "), F.coalesce("street_name", F.lit("")))
    return (
        (whole == full_address(F.lit(house), F.lit(street)))
        | ((address_part(F.col("house_number")) == h) & F.contains(address_part(F.col("street_name")), F.coalesce(s, F.lit(""))))
        | ((F.col("house_number") == house) & F.col("street_name").ilike(f"%{street}%"))
        | spaced.ilike(f"%{house} {street}%")
    )


def timeline(rows: DataFrame, key: str, dates: dict[str, str]) -> DataFrame:
    """key, label, date: a row for each date that is given, by date and key. ``dates``: column -> label."""
    pairs = F.array(*(F.struct(F.lit(label).alias("label"), F.col(column).cast("timestamp_ntz").alias("date")) for column, label in dates.items()))
    return rows.select(key, F.inline(pairs)).filter(F.col("date").isNotNull())


def running_excerpts(rows: DataFrame, by: str, order: str, text: str, each: int, total: int) -> DataFrame:
    """Texts cut to ``each`` characters, in order, until ``total`` are used; the text that crosses is cut there."""
    size = F.least(F.length(text), F.lit(each))
    before = F.sum(size).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    room = F.least(size, F.lit(total) - F.coalesce(before, F.lit(0)))
    return rows.withColumn("_room", room).filter("_room > 0").withColumn("excerpt", F.expr(f"substring({text}, 1, int(_room))")).drop("_room")


def feed_values(records: DataFrame, *keys: str) -> DataFrame:
    """A feed's records under the names of the violations table: either of two spellings of a field, dates read leniently, addresses normalised.

    ``records``: strings, as many of the fields as the feed has. Without an id, a hash of the record, as JSON of its fields
    in the order of their names, stands in for it.
    """
    have = {c.lower(): c for c in records.columns}
    pick = lambda *names: first_of(*(F.col(have[n]) for n in names if n in have), F.lit(None).cast("string"))
    whole = F.to_json(F.struct(*sorted(c for c in records.columns if c not in keys)))
    house, street = pick("housenumber", "house_number"), pick("streetname", "street_name")
    dates = {
        "inspection_date": "inspectiondate", "approved_date": "approveddate", "original_certify_by_date": "originalcertifybydate", "original_correct_by_date": "originalcorrectbydate",
        "new_certify_by_date": "newcertifybydate", "new_correct_by_date": "newcorrectbydate", "certified_date": "certifieddate", "current_status_date": "currentstatusdate",
    }
    texts = {
        "building_id": ("buildingid", "building_id"), "registration_id": ("registrationid", "registration_id"), "boro": ("boro", "borough"), "zip_code": ("zip", "zip_code"), "apartment": ("apartment",),
        "violation_class": ("class", "violationclass"), "order_number": ("ordernumber",), "nov_id": ("novid", "nov_id"), "nov_description": ("novdescription", "nov_description"), "current_status": ("currentstatus", "current_status"),
    }
    return records.select(
        *keys,
        F.coalesce(pick("violationid", "violation_id", "id"), F.sha2(whole, 256)).alias("external_id"),
        house.alias("house_number"), address_part(house).alias("normalized_house_number"), street.alias("street_name"), address_part(street).alias("normalized_street_name"),
        full_address(house, street).alias("normalized_full_address"),
        *(pick(*names).alias(c) for c, names in texts.items()),
        *(lenient_date(pick(name)).alias(c) for c, name in dates.items()),
        whole.alias("raw_record"),
    )


def shown(rows: DataFrame, description: str = "nov_description") -> DataFrame:
    """Rows as they are shown: broken encodings in the description repaired."""
    text = F.replace(clean_encoding(F.col(description)), F.lit("WWW.NYC.GOV\\HPD"), F.lit("WWW.NYC.GOV/HPD"))
    return rows.withColumn(description, text)


def trimmed_context(rows: DataFrame, by: str, rank: str, text: str, most_rows: int, most_chars: int) -> DataFrame:
    """The first rows of each list, as many as may be shown, until their characters are used up; the last one is cut and its end trimmed."""
    first = rows.filter(F.col(rank) <= most_rows)
    before = F.coalesce(F.sum(F.length(text)).over(Window.partitionBy(by).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = first.withColumn("_room", F.lit(most_chars) - before).filter("_room > 0")
    cut = F.regexp_replace(F.expr(f"substring({text}, 1, int(_room))"), r"(?U)\s+$", "")
    return placed.withColumn(text, F.when(F.length(text) > F.col("_room"), cut).otherwise(F.col(text))).drop("_room")


def evidence(rows: DataFrame, hits: DataFrame, query: str, most_rows: int = 25, most_hits: int = 4) -> DataFrame:
    """query, kind, place and id of what a summary rests on: the first property rows, then the best legal hits."""
    order = Window.partitionBy(query).orderBy(F.desc_nulls_last("inspection_date"), F.asc("violation_id"))
    first = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most_rows)
    return first.select(query, F.lit("property").alias("kind"), "place", F.col("violation_id").cast("string").alias("id")).unionByName(hits.filter(F.col("rank") <= most_hits).select(query, F.lit("legal").alias("kind"), F.col("rank").alias("place"), F.col("chunk_id").cast("string").alias("id")))


def complete_export(pages: DataFrame, key: str, page: str, position: str, most_pages: int, has_more: str) -> tuple[DataFrame, DataFrame]:
    """The rows of at most so many pages, each id once by its first place, and one row: rows, pages and why the export ends."""
    kept = pages.filter(F.col(page) < most_pages)
    rows = first_across_pages(kept, key, page, position)
    last = kept.agg(F.count_distinct(page).alias("pages"), F.max_by(has_more, F.struct(page, position)).alias("_more"), F.count_distinct(key).alias("rows"))
    reason = F.when(F.coalesce("_more", F.lit(False)), F.when(F.col("pages") >= most_pages, "page_limit").otherwise("interrupted")).otherwise("complete")
    return rows, last.select("rows", "pages", reason.alias("reason"))
