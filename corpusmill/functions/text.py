"""Text expressions, all on the JVM.

Python's ``\\s``, ``\\w`` and ``strip`` are Unicode-aware, Java's are not unless ``(?U)`` is set, so it is set throughout.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 20 words that queries ignore.
STOP_WORDS = ["a", "about", "an", "and", "are", "can", "does", "for", "how", "in", "is", "of", "or", "say", "the", "to", "under", "what", "when", "who"]

# Broken encodings and what they stand for, replaced in this order. The fifth ends in U+009D.
MOJIBAKE = [
    ("âS", "'s"),
    ("â€™", "'"),
    ("â€˜", "'"),
    ("â€œ", '"'),
    ("â€\u009d", '"'),
    ("â€“", "-"),
    ("â€”", "-"),
    ("Â§", "§"),
    ("Â", ""),
]


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


# What ends a line, and the white space of (?U)\s that doesn't, without and with the space itself.
_ENDS, _ODD = r"\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029", r"\t\xA0\u1680\u2000-\u200A\u202F\u205F\u3000"


def collapse_lines(text: Column) -> Column:
    """Each line collapsed, empty lines dropped. Texts that are so already are only scanned once."""
    spaced = F.regexp_replace(text, rf"[ {_ODD}]{{2,}}+|[{_ODD}]", " ")
    lines = F.regexp_replace(F.regexp_replace(spaced, rf" (?=[{_ENDS}])|(?<=[{_ENDS}]) ", ""), rf"[{_ENDS}]++", "\n")
    # scans with few ranges are fast; the first finds some characters that aren't white space too, which does no harm
    odd = text.rlike(r"[\t\r\x0B\x0C\x1C-\x1E\x85\xA0\u1680-\u200F\u2028-\u3000]")
    ragged = odd | text.rlike(r"[ \n][ \n]") | reduce(or_, (f(c) for f in (text.startswith, text.endswith) for c in " \n"))
    return F.when(ragged, F.regexp_replace(lines, r"\A[ \n]|[ \n]\z", "")).otherwise(text)


def falsy(value: Column) -> Column:
    """Null for the empty string, as where only non-empty values count."""
    return F.nullif(value.cast("string"), F.lit(""))


def first_of(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*map(falsy, values))


def search_tokens(query: Column) -> Column:
    """Distinct tokens of two characters or more, in order: words, section signs and hyphens."""
    found = F.regexp_extract_all(F.lower(query), F.lit(r"(?U)[\w§-]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > 1))


def match_query(query: Column) -> Column:
    """The tokens as quoted phrases joined by OR."""
    return F.array_join(F.transform(search_tokens(query), lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ")


def meaningful_terms(query: Column) -> Column:
    """Lower-case terms of two characters or more that aren't stop words; repeats stay."""
    found = F.regexp_extract_all(F.lower(query), F.lit(r"[a-z0-9][a-z0-9-]*"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))


def clean_encoding(text: Column) -> Column:
    """Broken encodings repaired in the listed order, then collapsed."""
    repaired = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), MOJIBAKE, text)
    return collapse(repaired)


def address_part(value: Column) -> Column:
    """Upper-case ASCII letters and digits only; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.upper(value), "[^A-Z0-9]", ""), F.lit(""))


def full_address(house: Column, street: Column) -> Column:
    return F.nullif(F.concat_ws(" ", address_part(house), address_part(street)), F.lit(""))


def address_key(*parts: Column) -> Column:
    """Parts in upper case without outer white space, joined by a pipe; nulls are empty."""
    strip = lambda x: F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), r"(?U)^\s+|\s+$", "")
    return F.concat_ws("|", *map(strip, parts))


# Codes of boroughs, and how the last word of a street is written out.
BOROUGHS = {"1": "MANHATTAN", "2": "BRONX", "3": "BROOKLYN", "4": "QUEENS", "5": "STATEN ISLAND", "MN": "MANHATTAN", "BX": "BRONX", "BK": "BROOKLYN", "QN": "QUEENS", "SI": "STATEN ISLAND"}
STREET_SUFFIXES = {"ST": "STREET", "ST.": "STREET", "AVE": "AVENUE", "AVE.": "AVENUE", "RD": "ROAD", "BLVD": "BOULEVARD"}


def _mapped(value: Column, known: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[value], value)


def canonical_house(value: Column) -> Column:
    """A house number in capitals with single spaces; null if it holds anything but digits, letters, spaces and hyphens."""
    house = collapse(F.upper(value))
    return F.when(house.rlike(r"^[0-9A-Z -]{1,30}$"), house)


def canonical_street(value: Column) -> Column:
    """A street in capitals, commas gone, its last word written out; null if other characters are in it."""
    words = F.split(collapse(F.upper(F.replace(value, F.lit(","), F.lit(" ")))), " ")
    last = F.element_at(words, -1)
    street = F.array_join(F.concat(F.slice(words, 1, F.size(words) - 1), F.array(_mapped(last, STREET_SUFFIXES))), " ")
    return F.when(street.rlike(r"^[0-9A-Z .'-]{1,100}$"), street)


def canonical_borough(value: Column) -> Column:
    """A borough's name from its name, number or code; null if it is none."""
    name = _mapped(collapse(F.upper(value)), BOROUGHS)
    return F.when(name.isin(*dict.fromkeys(BOROUGHS.values())), name)


def encode_cursor(request_hash: Column, building_id: Column, inspection_date: Column, violation_id: Column) -> Column:
    """A page's end as URL-safe text: compact JSON with sorted names, in base 64."""
    end = F.struct(building_id.alias("building_id"), inspection_date.alias("inspection_date"), request_hash.alias("request_hash"), violation_id.alias("violation_id"))
    return F.translate(F.base64(F.encode(F.to_json(end, {"ignoreNullFields": "false"}), "UTF-8")), "+/\r\n", "-_")


def decode_cursor(cursor: Column, request_hash: Column) -> Column:
    """building_id, inspection_date and violation_id of a cursor; null if it is broken, of another request or not numbered."""
    text = F.try_to_binary(F.translate(cursor, "-_", "+/"), F.lit("base64")).cast("string")
    end = F.from_json(text, "building_id string, inspection_date string, request_hash string, violation_id string")
    named = F.array_contains(F.json_object_keys(text), "inspection_date")
    good = (end["request_hash"] == request_hash) & end["building_id"].rlike(r"^\d+$") & end["violation_id"].rlike(r"^\d+$") & named
    return F.when(good, F.struct(end["building_id"].alias("building_id"), end["inspection_date"].alias("inspection_date"), end["violation_id"].alias("violation_id")))


def spreadsheet_safe(value: Column) -> Column:
    """A quote before what a spreadsheet would take for a formula."""
    return F.when(value.rlike(r"(?U)^\s*[=+@-]"), F.concat(F.lit("'"), value)).otherwise(value)


def lenient_date(value: Column) -> Column:
    """A date from any of three ISO forms, else null; months, days and times may have one digit."""
    text = F.substring(falsy(value), 1, 26)
    forms = ("yyyy-M-d'T'H:m:s[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]", "yyyy-M-d")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("date") for f in forms))


def excerpt(text: Column, limit: int) -> Column:
    """At most ``limit`` characters; cut text ends in three dots."""
    cut = F.regexp_replace(F.substring(text, 1, limit), r"(?U)\s+$", "")
    return F.when(F.length(text) > limit, F.concat(cut, F.lit("..."))).otherwise(text)


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def short_hash(value: Column, digits: int) -> Column:
    return F.substring(F.sha1(value), 1, digits)


def section_key(title: Column, place: Column) -> Column:
    """A section's key: its title as a slug, or else its place, and a short hash of both."""
    name = F.coalesce(F.nullif(slug(title), F.lit("")), F.concat(F.lit("section-"), place.cast("string")))
    return F.concat_ws("-", F.substring(name, 1, 100), short_hash(F.concat_ws(":", place.cast("string"), title), 6))


def _page_name(url: Column) -> Column:
    return F.regexp_replace(F.substring_index(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/", -1), r"\.page$", "")


def document_key(url: Column, otherwise: str = "hpd-guidance") -> Column:
    """A document's key: the last part of its URL's path as a slug, and a short hash of the URL."""
    return F.concat_ws("-", F.substring(slug(F.coalesce(F.nullif(_page_name(url), F.lit("")), F.lit(otherwise))), 1, 120), short_hash(url, 8))


def title_from_url(url: Column, otherwise: str = "HPD Guidance") -> Column:
    """The last part of a URL's path as words with capitals."""
    words = F.transform(F.split(_page_name(url), "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000))))
    return F.when(_page_name(url) == "", otherwise).otherwise(F.array_join(words, " "))


def canonical_url(url: Column) -> Column:
    """Scheme, host and path without query, fragment or closing slash."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")


def safe_web_url(url: Column) -> Column:
    """True for http and https URLs with a host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://[^/?#\s]+", 1)).isin("http", "https"), F.lit(False))


def input_token_bound(text: Column) -> Column:
    return F.greatest(F.lit(1), F.octet_length(text))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4)


def query_hash(query: Column) -> Column:
    return F.sha2(F.lower(collapse(query)), 256)


def money(value: Column) -> Column:
    """Eight decimals, ties to even."""
    return F.bround(value.cast("decimal(38,18)"), 8).cast("decimal(18,8)")


def token_cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Cost at rates per million tokens, to eight decimals with ties to even; null without a rate for what goes in."""
    exact = tokens_in.cast("decimal(12,0)") * rate_in.cast("decimal(18,8)") + tokens_out.cast("decimal(12,0)") * F.coalesce(rate_out, F.lit(0)).cast("decimal(18,8)")
    return F.bround(exact.cast("decimal(32,8)") * F.lit("0.000001").cast("decimal(6,6)"), 8).cast("decimal(18,8)")


def embedding_segments(text: Column, limit: int) -> Column:
    """A text in pieces of at most ``limit`` characters, cut at the last space that allows it, else in mid-word."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)(?:^|\s*)(.{{1,{limit}}}\z|.{{1,{limit}}}(?= )|.{{1,{limit}}})"), F.lit(1))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: p != ""))


def seed_embedding(text: Column, dimension: int) -> Column:
    """A deterministic vector of length 1 from the bytes of the text's hash, over and over; for tests without a model."""
    value = lambda digest, i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 * 2 - 1
    many = F.sequence(F.lit(0), F.lit(dimension - 1))
    values = F.transform(F.array(F.sha2(text, 256)), lambda digest: F.transform(many, lambda i: value(digest, i)))  # the hash and the length are computed once
    scaled = F.transform(values, lambda v: F.struct(v.alias("v"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)).alias("norm")))
    return F.transform(scaled, lambda s: F.transform(s["v"], lambda x: x / F.when(s["norm"] == 0, 1.0).otherwise(s["norm"])))[0]


def locator_label(locator: Column) -> Column:
    """Where in its source a chunk stands, in words, from the JSON of its locator: a page, paragraphs or a section."""
    at = lambda name: F.nullif(F.nullif(F.try_variant_get(F.try_parse_json(locator), f"$.{name}", "string"), F.lit("")), F.lit("0"))
    start, end = at("paragraph_start"), at("paragraph_end")
    return (
        F.when(at("pdf_page").isNotNull(), F.concat(F.lit("PDF page "), at("pdf_page")))
        .when(start.isNotNull() & (start == end), F.concat(F.lit("paragraph "), start))
        .when(start.isNotNull() & end.isNotNull(), F.concat(F.lit("paragraphs "), start, F.lit("-"), end))
        .otherwise(F.coalesce(at("section"), F.lit("not supplied")))
    )


def json_flag(json: Column, name: str) -> Column:
    """True unless the object says the literal false; a text, another value or broken JSON isn't that."""
    said = F.try_variant_get(F.try_parse_json(json), f"$.{name}", "variant")
    return ~F.coalesce((F.schema_of_variant(said) == "BOOLEAN") & ~F.try_variant_get(said, "$", "boolean"), F.lit(False))


def json_object(json: Column) -> Column:
    """The text if it is a JSON object, else an empty object."""
    return F.when(F.schema_of_variant(F.try_parse_json(json)).startswith("OBJECT"), json).otherwise("{}")


def stable_id(*parts: Column) -> Column:
    """A deterministic id from its parts."""
    return F.sha2(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


# Fixed value: the name space of URLs.
URL_SPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def uuid5(space: Column, name: Column) -> Column:
    """The version 5 UUID of a name in a name space: a SHA-1 with version and variant set."""
    digest = F.sha1(F.concat(F.unhex(F.replace(space, F.lit("-"), F.lit(""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    part = lambda start, n: F.substring(digest, start, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def expand_terms(query: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The meaningful terms and the additions of all rules whose pattern the query matches, each once and in order."""
    none = F.array().cast("array<string>")
    added = [F.when(query.rlike(pattern), F.array(*map(F.lit, terms))).otherwise(none) for pattern, terms in rules]
    return F.array_distinct(F.concat(meaningful_terms(query), *added))


def expand_text(query: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The query followed by the terms that the rules add to it."""
    return F.concat_ws(" ", query, F.array_except(expand_terms(query, rules), meaningful_terms(query)))


def focused_texts(query: Column, rules: list[tuple[str, str]]) -> Column:
    """The sub-queries of all rules whose pattern the query matches, each once and in order."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(query.rlike(pattern), F.lit(text)) for pattern, text in rules))))


def first_hint(query: Column, rules: list[tuple[str, str]]) -> Column:
    """The value of the first rule whose pattern the query matches, else null."""
    return F.coalesce(*(F.when(query.rlike(pattern), F.lit(value)) for pattern, value in rules), F.lit(None).cast("string"))
