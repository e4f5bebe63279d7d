"""Legal citations: patterns, normal forms and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import collapse

_MARK = r"(?:§+|sections?|sec\.?)"
# Citation families in order of precedence: (name, type, pattern with the number as group 1, normal form).
FAMILIES = [
    ("code", "nyc_code", rf"(?iU)(?:NYC\s+Admin(?:istrative)?\s+Code|Housing\s+Maintenance\s+Code)?\s*(?:{_MARK}\s*)?((?:27-\d{{3,5}}|26-5\d{{2}}(?:\.\d+)?))", "NYC Admin Code § "),
    ("mdl", "ny_law", rf"(?iU)(?:Multiple\s+Dwelling\s+Law|MDL)\s*(?:{_MARK}\s*)?(\d+(?:-[a-z]+|[a-z])?)", "Multiple Dwelling Law § "),
    ("rpapl", "rpapl", rf"(?iU)(?:RPAPL)\s*(?:{_MARK}\s*)?(\d+(?:-[a-z]+|[a-z])?)", "RPAPL § "),
    ("rpl", "ny_law", rf"(?iU)(?:Real\s+Property\s+Law|RPL)\s*(?:{_MARK}\s*)?(21[0-6]|231-c)", "Real Property Law § "),
]
# Number words.
UNITS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
NUMBERS = {w: i for i, w in enumerate(UNITS)} | {w: 10 * i for i, w in enumerate(TENS, 2)}
_WORD = "(?:" + "|".join([*NUMBERS, "hundred"]) + ")"
_SPOKEN = rf"(?iU)\b(?:section|sec\.?)\s+({_WORD}(?:[-\s]+{_WORD})*)\s+(MDL|multiple\s+dwelling\s+law|RPL|real\s+property\s+law)\b"


def number_in_words(words: Column) -> Column:
    """The value of number words below a thousand: "two hundred eleven" is 211."""
    value = F.create_map(*(x for w, v in NUMBERS.items() for x in (F.lit(w), F.lit(v))))
    step = lambda total, w: F.when(w == "hundred", F.greatest(total, F.lit(1)) * 100).otherwise(total + F.coalesce(value[w], F.lit(0)))
    return F.aggregate(F.split(F.lower(words), r"[-\s]+"), F.lit(0), step)


def normalize(text: Column) -> Column:
    """The normal form of the first family that the text matches, spoken forms included, else the text collapsed."""
    compact = collapse(text)
    branches = [F.when(compact.rlike(p), F.concat(F.lit(form), F.upper(F.regexp_extract(compact, p, 1)))) for _, _, p, form in FAMILIES]
    law = F.lower(F.regexp_extract(compact, _SPOKEN, 2))
    spoken = F.concat(
        F.when(law.isin("mdl", "multiple dwelling law"), F.lit("Multiple Dwelling Law § ")).otherwise(F.lit("Real Property Law § ")),
        number_in_words(F.regexp_extract(compact, _SPOKEN, 1)).cast("string"),
    )
    return F.coalesce(*branches, F.when(compact.rlike(r"(?i)\bsection\s+seven[-\s]+eleven\b"), F.lit("RPAPL § 711")), F.when(compact.rlike(_SPOKEN), spoken), compact)


def citation_type(text: Column) -> Column:
    return F.coalesce(*(F.when(text.rlike(p), F.lit(kind)) for _, kind, p, _ in FAMILIES), F.lit("guidance"))


def extract(docs: DataFrame, text: str, *keys: str) -> DataFrame:
    """A row for each different citation of a text: keys, ordinal, citation_text, normalized_citation, citation_type.

    Families come in their order; of equal normal forms, the first spelling stays.
    """
    # the first family's pattern begins with optional parts and is slow, but has one of two literals; the others begin with names
    named_code = F.col(text).contains("27-") | F.col(text).contains("26-5")
    named_law = F.col(text).rlike(r"(?iU)MDL|Multiple\s+Dwelling|RPAPL|RPL|Real\s+Property")
    empty = F.array().cast("array<string>")
    some = [(named_code if name == "code" else named_law, F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))) for name, _, p, _ in FAMILIES]
    found = F.concat(*(F.when(F.col(text).isNull(), None).when(test, parts).otherwise(empty) for test, parts in some))
    named = F.transform(found, lambda c: F.struct(c.alias("citation_text"), normalize(c).alias("normalized_citation"), citation_type(c).alias("citation_type")))
    first = F.filter("_found", lambda c, i: ~F.exists(F.slice("_found", 1, i), lambda earlier: earlier["normalized_citation"] == c["normalized_citation"]))
    return docs.select(*keys, named.alias("_found")).select(*keys, F.posexplode(first).alias("ordinal", "c")).select(*keys, "ordinal", "c.*")
