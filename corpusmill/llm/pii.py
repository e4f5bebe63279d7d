"""Personal data: one Aho-Corasick pass finds anchors, and local parsers expand them to spans and check them.

Anchors are at-signs, ``://``, digits, a plus before a digit, spelled-out at-signs and cue words of addresses and accounts. The four
base kinds give what their patterns give when searched for from the left without overlaps. The further kinds are
user information in URLs, spelled-out emails, street addresses, and accounts with a checked number. The work is
row-local; parsers look only around their anchor, so a text costs time in proportion to its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import picked, portions

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url_user", "email_text", "address", "account")
SCHEMA = ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, " + ", ".join(f"n_{k} long" for k in KINDS[4:])

DIGITS = frozenset("0123456789")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

AT_WORDS = ("[at]", "(at)", "{at}")
STREETS = ("Street", "Avenue", "Boulevard", "Road", "Lane", "Drive", "Square", "Court", "Place", "Way", "St", "Ave", "Blvd", "Rd", "Ln", "Dr", "Sq", "Ct", "Pl")
ACCOUNTS = ("iban", "account", "acct", "ssn")
#: Words of prose that no street name in lower case has, so that a number earlier in the sentence isn't taken for a house's.
PROSE = frozenset("a an and are at be but by down for from had has have he her his i in is it its my near of off on or our she that the their them then there they this to up was we were with you your".split())
LETTERS = LOCAL - frozenset("0123456789._%+-")
SCHEME = LETTERS | frozenset("0123456789+.-")
AUTHORITY = re.compile(r"[^\s/?#<>\"'@]+@[A-Za-z0-9.\[\]:-]+")
SPELLED_HOST = re.compile(r" ?[A-Za-z0-9-]+(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}) ?[A-Za-z0-9-]+)+")
NUMBER = re.compile(r"(?: ?(?:number|no\.?|num|nr\.?|#))?(?: ?[:#=]| is)? ?((?-i:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})|[0-9](?:[ -]?[0-9])+)", re.IGNORECASE | re.ASCII)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _iban(text: str) -> bool:
    code = text.replace(" ", "").upper()
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def house(text: str, at: int, low: int, capital: bool) -> tuple[int, int]:
    """Where the address begins whose street word follows the space at ``at``, or -1, and the number of its names.

    Names are words of letters, one space apart, each with a capital if the street word has one; before them stands a house number,
    digits with a letter at most. There may be any number of names, of any length; nothing before ``low`` is looked at.
    """
    here, names = at, 0
    while here > low:
        start = here
        while start > low and (text[start - 1].isalpha() or text[start - 1] in "'.-"):
            start -= 1
        word = text[start:here]
        fits = word[:1].isalpha() and start > low and text[start - 1] == " " and (any(map(str.isupper, word)) if capital else word.lower() not in PROSE)
        if not fits:
            break
        here, names = start - 1, names + 1
    stop = here - (here - 1 > low and text[here - 1] in LETTERS and text[here - 2] in DIGITS)
    start = stop
    while start > low and text[start - 1] in DIGITS:
        start -= 1
    whole = names and start < stop and text[start] != "0" and not (start and text[start - 1].isalnum())
    return (start if whole else -1), names


_automata: list = []


def _anchors():
    """The automaton, built once in a worker."""
    if _automata:
        return _automata[0]
    import ahocorasick

    found = ahocorasick.Automaton()
    words = {"@": "@", "://": "://"} | {d: "digit" for d in DIGITS} | {f"+{d}": "+" for d in DIGITS}
    words |= {w: "at" for w in AT_WORDS} | {f" {form}": kind for w in STREETS for form, kind in ((w, "street"), (w.upper(), "street"), (w.lower(), "lower street"))}
    words |= {form: "account" for w in ACCOUNTS for form in (w, w.capitalize(), w.upper())}
    for word, kind in words.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    _automata.append(found)
    return found


def spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of everything found, by kind and start; kinds are positions in ``KINDS``, offsets code points."""
    out = []
    done = dict.fromkeys(("@", "ip", "card", "+", "at", "street", "account"), 0)  # where the last match of a kind ended
    bare = {"street": 0, "lower street": 0}  # where the last names without a house number ended: longer ones have none either
    for last, (anchor, size) in _anchors().iter(text):
        at, end = last - size + 1, last + 1
        if anchor == "digit":
            if at >= done["ip"] and not (at and text[at - 1] in DIGITS) and (m := IP.match(text, at)):
                done["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    out.append((1, at, m.end()))
            if at >= done["card"] and (m := CARD.match(text, at)):
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "") if m.end() - at <= 37 else ""
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, at, m.end()))
        elif anchor == "@":
            start = at
            while start > done["@"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, end)):
                done["@"] = m.end()
                out.append((0, start, m.end()))
        elif anchor == "+":
            if at >= done["+"] and (m := PHONE.match(text, at)):
                done["+"] = m.end()
                if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                    out.append((3, at, m.end()))
        elif anchor == "://":
            start = at
            while start and text[start - 1] in SCHEME:
                start -= 1
            while start < at and text[start] not in LETTERS:
                start += 1
            if start < at and (m := AUTHORITY.match(text, end)):
                out.append((4, start, m.end()))
        elif anchor == "at":
            start = stop = at - (at > done["at"] and text[at - 1] == " ")
            while start > done["at"] and text[start - 1] in LOCAL:
                start -= 1
            if start < stop and (m := SPELLED_HOST.match(text, end)):
                done["at"] = m.end()
                out.append((5, start, m.end()))
        elif anchor in bare:
            if not text[end : end + 1].isalnum() and at >= done["street"]:
                start, names = house(text, at, max(done["street"], bare[anchor]), anchor == "street")
                if start >= 0:
                    done["street"] = end
                    out.append((6, start, end))
                elif names:
                    bare[anchor] = at
        elif at >= done["account"] and not (at and text[at - 1].isalnum()) and not text[end : end + 1].isalpha():
            m = NUMBER.match(text, end)
            if m:
                number = m[1]
                digits = re.sub(r"[ -]", "", number)
                cue = text[at:end].lower()
                if _iban(number) if number[0].isalpha() else len(digits) == 9 if cue == "ssn" else cue != "iban" and 6 <= len(digits) <= 17:
                    done["account"] = m.end()
                    out.append((7, m.start(1), m.end()))
    return sorted(out)


def personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each row of ``docs``: doc_id and ``SCHEMA``: counts by kind, a hash of the base spans, and all spans.

    Spans read kind:start:end, comma-joined, by kind as listed in ``KINDS``, then start. A null text counts as empty and
    has none. Null keys and repeated rows give a row each; an empty table gives an empty one. Texts are never cut.
    """
    rows = picked(docs, doc_id=F.col(key), text=F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            columns: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
            for t in batch.column(1).to_pylist():
                found = spans(t) if t else []
                listed = [f"{KINDS[k]}:{a}:{z}" for k, a, z in found]
                counts = [0] * len(KINDS)
                for k, _, _ in found:
                    counts[k] += 1
                for kind, n in zip(KINDS, counts, strict=True):
                    columns[f"n_{kind}"].append(n)
                columns["base_sha256"].append(hashlib.sha256(",".join(listed[: sum(counts[: len(BASE)])]).encode()).hexdigest())
                columns["spans"].append(",".join(listed))
            arrays = [pa.array(v, pa.int64() if k.startswith("n_") else pa.string()) for k, v in columns.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *columns])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
