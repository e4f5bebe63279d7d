"""Quality rules: how much of a text lies inside n-grams and lines that the text repeats.

Word ids are mixed into 64-bit values and rolled into hashes of every n-gram length with numpy, for many documents
at once. Windows with equal hashes are compared word by word, so a hash collision can't change a count.
The work is row-local: no shuffle, and memory is bounded by ``CHUNK_CHARS`` or one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import by_portion, chunks, picked, portions

#: n-gram length in words -> largest share of the word characters that repeated n-grams of this length may cover.
LIMITS = {5: 0.40, 8: 0.35, 12: 0.30}
#: Largest share of the word characters in lines equal to an earlier line.
LINE_LIMIT = 0.30
MIN_WORDS = 20
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
BASE = np.uint64(0x9E3779B97F4A7C15)

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, dup_line_share double, " + ", ".join(f"dup_{n}gram_share double" for n in LIMITS)
)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64: neighbouring ids become unrelated 64-bit values."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _repeated(keys: np.ndarray, starts: np.ndarray, ids: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The window starts, of ``starts``, whose n words occur at another start of the same document too."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    twin = np.flatnonzero(ordered[1:] == ordered[:-1])
    if not len(twin):
        return starts[:0]
    a, b = starts[order[twin]], starts[order[twin + 1]]
    same = doc[a] == doc[b]
    for k in range(n):
        same &= ids[a + k] == ids[b + k]
    if same.all():
        return np.unique(np.concatenate([a, b]))
    seen: dict[tuple, list[int]] = {}  # two different windows have one hash: group the windows in doubt by their words
    for s in np.unique(np.concatenate([a, b])).tolist():
        seen.setdefault((doc[s], *ids[s : s + n].tolist()), []).append(s)
    return np.array(sorted(s for group in seen.values() if len(group) > 1 for s in group), dtype=starts.dtype)


def _lines(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and the word characters in them."""
    seen, n, size = set(), 0, 0
    if "\n" in text:
        for line in text.split("\n"):
            raw = line.encode("utf-8", "surrogatepass").split()
            if raw:
                if line in seen:
                    n += 1
                    size += sum(len(w.decode("utf-8", "surrogatepass")) for w in raw)
                seen.add(line)
    return n, size


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The columns of ``FIELDS`` for a list of texts; null counts as the empty text."""
    texts = [t or "" for t in texts]
    parts = [_measure(texts[a:b]) for a, b in chunks(texts)] or [_measure([])]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _measure(texts: list[str]) -> dict[str, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    split = [b.split() for b in raw]  # bytes split on just the six ASCII white-space characters
    n_words = np.array([len(w) for w in split], dtype=np.int64)
    words = [w for ws in split for w in ws]
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))
    sizes = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in index), dtype=np.int64, count=len(index))[ids]
    ends = np.cumsum(n_words)
    begins = ends - n_words
    doc = np.repeat(np.arange(len(texts)), n_words)

    def per_doc(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[ends] - total[begins]

    word_chars = per_doc(sizes)
    left = np.repeat(ends, n_words) - np.arange(len(words))  # words from here to the document's end
    value, of_doc = _mix(ids), _mix(doc + (1 << 40))
    covered, rolled, length = {}, value, 1
    for n in sorted({*LIMITS, WINDOW}):
        while length < n:  # H(i, n) = H(i, n - 1) * BASE + value(i + n - 1)
            rolled = rolled[:-1] * BASE + value[length:] if len(rolled) else rolled
            length += 1
        starts = np.flatnonzero(left >= n)
        found = _repeated(rolled[starts] ^ of_doc[starts], starts, ids, doc, n)
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        edge[found] += 1
        np.add.at(edge, found + n, -1)
        covered[n] = np.cumsum(edge[:-1]) > 0
    lines = [_lines(t) for t in texts]
    out = {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": np.array([len(b) - len(b.translate(None, SYMBOLS)) for b in raw], dtype=np.int64),
        "n_dup_lines": np.array([n for n, _ in lines], dtype=np.int64),
        "n_repeat_words": per_doc(covered[WINDOW]),
    }
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > 30 * n_words)
    share = {"dup_line_share": np.array([size for _, size in lines], dtype=np.int64) / np.maximum(word_chars, 1)}
    share |= {f"dup_{n}gram_share": per_doc(np.where(covered[n], sizes, 0)) / np.maximum(word_chars, 1) for n in LIMITS}
    bad = share["dup_line_share"] > LINE_LIMIT
    for n, most in LIMITS.items():
        bad = bad | (share[f"dup_{n}gram_share"] > most)
    out["kept"] = ~out["base_failed"] & ~bad
    return out | share


def quality_rules(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and the measures of ``FIELDS`` for every row of ``docs``, other columns left out.

    A null or empty text has no words, fails the base rule and isn't kept. Repeated rows and null keys give a row each;
    an empty table gives an empty one. Texts are never cut, however long.
    """
    rows = picked(docs, doc_id=F.col(key), text=F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            got = measure(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, got.values())], ["doc_id", *got])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {FIELDS}")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``quality_rules`` keeps.

    Rows with a null or empty text go; repeated rows stay or go together; an empty table gives an empty one.
    """

    @F.arrow_udf("boolean")
    def kept(texts: pa.Array) -> pa.Array:
        return by_portion(texts, lambda part: measure(part)["kept"], pa.bool_())

    return docs.filter(kept(F.col(text)))


def _sql() -> str:
    """The same rows as SQL. Every row is numbered, so that repeated rows stay apart."""
    covered = "".join(
        rf"""
g{n} AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS times FROM (SELECT r, i, array_to_string(ws[i:i + {n - 1}], ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - {n} + 2)) AS i FROM w))),
c{n} AS (SELECT r, count(*) AS words, sum(length(ws[j])) AS chars FROM (SELECT DISTINCT r, unnest(range(i, i + {n})) AS j FROM g{n} WHERE times > 1) JOIN w USING (r) GROUP BY r),"""
        for n in sorted({*LIMITS, WINDOW})
    )
    shares = ", ".join(f"CAST(coalesce(c{n}.chars, 0) AS DOUBLE) / greatest(word_chars, 1) AS dup_{n}gram_share" for n in LIMITS)
    bad = " OR ".join([f"dup_line_share > {LINE_LIMIT}", *(f"dup_{n}gram_share > {most}" for n, most in LIMITS.items())])
    joins = " ".join(f"LEFT JOIN c{n} USING (r)" for n in sorted({*LIMITS, WINDOW}))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars FROM d),{covered}
l AS (SELECT r, line, row_number() OVER (PARTITION BY r, line) AS times FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM l WHERE times > 1 GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
    coalesce(c{WINDOW}.words, 0) AS n_repeat_words, CAST(coalesce(dup.chars, 0) AS DOUBLE) / greatest(word_chars, 1) AS dup_line_share, {shares}
  FROM w LEFT JOIN dup USING (r) {joins}
), b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT ({bad}) AS kept FROM b
"""


SQL = _sql()
