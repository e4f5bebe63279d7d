"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is the product of its letters' vectors, rotated by their
position; a document is the sum of its trigrams' vectors, a language the sum of its documents' unit vectors. A document
gets the language whose prototype has the largest cosine with it. Letters are those of Unicode, in lower case; whatever
stands between them counts as one boundary letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import chunks, held_out, picked, portions, small

DIMENSIONS = 1024
SEED = 20_240_607
#: Documents that prototypes are learned from, for each language, about; chosen by a hash of their id.
SAMPLE = 2000
#: Trigram vectors held at a time, and documents of a step.
BLOCK, STEP_DOCS = 8192, 1024
UNKNOWN = "und"

_vectors: dict[int, np.ndarray] = {}
_letters: list[np.ndarray] = []


def letter_vector(code: int) -> np.ndarray:
    """The random vector of a code point; 0 stands for the boundary."""
    if code not in _vectors:
        if len(_vectors) > 8192:
            _vectors.clear()
        _vectors[code] = (np.random.default_rng((SEED, code)).integers(0, 2, DIMENSIONS) * 2 - 1).astype(np.float32)
    return _vectors[code]


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of document and trigram with their counts, by document. A trigram is three code points of 21 bits.

    Trigrams whose middle is a boundary are left out: they say nothing about a word.
    """
    raw = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    sizes = np.array([len(r) + 2 for r in raw])
    codes = np.zeros(int(sizes.sum()), dtype=np.int64)
    ends = np.cumsum(sizes)
    for r, end in zip(raw, ends.tolist(), strict=True):
        codes[end - 1 - len(r) : end - 1] = r
    doc = np.repeat(np.arange(len(texts)), sizes)
    codes[~_is_letter()[codes]] = 0
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (doc[1:] != doc[:-1])
    codes, doc = codes[keep], doc[keep]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    used = np.flatnonzero((codes[1:-1] != 0) & (doc[:-2] == doc[2:]))
    letters = np.zeros(int(codes.max()) + 1, dtype=np.int64)
    alphabet = np.flatnonzero(np.bincount(codes))
    letters[alphabet] = np.arange(len(alphabet))
    n = len(alphabet)
    small_codes = letters[codes]
    key = ((doc[used] * n + small_codes[used]) * n + small_codes[used + 1]) * n + small_codes[used + 2]
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    trigram = (alphabet[key // (n * n) % n] << 42) | (alphabet[key // n % n] << 21) | alphabet[key % n]
    return key // n**3, trigram, count


def bundles(texts: list[str]) -> np.ndarray:
    """The documents' vectors, a row each; zeros for a text without letters."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    doc, trigram, count = _trigrams(texts)
    known, place = np.unique(trigram, return_inverse=True)
    order = np.lexsort((doc, place // BLOCK)) if len(known) > BLOCK else np.arange(len(doc))
    doc, place, count = doc[order], place[order], count[order].astype(np.float32)
    block = place // BLOCK
    for b in range(-(-len(known) // BLOCK)):
        part = known[b * BLOCK : (b + 1) * BLOCK]
        vectors = np.ones((len(part), DIMENSIONS), dtype=np.float32)
        for position, shift in enumerate((42, 21, 0)):
            codes, where = np.unique((part >> shift) & 0x1FFFFF, return_inverse=True)
            vectors *= np.stack([np.roll(letter_vector(c), 2 - position) for c in codes.tolist()])[where]
        lo, hi = np.searchsorted(block, [b, b + 1])
        starts = lo + np.flatnonzero(np.concatenate([[True], doc[lo + 1 : hi] != doc[lo : hi - 1]])) if hi > lo else []
        for a, z in zip(starts, [*starts[1:], hi], strict=True):
            out[doc[a]] += count[a:z] @ vectors[place[a:z] - b * BLOCK]
    return out


def _steps(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """First index and unit vectors of the documents, step by step."""
    filled = [t or "" for t in texts]
    for a, z in chunks(filled):
        for at in range(a, z, STEP_DOCS):
            vectors = bundles(filled[at : min(z, at + STEP_DOCS)])
            norm = np.linalg.norm(vectors, axis=1, keepdims=True)
            yield at, vectors / np.where(norm > 0, norm, 1)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Language -> prototype, from about ``sample`` documents of each language that are not held out.

    Null languages and null texts teach nothing. Sums are formed by partition and then by language and dimension; what
    comes to the driver is a vector per language.
    """
    taught = docs.filter(~held_out(F.col(key)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    share = small(taught.groupBy(F.col(lang).alias("language")).agg(F.least(F.lit(1.0), F.lit(float(sample)) / F.count("*")).alias("share")))
    chance = F.pmod(F.xxhash64(F.lit("sample"), F.col(key).cast("string")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    rows = taught.select(F.col(lang).alias("language"), F.col(text).alias("text"), chance.alias("chance")).join(share, "language").filter("chance < share").select("language", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in portions(batches):
            names, texts = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_pylist()
            for at, vectors in _steps(texts):
                for name in set(names[at : at + len(vectors)]):
                    total = vectors[names[at : at + len(vectors)] == name].sum(axis=0, dtype=np.float64)
                    sums[name] = sums.get(name, 0) + total
        for name, total in sums.items():
            yield pa.RecordBatch.from_pydict({"language": [name], "v": [np.rint(total * 1e6).astype(np.int64)]})

    parts = rows.mapInArrow(run, "language string, v array<long>")  # whole numbers: sums don't depend on the order
    summed = parts.select("language", F.posexplode("v").alias("d", "x")).groupBy("language", "d").agg(F.sum("x").alias("x"))
    got = summed.groupBy("language").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("v")).collect()
    out = {r["language"]: np.array([x["x"] for x in r["v"]], dtype=np.float64) for r in got}
    return {k: v / np.linalg.norm(v) for k, v in sorted(out.items()) if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred and score (the cosine, at least 0) for every row of ``docs``.

    ``und`` with score 0 for a null text, a text without letters, or if no language was learned. Null keys count as
    held out. Repeated rows give a row each; an empty table an empty one. Texts are never cut.
    """
    rows = picked(docs, doc_id=F.col(key), held_out=held_out(F.col(key)), text=F.col(text))
    names, matrix = list(prototypes), np.array(list(prototypes.values()), dtype=np.float32).reshape(-1, DIMENSIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            found, scores = [], []
            for _, vectors in _steps(batch.column(2).to_pylist()):
                cosines = vectors @ matrix.T if names else np.zeros((len(vectors), 1))
                best = cosines.argmax(axis=1)
                some = vectors.any(axis=1) & bool(names)
                found += [names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), some.tolist(), strict=True)]
                scores.append(np.where(some, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0))
            score = np.concatenate(scores).astype(np.float64) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out and predicts all of them."""
    return predict(docs, learn(docs))
