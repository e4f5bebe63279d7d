"""Benchmark decontamination: passages of the corpus search an inverted BM25 index of the benchmark items.

The terms of the index are word 5-grams: what makes an item leak is that a passage holds its 5-grams, and a corpus in the
items' own language shares few of these with them, while it shares nearly all of their words. A table of bits tells which
5-grams of a text any item has, so the cost of a text doesn't grow with the benchmark. Those that are left meet postings
with their largest impact in each short block. Where the largest impacts of a passage's terms add up to the threshold,
block-max WAND runs for many passages side by side: the lists of a passage are ordered by the item they stand at, the
first item that the lists up to it could lift to the threshold is the pivot, and the lists before it skip to the pivot,
or beyond the blocks that can't reach it.

What is found is verified by the word 5-grams of the item's question and answer that the passage holds. The threshold
follows from that rule: for each item it is the least BM25 score of any passage that would pass, so the search loses none.
Impacts are divided by it, and one threshold of 1 serves all items.

The index is built and written by tasks, in groups of items, to files in the shared folder, which workers map where it is
a disk. All groups are searched in one pass over the documents, which are cut into words once and not shuffled.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusmill.llm.common import by_portion, chunks, cut, mixed, new_folder, picked, portions
from corpusmill.llm.token_output import _settings, store_of

K1, B = 1.2, 0.75
#: Least mean share of the question's and the answer's 5-grams that a passage must hold.
OVERLAP = 0.5
GRAM = 5
#: An item of fewer words has too few 5-grams to tell part of it from chance: the passage must hold all of it in one run.
SHORT = 12
#: Words of a segment, at least; a passage is two segments, and a segment is as long as the longest item of its index.
MIN_SEGMENT = 32
#: Postings in a block.
BLOCK = 16
#: Characters of benchmark text in one group, which one task builds. Groups change no result.
GROUP_CHARS = 8_000_000
#: Bits of the table for each 5-gram of the benchmark; bits of a part of it, which one task makes; and bits at most, 64 MB:
#: of a benchmark beyond 16 million 5-grams more of what the table lets through is looked up in vain, nothing is lost.
BITS, PART_BITS, MOST_BITS = 32, 23, 29
#: (passage, list) cells that WAND moves side by side.
CELLS = 1 << 17
#: Sums of 32-bit impacts may fall short of the threshold by so much.
SLACK = 1e-4

_ASCII_BREAKS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_marks = re.compile(rb"\xe2[\x80\x81].|\xe3\x80.|\xef\xbc[\x81-\x8f\x9a-\xa0]")
#: Letters of scripts without spaces; each is a word of its own.
_unspaced = re.compile("[ก-๎ກ-໎က-ဿក-៓ぁ-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")


def words(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII, general and ideographic punctuation separates them."""
    text = (text or "").lower()
    if text.isascii():
        return text.encode().translate(_ASCII_BREAKS).split()
    if _unspaced.search(text):
        text = _unspaced.sub(r" \g<0> ", text)
    return _marks.sub(b" ", text.encode("utf-8", "surrogatepass")).translate(_ASCII_BREAKS).split()


def parts(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer: what stands up to the last question mark and after it, or else two halves."""
    at = max(text.rfind("?"), text.rfind("？"))
    question, answer = words(text[: at + 1]), words(text[at + 1 :])
    if at >= 0 and question and answer:
        return question, answer
    whole = words(text)
    return whole[: (len(whole) + 1) // 2], whole[(len(whole) + 1) // 2 :]


def grams(ws: list, n: int = GRAM) -> set[tuple]:
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


def halves(ws: list, split: int) -> tuple[set[tuple], set[tuple]]:
    """5-grams of the question, the first ``split`` words, and of the answer. One shorter than that borrows from the other.

    Of a short item both are its whole run of words.
    """
    if len(ws) < SHORT:
        return {tuple(ws)}, {tuple(ws)}
    return grams(ws[: max(split, GRAM)]), grams(ws[min(split, len(ws) - GRAM) :])


def overlaps(ws: list, split: int, passage: list) -> tuple[float, float]:
    """Shares of the question's and the answer's 5-grams that a passage holds."""
    have = grams(passage, min(len(ws), GRAM) if len(ws) >= SHORT else len(ws))
    question, answer = halves(ws, split)
    return len(question & have) / len(question), len(answer & have) / len(answer)


def least_score(ws: list, split: int, impact: dict) -> float:
    """A lower bound of the impacts of the 5-grams in any passage that holds enough of the item.

    Each 5-gram is worth its shares of the question and of the answer; those that cost least for what they are worth and
    are enough together, the last one in part, give the bound.
    """
    if len(ws) < SHORT:
        return sum(impact.values()) * (1 - 1e-6)
    question, answer = halves(ws, split)
    worth = {g: (g in question) / len(question) + (g in answer) / len(answer) for g in question | answer}
    need, total = 2 * OVERLAP, 0.0
    for price, g in sorted((impact[g] / w, g) for g, w in worth.items()):
        part = min(worth[g], need)
        total, need = total + price * part, need - part
        if need <= 1e-12:
            break
    return total * (1 - 1e-6)


def gram_keys(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of each run of n words, given the words' hashes."""
    out = mixed(hashes[: max(len(hashes) - n + 1, 0)] + np.uint64(n))
    for i in range(1, n):
        out = mixed(out ^ hashes[i : len(out) + i])
    return out


def word_hashes(ws: Iterator[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, ws), dtype=np.uint64, count=n)


@dataclass
class Index:
    """Items of like length. Postings of a term are those from start[term] to start[term + 1], by item; impacts are over the threshold.

    key: the terms' keys, ascending; words: the items' words, those of item i from edge[i] to edge[i + 1].
    """

    gram: int
    segment: int
    ids: pa.Array
    words: pa.Array
    edge: np.ndarray
    split: np.ndarray
    least: np.ndarray
    key: np.ndarray
    start: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    term_max: np.ndarray
    block_start: np.ndarray
    block_key: np.ndarray
    block_last: np.ndarray
    block_max: np.ndarray
    place: np.ndarray

    def words_of(self, item: int) -> list[bytes]:
        return self.words[int(self.edge[item]) : int(self.edge[item + 1])].to_pylist()


def build(items: list[tuple], df: dict[int, int], n_items: int, mean_length: float) -> list[dict]:
    """The fields of an ``Index`` for each class of lengths. items: (id, text); ``df`` by key; the statistics are the whole benchmark's."""
    classes: dict[tuple, list] = {}
    for item_id, text in items:
        question, answer = parts(text)
        ws = question + answer
        n = min(len(ws), GRAM)
        keys = gram_keys(word_hashes(iter(ws), len(ws)), n).tolist()
        gram_of = {tuple(ws[i : i + n]): k for i, k in enumerate(keys)}
        impact = {k: math.log(1 + (n_items - df[k] + 0.5) / (df[k] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(keys) / mean_length)) for k, c in Counter(keys).items()}
        least = least_score(ws, len(question), {g: impact[k] for g, k in gram_of.items()})
        segment = max(MIN_SEGMENT, 1 << (len(ws) - 1).bit_length())
        classes.setdefault((n, segment), []).append((item_id, ws, len(question), least / sum(impact.values()), [(k, x / least) for k, x in impact.items()]))
    out = []
    for (n, segment), rows in sorted(classes.items()):
        rows.sort(key=lambda r: (len(r[1]), r[1]))
        posted = sorted((k, i, x) for i, r in enumerate(rows) for k, x in r[4])
        key, begin = np.unique(np.array([p[0] for p in posted], dtype=np.uint64), return_index=True)
        start = np.append(begin, len(posted)).astype(np.int64)
        item, impact = np.array([p[1] for p in posted], dtype=np.int32), np.array([p[2] for p in posted], dtype=np.float32)
        n_blocks = -(-np.diff(start) // BLOCK)
        block_start = np.concatenate([[0], np.cumsum(n_blocks)])
        term_of = np.repeat(np.arange(len(key)), n_blocks)
        first = start[term_of] + BLOCK * (np.arange(len(term_of)) - block_start[term_of])
        block_last = item[np.minimum(first + BLOCK, start[term_of + 1]) - 1].astype(np.int64)
        out.append({
            "gram": n,
            "segment": segment,
            "ids": [r[0] for r in rows],
            "words": [w for r in rows for w in r[1]],
            "edge": np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])]),
            "split": np.array([r[2] for r in rows], dtype=np.int32),
            "least": np.array([r[3] for r in rows]),
            "key": key,
            "start": start,
            "item": item,
            "impact": impact,
            "term_max": np.maximum.reduceat(impact, begin),
            "block_start": block_start,
            "block_key": term_of * (len(rows) + 1) + block_last,
            "block_last": block_last,
            "block_max": np.maximum.reduceat(impact, first),
            "place": np.repeat(np.arange(len(key)), np.diff(start)) * (len(rows) + 1) + item,
        })
    return out


def wand(edge: np.ndarray, terms: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, item and score of all that reach the threshold. Row p is a passage with the different terms from edge[p] to edge[p + 1]."""
    n, reach = len(index.ids), 1 - SLACK
    found = []
    rows = np.arange(len(edge) - 1)
    place = np.arange(int(np.diff(edge).max(initial=0)))[None, :]
    real = place < np.diff(edge)[:, None]
    term = np.where(real, terms[np.minimum(edge[:-1, None] + place, max(len(terms) - 1, 0))], 0)
    most = np.where(real, index.term_max[term], np.float32(0))

    def item_at(post: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Where a list stands; n if it has no more."""
        return np.where(post < index.start[term + 1], index.item[np.minimum(post, len(index.item) - 1)], n)

    at = np.where(real, item_at(index.start[term], term), n)
    while len(rows):
        order = np.argsort(at, axis=1)
        reached = np.cumsum(np.take_along_axis(most, order, axis=1), axis=1) >= reach
        pivot = np.take_along_axis(at, np.take_along_axis(order, reached.argmax(axis=1)[:, None], axis=1), axis=1)[:, 0]
        alive = reached[:, -1] & (pivot < n)
        if not alive.all():
            rows, term, most, at, pivot = (x[alive] for x in (rows, term, most, at, pivot))
            if not len(rows):
                break
        r, c = np.nonzero(at <= pivot[:, None])
        t, d = term[r, c], pivot[r]
        block = np.searchsorted(index.block_key, t * (n + 1) + d)
        more = block < index.block_start[t + 1]
        block = np.minimum(block, len(index.block_key) - 1)
        good = np.bincount(r, np.where(more, index.block_max[block], 0), len(rows)) >= reach
        # rows whose blocks can't reach the threshold go on behind the first of them that ends, or at the next list's item
        beyond = np.where(at > pivot[:, None], at, n).min(axis=1)
        np.minimum.at(beyond, r, np.where(more, index.block_last[block] + 1, n))
        target = np.where(good, pivot, beyond)[r]
        post = np.searchsorted(index.place, t * (n + 1) + target)
        inside = post < index.start[t + 1]
        post = np.minimum(post, len(index.place) - 1)
        hit = inside & good[r] & (index.item[post] == d)
        score = np.bincount(r, np.where(hit, index.impact[post], 0), len(rows))
        best = np.flatnonzero(good & (score >= reach))
        found.append((rows[best], pivot[best], score[best]))
        at[r, c] = item_at(np.where(inside, post + hit, index.start[t + 1]), t)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all the ranges, one range after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def search(n_words: np.ndarray, at: np.ndarray, keys: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, float]]:
    """(document, first word of the passage, item, score) of all passages and items at the threshold or above.

    ``at`` and ``keys``: places among the documents' words, one document after the other, of terms that may be the index's.
    Passages start at every segment, so that any copy of an item lies inside one; they hold the terms that end in them.
    """
    term = np.minimum(np.searchsorted(index.key, keys), len(index.key) - 1)
    known = index.key[term] == keys
    at, term = at[known], term[known]
    n_segments = -(-n_words // index.segment)
    base = np.cumsum(n_segments) - n_segments
    ends = np.cumsum(n_words)
    doc = np.searchsorted(ends, at, side="right")
    place = at - (ends - n_words)[doc]
    segment = base[doc] + place // index.segment
    size, n_terms = int(n_segments.sum()), len(index.key)
    earlier = (place >= index.segment) & (place % index.segment + index.gram <= index.segment)  # in the passage that starts a segment before, too
    pairs = np.unique(np.concatenate([segment * n_terms + term, (segment[earlier] - 1) * n_terms + term[earlier]]))
    passage, term = pairs // n_terms, pairs % n_terms
    alive = np.flatnonzero(np.bincount(passage, index.term_max[term], minlength=size) >= 1 - SLACK)
    edge = np.searchsorted(passage, np.arange(size + 1))
    lengths = (edge[1:] - edge[:-1])[alive]
    order = np.argsort(lengths, kind="stable")  # rows side by side have like many lists
    owner = np.repeat(np.arange(len(n_words)), n_segments)
    stop = len(order)
    while stop:
        start = max(0, stop - max(1, CELLS // int(lengths[order[stop - 1]])))
        side = order[start:stop]
        row, item, score = wand(np.concatenate([[0], np.cumsum(lengths[side])]), term[_ranges(edge[alive[side]], lengths[side])], index)
        for k in range(len(row)):
            here = int(alive[side[row[k]]])
            yield int(owner[here]), (here - int(base[owner[here]])) * index.segment, int(item[k]), float(score[k])
        stop = start


class Benchmark:
    """The index in a worker: a table of bits, and an ``Index`` for each group and class of lengths."""

    def __init__(self, bits: np.ndarray, indexes: list[Index]):
        self.bits, self.shift = bits, np.uint64(64 - 3 - (len(bits).bit_length() - 1))
        self.indexes = indexes

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys that some item may have."""
        slot = keys >> self.shift
        return np.flatnonzero(self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)

    def leaks(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text (item id, first word of the passage, score, question overlap, answer overlap), one per item at most."""
        out: list[dict] = [{} for _ in texts]
        for a, z in chunks([t or "" for t in texts]):
            split = [words(t) for t in texts[a:z]]
            n_words = np.array([len(ws) for ws in split])
            hashes = word_hashes(chain.from_iterable(split), int(n_words.sum()))
            doc = np.repeat(np.arange(len(split)), n_words)
            for gram in sorted({index.gram for index in self.indexes}):
                keys = gram_keys(hashes, gram)
                at = self.may_have(keys)
                at = at[doc[at] == doc[at + gram - 1]]
                for n, index in enumerate(self.indexes):
                    if index.gram != gram or not len(at):
                        continue
                    for d, start, item, score in search(n_words, at, keys[at], index):
                        shares = overlaps(index.words_of(item), int(index.split[item]), split[d][start : start + 2 * index.segment])
                        if sum(shares) / 2 >= OVERLAP:
                            found = (index.ids[item].as_py(), start, score * float(index.least[item]), *shares)
                            held = out[a + d]
                            if (n, item) not in held or (sum(shares), found[2], -start) > (sum(held[n, item][3:]), held[n, item][2], -held[n, item][1]):
                                held[n, item] = found
        return [list(x.values()) for x in out]


NUMBERS = {"edge": "int64", "split": "int32", "least": "float64", "key": "uint64", "start": "int64", "item": "int32", "impact": "float32", "term_max": "float32", "block_start": "int64", "block_key": "int64", "block_last": "int64", "block_max": "float32", "place": "int64"}


@dataclass
class Files:
    """An index in the shared folder, as plain data: what a worker needs to open it."""

    folder: str
    settings: dict
    bits: int
    parts: list
    groups: list

    def open(self) -> Benchmark:
        """Maps the files where the folder is a disk, else reads them."""
        store, root = store_of(self.folder, self.settings)

        def source(name: str):
            path = f"{root}/{name}"
            return pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else pa.BufferReader(store.open_input_file(path).read())

        bits = np.zeros(1 << (self.bits - 3), dtype=np.uint8)
        for part, name in self.parts:
            held = np.frombuffer(source(name).read_buffer(), dtype=np.uint8)
            bits[part * len(held) : (part + 1) * len(held)] = held
        indexes = []
        for gram, segment, name in self.groups:
            row = pa.ipc.open_file(source(name)).get_batch(0)
            fields = {n: row.column(n)[0].values for n in ("ids", "words", *NUMBERS)}
            indexes.append(Index(gram, segment, **{n: v.to_numpy() if n in NUMBERS else v for n, v in fields.items()}))
        return Benchmark(bits, indexes)


def _write(store: fs.FileSystem, path: str, index: dict, id_type: pa.DataType) -> None:
    kinds = {"ids": id_type, "words": pa.binary(), **{n: pa.type_for_alias(k) for n, k in NUMBERS.items()}}
    row = pa.RecordBatch.from_arrays([pa.array([index[n]], pa.list_(k)) for n, k in kinds.items()], list(kinds))
    with store.open_output_stream(path) as out, pa.ipc.new_file(out, row.schema) as file:
        file.write_batch(row)


def write_index(benchmark: DataFrame, text: str = "text", key: str = "item_id") -> Files | None:
    """Builds the index in the shared folder; None if no item has a word. Repeated rows count once.

    Statistics cover the whole benchmark. A group of about ``GROUP_CHARS`` of text at most is the work of one task, which
    returns the names of its files: a task that is tried again writes others. The driver keeps a name per group and class.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(key).alias("item_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).dropDuplicates()
    numbered = cut(items.withColumn("item", F.monotonically_increasing_id()))

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            split = [words(t) for t in batch.column(1).to_pylist()]
            keys = [gram_keys(word_hashes(iter(ws), len(ws)), min(len(ws), GRAM)) if ws else np.zeros(0, np.uint64) for ws in split]
            terms = pa.array([np.unique(k).view(np.int64) for k in keys], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(k) for k in keys], pa.int64()), terms], ["item", "n", "terms"])

    split = cut(numbered.select("item", "text").mapInArrow(tokenised, "item long, n long, terms array<long>").filter("n > 0"))
    n_items, mean = split.agg(F.count("*"), F.avg("n")).first()
    if not n_items:
        return None
    folder = new_folder(spark, "benchmark")
    settings, id_type = _settings(spark, folder), to_arrow_type(benchmark.schema[key].dataType)
    n_groups = -(-numbered.agg(F.sum(F.length("text"))).first()[0] // GROUP_CHARS)
    posted = split.select("item", F.explode("terms").alias("term"))
    df = cut(posted.groupBy("term").agg(F.count("*").alias("df")))
    counted = posted.join(df, "term").groupBy("item").agg(F.collect_list(F.struct("term", "df")).alias("p"))
    rows = numbered.join(counted, "item").select(F.pmod(F.xxhash64("item"), F.lit(n_groups)).alias("shard"), "item_id", "text", F.col("p.term").alias("terms"), F.col("p.df").alias("dfs"))
    place = lambda name: (*store_of(folder, settings), f"{name}-{uuid.uuid4().hex}")

    def built(group: pa.Table) -> pa.Table:
        counts: dict[int, int] = {}
        for terms, n in zip(group["terms"], group["dfs"], strict=True):
            counts.update(zip((t % (1 << 64) for t in terms.as_py()), n.as_py(), strict=True))
        pairs = sorted(zip(group["item_id"].to_pylist(), group["text"].to_pylist(), strict=True), key=lambda x: (x[0] is None, x))
        names = []
        for index in build(pairs, counts, n_items, mean):
            store, root, name = place("index")
            store.create_dir(root, recursive=True)
            _write(store, f"{root}/{name}", index, id_type)
            names.append((index["gram"], index["segment"], name))
        return pa.table(dict(zip(("gram", "segment", "name"), (pa.array(c) for c in zip(*names, strict=True)), strict=True)))

    groups = [tuple(r) for r in cut(rows.groupBy("shard").applyInArrow(built, "gram long, segment long, name string")).orderBy("gram", "segment", "name").collect()]
    bits = min(MOST_BITS, max(16, (BITS * df.count() - 1).bit_length()))
    part_bits = min(bits, PART_BITS)

    def marked(group: pa.Table) -> pa.Table:
        slot = group["term"].to_numpy().view(np.uint64) >> np.uint64(64 - bits)
        flags = np.zeros(1 << part_bits, dtype=bool)
        flags[(slot & np.uint64((1 << part_bits) - 1)).astype(np.int64)] = True
        store, root, name = place("bits")
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{name}") as out:
            out.write(np.packbits(flags, bitorder="little").tobytes())
        return pa.table({"part": group["part"][:1].cast(pa.int64()), "name": [name]})

    slots = df.select("term", F.shiftrightunsigned("term", 64 - bits + part_bits).alias("part") if bits > part_bits else F.lit(0).cast("long").alias("part"))
    return Files(folder, settings, bits, [tuple(r) for r in cut(slots.groupBy("part").applyInArrow(marked, "part long, name string")).collect()], groups)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """A row for each document and benchmark item that it holds: doc_id, item_id, passage_start, bm25, question_overlap, answer_overlap.

    ``bm25`` is a share of the item's own score. Null and empty texts hold nothing, and null and empty items are in
    nothing; nor does any text hold any item if the benchmark is empty. Repeated rows and null keys of documents give
    their rows alike. Whole texts are searched. Sorted within a document by item.
    """
    rows = picked(docs, doc_id=F.col(key), text=F.col(text))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    item_field = benchmark.schema[item_key]
    schema = f"doc_id {id_type}, item_id {item_field.dataType.simpleString()}, passage_start long, bm25 double, question_overlap double, answer_overlap double"
    kinds = (to_arrow_type(item_field.dataType), pa.int64(), *[pa.float64()] * 3)

    index = write_index(benchmark, key=item_key)
    if index is None:
        return docs.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = None
        for batch in portions(batches):
            items = items or index.open()
            found = items.leaks(batch.column(1).to_pylist())
            at = [i for i, rows in enumerate(found) for _ in rows]
            columns = list(zip(*(r for rows in found for r in sorted(rows, key=repr)), strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))],
                ["doc_id", "item_id", "passage_start", "bm25", "question_overlap", "answer_overlap"],
            )

    return rows.mapInArrow(run, schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item.

    Rows with a null or empty text stay, as do all rows if the benchmark is empty; repeated rows stay or go together.
    """
    index = write_index(benchmark)
    if index is None:
        return docs
    held: list[Benchmark] = []  # filled once in a worker

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(index.open())
        return by_portion(texts, lambda part: [not found for found in held[0].leaks(part)], pa.bool_())

    return docs.filter(clean(F.col(text)))
