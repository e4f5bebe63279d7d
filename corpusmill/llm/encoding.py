"""Encoding whole texts with a tokenizer file, in tasks."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Encoded pieces that a worker remembers after meeting them in one step only, and after meeting them in two or more.
#: Most different pieces occur once; kept apart, they don't push out those that come back.
TRIED, STEADY = 150_000, 300_000
#: Longer pieces, in bytes, aren't remembered.
LONG = 64
#: Bytes of text in a step, about; a longer text is a step of its own.
STEP_BYTES = 1 << 20

#: What a byte-level pre-tokenizer tells apart. 0: not asked for yet.
SPACE, LETTER, NUMBER, OTHER = 1, 2, 3, 4

#: How byte-level tokenizers write bytes: printable ones as they are, the others from U+0100 on.
_printed = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_written = np.arange(256, dtype="<u4")
_written[np.setdiff1d(np.arange(256), _printed)] = np.arange(256, 512 - len(_printed))


def steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``STEP_BYTES`` each; no text is split."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_numpy().tolist()):
        if i > start and size + n > STEP_BYTES:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


class Encoder:
    """Texts -> token ids as little-endian unsigned integers, equal to what the tokenizer gives for the whole text.

    A byte-level pre-tokenizer cuts texts into pieces, and merges never cross pieces. So texts are cut in one go as columns
    of characters, and the tokenizer's model encodes each different piece once; of which kind a character is, the
    pre-tokenizer itself says. Texts that hold an added token, and tokenizers of other kinds, are encoded in one go.
    """

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(1000)  # each piece comes once: a larger cache costs more than it saves
        self.vocabulary = self.tokenizer.get_vocab_size()
        #: The type of the ids in ``encode_column``.
        self.kind = "<u2" if self.vocabulary <= 1 << 16 else "<u4"
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.kinds = np.zeros(0x110000, dtype=np.uint8)
        self.tried: dict[bytes, bytes] = {}
        self.steady: dict[bytes, bytes] = {}

    def _whole(self, texts: list[str], kind: str = "<u4") -> list[bytes]:
        return [np.array(e.ids, dtype=kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _kinds(self, characters: np.ndarray) -> np.ndarray:
        """Of which kind each character is: it makes one piece with a letter, a number or another character, or is white space."""
        kinds = self.kinds[characters]
        if not kinds.all():
            joins = lambda c, x: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(c + x)) == 1
            for x in np.unique(characters[kinds == 0]).tolist():
                self.kinds[x] = next((kind for c, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)) if joins(c, chr(x))), SPACE)
            kinds = self.kinds[characters]
        return kinds

    def _cuts(self, characters: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Whether a piece starts at each character; ``begins`` says where texts do. In the pre-tokenizer's words:
        ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``."""
        n, kinds = len(characters), self._kinds(characters)
        white = kinds == SPACE
        cuts = begins.copy()
        # another kind than before, except after a space, which goes with what follows
        cuts[1:] |= (kinds[1:] != kinds[:-1]) & (characters[:-1] != 32)
        cuts[1:] |= white[1:] & ~white[:-1]
        # the last of several white ones, if something follows
        cuts[1:-1] |= white[:-2] & white[1:-1] & ~white[2:] & ~begins[2:]
        at = np.flatnonzero((characters[:-1] == 39) & cuts[:-1] & ~begins[1:]) if n else np.zeros(0, dtype=np.int64)
        after = characters[at + 1]
        short = at[np.isin(after, [ord(c) for c in "stmd"])]
        at, after = at[(at + 2 < n)], after[(at + 2 < n)]
        pair = (after << 8) | characters[at + 2]
        long = at[np.isin(pair, [ord(c) << 8 | ord(d) for c, d in ("re", "ve", "ll")]) & ~begins[at + 2]] if len(at) else at
        for found, length in ((short, 2), (long, 3)):
            cuts[found + 1] = False
            cuts[(found + length)[found + length < n]] = True
        return cuts

    def _by_model(self, pieces: list[bytes]) -> list[bytes]:
        """Encodings of pieces, by the model alone."""
        raw = b"".join(pieces)
        written = _written[np.frombuffer(raw, dtype=np.uint8)].tobytes().decode("utf-32-le")
        ids, edges = [], [0]
        for a, z in pairwise(np.cumsum([0, *map(len, pieces)]).tolist()):
            ids += [t.id for t in self.model.tokenize(written[a:z])]
            edges.append(len(ids))
        raw, width = np.array(ids, dtype=self.kind).tobytes(), int(self.kind[2])
        return [raw[width * a : width * z] for a, z in pairwise(edges)]

    def _forget(self) -> None:
        """Keeps the memory bounded. Steady pieces not added lately must be met again to stay."""
        if len(self.steady) > STEADY:
            half = len(self.steady) // 2
            self.tried |= islice(self.steady.items(), half)
            self.steady = dict(islice(self.steady.items(), half, None))
        if len(self.tried) > TRIED:
            self.tried = dict(islice(self.tried.items(), len(self.tried) - TRIED // 2, None))

    def _remembered(self, pieces: list[bytes]) -> list[bytes]:
        """Encodings of different pieces; those that no earlier step left are made."""
        steady, tried = self.steady, self.tried
        found = list(map(steady.get, pieces))
        lost = [p for p, ids in zip(pieces, found, strict=True) if ids is None]
        again = {p: tried.pop(p) for p in lost if p in tried}
        steady.update(again)
        new = [p for p in lost if p not in again] if again else lost
        made = dict(zip(new, self._by_model(new), strict=True))
        tried.update(made if max(map(len, new), default=0) <= LONG else {p: ids for p, ids in made.items() if len(p) <= LONG})
        made |= again
        return [made[p] if ids is None else ids for p, ids in zip(pieces, found, strict=True)]

    def _joined(self, texts: pa.Array) -> pa.Array:
        """Encodings of texts without nulls, piece by piece."""
        edges = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2].slice(int(edges[0]), int(edges[-1] - edges[0])) if edges[-1] > edges[0] else pa.py_buffer(b"")
        edges = edges - edges[0]
        characters = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), dtype="<u4")
        places = np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)  # bytes where characters start
        begins = np.zeros(len(characters), dtype=bool)
        begins[np.searchsorted(places, edges[:-1][np.diff(edges) > 0])] = True
        starts = np.append(places[self._cuts(characters, begins)], edges[-1]).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), data]).dictionary_encode()
        each = self._remembered(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = pa.array(each, pa.binary()).take(pieces.indices)
        ends = np.frombuffer(ids.buffers()[1], dtype=np.int32)[np.searchsorted(starts, edges)]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), ids.buffers()[2]])

    def encode_column(self, texts: pa.Array) -> pa.Array:
        """The ids of each text of a column, as bytes of ``kind``; a null is an empty text. ``steps`` says what to give at a time."""
        texts = texts.cast(pa.string()).fill_null("")
        if not self.by_piece:
            return pa.array(self._whole(texts.to_pylist(), self.kind), pa.binary())
        self._forget()
        one = np.zeros(len(texts), dtype=bool)  # texts that hold an added token
        for token in self.added:
            one |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not one.any():
            return self._joined(texts)
        whole = pa.array(self._whole(texts.filter(pa.array(one)).to_pylist(), self.kind), pa.binary())
        order = np.argsort(np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)]))
        return pa.concat_arrays([self._joined(texts.filter(pa.array(~one))), whole]).take(pa.array(order))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers."""
        return [np.frombuffer(ids, dtype=self.kind).astype("<u4").tobytes() for ids in self.encode_column(pa.array(texts, pa.string())).to_pylist()]


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder for a tokenizer file; None for the byte-level BPE of about 50,000 ids."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
