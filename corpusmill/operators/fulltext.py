"""The full-text query language over a saved index: words, phrases, prefixes, NEAR, columns, AND, OR, NOT and parentheses.

``"a b"`` and ``a + b`` are phrases, ``ab*`` is a prefix, ``title : x`` looks in one column, ``NEAR(a b, 5)`` wants phrases
with at most five words between the first and the last one. Words beside each other must all be there; they bind tighter
than NOT, which binds tighter than AND, and that than OR. Operators are written in capitals. Each part of a query is a set
of chunks from the postings of its own terms, which the index's files are clustered by; parts meet in joins by chunk.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.search import FIELD, folded_tokens

_LEXEME = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([\w\x80-\U0010ffff]+)|([()+*:,]))', re.ASCII)
#: Words between the phrases of NEAR, if the query doesn't say.
NEAR = 10


def _lexemes(query: str) -> list[tuple[str, str]]:
    """(kind, text) of each lexeme: string, word or mark."""
    out, at, query = [], 0, query.rstrip()
    while at < len(query):
        m = _LEXEME.match(query, at)
        if not m:
            raise ValueError(f"The query can't be read from {query[at:][:20]!r} on.")
        kind = "string" if m[1] is not None else "word" if m[2] is not None else "mark"
        out.append((kind, (m[1] or "").replace('""', '"') if kind == "string" else m[2] or m[3]))
        at = m.end()
    return out


class _Reader:
    """Reads a query into nested tuples: ("and" | "or" | "not", left, right), ("phrase", column, words, prefix), ("near", column, phrases, distance)."""

    def __init__(self, query: str):
        self.left = _lexemes(query)

    def _next(self, *texts: str, kind: str | None = None) -> bool:
        return bool(self.left) and (not texts or self.left[0][1] in texts) and (self.left[0][0] == kind if kind else self.left[0][0] != "string")

    def _take(self, text: str) -> None:
        if not self._next(text):
            raise ValueError(f"The query lacks {text!r}.")
        self.left.pop(0)

    def whole(self) -> tuple:
        out = self.level(0)
        if self.left:
            raise ValueError(f"The query has {self.left[0][1]!r} where nothing fits it.")
        return out

    def level(self, depth: int) -> tuple:
        if depth == 3:
            return self.beside()
        name = ("OR", "AND", "NOT")[depth]
        out = self.level(depth + 1)
        while self._next(name, kind="word"):
            self.left.pop(0)
            out = (name.lower(), out, self.level(depth + 1))
        return out

    def beside(self) -> tuple:
        out = self.unit()
        while self.left and not self._next("OR", "AND", "NOT", kind="word") and not self._next(")", ",", kind="mark"):
            out = ("and", out, self.unit())
        return out

    def unit(self, column: str | None = None) -> tuple:
        if self._next("(", kind="mark"):
            self.left.pop(0)
            out = self.level(0)
            self._take(")")
            return _in_column(out, column)
        if column is None and len(self.left) > 1 and self.left[0][0] == "word" and self.left[1] == ("mark", ":"):
            name = self.left.pop(0)[1]
            self.left.pop(0)
            return self.unit(name.lower())
        if self._next("NEAR", kind="word") and self.left[1:2] == [("mark", "(")]:
            del self.left[:2]
            phrases, distance = [], NEAR
            while not self._next(")", ",", kind="mark"):
                phrases.append(self.phrase(column))
            if self._next(",", kind="mark"):
                self.left.pop(0)
                if not (self.left and self.left[0][1].isdigit()):
                    raise ValueError("NEAR wants a number after its comma.")
                distance = int(self.left.pop(0)[1])
            self._take(")")
            return ("near", column, phrases, distance)
        return self.phrase(column)

    def phrase(self, column: str | None) -> tuple:
        words, prefix = [], False
        while True:
            if not self.left or self.left[0][0] == "mark":
                raise ValueError("The query ends, or has a mark, where a word should be.")
            words += folded_tokens(self.left.pop(0)[1])
            if self._next("*", kind="mark"):
                self.left.pop(0)
                prefix = True
                break
            if not self._next("+", kind="mark"):
                break
            self.left.pop(0)
        return ("phrase", column, words, prefix)


def _in_column(tree: tuple, column: str | None) -> tuple:
    if column is None:
        return tree
    if tree[0] in ("phrase", "near"):
        inner = [_in_column(p, column) for p in tree[2]] if tree[0] == "near" else tree[2]
        return (tree[0], tree[1] or column, inner, tree[3])
    return (tree[0], _in_column(tree[1], column), _in_column(tree[2], column))


def parse(query: str) -> tuple:
    """The query as nested tuples; an error says what can't be read."""
    return _Reader(query).whole()


def literal(text: str) -> str:
    """A query in which every word of a text is meant as it stands, whatever operator it looks like."""
    return " ".join(f'"{w}"' for w in folded_tokens(text)) or '""'


def _starts(index: DataFrame, phrase: tuple, fields: list[str]) -> DataFrame:
    """chunk_id and starts, the places where the phrase begins."""
    _, column, words, prefix = phrase
    if column is not None and column not in fields:
        raise ValueError(f"There is no column {column!r}.")
    if not words:
        return index.limit(0).select("chunk_id", "positions").withColumnRenamed("positions", "starts")
    out = None
    for i, word in enumerate(words):
        wanted = F.col("term").startswith(word) if prefix and i == len(words) - 1 else F.col("term") == word
        rows = index.filter(wanted).select("chunk_id", F.transform("positions", lambda p: p - i).alias("starts"))  # noqa: B023
        if prefix and i == len(words) - 1:
            rows = rows.groupBy("chunk_id").agg(F.flatten(F.collect_list("starts")).alias("starts"))
        out = rows if out is None else out.join(rows.withColumnRenamed("starts", "more"), "chunk_id").select("chunk_id", F.array_intersect("starts", "more").alias("starts"))
    if column is not None:
        out = out.withColumn("starts", F.filter("starts", lambda p: F.floor(p / FIELD) == fields.index(column)))
    return out.filter(F.size("starts") > 0)


def _near(index: DataFrame, tree: tuple, fields: list[str]) -> DataFrame:
    _, _, phrases, distance = tree
    if not phrases:
        raise ValueError("NEAR wants phrases.")
    out = _starts(index, phrases[0], fields).withColumnRenamed("starts", "s0")
    for i, p in enumerate(phrases[1:], 1):
        out = out.join(_starts(index, p, fields).withColumnRenamed("starts", f"s{i}"), "chunk_id")

    def first(j: int) -> Column:
        """Phrase j stands somewhere so that every other one begins there or later, and soon enough after its end."""
        soon = lambda i, x: F.exists(f"s{i}", lambda y: (y >= x) & (y - x - len(phrases[j][2]) <= distance))
        return F.exists(f"s{j}", lambda x: reduce(lambda a, b: a & b, (soon(i, x) for i in range(len(phrases)) if i != j), F.lit(True)))

    return out.filter(reduce(lambda a, b: a | b, map(first, range(len(phrases))))).select("chunk_id")


def matching(index: DataFrame, query: str | tuple, fields: list[str]) -> DataFrame:
    """chunk_id of the chunks that match, each once. ``index``: as ``search.save_index`` writes it, over ``fields``."""
    tree = parse(query) if isinstance(query, str) else query
    kind = tree[0]
    if kind == "phrase":
        return _starts(index, tree, fields).select("chunk_id")
    if kind == "near":
        return _near(index, tree, fields)
    left, right = matching(index, tree[1], fields), matching(index, tree[2], fields)
    if kind == "or":
        return left.unionByName(right).distinct()
    return left.join(right, "chunk_id", "left_semi" if kind == "and" else "left_anti")
