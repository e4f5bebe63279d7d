"""The full-text query language against a plain evaluation of the same queries."""

import random
import re

import pytest

from corpusmill.operators import fulltext, search

FIELDS = ["title", "body"]


def tokens(text):
    return re.findall(r"\w+", text.lower())


def begins(chunk, words, prefix, column=None):
    """(column, place) of each occurrence."""
    out = []
    for f, text in zip(FIELDS, chunk, strict=True):
        ws = tokens(text)
        for i in range(len(ws) - len(words) + 1):
            same = [w == v for w, v in zip(words, ws[i:], strict=False)]
            if prefix:
                same[-1] = ws[i + len(words) - 1].startswith(words[-1])
            if all(same) and column in (None, f):
                out.append((f, i))
    return out


def near(chunk, phrases, n):
    places = [[(f, i, len(p)) for f, i in begins(chunk, p, False)] for p in phrases]

    def pick(rest, chosen):
        if not rest:
            first = min(chosen, key=lambda c: c[1])
            return len({c[0] for c in chosen}) == 1 and any(max(c[1] for c in chosen) - (x[1] + x[2]) <= n for x in chosen if x[1] == first[1])
        return any(pick(rest[1:], [*chosen, c]) for c in rest[0])

    return pick(places, [])


has = lambda *words, prefix=False, column=None: lambda c: bool(begins(c, words, prefix, column))
CASES = {
    "heat": has("heat"),
    "HEAT water": lambda c: has("heat")(c) and has("water")(c),
    '"heat water"': has("heat", "water"),
    "heat + water": has("heat", "water"),
    "rep*": has("rep", prefix=True),
    '"hot wat" *': has("hot", "wat", prefix=True),
    "title : heat": has("heat", column="title"),
    "title:(heat OR water) rent": lambda c: (has("heat", column="title")(c) or has("water", column="title")(c)) and has("rent")(c),
    "heat OR water AND rent": lambda c: has("heat")(c) or (has("water")(c) and has("rent")(c)),
    "heat water NOT rent": lambda c: has("heat")(c) and has("water")(c) and not has("rent")(c),
    "heat AND water NOT rent OR lease": lambda c: (has("heat")(c) and has("water")(c) and not has("rent")(c)) or has("lease")(c),
    "(heat OR water) AND NOTICE": lambda c: (has("heat")(c) or has("water")(c)) and has("notice")(c),
    "NEAR(heat rent, 2)": lambda c: near(c, [["heat"], ["rent"]], 2),
    'NEAR("hot water" rent lease, 3)': lambda c: near(c, [["hot", "water"], ["rent"], ["lease"]], 3),
    "NEAR(heat heat, 0)": lambda c: near(c, [["heat"], ["heat"]], 0),
    '"OR" rent': lambda c: has("or")(c) and has("rent")(c),
    "absent": lambda c: False,
    '""': lambda c: False,
}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    words = ["heat", "water", "hot", "rent", "lease", "repair", "report", "notice", "or", "tenant"]
    chunks = {i: (" ".join(rng.choice(words) for _ in range(rng.randint(0, 3))), " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(300)}
    rows = spark.createDataFrame([(i, *c) for i, c in chunks.items()], "chunk_id long, title string, body string")
    return chunks, search.save_index(rows, FIELDS, f"file://{tmp_path_factory.mktemp('ft')}/index").cache()


@pytest.mark.parametrize("query", CASES)
def test_queries_match_what_a_plain_evaluation_matches(corpus, query):
    chunks, index = corpus
    got = [r[0] for r in fulltext.matching(index, query, FIELDS).collect()]
    assert sorted(got) == [i for i, c in chunks.items() if CASES[query](c)]


@pytest.mark.parametrize("query", ["", "(heat", "heat)", "heat AND", "NEAR(heat", "NEAR(heat, x)", "AND", "he-at", "* heat", "heat ^ rent", '"heat'])
def test_what_cannot_be_read_is_an_error(query):
    if query == "AND":  # a word like any other where no operator can stand
        assert fulltext.parse(query) == ("phrase", None, ["and"], False)
        return
    with pytest.raises(ValueError):
        fulltext.parse(query)


def test_operator_like_text_is_taken_as_text(corpus):
    chunks, index = corpus
    text = 'heat OR (rent "NEAR'
    got = [r[0] for r in fulltext.matching(index, fulltext.literal(text), FIELDS).collect()]
    assert got == [] and fulltext.literal(text) == '"heat" "or" "rent" "near"'
    assert fulltext.matching(index, fulltext.literal("*)"), FIELDS).count() == 0
    with pytest.raises(ValueError):
        fulltext.matching(index, "nowhere : heat", FIELDS)
