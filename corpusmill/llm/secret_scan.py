"""Secret scans: fixed patterns, and a battery of randomness tests for tokens that look generated.

Everything is a DataFrame expression. Spans come from one pattern scan each; only rows with a match compute positions.
A token's alphabet is inferred from its characters. A chi-squared test asks whether its symbols are as uneven as
ordinary text would make them (the hypothesis that a secret rejects), and a runs test and a lag-1 serial correlation
must find nothing against randomness. Tokens of a length class then pass a Benjamini-Hochberg threshold over all rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut

#: kind -> (pattern, least length of the given group), in the order in which spans are listed.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),  # the same matches as [0-9a-f]+ of 16 characters or more
}
#: Runs of token characters, of any kind; the tests tell what they are. A shorter run is too little evidence for any test. The
#: look-behind lets a run be tried only once.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}"

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: kind -> (what a token of this encoding matches, its alphabet, unevenness of the hypothesis to reject); the first match counts.
#: Unevenness is the alphabet's size times the chance that two symbols are equal, less one: 0 for random tokens.
ENCODINGS = {
    "random_hex": (r"^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef", 0.8),
    "random_base32": (r"^[A-Z2-7]+$", UPPER + "234567", 1.0),
    "random_base62": (r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS, 1.2),
    "random_base64": (r"^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/", 1.2),
    "random_url64": (r"^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_", 1.2),
}
KINDS = [*BASE, *ENCODINGS]
#: Lower ends of the length classes; each has a threshold of its own.
LENGTHS = (16, 24, 32, 48, 96)
#: Share of false finds allowed among the tokens found, in each length class.
FDR = 0.05
#: Tokens whose runs or serial correlation are less likely than this, if random, are dropped.
LEAST_P = 0.001
#: p-values are rounded up to powers of 10 ** (1 / BINS), down to 10 ** -DECADES.
BINS, DECADES = 20, 40


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def running(values: Column, block: int = 64) -> Column:
    """Sums of all that stands before each element. In blocks, so that long arrays aren't copied once per element."""

    def exclusive(xs: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("seen"))
        step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["seen"], F.array(a["at"])).alias("seen"))
        return F.aggregate(xs, start, step, lambda a: a["seen"])

    n = F.size(values)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: F.slice(values, b * block + 1, F.lit(block)))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x))
    shifted = F.zip_with(exclusive(sums), blocks, lambda base, b: F.transform(exclusive(b), lambda x: x + base))
    return F.when(n > 0, F.flatten(shifted)).otherwise(F.array().cast("array<bigint>"))


def matches(text: Column, pattern: str) -> Column:
    """Matches, leftmost and non-overlapping: array of start, end (code points), token. The gaps between them add up to the starts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))

    def placed(tokens: Column) -> Column:
        lengths = F.transform(tokens, lambda x: F.length(x).cast("long"))
        before = F.zip_with(running(F.slice(gaps, 1, F.size(tokens))), running(lengths), lambda a, b: a + b)
        starts = F.zip_with(before, F.slice(gaps, 1, F.size(tokens)), lambda a, b: a + b)
        return F.zip_with(starts, tokens, lambda s, t: F.struct(s.alias("start"), (s + F.length(t)).alias("end"), t.alias("token")))

    none = F.array().cast("array<struct<start:bigint,end:bigint,token:string>>")
    return _let(found, lambda tokens: F.when(F.size(tokens) > 0, placed(tokens)).otherwise(none))


def normal_cdf(z: Column) -> Column:
    """Phi(z), to 1e-7 of its value in the middle and with the right order of magnitude in the tails."""
    x = F.least(F.abs(z), F.lit(12.0))
    t = 1 / (1 + 0.2316419 * x)
    poly = reduce(lambda a, c: (a + c) * t, (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530), F.lit(0.0))
    tail = poly * F.exp(-x * x / 2) / 2.5066282746310002
    return F.when(z < 0, tail).otherwise(1 - tail)


def _pick(index: Column, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), index)


def _encoding(token: Column) -> Column:
    """Position, from 1, of the token's encoding in ENCODINGS; 0 for none."""
    out = F.lit(0)
    for i, (pattern, _, _) in reversed(list(enumerate(ENCODINGS.values(), 1))):
        out = F.when(token.rlike(pattern), i).otherwise(out)
    return out


def _tested(span: Column) -> Column:
    """start, end, kind, length class and bin of the p-value; a bin of -1 if a test rejects randomness."""

    def with_encoding(code: Column) -> Column:
        alphabet, uneven = _pick(code, [a for _, a, _ in ENCODINGS.values()]), _pick(code, [d for _, _, d in ENCODINGS.values()])
        token = F.when(code == 1, F.lower(span["token"])).otherwise(span["token"])
        k, n = F.length(alphabet).cast("double"), F.length(token).cast("double")
        counts = F.transform(F.split(alphabet, ""), lambda c: (n - F.length(F.replace(token, c, F.lit("")))))
        df = k - 1
        mean, var = df + n * uneven, 2 * (df + 2 * n * uneven)
        chi = k / n * _total(F.transform(counts, lambda c: c * c)) - n
        p = normal_cdf((chi - mean) / F.sqrt(var))

        def series(values: Column) -> Column:
            side = F.transform(values, lambda v: (v >= k / 2).cast("double"))
            pairs = F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            turns = _total(F.transform(pairs, lambda q: ((q["a"] >= k / 2) != (q["b"] >= k / 2)).cast("double")))
            up = _total(side)
            runs_mean = 1 + 2 * up * (n - up) / n
            runs_var = (runs_mean - 1) * (runs_mean - 2) / (n - 1)
            runs_z = F.when(runs_var > 0, (1 + turns - runs_mean) / F.sqrt(runs_var)).otherwise(F.lit(12.0))

            def serial(level: Column) -> Column:  # the mean is computed once, not once per symbol
                spread = _total(F.transform(values, lambda v: (v - level) * (v - level)))
                product = _total(F.transform(pairs, lambda q: (q["a"] - level) * (q["b"] - level)))
                return F.when(spread > 0, (product / spread + 1 / n) * F.sqrt(n)).otherwise(F.lit(12.0))

            return F.least(2 * normal_cdf(-F.abs(runs_z)), 2 * normal_cdf(-F.abs(_let(_total(values) / n, serial))))

        values = F.transform(F.split(token, ""), lambda c: F.position(c, alphabet).cast("double") - 1)
        bins = F.least(F.lit(BINS * DECADES), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * BINS)).cast("int")
        order = sum(((n >= least).cast("int") for least in LENGTHS[1:]), F.lit(0))
        return F.struct(
            span["start"].alias("start"),
            span["end"].alias("end"),
            (code + len(BASE) - 1).alias("kind"),
            order.alias("class"),
            F.when(_let(values, series) >= LEAST_P, bins).otherwise(-1).alias("bin"),
        )

    none = F.lit(None).cast("struct<start:bigint,end:bigint,kind:int,class:int,bin:int>")
    return _let(_encoding(span["token"]), lambda code: F.when(code > 0, with_encoding(code)).otherwise(none))


def _thresholds(candidates: DataFrame) -> dict[int, int]:
    """Length class -> least bin that passes. Counts by class and bin, at most len(LENGTHS) * 801 of them, are all that is gathered."""
    got = candidates.select(F.explode("tokens").alias("t")).groupBy("t.class", "t.bin").count().collect()
    out = {}
    for c in range(len(LENGTHS)):
        counts = {r["bin"]: r["count"] for r in got if r["class"] == c}
        total, rank = sum(counts.values()), 0
        for b in sorted((b for b in counts if b >= 0), reverse=True):
            rank += counts[b]
            if 10 ** (-b / BINS) <= FDR * rank / total:
                out[c] = b
    return out


def _span(s: Column, kind: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind"))


def _base_spans(text: Column, index: int) -> Column:
    """The spans of one base kind; a match that is too short is dropped, and the text in it isn't tried again."""
    pattern, group, least = list(BASE.values())[index]
    part = lambda s: F.regexp_extract(s["token"], pattern, group)
    return F.transform(F.filter(matches(text, pattern), lambda s: F.length(part(s)) >= least), lambda s: _span(s, F.lit(index)))


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each row of ``docs``: doc_id and found, an array of start, end, kind ordered by start, then kind.

    A null text counts as empty and has no spans. Null keys and repeated rows give a row each. The thresholds come from
    all rows. An empty table gives an empty one. Texts are never cut.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    spans = [_base_spans(body, i) for i in range(len(BASE))]
    tested = F.filter(F.transform(matches(body, TOKEN), _tested), lambda t: t.isNotNull())
    rows = cut(docs.select(F.col(key).alias("doc_id"), F.concat(*spans).alias("base"), tested.alias("tokens")))
    least = _thresholds(rows)
    passed = lambda t: reduce(lambda a, c: a | ((t["class"] == c) & (t["bin"] >= least[c])), least, F.lit(False))
    inside = lambda t: F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    more = F.transform(F.filter("tokens", lambda t: passed(t) & ~inside(t)), lambda t: _span(t, t["kind"]))
    ordered = lambda xs: F.array_sort(F.transform(xs, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return rows.select("doc_id", ordered(F.col("base")).alias("base"), ordered(F.concat("base", more)).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, and all spans as text, for each row of ``scan_secrets``.

    A row without spans has counts of 0, the hash of the empty text and empty ``spans``. Null ids and repeated rows give a
    row each; an empty table gives an empty one.
    """
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", _pick(s["kind"] + 1, KINDS), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
