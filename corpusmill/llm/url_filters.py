"""URL filters: rules by host and path, and empirical-Bayes reputations of hosts for the pages that no rule judges.

A labelled page is bad or not. Counts of hosts add up to registered domains (the last two labels of the host), suffixes
(the last one) and the whole. At each level the spread of the children's rates around their parent's gives, by moments, the
correlation of two pages of one child beyond their parent, and with it the weight of the beta prior that a child starts
from: its parent's mean, worth (1 - correlation) / correlation pages. So a host with few labels is judged by its domain,
and one without any by what is above it. A page is blocked if the lower bound of its host's posterior rate is over a limit.

Everything is a DataFrame expression. Urls are aggregated by host before anything is joined, and the table of hosts is
broadcast only if its bytes were measured to be few.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, picked, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: The number of the document that a page shows: the second part of its path.
ITEM = "^/[^/]*/([0-9]{1,18})([^0-9].*)?$"
#: A page is blocked if the rate of bad pages, less so many standard deviations, is over the limit.
LIMIT, DEVIATIONS = 0.5, 1.645
#: Bounds of the correlation of two pages of one host, domain or suffix; the value where nothing tells it; digits kept.
LEAST_RHO, MOST_RHO, PRIOR_RHO = 0.0001, 0.9999, 0.5
DIGITS = 9


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty if there is no ``://`` or url."""
    return F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if there is no ``://`` or url."""
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule whose host is ``host`` or above it and with whose path ``path`` starts, and its verdict; nulls if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def outcomes_of(labels: DataFrame, key: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """item and bad (0 or 1): of low quality or toxic by any row of its labels. Null keys, and rows without either label, count for nothing."""
    bad = F.greatest((F.col(quality) == 0).cast("int"), (F.col(toxic) == 1).cast("int"))
    rows = picked(labels, item=F.col(key).cast("long"), bad=bad).filter(F.col("item").isNotNull() & F.col("bad").isNotNull())
    return rows.groupBy("item").agg(F.max("bad").alias("bad"))


def _level(children: DataFrame, name: str) -> DataFrame:
    """``children`` (n, bad, mean: the parent's) with alpha and beta, the posterior of the rate, and rate, its mean.

    The correlation is one row, taken from all children; a child without pages gets its parent's mean.
    """
    spread = F.col("mean") * (1 - F.col("mean"))
    some = children.filter("n > 0").select("n", spread.alias("s"), (F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mean"), 2)).alias("d"))
    rho = some.agg(((F.sum("d") - F.sum("s")) / F.nullif(F.sum(F.col("s") * (F.col("n") - 1)), F.lit(0.0))).alias("rho"))
    weight = rho.select(F.round(F.greatest(F.lit(LEAST_RHO), F.least(F.lit(MOST_RHO), F.coalesce("rho", F.lit(PRIOR_RHO)))), DIGITS).alias("rho"))
    weight = weight.select(((1 - F.col("rho")) / F.col("rho")).alias("weight"))
    alpha, beta = F.col("weight") * F.col("mean") + F.col("bad"), F.col("weight") * (1 - F.col("mean")) + F.col("n") - F.col("bad")
    return children.crossJoin(F.broadcast(weight)).withColumns({"alpha": alpha, "beta": beta}).withColumn(name, F.col("alpha") / (F.col("alpha") + F.col("beta"))).drop("weight", "mean")


def reputations(counts: DataFrame) -> DataFrame:
    """host, n, bad, rate and bound for rows of host, n (labelled pages) and bad; hosts are different.

    bound is the lower bound of the rate of bad pages, in ``DIGITS`` digits.
    """
    parts = lambda n: F.substring_index("host", ".", -n)
    hosts = cut(counts.withColumns({"domain": parts(2), "suffix": parts(1)}))
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).select(((F.col("bad") + 1) / (F.col("n") + 2)).alias("mean"))
    sums = F.sum("n").alias("n"), F.sum("bad").alias("bad")
    domains = cut(hosts.groupBy("suffix", "domain").agg(*sums))
    suffixes = cut(domains.groupBy("suffix").agg(*sums))
    above = small(_level(suffixes.crossJoin(F.broadcast(total)), "rate").select("suffix", F.col("rate").alias("mean")))
    middle = small(_level(domains.join(above, "suffix"), "rate").select("domain", F.col("rate").alias("mean")))
    a, b = F.col("alpha"), F.col("beta")
    bound = F.col("rate") - DEVIATIONS * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return _level(hosts.join(middle, "domain"), "rate").select("host", "n", "bad", "rate", F.round(bound, DIGITS).alias("bound"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: tuple = RULES, url: str = "url", key: str = "page_id", item: str = ITEM, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), and labelled and bad, the host's counts, for each row of ``pages``.

    A page's label is that of the document whose number its path holds by the pattern ``item``. A null url, or one
    without ``://``, has an empty host and path: no rule fits, and its verdict is that of the host with the empty name.
    Null keys and repeated rows give a row each, and a page counts as often as it is there. Without labels nothing is
    blocked but by rules. An empty table gives an empty one. Other columns are left out.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    number = F.regexp_extract("path", item, 1)
    shown = rows.select("host", F.when(number != "", number.cast("long")).alias("item")).groupBy("host", "item").agg(F.count("*").alias("n"))
    labelled = shown.join(cut(outcomes_of(labels)), "item").groupBy("host").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("bad")).alias("bad"))
    zero = F.lit(0).cast("long")
    counts = rows.select("host").distinct().join(labelled, "host", "left").select("host", F.coalesce("n", zero).alias("n"), F.coalesce("bad", zero).alias("bad"))
    known = small(reputations(counts).select("host", "n", "bad", (F.col("bound") > limit).alias("blocked")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow"))
    return rows.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), judged.alias("verdict"), F.col("n").alias("labelled"), "bad")


def sql() -> str:
    """The same rows as SQL over ``pages`` and ``labels``."""
    rules = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))

    def fits(text: str) -> str:
        name, _, rest = text.partition("/")
        return f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')"

    case = lambda i: "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{r[i]}'" for r in rules) + " END"

    def level(name: str, children: str) -> str:
        rho = f"""SELECT round(greatest({LEAST_RHO}, least({MOST_RHO}, coalesce(sum(n * (bad / n - mean) ** 2 - mean * (1 - mean)) / nullif(sum(mean * (1 - mean) * (n - 1)), 0), {PRIOR_RHO}))), {DIGITS}) AS rho FROM {name}_in WHERE n > 0"""
        post = f"SELECT *, (1 - rho) / rho * mean + bad AS a, (1 - rho) / rho * (1 - mean) + n - bad AS b FROM {name}_in, ({rho})"
        return f"{name}_in AS ({children}), {name} AS (SELECT *, a / (a + b) AS rate FROM ({post}))"

    return f"""WITH parsed AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        rows AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parsed),
        outcomes AS (SELECT doc_id AS item, max(greatest((quality = 0)::INT, (toxic = 1)::INT)) AS bad FROM labels GROUP BY 1 HAVING item IS NOT NULL AND bad IS NOT NULL),
        hosts AS (SELECT host, array_to_string(split(host, '.')[-2:], '.') AS domain, split(host, '.')[-1] AS suffix, count(o.item) AS n, coalesce(sum(o.bad), 0)::BIGINT AS bad
            FROM rows LEFT JOIN outcomes o ON o.item = try_cast(regexp_extract(path, '{ITEM}', 1) AS BIGINT) GROUP BY host),
        total AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean FROM hosts),
        {level("suffixes", "SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(mean) AS mean FROM hosts, total GROUP BY suffix")},
        {level("domains", "SELECT h.domain, sum(h.n) AS n, sum(h.bad) AS bad, any_value(s.rate) AS mean FROM hosts h JOIN suffixes s ON s.suffix = h.suffix GROUP BY h.domain")},
        {level("judged", "SELECT h.*, d.rate AS mean FROM hosts h JOIN domains d ON d.domain = h.domain")}
        SELECT page_id, host, path, {case(1)} AS rule, coalesce({case(0)}, CASE WHEN round(j.rate - {DEVIATIONS} * sqrt(j.a * j.b / ((j.a + j.b) ** 2 * (j.a + j.b + 1))), {DIGITS}) > {LIMIT}
            THEN 'block' ELSE 'allow' END) AS verdict, j.n AS labelled, j.bad AS bad FROM rows JOIN judged j USING (host)"""
