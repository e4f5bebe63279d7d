"""Centroid clusters, periodic runs and URL filters against plain versions of them."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from corpusmill.llm import centroid_clusters, periodic_runs, queries, url_filters

RNG = random.Random(5)


# centroid clusters


def plain_clusters(rows, k, rounds, dimension):
    """Lloyd's rounds by whole numbers of any size."""
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2**60 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    place = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    at = [v for _, v in sorted(kept, key=place)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(at)):
            own = [v for (_, v), c in zip(kept, of, strict=True) if c == j]
            if own:
                at[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    sums = {j: sum(d for _, c, d in found if c == j) for j in range(len(at))}
    fit = lambda n: n if n < 1 << 63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    lost = {c for _, c, d in found if d >= 1 << 63}
    return sorted(((i, c, fit(d), None if c in lost else fit(sums[c]), None if lost else fit(sum(sums.values())), sha[c]) for i, c, d in found), key=repr)


def clusters(df, **more):
    return sorted(map(tuple, centroid_clusters.centroid_clusters(df, **more).collect()), key=repr)


def vectors(spark, rows, kind="float"):
    """Rows of (id, vector), with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, v, 7, "x", [1]) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, upper string, q array<int>")


def points(n, dimension, spread=1.0, groups=5):
    rng = np.random.default_rng(n)
    return [[float(np.float32(x)) for x in v] for v in rng.normal(0, spread, (groups, dimension))[rng.integers(0, groups, n)] + rng.normal(0, spread / 3, (n, dimension))]


def test_clusters_equal_plain_rounds(spark):
    rows = list(enumerate(points(400, 6)))
    rows += [(7, rows[7][1]), (None, rows[3][1]), (None, rows[4][1]), (900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 7), (904, [1.0] * 5 + [None]), (905, [1.0] * 5 + [math.nan]), (906, [math.inf] * 6)]
    assert clusters(vectors(spark, rows), clusters=8, rounds=10, dimension=6) == plain_clusters(rows, 8, 10, 6)


def test_ties_go_to_the_smaller_number(spark):
    grid = [[float(x), float(y)] for x in range(-3, 4) for y in range(-3, 4)]
    rows = [(i, [x / 1024 for x in v]) for i, v in enumerate(grid + grid)]
    for rounds in (0, 1, 5):
        assert clusters(vectors(spark, rows), clusters=6, rounds=rounds, dimension=2) == plain_clusters(rows, 6, rounds, 2)


def test_equal_vectors_few_vectors_and_none(spark):
    same = [(i, [0.5, -0.25, 3.0]) for i in range(20)]
    assert clusters(vectors(spark, same), clusters=4, rounds=3, dimension=3) == plain_clusters(same, 4, 3, 3)
    assert clusters(vectors(spark, same[:2]), clusters=8, rounds=10, dimension=3) == plain_clusters(same[:2], 8, 10, 3)
    assert clusters(vectors(spark, same[:1]), clusters=1, rounds=2, dimension=3) == plain_clusters(same[:1], 1, 2, 3)
    empty = centroid_clusters.centroid_clusters(vectors(spark, []))
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and not empty.collect()


def test_huge_components_stay_exact(spark):
    rows = [(i, v) for i, v in enumerate(points(60, 3))] + [(100 + i, [x * 1e5 for x in v]) for i, v in enumerate(points(30, 3))]
    assert clusters(vectors(spark, rows, "double"), clusters=5, rounds=6, dimension=3) == plain_clusters(rows, 5, 6, 3)
    rows += [(200, [1e300, -1e300, 0.0]), (201, [1e300, 1e17, 1e-300]), (202, [-5e9, 3e12, 2.5])]
    assert clusters(vectors(spark, rows, "double"), clusters=5, rounds=6, dimension=3) == plain_clusters(rows, 5, 6, 3)


def test_bounds_spare_distances():
    """Of well separated groups hardly any vector is compared with centroids again once these move little."""
    values = np.array(points(2000, 8, 4.0)) * 1024 // 1
    values = values.astype(np.int64)
    at = [values[i].tolist() for i in range(5)]
    cluster, upper, lower = np.zeros(2000, dtype=np.int64), np.full(2000, np.inf), np.zeros(2000)
    asked = []
    plain = centroid_clusters.squares
    for _ in range(8):
        moved = [0.0] * 5 if not asked else [centroid_clusters._distance(a, b) for a, b in zip(then, at, strict=True)]
        found = centroid_clusters.Centroids(at, moved)
        asked.append(0)
        centroid_clusters.squares = lambda a, b: (asked.__setitem__(-1, asked[-1] + len(a)), plain(a, b))[1]
        cluster, upper, lower = found.assign(values, cluster, upper, lower)
        centroid_clusters.squares = plain
        assert (cluster == np.argmin([plain(values, np.array(c)) for c in at], axis=0)).all()
        then, at = at, [(values[cluster == j].sum(axis=0) // max(1, (cluster == j).sum())).tolist() if (cluster == j).any() else at[j] for j in range(5)]
    assert asked[-1] < 2000 * 5 / 4


# periodic runs


def plain_runs(words):
    """Every stretch that agrees with itself one period on, for every period."""
    found = {}
    for p in range(1, len(words) // 3 + 1):
        at = 0
        while at + p < len(words):
            start = at
            while at + p < len(words) and words[at] == words[at + p]:
                at += 1
            if at > start and at + p - start >= max(24, 3 * p):
                found.setdefault((start, at + p), p)
            at += 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def patchwork(n, letters, rng=RNG):
    out = []
    while len(out) < n:
        period = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 12, 20, 40]))]
        out += [period[i % len(period)] for i in range(rng.randrange(1, 6 * len(period) + 30))] if rng.random() < 0.6 else [rng.randrange(letters) for _ in range(rng.randrange(1, 20))]
    return [f"w{x}".encode() for x in out[:n]]


def test_runs_of_a_batch_equal_plain_ones():
    texts = [patchwork(RNG.choice([0, 1, 23, 24, 25, 60, 150, 400]), RNG.choice([1, 2, 3, 50])) for _ in range(200)]
    assert periodic_runs.runs_of(texts) == [plain_runs(t) for t in texts]


@pytest.mark.parametrize("words", [[b"a"] * 3000, [b"a", b"b"] * 1500, [str(i % 1000).encode() for i in range(3000)], [str(i % 1000).encode() for i in range(2999)], [bytes([97 + (bin(i).count("1") & 1)]) for i in range(3000)]])
def test_runs_of_long_texts(words):
    assert periodic_runs.runs_of([words]) == [plain_runs(words)]


def test_equal_hashes_of_unequal_stretches_are_told_apart(monkeypatch):
    monkeypatch.setattr(periodic_runs, "mixed", lambda x: x.astype(np.uint64) % np.uint64(3))
    words = [str(i % 3).encode() for i in range(0, 300)] + [str(3 * i).encode() for i in range(40)]
    assert [r for r in periodic_runs.runs(np.array([int(w) for w in words])) if r[2] == 3][0] == plain_runs(words)[0] == (0, 301, 3)


def test_masked_words_hold_no_run():
    text = patchwork(2000, 30, random.Random(2))
    ids = np.array([int(w[1:]) for w in text])
    keep = periodic_runs.surviving(ids, np.zeros(len(ids), dtype=np.int64))
    assert all(keep[s : s + n].all() for s, n, _ in plain_runs(text)) and not keep.all()


TEXTS = [None, "", " \n", "one", "a " * 40, "the cat\tsat on\nthe mat " * 20, "ünï 😀 " * 30 + "end", "b " * 23, "b " * 24, " ".join(map(str, range(500))), "x y z\n" * 9 + "other words " + "x y z\n" * 9, "w " * 30_000, "q" * 40_000]


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words) if len(set(words)) > 1 or n < 5000 else [(0, n, 1)]
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = max(runs, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs_of_a_table(spark):
    ids = [i for i in range(600) if zlib.crc32(str(i).encode()) % 10 == 0][:20] + [i for i in range(600) if zlib.crc32(str(i).encode()) % 10 == 3][:20]
    rows = [(i, t, "k", 1) for i, t in zip(ids, (TEXTS + [" ".join(f"w{RNG.randrange(90)}" for _ in range(n)) for n in (30, 200, 700)] * 3) * 2, strict=False)]
    rows += [(None, "a b c " * 20, "k", 2), (None, None, None, None), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed int")
    found = periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.planted(docs)))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((plain_digest(r[0], r[1]) for r in rows), key=repr)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert not periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.planted(docs.limit(0)))).collect()


def test_periodic_runs_of_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if len(r["text"] or "") < 20_000]
    want = {r[0]: plain_digest(*r) for r in rows}
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, folder).collect()}
    assert {k: got[k] for k in want} == want and sum(r[1] > 0 for r in want.values()) > 5


# URL filters

HOSTS = ["a.example.com", "b.example.com", "example.net", "x.y.example.net", "org", "www.shop.org", "notnet", "lone", "HOST.Example.ORG", "user@a.example.com:80", "1.2.3.4", ""]
URLS = [None, "", "no scheme/at/all", "://", "http://", "a://b://c/d", "http://net", "http://net/", "http://NET/x", "http://a.net?q", "http://a.net/?q", "http://example.net/en", "http://example.net/en/", "http://x.example.net/en/a#b", "http://xexample.net/en/1",
        "http://org/fr/", "http://a.org/fr/3", "http://a.org/FR/3", "http://example.com/de/2", "http://ÄÖ.example.com/de/é", "http://é.com\n/x\ny?z", "HTTP://A.B/C://D", "http://bad.com/x/5", "x" * 5000 + "://h/p" * 3]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_verdicts(pages, labels, rules=url_filters.RULES):
    bad = {}
    for item, quality, toxic in labels:
        seen = [x for x in (None if quality is None else quality == 0, None if toxic is None else toxic == 1) if x is not None]
        if item is not None and seen:
            bad[item] = max(bad.get(item, False), *seen)
    counts = {}
    for _, url in pages:
        host, path = plain_parts(url)
        n = counts.setdefault(host, [0, 0])
        number = re.match(r"/[^/]*/([0-9]{1,18})(?![0-9])", path.split("\n")[0]) if "\n" not in path else None
        if number and int(number[1]) in bad:
            n[0] += 1
            n[1] += bad[int(number[1])]
    up = lambda host, n: ".".join(host.split(".")[-n:])
    mean = {"": (sum(b for _, b in counts.values()) + 1) / (sum(n for n, _ in counts.values()) + 2)}
    parent = lambda level, name: "" if level == 1 else up(name, level - 1)
    for level in (1, 2, 99):
        groups = {}
        for host, (n, b) in counts.items():
            total = groups.setdefault(up(host, level), [0, 0])
            total[0] += n
            total[1] += b
        above = {g: mean[("" if level == 1 else (level - 1 if level == 2 else 2, up(g, 1 if level == 2 else 2)))] for g in groups}
        some = [(n, b, above[g]) for g, (n, b) in groups.items() if n]
        top = sum(n * (b / n - m) ** 2 - m * (1 - m) for n, b, m in some)
        bottom = sum(m * (1 - m) * (n - 1) for n, b, m in some)
        rho = round(max(0.0001, min(0.9999, top / bottom if bottom else 0.5)), 9)
        weight = (1 - rho) / rho
        beta = {g: (weight * above[g] + b, weight * (1 - above[g]) + n - b) for g, (n, b) in groups.items()}
        mean |= {(level, g): a / (a + z) for g, (a, z) in beta.items()}
    out = []
    for page, url in pages:
        host, path = plain_parts(url)
        fits = [(len(r), r, v) for v, r in rules for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        a, z = beta[host]
        verdict = "block" if a / (a + z) - 1.645 * math.sqrt(a * z / ((a + z) ** 2 * (a + z + 1))) > 0.5 else "allow"
        best = max(fits, default=None)
        out.append((page, host, path, best and best[1], best[2] if best else verdict))
    return sorted(out, key=repr)


def page_table(spark, rows):
    return spark.createDataFrame([(i, u, "html", 1, 2, "z") for i, u in rows], "page_id long, url string, html string, n int, bad int, host string")


def label_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def verdicts(df):
    return sorted(map(tuple, df.select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)


def test_urls_and_rules(spark):
    rows = list(enumerate(URLS)) + [(None, "http://a.org/fr/3"), (3, URLS[3])]
    labels = [(3, 1, 0), (None, 0, 0), (2, None, None)]
    got = verdicts(url_filters.filter_urls(page_table(spark, rows), label_table(spark, labels)))
    assert got == plain_verdicts(rows, labels)
    assert not verdicts(url_filters.filter_urls(page_table(spark, []), label_table(spark, labels)))
    assert verdicts(url_filters.filter_urls(page_table(spark, rows), label_table(spark, []))) == plain_verdicts(rows, [])


def test_reputations_block_bad_hosts_and_spare_others(spark):
    rng, rows, labels = random.Random(3), [], []
    rate = {f"h{i}.site{i % 7}.{['com', 'org', 'biz'][i % 3]}": (0.95 if i % 7 == 3 else 0.1) for i in range(60)}
    for host, p in rate.items():
        for _ in range(rng.choice([1, 5, 60])):
            item = len(rows)
            rows.append((item, f"https://{host}/en/{item}{rng.choice(['', '.html', '/', '?a=1', '#x'])}"))
            labels.append((item, int(rng.random() >= p), rng.choice([0, 0, None])))
    rows += [(10**6, "http://new.site3.com/en/99999999"), (10**6 + 1, "http://new.site1.org/en/99999999"), (10**6 + 2, "http://other.place/")]
    got = verdicts(url_filters.filter_urls(page_table(spark, rows), label_table(spark, labels)))
    assert got == plain_verdicts(rows, labels)
    blocked = {r[1] for r in got if r[4] == "block"}
    assert "new.site3.com" in blocked and "new.site1.org" not in blocked and all(".site3." in h for h in blocked)


def test_filter_urls_runs_no_python_and_reads_two_columns(spark):
    folder = "/root/testdata/sf0.001"
    df = queries.QUERIES["op13_url_filters"](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "url:string" in plan and not re.search("Python|Arrow|Pandas|html", plan)
    source = re.sub(r'""".*?"""', "", open(url_filters.__file__).read(), flags=re.S)
    assert not re.search(r"udf|inPandas|InArrow|\.rdd|toPandas|collect\(", source)


@pytest.mark.parametrize("name", ["op11_centroid_clusters", "op13_url_filters"])
def test_queries_equal_their_sql(spark, name):
    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, folder), con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.select(*got.columns).fetchall(), key=repr)
