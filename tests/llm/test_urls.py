from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from marquee.llm import queries, urls
from marquee.llm.urls import Options
from tests.llm.conftest import clashing

PAGES = "page_id long, url string, html string"
LABELS = "page_id long, bad int"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    best = None
    for pattern, verdict in [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]:
        h, p = pattern.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(pattern) > len(best[0])):
            best = pattern, verdict
    return best or (None, None)


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/x?y#z", "https://www.example.com/en/1", "https://x.www.example.com/en/"]
URLS += ["http://example.com", "http://notexample.com/en/", "http://a.net/es/1", "http://a.net/esp/", "http://net/fr/", "a://b://c/d", "http://h?x=/en/", "http://ÀB.com/é"]
URLS += ["http://user@example.com:80/en/", "x\nhttp://example.com/en/\ny", "http://com/"]


def test_hosts_paths_and_rules(engine):
    pages = engine.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], PAGES)
    got = urls.judge(clashing(pages, "host", "rate", "bad", "n", "domain"), engine.createDataFrame([], LABELS)).collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path = parts(URLS[r["page_id"]])
        pattern, verdict = rule(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, pattern, verdict or "allow")


def test_query_on_whole_table(engine, small):
    got = queries.op2_urls(engine, "/root/testdata/sf0.001").collect()
    rows = {r["page_id"]: r["url"] for r in small("pages").collect()}
    assert sorted(r["page_id"] for r in got) == sorted(rows)
    for r in got:
        host, path = parts(rows[r["page_id"]])
        pattern, verdict = rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, pattern)
        assert r["verdict"] == (verdict or ("block" if r["sure"] >= 0.95 else "allow"))


def test_shrinkage_follows_the_levels(engine):
    """A host without labels is judged by its domain, one with many by its own."""
    pages, labels, n = [], [], 0

    def add(host, good, bad, silent=0):
        nonlocal n
        for outcome in [0] * good + [1] * bad + [None] * silent:
            pages.append((n, f"http://{host}/p", None))
            if outcome is not None:
                labels.append((n, outcome))
            n += 1

    for i in range(12):
        add(f"h{i}.farm.org", 1, 30)
        add(f"h{i}.fine.org", 30, 1)
    add("quiet.farm.org", 0, 0, 5)
    add("good.farm.org", 200, 0)
    add("quiet.fine.org", 0, 0, 5)
    add("alone.org", 0, 1)
    got = {r["host"]: r for r in urls.judge(engine.createDataFrame(pages, PAGES), engine.createDataFrame(labels, LABELS)).collect()}
    assert got["h3.farm.org"]["verdict"] == "block" and got["h3.fine.org"]["verdict"] == "allow"
    assert got["quiet.farm.org"]["rate"] > 0.5 > got["quiet.fine.org"]["rate"]
    assert got["good.farm.org"]["verdict"] == "allow" and got["good.farm.org"]["rate"] < 0.2
    assert got["alone.org"]["verdict"] == "allow"


def test_estimates_equal_the_formulas(engine):
    pages = [(i, f"http://{h}/", None) for i, h in enumerate(["a.x.org"] * 6 + ["b.x.org"] * 4 + ["y.org"] * 5 + ["z.net"] * 3)]
    outcomes = [1, 1, 0, 1, 0, 1, 0, 0, 0, 1, 1, 1, 1, 0, 1, 0, 0, 1]
    labels = list(enumerate(outcomes))
    o = Options()
    rows = urls.reputations(
        engine.createDataFrame(pages, PAGES).select("page_id", urls.host_of(F.col("url")).alias("host")), engine.createDataFrame(labels, LABELS)
    ).collect()

    def fit(groups):
        apart = sum((b - n * p) ** 2 - n * p * (1 - p) for b, n, p in groups)
        most = sum(n * p * (1 - p) * (n - 1) for b, n, p in groups)
        return min(max(o.most_strength if apart <= 0 else most / apart - 1, o.least_strength), o.most_strength)

    base = (sum(outcomes) + 1) / (len(outcomes) + 5)
    suffix = {"org": (10, 15), "net": (1, 3)}
    s = fit([(b, n, base) for b, n in suffix.values()])
    p1 = {k: (b + s * base) / (n + s) for k, (b, n) in suffix.items()}
    domain = {"x.org": (5, 10, "org"), "y.org": (4, 5, "org"), "z.net": (1, 3, "net")}
    # the last page of y.org is labelled 1 of 5
    domain["y.org"] = (sum(outcomes[10:15]), 5, "org")
    domain["x.org"] = (sum(outcomes[:10]), 10, "org")
    domain["z.net"] = (sum(outcomes[15:]), 3, "net")
    suffix = {"org": (domain["x.org"][0] + domain["y.org"][0], 15), "net": (domain["z.net"][0], 3)}
    s = fit([(b, n, base) for b, n in suffix.values()])
    p1 = {k: (b + s * base) / (n + s) for k, (b, n) in suffix.items()}
    s = fit([(b, n, p1[u]) for b, n, u in domain.values()])
    p2 = {k: (b + s * p1[u]) / (n + s) for k, (b, n, u) in domain.items()}
    host = {"a.x.org": (sum(outcomes[:6]), 6, "x.org"), "b.x.org": (sum(outcomes[6:10]), 4, "x.org"), "y.org": (*domain["y.org"][:2], "y.org"), "z.net": (*domain["z.net"][:2], "z.net")}
    s = fit([(b, n, p2[d]) for b, n, d in host.values()])
    for r in rows:
        b, n, d = host[r["host"]]
        rate = (b + s * p2[d]) / (n + s)
        assert r["rate"] == pytest.approx(rate)
        assert r["weight"] == pytest.approx(n + s)
        assert r["sure"] == pytest.approx(above(rate, n + s, o.limit), abs=1e-9)


def above(rate, weight, limit):
    """The beta law's density summed up by Simpson's rule, in a variable that is flat at both ends."""
    a, b = weight * rate, weight * (1 - rate)
    constant = math.lgamma(weight) - math.lgamma(a) - math.lgamma(b)

    def density(t):  # p = 1 / (1 + exp(-t))
        return math.exp(constant - a * soft(-t) - b * soft(t))

    def soft(t):
        return max(t, 0.0) + math.log1p(math.exp(-abs(t)))

    first = math.log(limit / (1 - limit))
    middle = math.log(a / b)
    last = max(first, middle) + 40 * max(1 / math.sqrt(a * b / weight), 1 / b, 0.1)
    steps = 40_000
    h = (last - first) / steps
    return h / 3 * sum((1 if i in (0, steps) else 4 if i % 2 else 2) * density(first + i * h) for i in range(steps + 1))


def test_posterior_probability(engine):
    cases = [(r, w, x) for r in (0.02, 0.3, 0.5, 0.7, 0.97) for w in (1.0, 7.5, 240.0, 1e5) for x in (0.1, 0.5, 0.9)]
    cases += [(x + d / w**0.5, w, x) for x in (0.1, 0.5, 0.9) for w in (1e3, 1e6) for d in (-0.9, -0.1, 0.0, 0.1, 0.9)]
    for limit in (0.1, 0.5, 0.9):
        mine = [c for c in cases if c[2] == limit]
        frame = engine.createDataFrame([(r, w) for r, w, _ in mine], "rate double, weight double")
        got = frame.select(urls.share_above(F.col("rate"), F.col("weight"), limit)).collect()
        for (rate, weight, _), (value,) in zip(mine, got):
            assert value == pytest.approx(above(rate, weight, limit), abs=1e-7), (rate, weight, limit)


def test_owners(engine):
    hosts = ["a.b.co.uk", "co.uk", "x.org", "10.0.0.1:80", "[::1]:8080", "u@w.x.org.:1", "localhost", "", "a.city.kawasaki.jp", "b.c.kobe.jp", "1.2.3"]
    frame = engine.createDataFrame([(h,) for h in hosts], "host string")
    plain = {r["host"]: (r["domain"], r["suffix"]) for r in urls.with_owner(frame, Options()).collect()}
    assert plain["a.b.co.uk"] == ("b.co.uk", "co.uk") and plain["co.uk"] == ("co.uk", "uk")
    assert plain["10.0.0.1:80"] == ("10.0.0.1", urls.ADDRESS) and plain["[::1]:8080"] == ("[::1]", urls.ADDRESS)
    assert plain["u@w.x.org.:1"] == plain["x.org"] == ("x.org", "org") and plain["localhost"] == ("localhost", "localhost")
    assert plain[""] == ("", "") and plain["1.2.3"] == ("2.3", "3")
    table = engine.createDataFrame([("jp",), ("kobe.jp",), ("kawasaki.jp",), ("uk",), ("org",), ("org",), (None,)], "suffix string")
    longer = {r["host"]: (r["domain"], r["suffix"]) for r in urls.with_owner(frame, Options(), table).collect()}
    assert len(longer) == len(hosts)
    assert longer["a.city.kawasaki.jp"] == ("city.kawasaki.jp", "kawasaki.jp") and longer["b.c.kobe.jp"] == ("c.kobe.jp", "kobe.jp")
    assert longer["a.b.co.uk"] == ("co.uk", "uk") and longer["x.org"] == ("x.org", "org") and longer[""] == ("", "")
    assert longer["10.0.0.1:80"] == ("10.0.0.1", urls.ADDRESS)


def test_sql_on_planted_hosts(engine):
    """The given tables hold no bad host, so the SQL is held against one that does, at each level."""
    import duckdb
    import pyarrow as pa

    from marquee.llm import sql

    rows = [(f"http://h{i % 6}.farm.org/{i}", int(i % 12 != 0)) for i in range(400)] + [(f"http://h{i % 6}.fine.org/{i}", int(i % 12 == 0)) for i in range(400)]
    rows += [("http://quiet.farm.org/", None), ("http://quiet.fine.org/", None), ("http://10.0.0.1:80/a", 1), ("http://u@x.net./fr", 1), ("none", 0), (None, 1)]
    pages = pa.table({"page_id": pa.array(range(len(rows)), pa.int64()), "url": pa.array([u for u, _ in rows], pa.string())})
    labels = pa.table({"doc_id": pa.array(range(len(rows)), pa.int64()), "quality": pa.array([None if b is None else 1 - b for _, b in rows], pa.int64()), "toxic": pa.array([None] * len(rows), pa.int64())})
    con = duckdb.connect()
    con.register("pages", pages)
    con.register("labels", labels)
    want = {r[0]: r[1:] for r in con.sql(sql.URLS).fetchall()}
    frames = [engine.createDataFrame(x.to_pylist(), s) for x, s in ((pages, "page_id long, url string"), (labels, "doc_id long, quality long, toxic long"))]
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(frames[0], urls.page_labels(frames[1])).collect()}
    assert got.keys() == want.keys()
    for key, row in got.items():
        assert row[:4] == want[key][:4] and row[4:] == pytest.approx(want[key][4:], abs=2e-6)
    verdict = {rows[k][0]: r[3] for k, r in got.items()}
    assert verdict["http://h1.farm.org/1"] == "block" and verdict["http://h1.fine.org/1"] == "allow"


def test_no_python_in_the_plan(engine, small):
    plan = urls.judge(small("pages"), urls.page_labels(small("labels")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_empty_tables(engine):
    pages, labels = engine.createDataFrame([], PAGES), engine.createDataFrame([(1, None), (None, 1)], LABELS)
    assert urls.judge(pages, labels).count() == 0
    one = engine.createDataFrame([(1, "http://a.org/", None), (1, "http://a.org/", None), (None, None, None)], PAGES)
    assert [r["verdict"] for r in urls.judge(one, labels).collect()] == ["allow"] * 3
