"""Dated lists against a day-by-day replay in plain Python."""

import datetime as dt
import random

from obsexp.llm import url_filters

CAPTURES = "page_id long, url string, fetched date, host string, decision int"
ENTRIES = "pattern string, action string, listed date, url int"
DAY = dt.date(2020, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def replay(url, fetched, entries):
    strength = {"remove": 3, "block": 2, "allow": 1}
    rest = url.split("://", 1)[1]
    host, _, path = rest.partition("/")
    host = host.split("@")[-1].split(":")[0].lower().rstrip(".")
    segment = path.split("/")[0].split("?")[0].split("#")[0]
    labels = host.split(".")
    keys = ([f"{host}/{segment}"] if segment else []) + [".".join(labels[i:]) for i in range(len(labels))]
    for k in keys:
        past = [(d, strength[a], a) for p, a, d, _ in entries if p == k and d <= fetched]
        if past and max(past)[2] != "remove":
            d = max(past)[0]
            return max(past)[2], k, d
    return "default", None, None


def test_decisions_match_a_replay(spark):
    rng = random.Random(6)
    hosts = ["a.example.org", "b.example.org", "example.org", "x.y.z.test", "org"]
    patterns = [*hosts, "y.z.test", "a.example.org/news", "test"]
    entries = [(rng.choice(patterns), rng.choice(["block", "allow", "remove"]), day(rng.randint(0, 200)), 1) for _ in range(60)]
    captures = []
    for i in range(600):
        host = rng.choice(hosts)
        url = f"http://{rng.choice(['', 'u:p@'])}{host.upper() if i % 9 == 0 else host}{rng.choice(['', '.', ':80'])}{rng.choice(['', '/', '/news', '/news/1?x', '/Other#a'])}"
        captures.append((i, url, day(rng.randint(0, 260)), "clash", 1))
    got = url_filters.judge(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES)).collect()
    assert len(got) == 600
    for r in got:
        assert (r.decision, r.pattern, r.listed) == replay(r.url, r.fetched, entries), r


def test_capitals_and_deep_paths(spark):
    entries = [("A.example.org/Docs", "block", day(1), 1), ("a.example.org/docs", "allow", day(1), 1),
               ("a.example.org/Docs/open/x", "allow", day(1), 1), ("a.example.org/Docs/old/", "allow", day(1), 1)]
    want = {"/Docs": ("block", "a.example.org/Docs"), "/Docs/1?q=/open/x": ("block", "a.example.org/Docs"), "/docs/1": ("allow", "a.example.org/docs"),
            "/DOCS": ("default", None), "/Docs/open": ("block", "a.example.org/Docs"), "/Docs/open/x/y#z": ("allow", "a.example.org/Docs/open/x"),
            "/Docs/open/xy": ("block", "a.example.org/Docs"), "/Docs/old/": ("allow", "a.example.org/Docs/old"), "//Docs": ("default", None)}
    captures = [(i, "http://u@A.Example.org:80" + path, day(5), "x", 1) for i, path in enumerate(want)]
    got = url_filters.judge(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES)).collect()
    assert {r.page_id: (r.decision, r.pattern) for r in got} == dict(enumerate(want.values()))


def test_nulls_bad_urls_repeats_and_no_rows(spark):
    rows = [(None, None, None, None, None), (1, "no url", day(3), "x", 1), (2, "http://a.b/", None, "x", 1), (3, "http://a.b/", day(3), "x", 1),
            (3, "http://a.b/", day(3), "x", 1), (4, "http://" + "a." * 200 + "b/" + "p" * 50000, day(9), "x", 1)]
    entries = [("a.b", "block", day(1), 1), (None, "block", day(1), 1), ("a.b", None, day(1), 1), ("a.b", "allow", None, 1), ("a.b", "odd", day(2), 1)]
    captures, listed = spark.createDataFrame(rows, CAPTURES), spark.createDataFrame(entries, ENTRIES)
    got = sorted((r.page_id or 0, r.decision) for r in url_filters.judge(captures, listed).collect())
    assert got == [(0, "default"), (1, "default"), (2, "default"), (3, "block"), (3, "block"), (4, "block")]
    assert url_filters.judge(captures.limit(0), listed).collect() == []
    assert {r.decision for r in url_filters.judge(captures, listed.limit(0)).collect()} == {"default"}
    assert url_filters.allowed(captures, listed).count() == 3
