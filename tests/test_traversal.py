from __future__ import annotations

import random
from collections import deque
from urllib.parse import urlparse
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from docloom.operators.robots import allowed, parse_robots
from docloom.operators.traversal import crawl, in_scope

H = "https://h.org"


def sequential(start, pages, links, blocked, depth, limit):
    """One crawl with a plain queue: the set of final URLs."""
    host, seen, queue = urlparse(start).netloc, set(), deque([(start, 0)])
    while queue and (limit is None or len(seen) < limit):
        url, level = queue.popleft()
        if (depth is not None and level > depth) or url in seen or url in blocked:
            continue
        if urlparse(url).netloc != host or url not in pages:
            continue
        final, content = pages[url]
        if urlparse(final).netloc != host or not content:
            continue
        seen.add(final)
        for href in links.get(url, []):
            target = href.split("#")[0].replace(url, final) if href else ""
            if href and target not in seen and target not in [u for u, _ in queue]:
                queue.append((target, level + 1))
    return seen


def random_site(seed):
    rng = random.Random(seed)
    names = [f"{H}/p{i}/" for i in range(24)]
    pages, links = {}, {}
    for i, url in enumerate(names):
        final = url
        if i and i % 7 == 3:
            final = names[(i // 7) * 5 + 1] if ((i // 7) * 5 + 1) % 7 != 3 else url
        if i == 20:
            final = "https://away.org/x"
        pages[url] = (final, "" if i in (9, 14) else "text")
        links[url] = [
            rng.choice([*names, "", "https://away.org/", f"{H}/missing/", rng.choice(names) + "#s", url])
            for _ in range(rng.randint(0, 6))
        ]
    blocked = {names[5], names[17]}
    return names, pages, links, blocked


@pytest.mark.parametrize("depth, limit", [(None, None), (0, None), (2, None), (None, 0), (None, 4), (3, 7)])
def test_same_pages_as_a_sequential_queue(spark, depth, limit):
    starts, captures, edges, rules, expected = [], [], [], [], {}
    for seed in range(4):
        names, pages, links, blocked = random_site(seed)
        host = f"h{seed}.org"

        def move(url, host=host):
            return url.replace("h.org", host)

        starts.append((seed, move(names[0])))
        captures += [(move(u), move(f), c) for u, (f, c) in pages.items()]
        edges += [(move(u), i, move(h)) for u, hs in links.items() for i, h in enumerate(hs)]
        rules += [(host, i, "*", "Disallow", urlparse(u).path) for i, u in enumerate(sorted(blocked))]
        expected[seed] = {move(u) for u in sequential(names[0], pages, links, blocked, depth, limit)}
    got = crawl(
        spark.createDataFrame(starts, "crawl_id long, start_url string"),
        spark.createDataFrame(captures, "url string, final_url string, content string"),
        spark.createDataFrame(edges, "url string, link_pos int, href string"),
        spark.createDataFrame(rules, "netloc string, rule_no int, agent string, directive string, path string"),
        depth=depth,
        limit=limit,
    ).collect()
    for seed in range(4):
        assert {r["url"] for r in got if r["crawl_id"] == seed} == expected[seed], seed
    assert len(got) == sum(map(len, expected.values()))


def test_crawls_of_different_bounds_run_together(spark):
    own = [(None, None, False), (0, None, False), (2, None, True), (None, 0, False), (None, 4, True), (3, 7, None), (None, 1, False)]
    starts, captures, edges, rules, expected = [], [], [], [], {}
    for seed, (depth, limit, ignores) in enumerate(own):
        names, pages, links, blocked = random_site(seed % 4)
        host = f"h{seed}.org"

        def move(url, host=host):
            return url.replace("h.org", host)

        starts.append((seed, move(names[0]), depth, limit, ignores))
        captures += [(move(u), move(f), c) for u, (f, c) in pages.items()]
        edges += [(move(u), i, move(h)) for u, hs in links.items() for i, h in enumerate(hs)]
        rules += [(host, i, "*", "Disallow", urlparse(u).path) for i, u in enumerate(sorted(blocked))]
        shut = set() if ignores else blocked
        expected[seed] = {move(u) for u in sequential(names[0], pages, links, shut, depth, limit)}
    got = crawl(
        spark.createDataFrame(starts, "crawl_id long, start_url string, depth int, limit long, ignore_robots boolean"),
        spark.createDataFrame(captures, "url string, final_url string, content string"),
        spark.createDataFrame(edges, "url string, link_pos int, href string"),
        spark.createDataFrame(rules, "netloc string, rule_no int, agent string, directive string, path string"),
    ).collect()
    for seed in expected:
        assert {r["url"] for r in got if r["crawl_id"] == seed} == expected[seed], seed
    assert expected[3] == set() and len(expected[1]) == len(expected[6]) == 1


def test_fragments_foreign_hosts_and_empty_links_are_skipped(spark):
    start = f"{H}/start"
    hrefs = [f"{H}/page1", f"{H}/page2", f"{H}/page2#section", "https://other.org/x", "", start]
    pages = [start, f"{H}/page1", f"{H}/page2", f"{H}/page2#section", "https://other.org/x"]
    got = crawl(
        spark.createDataFrame([(1, start)], "crawl_id long, start_url string"),
        spark.createDataFrame([(p, p, "text") for p in pages], "url string, final_url string, content string"),
        spark.createDataFrame([(start, i, h) for i, h in enumerate(hrefs)], "url string, link_pos int, href string"),
    )
    assert {r["url"]: r["depth"] for r in got.collect()} == {start: 0, f"{H}/page1": 1, f"{H}/page2": 1}


def test_scope_is_tested_before_and_after_a_redirect(spark):
    rows = [
        (f"{H}/a", f"{H}/b", True), (f"{H}/a", "https://o.org/", False), ("https://o.org/", f"{H}/a", False),
        ("https://h.org:81/a", "https://h.org:81/a", False), ("http://h.org/a", "http://h.org/a", True),
        ("https://H.org/a", "https://H.org/a", False),
    ]
    df = spark.createDataFrame([(H, *r) for r in rows], "start_url string, url string, final_url string, ok boolean")
    assert {(r["url"], r["final_url"]) for r in in_scope(df).collect()} == {(a, b) for a, b, ok in rows if ok}


def test_deep_crawl(spark):
    pages = [f"{H}/{i:02d}/" for i in range(26)]
    got = crawl(
        spark.createDataFrame([(1, pages[0])], "crawl_id long, start_url string"),
        spark.createDataFrame([(p, p, "text") for p in pages], "url string, final_url string, content string"),
        spark.createDataFrame(
            [(a, 0, b) for a, b in zip(pages, pages[1:] + pages[:1], strict=True)], "url string, link_pos int, href string"
        ),
    )
    assert {r["url"]: r["depth"] for r in got.collect()} == {p: i for i, p in enumerate(pages)}


ROBOTS = {
    "plain": "User-agent: *\nDisallow: /blocked\nAllow: /docs\n",
    "order": "user-agent: *\nallow: /x/y\ndisallow: /x\n",
    "empty": "User-agent: *\nDisallow:\nDisallow: /\n",
    "agents": "User-agent: bot\nDisallow: /\n\nUser-agent: *\nUser-agent: other\nDisallow: /p # no\n",
    "quoted": "User-agent: *\nDisallow: /caf%C3%A9\nDisallow: /q?a=\n",
    "second": "User-agent: *\nDisallow: /one\n\nUser-agent: *\nDisallow: /two\n",
    "none": "# nothing\n",
    "blank": "User-agent: *\nDisallow: /one\n\nDisallow: /two\n",
    "early": "User-agent: *\n\nDisallow: /one\nUser-agent: x\nDisallow: /two\n",
    "comment": "User-agent: *\n# note\n \nDisallow: /one\n",
}
PATHS = ["/", "", "/blocked/x", "/docs", "/x/y/z", "/x/a", "/p1", "/café/1", "/caf%C3%A9", "/q?a=1", "/one", "/two", "/a+b"]


def test_robots_rules_decide_like_the_standard_parser(spark):
    files = spark.createDataFrame([(f"{k}.org", v) for k, v in ROBOTS.items()], "netloc string, body string")
    urls = [(f"https://{k}.org{p}",) for k in [*ROBOTS, "unlisted"] for p in PATHS]
    got = allowed(spark.createDataFrame(urls, "url string"), parse_robots(files)).collect()
    assert len(got) == len(urls)
    for row in got:
        parser = RobotFileParser()
        parser.parse(ROBOTS.get(urlparse(row["url"]).netloc.removesuffix(".org"), "").splitlines())
        assert row["allowed"] == parser.can_fetch("*", row["url"]), row["url"]


def test_numbers_span_partitions(spark):
    from docloom.operators.ranking import best_per_group, number_rows

    df = spark.range(5000).select(
        (F.col("id") * 7919 % 5000).alias("v"), F.when(F.col("id") % 3 == 0, "hot").otherwise("rest").alias("g")
    )
    rows = number_rows(df, "n", ["v"], within=["g"]).collect()
    for group in ("hot", "rest"):
        ordered = sorted((r["v"], r["n"]) for r in rows if r["g"] == group)
        assert [n for _, n in ordered] == list(range(1, len(ordered) + 1))
    best = best_per_group(df, ["g"], [F.desc("v")], 5, spread="v", name="rank").collect()
    for group in ("hot", "rest"):
        wanted = sorted((r["v"] for r in rows if r["g"] == group), reverse=True)[:5]
        assert [r["v"] for r in sorted(best, key=lambda r: r["rank"]) if r["g"] == group] == wanted
