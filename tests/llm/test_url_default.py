"""The URL filter with its production threshold, run to the tolerance."""

from __future__ import annotations

from answerscore.llm import url_graph


def page(i, url, *links):
    return i, url, "".join(f'<a href="{x}">l</a>' for x in links)


def test_default_threshold_blocks_hosts_that_link_to_blocked_ones(spark):
    rows = [
        page(1, "http://bad.net/x", "http://clean.com/"), page(2, "http://spam.com/p", "http://bad.net/"), page(3, "http://clean.com/", "/own"),
        page(4, "http://few.com/", "http://bad.net/", "http://clean.com/", "http://clean.com/b", "http://clean.com/c"),
        page(5, "http://good.org/fr/a", "http://torn.com/"), page(6, "http://torn.com/", "http://bad.net/", "http://good.org/fr/a"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_graph.judge(pages).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow"}


def test_scores_reach_the_tolerance(spark):
    pages = spark.createDataFrame([page(1, "http://a.org/fr/", "http://b.com/"), page(2, "http://b.com/", "http://a.org/fr/")], "page_id long, url string, html string")
    trust = {r["host"]: r["trust"] for r in url_graph.host_scores(pages).collect()}
    assert abs(trust["a.org"] - 0.15 / (1 - 0.85**2)) < 1e-5 and abs(trust["b.com"] - 0.85 * trust["a.org"]) < 1e-5
