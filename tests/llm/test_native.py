"""Line dedup, mixing, url graph and licence scan against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from answerscore.llm import licences, line_dedup, mixing, url_graph


def brute_dedup(docs, least):
    order = sorted(docs)
    lines = {i: (docs[i] or "").split("\n") if docs[i] is not None else [] for i in order}
    places = defaultdict(list)
    for i in order:
        for p, line in enumerate(lines[i]):
            places[line].append((i, p))
    out = {}
    for i in order:
        mine, gone = lines[i], set()
        for p in range(len(mine)):
            best = 0
            for j, q in places[mine[p]]:
                if (j, q) >= (i, p):
                    break
                n = 0
                while p + n < len(mine) and q + n < len(lines[j]) and mine[p + n] == lines[j][q + n]:
                    n += 1
                best = max(best, n)
            if best and sum(len(x.split()) for x in mine[p : p + best]) >= least:
                gone.update(range(p, p + best))
        out[i] = docs[i] if docs[i] is None else "\n".join(x for p, x in enumerate(mine) if p not in gone)
    return out


@pytest.mark.parametrize("seed, least", [(1, 1), (2, 5), (4, 30)])
def test_line_dedup(spark, seed, least):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 4))) for _ in range(7)]
    docs = {i * 3: "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 25))) for i in range(25)} | {4: None, 5: "", 7: "\n\n"}
    docs |= {200: docs[0], 201: docs[3] + "\n" + docs[6]}
    df = spark.createDataFrame([(i, t, "keep") for i, t in docs.items()], "doc_id long, text string, runs string")
    rows = line_dedup.strip(df, least).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == brute_dedup(docs, least)
    assert all(r["n_removed"] == sum(x["end"] - x["first"] for x in r["runs"]) for r in rows)
    lines = {i: (t or "").split("\n") for i, t in docs.items()}
    for r in rows:
        for c in r["copies"]:
            run = lines[r["doc_id"]][c["first"] : c["end"]]
            assert run == lines[c["source"]][c["source_first"] : c["source_first"] + len(run)] and (c["source"], c["source_first"]) < (r["doc_id"], c["first"])
            assert sum(len(x.split()) for x in run) >= least and any(x["first"] <= c["first"] and c["end"] <= x["end"] for x in r["runs"])
    whole = next(r for r in rows if r["doc_id"] == 200)
    if sum(len(x.split()) for x in lines[0]) >= least:
        assert [tuple(c) for c in whole["copies"]] == [(0, len(lines[0]), 0, 0)]


def test_line_dedup_of_many_lines(spark):
    long = "\n".join(f"{i} b c d" for i in range(6000))
    df = spark.createDataFrame([(1, long), (2, "own line of this text here\n" + long), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.strip(df).collect()}
    assert got[2]["text"] == "own line of this text here" and got[1]["text"] == long and got[3]["text"] is None
    assert [tuple(c) for c in got[2]["copies"]] == [(1, 6001, 1, 0)] and [tuple(x) for x in got[2]["runs"]] == [(1, 6001)]


def test_line_dedup_edges(spark):
    long = " ".join(str(i) for i in range(20))
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (2, long + "\nx"), (1, "other\n" + long)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in line_dedup.strip(df).collect())
    # rows that repeat id and text are one document; null ids come last
    assert got[(2, "x")] == 1 and got[(None, "")] == 1
    # which of the two documents of id 1 comes first is decided by the hash of the text
    assert got == Counter({(1, long): 2, (1, "other"): 1, (2, "x"): 1, (None, ""): 1}) or got == Counter({(1, ""): 2, (1, "other\n" + long): 1, (2, "x"): 1, (None, ""): 1})
    assert line_dedup.strip(df.limit(0)).count() == 0


def brute_targets(sizes, cap=3):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), set(order)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= cap * sizes[s]
        free -= over
    return target


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", "B", "é", "zz", None]), " ".join("w" for _ in range(int(rng.paretovariate(0.8)) % 4000)), 1) for i in range(400)]
    rows += [(1000 + i, "hot", "same size here", 1) for i in range(300)] + [(2000, "tiny", "one", 1), (2001, "none", None, 1), (2002, "none", " \t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
    want, taken = brute_targets(dict(sizes)), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 3 * r["size"] and abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + want[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    for source in sizes:  # the rates are the exponential tilt that meets the target
        own = [r for r in got if r["source"] == source]
        if 0 < want[source] < 3 * sizes[source] * (1 - 1e-9):
            scale, low, high = sizes[source] / len(own), -1e4, 1e4
            for _ in range(200):
                lam = (low + high) / 2
                rates = [3 / (1 + 2 * math.exp(min(700, -lam * r["size"] / scale))) for r in own]
                if sum(x * r["size"] for x, r in zip(rates, own)) < want[source]:
                    low = lam
                else:
                    high = lam
            assert all(abs(x - r["rate"]) < 1e-3 for x, r in zip(rates, own))
    assert Counter((r["doc_id"], r["taken"]) for r in got) == Counter((r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(7)).collect())
    copies = mixing.mix_copies(docs)
    assert copies.columns == docs.columns
    words = Counter()
    for r in copies.collect():
        words[r["source"]] += len((r["text"] or "").split())
    assert {s: words[s] for s in sizes} == {s: taken[s] for s in sizes}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix_copies(docs.limit(0)).count() == 0


def test_url_rules(spark):
    urls = {
        "http://A.Example.NET/en/x?y": ("a.example.net", "/en/x", "example.net/en/", "allow"), "https://b.net/": ("b.net", "/", "net/", "block"), "https://b.net": ("b.net", "", None, None),
        "x://example.com/de/1#z": ("example.com", "/de/1", "example.com/de/", "block"), "ftp://sub.org/fr/": ("sub.org", "/fr/", "org/fr/", "allow"), "http://notexample.net/en/": ("notexample.net", "/en/", "net/", "block"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://h.com?q=://x/": ("h.com", "", None, None), "http://org/fr/a\nb": ("org", "/fr/a\nb", "org/fr/", "allow"),
    }
    rows = [(i, u, None, "v") for i, u in enumerate(urls)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    got = url_graph.judge(pages).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        host, path, rule, verdict = urls[rows[r["page_id"]][1]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict)
    assert url_graph.judge(pages.limit(0)).count() == 0


def test_trust_and_distrust_against_brute_force(spark):
    def page(i, url, *links):
        return i, url, "".join(f'<a href="{x}">l</a><A class=b HREF = \'{x}\'>l</A>' for x in links)

    rows = [page(1, "http://good.org/fr/a", "http://friend.com/x", "/own"), page(2, "http://friend.com/", "//mate.com/y"), page(3, "http://bad.net/x", "http://good.org/"), page(4, "http://spam.com/p", "http://bad.net/", "http://bad.net/z"), page(5, "http://mate.com/"), page(6, "http://half.com/", "http://bad.net/", "http://friend.com/")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = Counter({("good.org", "friend.com"): 2, ("good.org", "good.org"): 2, ("friend.com", "mate.com"): 2, ("bad.net", "good.org"): 2, ("spam.com", "bad.net"): 4, ("half.com", "bad.net"): 2, ("half.com", "friend.com"): 2, ("mate.com", "mate.com"): 1})
    hosts = {h for e in edges for h in e}
    out = Counter()
    for (a, _), n in edges.items():
        out[a] += n
    t0, b0 = {h: float(h == "good.org") for h in hosts}, {h: float(h == "bad.net") for h in hosts}
    t, b = dict(t0), dict(b0)
    for _ in range(200):
        t = {h: 0.15 * t0[h] + 0.85 * sum(t[a] * n / out[a] for (a, d), n in edges.items() if d == h) for h in hosts}
        b = {h: 0.15 * b0[h] + 0.85 * sum(b[d] * n / out[a] for (a, d), n in edges.items() if a == h) for h in hosts}
    got = {r["host"]: r for r in url_graph.host_scores(pages, rounds=100).collect()}
    assert set(got) == hosts
    assert all(abs(got[h]["trust"] - t[h]) < 1e-3 and abs(got[h]["distrust"] - b[h]) < 1e-3 for h in hosts)
    verdicts = {r["page_id"]: r["verdict"] for r in url_graph.judge(pages, threshold=0.1).collect()}
    assert verdicts == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "block" if b["half.com"] - t["half.com"] >= 0.1 else "allow"}


def test_licences(spark):
    texts = {
        1: "Words.\nReleased under the MIT License.", 2: "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0. You may not use this file except in compliance with the License.", 3: None, 4: "",
        5: "The mit license is nice", 6: "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.\nAll rights reserved.",
        7: 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.\n\nThe software is provided "as is", without warranty of any kind, express or implied.',
    }
    docs = spark.createDataFrame([(i, t, "l") for i, t in texts.items()], "doc_id long, text string, licences string")
    got = {r["doc_id"]: (["|".join((str(x["pos"]), x["id"])) for x in r["sentences"]], [x["licence"] for x in r["licences"]]) for r in licences.scan(docs).collect()}
    assert got[1] == (["1|mit-notice"], ["MIT"]) and got[2] == (["0|apache2-notice", "1|apache2-use"], ["Apache-2.0"])
    assert got[3] == got[4] == got[5] == ([], [])
    assert got[6][1] == ["GPL-3.0", "CC-BY-NC-4.0", "Proprietary"] and got[7] == (["0|mit-grant", "1|mit-warranty"], ["MIT"])
    rule = {r["doc_id"]: r["rule"] for r in licences.scan(docs).select("doc_id", F.get("licences", F.lit(0))["rule"].alias("rule")).filter("rule is not null").collect()}
    assert licences.RULES[rule[7]][1] == ("mit-grant", "mit-warranty")
    assert licences.scan(docs.limit(0)).count() == 0
