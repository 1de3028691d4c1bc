import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import docs, table_rows, words
from pyspark.sql import functions as F

from gridlore.llm import q_mixing, q_sharding, q_urlfilter, sharding
from gridlore.llm.mixing import mix
from gridlore.llm.urlfilter import build_filter, judge_urls, rules_frame

ODD = [(None, "a b", "en", "x"), (1, None, "en", None), (2, "", None, ""), (3, " \n\t", "en", "x"), (4, "same text", "en", "x"), (4, "same text", "en", "x"), (5, "same text", "de", None), (6, "w " * 30_000, "en", "big")]


# ---- sharding

def check_law(rows, n, shards):
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == n and (not n or max(sizes.values()) - min(sizes[s] for s in range(shards)) <= 1)
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


def test_op1_over_its_table(spark, sf):
    got = [r.asDict() for r in q_sharding.query(spark, sf).collect()]
    want = {r["doc_id"]: r["text"] for r in table_rows(spark, sf, "documents")}
    check_law(got, len(want), 8)
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    for r in got:
        raw = want[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in q_sharding.query(spark, sf).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in got}


CLASH = ["n_words", "kept", "skey", "h", "at", "b", "t", "w", "c0", "part", "__h", "__b", "__text", "__size"]


def clash():
    return {c: F.lit(f"clash {c}") for c in CLASH}


def test_shuffle_of_odd_rows(spark):
    df = docs(spark, ODD).withColumns({"shard": F.lit("clash"), "slot": F.lit("clash"), "size": F.lit(1), **clash()})
    got = [r.asDict() for r in sharding.shuffle_into_shards(df, 3).collect()]
    check_law(got, len(ODD), 3)
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t) for i, t, _, _ in ODD)
    assert all(r["size"] == 1 and all(r[c] == f"clash {c}" for c in CLASH) for r in got)
    assert sharding.shuffle_into_shards(df.limit(0), 3).count() == 0
    few = sharding.shuffle_into_shards(df.where("doc_id = 1"), 8).collect()
    assert [(r["shard"], r["slot"]) for r in few] == [(0, 0)]


def test_repeats_are_spread(spark):
    got = sharding.shuffle_into_shards(spark.range(3000).selectExpr("id % 1500 AS doc_id"), 8, tiles=4, blocks=16).collect()
    check_law([r.asDict() for r in got], 3000, 8)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["shard"], r["slot"]))
    together = [p for p in by.values() if p[0][0] == p[1][0]]
    assert abs(len(together) - 1500 / 8) < 5 * (1500 / 8) ** 0.5  # as by chance
    assert sum(abs(a[1] - b[1]) == 1 for a, b in together) < 12


def test_matrix_has_exact_margins_and_the_law():
    rows, shards = [5, 0, 17, 30, 8], [20, 20, 20]
    seen = []
    for seed in range(400):
        m = sharding.communication_matrix(rows, shards, seed)
        assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).tolist() == shards
        seen.append(m[3, 0])
    n, k, d = 60, 20, 30  # hypergeometric mean and variance
    var = d * (k / n) * (1 - k / n) * (n - d) / (n - 1)
    assert abs(np.mean(seen) - d * k / n) < 4 * (var / 400) ** 0.5
    assert 0.7 < np.var(seen) / var < 1.4


def test_own_sampler_equals_the_law(monkeypatch):
    monkeypatch.setattr(sharding, "NUMPY_ITEMS", 0)
    rng = np.random.default_rng(1)
    draws = Counter(sharding.hypergeometric(rng, 7, 5, 6) for _ in range(20_000))
    for k in range(1, 7):
        p = math.comb(7, k) * math.comb(5, 6 - k) / math.comb(12, 6)
        assert abs(draws[k] / 20_000 - p) < 0.02
    big = sharding.hypergeometric(rng, 10**11, 3 * 10**11, 10**10)
    assert abs(big - 2.5e9) < 10 * (10**10 * 0.25 * 0.75) ** 0.5


def test_uniform_over_positions(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"))
    hits = Counter()
    for seed in range(12):
        hits.update(r["shard"] for r in sharding.shuffle_into_shards(df, 4, seed=seed).where("doc_id < 40").collect())
    assert all(70 < hits[s] < 170 for s in range(4))  # 120 expected


# ---- mixing

def water_fill(totals, weights=(3, 1, 2), share=1.5, cap=2.0):
    order = sorted((s for s in totals if s is not None)) + [s for s in totals if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, share * sum(totals.values()), set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level >= cap * totals[s]}
        if not full:
            target |= {s: w[s] * level for s in open_}
            break
        for s in full:
            target[s] = cap * totals[s]
            left -= target[s]
        open_ -= full
    return target


def brute_rates(sizes, target, cap=2.0):
    """Entropy balancing of one source by bisection on its multiplier."""
    mean = sum(sizes) / len(sizes)
    rate = lambda lam: [min(cap, math.exp(min(lam * x / mean, 50))) for x in sizes]
    lo, hi = -500.0, 500.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(r * x for r, x in zip(rate(mid), sizes)) < target else (lo, mid)
    return rate(lo)


def test_op3_over_its_table(spark, sf):
    got = [r.asDict() for r in q_mixing.query(spark, sf).collect()]
    table = {r["doc_id"]: r for r in table_rows(spark, sf, "documents")}
    sizes = {i: len(words(r["text"])) for i, r in table.items()}
    totals, taken, mine = defaultdict(int), defaultdict(int), defaultdict(list)
    for i, r in table.items():
        totals[r["source"]] += sizes[i]
    want = water_fill(totals)
    assert len(got) == len(table)
    for r in got:
        s = table[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"]) == (sizes[r["doc_id"]], totals[s])
        assert r["target"] == pytest.approx(want[s], rel=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
        mine[s].append(r)
    for s, rows in mine.items():
        assert abs(taken[s] - want[s]) <= max(sorted(r["size"] for r in rows)[: max(1, len(rows) // 2)])
        if want[s] < 2 * totals[s] * (1 - 1e-9):
            for r, b in zip(rows, brute_rates([r["size"] for r in rows], want[s])):
                assert r["rate"] == pytest.approx(b, rel=1e-3)
    again = {r["doc_id"]: r["taken"] for r in q_mixing.query(spark, sf).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_mix_of_odd_rows(spark):
    df = docs(spark, ODD).withColumns({"size": F.lit("clash"), "target": F.lit(1), **clash()})
    got = [r.asDict() for r in mix(df, key=["doc_id", "text"]).collect()]
    assert all(r[c] == f"clash {c}" for r in got for c in CLASH)
    assert len(got) == len(ODD) and {r["source"] for r in got} == {s for *_, s in ODD}
    want = water_fill({s: sum(len(words(t)) for _, t, _, x in ODD if x == s) for s in {s for *_, s in ODD}})
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 2 * r["size"]
        if not r["size"]:
            assert (r["copies"], r["taken"]) == (1, 0)
    assert mix(df.limit(0), key=["doc_id"]).count() == 0


def test_a_large_group_of_copies_is_shared_out_exactly(spark):
    rows = [(i, "one two three", "en", "a") for i in range(700)] + [(1000 + i, "w " * (1 + i % 90), "en", "b" if i % 2 else "c") for i in range(300)]
    got = [r.asDict() for r in mix(docs(spark, rows), key=["doc_id"]).collect()]
    for s in "abc":
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 3


def test_mix_without_a_broadcast_agrees(spark, monkeypatch):
    df = docs(spark, [(i, "w " * (1 + i % 9), "en", "abc"[i % 3]) for i in range(400)] + [(7, "w w", "en", "a")] * 60)
    one = Counter((r["doc_id"], r["copies"]) for r in mix(df, key=["doc_id"]).collect())
    monkeypatch.setattr("gridlore.llm.mixing.MAX_BROADCAST_CELLS", 3)
    assert Counter((r["doc_id"], r["copies"]) for r in mix(df, key=["doc_id"]).collect()) == one
    mine = [r for r in mix(df, key=["doc_id"]).collect() if r["source"] == "a"]
    assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 3 and max(r["copies"] for r in mine) <= 2


def test_a_dual_that_does_not_settle_is_an_error(spark, monkeypatch):
    monkeypatch.setattr("gridlore.llm.mixing.MAX_ITERATIONS", 0)
    with pytest.raises(RuntimeError):
        mix(docs(spark, [(i, "w " * (1 + i % 9), "en", "abc"[i % 3]) for i in range(30)]), key=["doc_id"])


# ---- urls

def brute_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


ODD_URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com", "http://example.com/", "http://xexample.com/en/", "http://a.b.net/fr/?q", "x://net/es/",
    "http://net?/es/", "http://NET/es", "http://a//b://c", "http://ÄÖ.com/en/", "http://u@example.com:80/en/", "http://www.example.com/en/", "http://m.www.example.com/en/a", "http://.com/", "a\nb://net/es/", "http://" + "x." * 3000 + "com/", "http://" + "x." * 3000 + "c.b.a.com/x/y", "http://net/fr/" + "y" * 100_000,
]


def test_op9_over_its_table(spark, sf):
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in q_urlfilter.query(spark, sf).collect()}
    for r in table_rows(spark, sf, "pages"):
        assert got[r["page_id"]] == brute_verdict(r["url"], q_urlfilter.RULES)


@pytest.mark.parametrize("literal", [True, False])
def test_urls_against_brute_force(spark, monkeypatch, literal):
    if not literal:
        monkeypatch.setattr("gridlore.llm.urlfilter.MAX_LITERAL_WORDS", 0)
        monkeypatch.setattr("gridlore.llm.urlfilter.MAX_BROADCAST_RULES", 0)
    rnd = random.Random(3)
    hosts = ["com", "net", "a.com", "b.a.com", "a.net", "c.b.a.com"]
    rules = q_urlfilter.RULES + [(h, p, rnd.choice(["allow", "block"])) for h in hosts[2:] for p in ("", "/x", "/x/y")]
    urls = ODD_URLS + [f"http://{rnd.choice(hosts)}{rnd.choice(['', '/', '/x', '/x/y/z', '/q'])}" for _ in range(150)] + ["http://a.com/x"] * 40
    df = spark.createDataFrame([(i // 2, u, "k") for i, u in enumerate(urls)], "page_id long, url string, key string").withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "labels", "c0")})
    got = Counter((r["page_id"], r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(df, rules_frame(spark, rules), carry=("page_id", "url", "host", "labels", "c0")).collect())
    assert got == Counter((i // 2, u, *brute_verdict(u, rules)) for i, u in enumerate(urls))


def test_empty_list_and_empty_table(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = rules_frame(spark, [("x", "", "block")]).limit(0)
    assert [r["verdict"] for r in judge_urls(df, none, default="block").collect()] == ["block"]
    assert judge_urls(df.limit(0), rules_frame(spark, q_urlfilter.RULES)).count() == 0


def test_filter_has_no_false_negative_and_few_false_positives(spark):
    from gridlore.llm.urlfilter import BITS_PER_KEY, _bits, _hit

    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    n_blocks = 1000 * BITS_PER_KEY // 256
    built = build_filter(keys.where("id < 1000"), n_blocks)
    block, probes = _bits(F.col("key"), n_blocks)
    hit = F.coalesce(_hit(F.col("words"), F.lit(0), probes), F.lit(False))
    tested = keys.withColumn("block", block).join(built, "block", "left").select("id", hit.alias("hit")).collect()
    assert all(r["hit"] for r in tested if r["id"] < 1000)
    assert sum(r["hit"] for r in tested if r["id"] >= 1000) < 50
