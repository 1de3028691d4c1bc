import hashlib
import html
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from helpers import docs, lowered, table_rows, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlore.llm import chat, common, decontam, htmltext, langid, lmscore, neardup, q_chat, q_decontam, q_htmltext, q_langid, q_lmscore, q_neardup, q_quality, quality
from gridlore.llm.graph import components

ODD = [(None, "a b c d", "en", "x"), (1, None, "en", None), (2, "", None, ""), (3, " \n\t", "en", "x"), (4, "the same text here", "en", "x"), (4, "the same text here", "en", "x"), (5, "THE same\ntext here", "de", None), (6, "w x " * 30_000, "en", "big")]


# ---- languages

def test_op2_learns_held_out_languages(spark, sf):
    got = {r["doc_id"]: r for r in q_langid.query(spark, sf).collect()}
    table = table_rows(spark, sf, "documents")
    assert len(got) == len(table)
    held = [r for r in table if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(got[r["doc_id"]]["held_out"] == (r in held) for r in table)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)


def test_odd_texts_of_languages(spark):
    model = langid.train([("en", langid.gram_counts("the and that with")), ("fr", langid.gram_counts("le la les élève"))] * 5)
    df = docs(spark, [*ODD, (9, "1 2 3 !", "en", "x"), (10, "les élèves", None, "x"), (11, "\U00010400\U00010401", "en", "x")]).withColumns({"score": F.lit(7), "t": F.lit(8), "c0": F.lit(9)})
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(df, model, text_col="text", carry=["doc_id", "score", "t", "c0"]).collect()]
    by = dict((i, (p, s)) for i, p, s in got)
    assert len(got) == len(ODD) + 3
    assert by[1] == by[2] == by[3] == by[9] == ("und", 0.0)
    assert by[10][0] == "fr" and by[11][0] in ("en", "fr")
    nothing = langid.fit(df.where("false"), text_col="text", lang_col="lang", id_col="doc_id")
    assert nothing.predict("the text") == ("und", 0.0, True)


def test_the_sample_is_bounded_and_frequencies_are_not(spark, monkeypatch):
    rows = [(7, "the same id again", "en", "x")] * 400 + [(7, f"an id given twice {chr(97 + i % 26)}{i}", "en", "x") for i in range(300)] + [(i, f"ein anderer text {i}", f"l{i % 30}", "x") for i in range(60)]
    seen = {}
    monkeypatch.setattr(langid, "train", lambda samples, df, n: seen.update(samples=samples, df=df, n=n))
    langid.fit(docs(spark, rows).withColumns({"key": F.lit(1), "lang_": F.lit(2)}), text_col="text", lang_col="lang", id_col="doc_id", per_language=20)
    per = Counter(lang for lang, _ in seen["samples"])
    assert len(per) == 31 and max(per.values()) <= 20 and seen["n"] == len(rows)
    assert (seen["df"] == np.sum([langid.gram_counts(t) > 0 for _, t, _, _ in rows], axis=0)).all()


def test_cosine_is_the_brute_force_one():
    texts = {"a": "alpha beta gamma", "b": "один два три"}
    model = langid.train([(k, langid.gram_counts(t)) for k, t in texts.items()])
    c = langid.gram_counts("alpha два").astype(float)
    v = np.where(c > 0, 1 + np.log(np.maximum(c, 1)), 0) * model.idf
    want = max(float(m @ v / np.linalg.norm(v)) for m in model.centroids)
    assert model.predict("alpha два")[1] == pytest.approx(want, abs=1e-5)
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)


# ---- near-duplicates

def brute_components(rows, width, percent):
    sets, root = {}, {}
    for i, t in rows:
        w = words(lowered(t))
        sets[i] = frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    for i, s in sets.items():
        shared = Counter(j for x in s for j in inverted[x] if j > i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_op4_equals_brute_force(spark, sf):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in q_neardup.query(spark, sf).collect()}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in table_rows(spark, sf, "documents")], 3, 85)


def test_dense_family_in_blocks(spark, monkeypatch):
    """A chain of drifting copies and a star of copies that share a common passage, over several blocks."""
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [rnd.choice(vocabulary) for _ in range(90)]
    rows, text = [], list(base)
    for i in range(60):
        rows.append((i, " ".join(text)))
        text = list(text)
        text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
    for i in range(60, 120):
        copy = list(base)
        for _ in range(rnd.choice([0, 1, 2, 5, 9])):
            copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(copy)))
    rows += [(200 + i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 200))) + " " + " ".join(base[:20])) for i in range(40)]
    want = brute_components(rows, 3, 85)
    df = docs(spark, [(i, t, "en", "x") for i, t in rows]).withColumns({"rep": F.lit(1), "n": F.lit("clash"), "t1": F.lit(None).cast("string")})
    made = neardup.sketch(df, text_col="text", id_col="doc_id", width=3).where("n > 0")
    grouped = made.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("t1").alias("t1"), F.first("t2").alias("t2"), F.first("sketch").alias("sketch")).cache()
    reps = {r["rep"] for r in grouped.collect()}
    monkeypatch.setattr(neardup, "PART", 9000)  # the centre's family is dealt out in parts too
    for rounds in (0, 1):
        small = neardup.links(df, grouped, text_col="text", width=3, percent=85, block=9000, rounds=rounds)
        rooted = {r["node"]: r["root"] for r in components(small).collect()}
        assert {i: rooted.get(i, i) for i in reps} == {i: want[i][1] for i in reps}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()}
    assert got == want


def test_links_are_between_texts_not_ids(spark):
    rnd = random.Random(2)
    one, other = ([f"{c}{rnd.randrange(9999)}" for _ in range(90)] for c in "ab")
    near = [*one[:-1], "last"]
    rows = [(5, " ".join(one)), (5, " ".join(other)), (3, " ".join(near)), (None, " ".join([*other[:-1], "end"])), (None, "alone with no id at all"), (9, " ".join(other))]
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs(spark, [(i, t, "en", "x") for i, t in rows])).collect()]
    assert Counter(got) == Counter([(5, 3, False), (3, 3, True), (5, 5, True), (9, 5, False), (None, 5, False), (None, None, True)])


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 30), min_size=1), st.sets(st.integers(0, 30), min_size=1), st.sets(st.integers(0, 30), min_size=1))
def test_rings_lose_no_link(a, b, c):
    a, b, c = (np.array(sorted(x), np.uint64) for x in (a, b, c))
    ring = lambda x, y: neardup.ring(x, y, 85)
    inter = len(np.intersect1d(a, b))
    assert (ring(a, b) == 0) == (100 * inter >= 85 * (len(a) + len(b) - inter))
    if ring(a, c) == 0 and ring(a, b) == 0:  # a links b and c, so b is no further than ring 1 from c
        assert ring(b, c) < 2


def test_odd_rows_of_near_duplicates(spark):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs(spark, ODD)).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 2, 4, True), (4, 2, 4, True), (5, 2, 4, False), (6, 2, 6, True)], key=str)
    assert neardup.near_duplicates(docs(spark, ODD).limit(0)).count() == 0


def test_union_estimate_is_exact_on_whole_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 200, rng.integers(1, 120)).astype(np.uint64)) for _ in range(30)]
    sketches, kept = neardup._pad(sets)
    for s in sets:
        got = neardup.union_estimate(s[: neardup.SKETCH], sketches, kept)
        for o, g in zip(sets, got):
            union = np.union1d(s, o)[: neardup.SKETCH]
            assert g == pytest.approx(np.isin(union, np.intersect1d(s, o)).mean())


def test_links_of_blocks_span_those_of_all_pairs():
    rng = np.random.default_rng(4)
    base = rng.choice(5000, 120, replace=False).astype(np.uint64)
    sets = []
    for _ in range(160):
        s = base.copy()
        s[rng.choice(120, rng.integers(0, 40), replace=False)] = rng.choice(100_000, 1).astype(np.uint64) + np.uint64(5000)
        sets.append(np.unique(s))
    sets += [np.unique(rng.integers(0, 300, rng.integers(1, 9)).astype(np.uint64)) for _ in range(60)]

    def parts(edges):
        root = list(range(len(sets)))
        for a, b in edges:
            root = [root[a] if x == root[b] else x for x in root] if root[a] != root[b] else root
        return [root.index(x) for x in root]

    every = [(i, j) for i in range(len(sets)) for j in range(i) if neardup.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 85)]
    ids = list(range(len(sets)))
    assert parts(neardup.link_blocks(sets, sets, ids, ids, 85)) == parts(every)
    lists = neardup.Lists(sets)
    assert all((lists.overlaps(s) == [len(np.intersect1d(s, o)) for o in sets]).all() for s in sets[:20])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(40)] + [(7, 7), (None, 3), (300, 200), (200, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {100 + i: 100 for i in range(1, 40)} | {300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_keys_join_as_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    many = spark.createDataFrame([(1 if i < 300 else i % 40, i) for i in range(600)], "k long, v long")
    one = many.groupBy("k").agg(F.count("*").alias("m"), F.max("v").alias("top")).where("k <> 7")
    got = Counter(tuple(r) for r in common.hot_join(many, one, "k").select("k", "v", "top").collect())
    assert got == Counter(tuple(r) for r in many.join(one, "k").select("k", "v", "top").collect())


# ---- pages

def test_op5_over_its_table(spark, sf):
    got = {r["page_id"]: r for r in q_htmltext.query(spark, sf).collect()}
    for r in table_rows(spark, sf, "pages"):
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        want = "\n".join(p for p in parts if p)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>
<div class="cookie-notice">We use cookies and store them for as long as we please on your device.</div><main><h2>Head &amp; line</h2><p>First   paragraph
with <b>bold</b><i>ness</i>, &lt;tags&gt; and a <a href="y">link</a> inside it.<p>Second one, unclosed.<ul><li>point one<li>point two</ul>
<div class="ad">Buy now, all you can, for the lowest price that was ever seen in the world.</div><aside>Also read this and that.</aside>
<form><label>Name</label><input></form><blockquote>Quoted words of some length.</blockquote></main><section id="comments"><p>A reader says a long and thoughtful thing.</p></section>
<div class="sidebar"><p>Popular things that you may want to look at some time.</p></div><script>var a = "<p>no</p>";</script><footer>&copy; x</footer>"""


def test_a_page_of_many_parts():
    assert htmltext.main_text(PAGE) == "Head & line\nFirst paragraph with boldness, <tags> and a link inside it.\nSecond one, unclosed.\npoint one\npoint two\nQuoted words of some length."


def test_odd_pages(spark):
    pages = [(1, None), (2, ""), (3, "plain words only"), (4, "<p>x</p>" * 3000), (5, "<article>" + "<p>a b</p>" * 20_000 + "</article>"), (6, "<article><p>cut off <b"), (6, "<article><p>cut off <b"), (7, "<nav>only a menu</nav>"), (8, "<article><!-- <p>no</p> --><p>yes&nbsp;&#233;&bogus;</p></article>")]
    df = spark.createDataFrame(pages, "page_id long, html string").withColumns({"url": F.lit(None).cast("string"), "text": F.lit("clash")})
    got = htmltext.extract(df, carry=["page_id", "url"]).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 9 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert text[1] == text[2] == text[7] == "" and text[6].startswith("cut off") and text[8] == "yes é&bogus;"
    assert text[5].count("\n") == 19_999
    assert htmltext.extract(df.limit(0), carry=["page_id"]).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-9, 9), min_size=1, max_size=7), st.data())
def test_cut_is_minimal(odds, data):
    n = len(odds)
    pairs = list(itertools.combinations(range(n), 2))
    edges = [(i, j, float(data.draw(st.integers(1, 5)))) for i, j in (data.draw(st.lists(st.sampled_from(pairs), max_size=8)) if pairs else [])]
    cost = lambda keep: sum(o for o, k in zip(odds, keep) if o > 0 and not k) + sum(-o for o, k in zip(odds, keep) if o < 0 and k) + sum(p for i, j, p in edges if keep[i] != keep[j])
    assert cost(htmltext.minimum_cut([float(o) for o in odds], edges)) == min(cost(k) for k in itertools.product([False, True], repeat=n))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-9, 9), min_size=1, max_size=8), st.data())
def test_labels_are_the_cut_of_all_blocks(odds, data):
    edges = [(i, i + 1, 1.5) for i in range(len(odds) - 1)] + [(0, len(odds) - 1, float(data.draw(st.integers(1, 5))))] * (len(odds) > 2)
    cost = lambda keep: sum(abs(o) for o, k in zip(odds, keep) if o and (o > 0) != k) + sum(p for i, j, p in edges if keep[i] != keep[j])
    assert cost(htmltext.labels([float(o) for o in odds], edges)) == pytest.approx(cost(htmltext.minimum_cut([float(o) for o in odds], edges)))


def soup(rnd, name="", marked=False):
    """A page and its article's lines: no element says what it holds, unless ``marked``."""
    sentence = lambda n: " ".join("".join(rnd.choices("abdeilmnorstu", k=rnd.randint(2, 9))) for _ in range(n))
    inside = [rnd.choice([sentence(30) + ".", sentence(18) + ".", sentence(2)]) for _ in range(12)]
    inside[0] = inside[-1] = sentence(40) + "."
    menu = "".join(f'<li><a href="/{i}">{sentence(2)}</a></li>' for i in range(8))
    notice = f'<div class="{name}"><p>{sentence(25)}.</p></div>'
    head, tail = ("<article>", "</article>") if marked else ("<div><div>", "</div></div>")
    return f"<body><div><ul>{menu}</ul></div>{head}{''.join(f'<p>{x}</p>' for x in inside)}{tail}{notice}<div><ul>{menu}</ul></div></body>", inside


def test_the_cut_beats_a_threshold():
    rnd = random.Random(6)
    wrong = Counter()
    for _ in range(60):
        page, inside = soup(rnd, "sidebar")
        blocks, parents = htmltext.blocks_of(page)
        odds = [htmltext.log_odds(b, htmltext.View(), False) for b in blocks]
        for how, keep in (("cut", htmltext.labels(odds, htmltext.edges_of(blocks, parents))), ("threshold", [o > 0 for o in odds])):
            wrong[how] += sum(k != (b.text in inside) for b, k in zip(blocks, keep))
    assert wrong["threshold"] > 100 and wrong["cut"] < 0.2 * wrong["threshold"]


def test_names_are_learned_from_marked_pages():
    rnd = random.Random(7)
    view = htmltext.train([r for _ in range(80) for r in htmltext.labelled(soup(rnd, "zorbl", marked=True)[0])])
    page, inside = soup(rnd, "zorbl")
    assert htmltext.main_text(page, htmltext.View()).split("\n") != inside  # no list has this name
    assert htmltext.main_text(page, view).split("\n") == inside
    assert (htmltext.train([]).text == htmltext.View().text).all()


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a "' * 250_000, "<span>" * 40_000 + "</p>" * 40_000, "<b>" + "<div>" * 20_000 + "</b>" * 20_000, "<!--" * 200_000, "<textarea>" * 100_000, "<li><ul>" * 20_000, '<a ">" ' * 100_000 + "'", "x < y " * 150_000])
def test_broken_pages_take_time_in_proportion(page):
    began = time.process_time()
    htmltext.main_text(page)
    assert time.process_time() - began < 4


def test_cut_off_and_unclosed_tags():
    lines = lambda t: htmltext.main_text(f"<article><p>{t}").split("\n")
    assert lines('one <b class="x>y">bold</b> two <a href="z') == ["one bold two"]
    assert lines('one <b class="never>bold</b> two</p><p>three') == ["one bold two", "three"]
    assert lines("1 < 2 and <3 </p><!-- never ends <p>three") == ["1 < 2 and <3"]


# ---- quality

def brute_stats(text):
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_op6_over_its_table(spark, sf):
    got = {r["doc_id"]: r for r in q_quality.query(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in table_rows(spark, sf, "labels")}
    for r in table_rows(spark, sf, "documents"):
        g, want = got[r["doc_id"]], brute_stats(r["text"])
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == want
        assert g["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (g["base_failed"] and g["kept"])
        if labels.get(r["doc_id"]) == 1 and not g["base_failed"]:
            assert g["kept"]  # no clean document is lost


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c d", "\n", "a b c d e f g h", "\x1c", "\x85x", "é#*", " \t"]), max_size=40))
def test_measures_equal_brute_force(parts):
    text = " ".join(parts)
    assert quality.measure(text)[:5] == brute_stats(text)


def test_odd_rows_of_quality(spark):
    labels = spark.createDataFrame([(4, 1, 0), (None, 0, 0), (6, None, 1)], "doc_id long, quality int, toxic int")
    clash = {c: F.lit("clash") for c in ("n_words", "kept", "base_failed", "c0", "t", "__text", "id", "quality")}
    df = docs(spark, ODD).withColumns(clash)
    got = quality.judge(df, labels, carry=df.columns).collect()
    assert len(got) == len(ODD) and not any(r["kept"] for r in got) and {r["c0"] for r in got} == {"clash"}
    assert Counter((r["doc_id"], r["n_words"], r["text"]) for r in got) == Counter((i, len(words(t)), t) for i, t, _, _ in ODD)
    assert quality.judge(df.limit(0), labels.limit(0)).count() == 0


def test_repeated_ids_do_not_enlarge_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "learn", lambda x, bad: seen.append(len(bad)) or [])
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, 1)], "doc_id long, quality int")
    quality.fit(docs(spark, [(1, f"text {'w ' * i}", "en", "x") for i in range(300)] + [(2, "b", "en", "x")] * 50), labels, text_col="text", id_col="doc_id")
    assert seen == [2]


def brute_list(rules, stats):
    """Whether an ordered list of rules rejects a document of these statistics."""
    for rule in rules:
        if all((stats[c.statistic] > c.threshold) == c.above for c in rule):
            return True
    return False


def brute_statistics(text):
    """Whether the base rule rejects a text, and the statistics that rules speak of."""
    t = text or ""
    w, lines = words(t), [x for x in t.split("\n") if words(x)]
    n, m = max(len(w), 1), max(len(lines), 1)
    _, chars, symbols, dup, repeat = brute_stats(t)
    return len(w) < 20 or 100 * repeat > 30 * len(w), {
        "symbols_per_word": symbols / n, "upper_share": sum(x.isupper() and len(x) > 1 for x in w) / n, "marks_per_word": sum(c in "!?" for c in t) / n, "digits_per_word": sum(c in "0123456789" for c in t) / n,
        "repeat_share": repeat / n, "dup_line_share": dup / m, "open_line_share": sum(words(x)[-1][-1] not in ".!?:;\"')" for x in lines) / m, "word_length": chars / n, "words_per_line": len(w) / m, "distinct_share": len(set(w)) / n,
    }


def test_op6_verdict_equals_the_list_by_hand(spark, sf):
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality.fit(table, labels, text_col="text", id_col="doc_id", base=quality.base_rule())
    got = {r["doc_id"]: r for r in q_quality.query(spark, sf).collect()}
    marked = {r["doc_id"]: r["quality"] for r in labels.collect()}
    wrong = bad = 0
    for r in table.collect():
        base, stats = brute_statistics(r["text"])
        g = got[r["doc_id"]]
        assert (g["base_failed"], g["kept"]) == (base, not base and not brute_list(rules, stats))
        if marked.get(r["doc_id"]) == 0:
            bad += 1
            wrong += g["kept"]
    assert bad and wrong <= 0.1 * bad  # few bad documents are kept


def test_learned_list_separates_and_compiles(spark):
    rng = np.random.default_rng(3)
    n = 600
    bad = rng.random(n) < 0.3
    symbols = np.where(bad & (np.arange(n) % 2 == 0), rng.integers(40, 90, n), rng.integers(0, 12, n))
    upper = np.where(bad & (np.arange(n) % 2 == 1), rng.integers(60, 100, n), rng.integers(0, 20, n))
    frame = pd.DataFrame({c: np.zeros(n, int) for c in quality.COUNTS}).assign(n_words=100, n_symbols=symbols, n_upper_words=upper, n_lines=5)
    x = {k: (frame[a] / np.maximum(frame[b], 1)).to_numpy(float) for k, (a, b) in quality.STATISTICS.items()}
    rules = quality.learn(x, bad)
    hit = np.any([quality.covers(r, x, n) for r in rules], axis=0)
    assert (hit == bad).all() and 2 <= len(rules) <= 4
    kept = [r[0] for r in spark.createDataFrame(frame).select(quality.verdict(rules)).collect()]
    assert kept == (~hit).tolist()
    assert quality.learn(x, np.zeros(n, bool)) == []
    assert quality.learn(x, rng.random(n) < 0.5) == []  # nothing to learn from noise


# ---- chats

def brute_chat(rows):
    sha, loss = hashlib.sha256(), ""
    for _, role, text in rows:
        sha.update(f"{role or ''}\n{text or ''}\n".encode())
        loss += (text or "") if role == "assistant" else ""
    return len(rows), sha.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_op7_over_its_table(spark, sf):
    by = defaultdict(list)
    for r in table_rows(spark, sf, "conversations"):
        by[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    by[-1] = [(0, "user", q_chat.PROBE), (1, "assistant", q_chat.PROBE)]
    got = {r["conv_id"]: r for r in q_chat.query(spark, sf).collect()}
    assert set(got) == set(by)
    for i, rows in by.items():
        g = got[i]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == brute_chat(sorted(rows, key=lambda r: r[0]))
        assert g["formatted_chars"] >= sum(len(t or "") for _, _, t in rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "<", "[", "\\", "s>", "x"]), max_size=8), st.sampled_from(["system", "user", "assistant", "tool", "[ROLE]", ""]))
def test_escaping_is_reversible(parts, role):
    text = "".join(parts)
    body = chat.escape(text)
    assert chat.unescape(body) == text
    assert not re.search(r"</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]", body)
    out, start, end = chat.render(role, text)
    assert out[start:end] == body and list(chat.parse(out + out)) == [(role, text)] * 2


def test_windows_hold_budget_history_and_mask(spark):
    turns = [(1, 0, "system", "be brief")] + [(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "x" * (i % 7) * 5) for i in range(1, 60)] + [(2, 0, "user", "y" * 900)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = sorted(chat.format_conversations(df, budget=300, history=80).collect(), key=lambda r: (r["conv_id"], r["window"]))
    one = [r for r in rows if r["conv_id"] == 1]
    assert len(one) > 5 and all(len(r["text"]) <= 300 for r in one) and len(rows) == len(one) + 1
    new = []
    for k, r in enumerate(one):
        parsed = list(chat.parse(r["text"]))
        assert parsed[0] == ("system", "be brief") and (r["repeated"] > 0) == (k > 0)
        repeats = parsed[1 : r["repeated"]] if k else []
        assert sum(len(chat.render(*t)[0]) for t in repeats) <= 80
        assert repeats == new[len(new) - len(repeats) :]
        fresh = parsed[r["repeated"] :]
        assert [chat.unescape(r["text"][s["start"] : s["end"]]) for s in r["loss"]] == [t for role, t in fresh if role == "assistant"]
        new += fresh
    assert new == [(r, t) for _, _, r, t in turns[:-1]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool"]), st.integers(0, 130)), max_size=25), st.integers(20, 120), st.integers(0, 90))
def test_no_window_exceeds_its_budget(turns, budget, history):
    at, rows, fed = chat.Windows(1, budget, history, chat.byte_tokens), [], []
    for role, n in turns:
        fed.append((role, "y" * n))
        rows.extend(at.add(*fed[-1]))
    if turns:
        rows.append(at.close())
    new = []
    for _, k, text, repeated, loss in rows:
        parsed = list(chat.parse(text))
        assert chat.byte_tokens(text) <= budget or len(parsed) == 1
        before = ([fed[0]] if k and fed[0][0] == "system" else []) + new
        system = 1 if repeated and parsed[0] == before[0] and fed[0][0] == "system" else 0
        history_part = parsed[system:repeated]
        assert history_part == new[len(new) - len(history_part) :] and sum(len(chat.render(*t)[0]) for t in history_part) <= history
        assert [text[x["start"] : x["end"]] for x in loss] == [t for role, t in parsed[repeated:] if role == "assistant"]
        new += parsed[repeated:]
    assert new == fed


def test_odd_conversations(spark):
    rows = [(None, 0, "user", "a"), (1, 1, None, None), (1, 0, "assistant", ""), (1, 0, "assistant", ""), (2, None, "tool", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for conv, mine in ((None, [(0, "user", "a")]), (1, [(0, "assistant", ""), (0, "assistant", ""), (1, None, None)]), (2, [(None, "tool", "t")])):
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == brute_chat(mine)
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


# ---- decontamination

def test_op8_finds_every_verbatim_item(spark, sf):
    norm = lambda t: f" {' '.join(decontam.normal_words(t))} "
    items = [(r["item_id"], norm(r["text"])) for r in table_rows(spark, sf, "benchmark")]
    want = {(d["doc_id"], i) for d in table_rows(spark, sf, "documents") for i, t in items if t in norm(d["text"])}
    assert {(r["doc_id"], r["item_id"]) for r in q_decontam.query(spark, sf).collect()} == want


def index_of(texts):
    return decontam.Index([(str(i), t) for i, t in enumerate(texts)], decontam.Corpus.of(texts))


def dense(index):
    """Terms x items, and terms x blocks, of what the index holds."""
    weights = np.zeros((len(index.terms), len(index.ids)))
    for t in range(len(index.terms)):
        at, x = index.postings(t)
        weights[t, at] = x
    padded = np.pad(weights, ((0, 0), (0, index.blocks * decontam.BLOCK - len(index.ids))))
    return weights, padded.reshape(len(index.terms), index.blocks, decontam.BLOCK).max(axis=2)


def test_wand_equals_scoring_everything(sf, spark):
    index = index_of([r["text"] for r in table_rows(spark, sf, "benchmark")])
    weights, blocks = dense(index)
    assert np.allclose(weights.sum(axis=0), 1)
    rnd = random.Random(1)
    for _ in range(200):
        terms, threshold = sorted(rnd.sample(range(len(index.terms)), rnd.randint(1, 150))), rnd.choice([0.05, 0.2, 0.4])
        scores = weights[terms].sum(axis=0)
        live = index.live(np.zeros(len(terms), int), np.array(terms), 1, threshold)
        assert set(np.flatnonzero(blocks[terms].sum(axis=0) >= threshold)) <= set(live)  # no block is lost
        for given in (None, live.tolist()):
            got = dict(index.search(terms, threshold, given))
            assert set(got) == set(np.flatnonzero(scores >= threshold - 1e-6)) and all(abs(scores[i] - s) < 1e-9 for i, s in got.items())


def brute_hits(text, index, threshold=decontam.THRESHOLD, overlap=decontam.OVERLAP):
    """Every item scored against every passage."""
    weights, _ = dense(index)
    w, out = decontam.normal_words(text or ""), {}
    stride = max(decontam.LEAST_PASSAGE // 2, index.longest)
    for p in range(max(1, -(-len(w) // stride) - 1) if w else 0):
        small = w[p * stride : (p + 2) * stride]
        scores = weights[sorted({index.terms[x] for x in small if x in index.terms})].sum(axis=0)
        for d in np.flatnonzero(scores >= threshold - 1e-6):
            q, a = (index._overlap(part, decontam.grams(small), small) for part in index.parts[d])
            if q >= overlap and a >= overlap and (d not in out or scores[d] > out[d][1] + 1e-9):
                out[d] = (p, scores[d], q, a)
    return {(index.ids[d], p): (pytest.approx(min(s, 1.0)), q, a) for d, (p, s, q, a) in out.items()}


def test_hits_equal_brute_force_over_passages():
    rnd = random.Random(4)
    vocabulary = [f"v{i}" for i in range(300)]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 40))) + rnd.choice(["", ". " + " ".join(rnd.choices(vocabulary, k=3))]) for _ in range(60)]
    index = index_of(texts)
    for _ in range(40):
        parts = [" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 400))) for _ in range(3)]
        for _ in range(2):
            leak = decontam.normal_words(rnd.choice(texts))
            for _ in range(rnd.randint(0, 4)):
                leak[rnd.randrange(len(leak))] = rnd.choice(vocabulary)
            parts.insert(rnd.randrange(len(parts) + 1), " ".join(leak))
        text = " ".join(parts)
        got = index.hits(text, decontam.THRESHOLD, decontam.OVERLAP)
        assert {(i, p): (s, q, a) for i, p, s, q, a in got} == brute_hits(text, index)


def test_long_texts_are_searched_in_proportion(sf, spark):
    index = index_of([r["text"] for r in table_rows(spark, sf, "benchmark")])
    text = " ".join(r["text"] for r in table_rows(spark, sf, "documents"))
    words_ = text.split()

    def seconds(n):
        given, began = " ".join((words_ * (1 + n // len(words_)))[:n]), time.process_time()
        index.hits(given, decontam.THRESHOLD, decontam.OVERLAP)
        return time.process_time() - began

    seconds(20_000)
    assert seconds(400_000) < 4 * 4 * seconds(100_000)


def test_leaks_across_passages_and_odd_rows(spark):
    item = "What colour is the quick brown fox that jumps over lazy dogs? It is brown as the name says."
    items = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "", 0), (4, item, 0), (5, "short one", 0), (None, "null key of an item", 0)], "item_id long, text string, passage int")
    pad = [f"filler{i}" for i in range(700)]
    rows = [(i, " ".join(pad[: 20 * i]) + " " + item.upper() + " " + " ".join(pad), "en", "x") for i in range(12)]
    rows += [(50, "What colour is the quick brown fox that jumps over lazy dogs? Nobody knows.", "en", "x"), *[(None if i is None else i + 100, t, la, s) for i, t, la, s in ODD], (99, "a short one here", "en", "x"), (98, "a null key of an item", "en", "x")]
    clash = docs(spark, rows).withColumns({"key": F.lit(1), "id": F.lit(2), "item_id": F.lit("clash"), "score": F.lit(None).cast("string")})
    for most in (decontam.MAX_POSTINGS, 5):
        got = Counter((r["doc_id"], r["item_id"]) for r in decontam.contaminated(clash, items, most=most).collect())
        assert got == Counter({(i, k): 1 for i in range(12) for k in (1, 4)} | {(99, 5): 1, (98, None): 1})
    assert decontam.contaminated(docs(spark, rows), items.limit(0)).count() == 0
    assert decontam.contaminated(docs(spark, rows).limit(0), items).count() == 0


def test_any_number_of_index_parts_gives_the_same_scores(spark):
    rnd = random.Random(9)
    vocabulary = [f"t{int(rnd.paretovariate(0.6)) % 4000}" for _ in range(5000)]
    made = [" ".join(rnd.choices(vocabulary, k=rnd.randint(8, 30))) + "? " + " ".join(rnd.choices(vocabulary, k=4)) for _ in range(2100)]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(made)] + [(5000, made[0])], "item_id long, text string")
    rows = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 200)) + made[7 * i].split()[:-2] + rnd.choices(vocabulary, k=90)), "en", "x") for i in range(120)]
    results = []
    for most in (decontam.MAX_POSTINGS, 12_000):
        results.append(sorted(tuple(r) for r in decontam.contaminated(docs(spark, rows), items, most=most, overlap=0.5).collect()))
    assert results[0] == results[1] and len(results[0]) > 50


# ---- language model

def test_gradients_are_right():
    rng = np.random.default_rng(0)
    net = lmscore.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    context = rng.integers(0, lmscore.CLASSES**2, 6)
    counts = rng.integers(0, 4, (6, lmscore.CLASSES)).astype(np.float64)
    _, g = net.gradients(context, counts)
    for k in net.p:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        net.p[k][at] += 1e-5
        up, _ = net.gradients(context, counts)
        net.p[k][at] -= 2e-5
        down, _ = net.gradients(context, counts)
        net.p[k][at] += 1e-5
        assert g[k][at] == pytest.approx((up - down) / 2e-5, rel=1e-3)


def test_op10_counts_and_scores(spark, sf):
    table = table_rows(spark, sf, "documents")
    df = spark.read.parquet(f"{sf}/documents.parquet")
    counted = lmscore.word_counts(df, "text").cache()
    want, has = Counter(), defaultdict(list)
    for r in table:
        split = [w.encode().lower() for w in words(r["text"])]
        want.update(split)
        for w in set(split):
            has[w].append(r["doc_id"])
    assert {bytes(r["word"]): (r["n"], r["df"]) for r in counted.collect()} == {w: (n, len(has[w])) for w, n in want.items()}
    vocabulary = lmscore.vocabulary(counted)
    assert vocabulary.words == [w for w, n in sorted(want.items(), key=lambda x: (-x[1], x[0])) if n > 1]
    few = lmscore.vocabulary(counted, 500)
    assert few.words == vocabulary.words[: len(few.words)] and 200 < len(few.words) <= 500
    triples, letters = Counter(), Counter()
    for r in table:
        c = few.classes(r["text"]).tolist()
        for a, b, d in zip([0, *c[:-1]], c, [*c[1:], 0]):
            triples[(a * lmscore.CLASSES + d) * lmscore.CLASSES + b] += 1
        letters.update((-1 - lmscore.trigrams([w for w in lmscore.split(r["text"]) if w not in few.words])[0].astype(int)).tolist())
    assert {r["code"]: r["n"] for r in lmscore.all_counts(df, "text", few).collect()} == triples + letters
    got = {r["doc_id"]: r for r in q_lmscore.query(spark, sf).collect()}
    model = lmscore.fit(df, text_col="text")
    totals = Counter(x for r in table for x in model.words.classes(r["text"]).tolist())
    for r in table:
        assert got[r["doc_id"]]["n_novel"] == sum(has[w] == [r["doc_id"]] for w in set(lmscore.split(r["text"])))
    for r in table[:5]:
        c = model.words.classes(r["text"])
        sides = np.concatenate([[0], c, [0]])
        z = model.net.forward(sides[:-2] * lmscore.CLASSES + sides[2:])[2][np.arange(len(c)), c]
        assert got[r["doc_id"]]["n_tokens"] == len(c)
        assert got[r["doc_id"]]["class_log_likelihood"] == pytest.approx(float(z.sum()), rel=1e-4)
        inside = [np.log(want[w] / (totals[x] + 1)) if x >= lmscore.CLASSES - lmscore.SHARED else 0.0 for w, x in zip(lmscore.split(r["text"]), c.tolist()) if want[w] > 1]
        spelled = [model.shares[model.words[w]] + model.tables()[1].each([w])[0] for w in lmscore.split(r["text"]) if want[w] == 1]
        assert got[r["doc_id"]]["log_likelihood"] == pytest.approx(float(z.sum()) + sum(inside) + sum(spelled), rel=1e-4)


def test_training_beats_the_unigram():
    rng = np.random.default_rng(5)
    c = np.concatenate([[(i + s) % 7 + 1 for i in range(20)] for s in rng.integers(0, 7, 300)])
    code, n = np.unique(lmscore.coded(c), return_counts=True)
    losses = lmscore.Network().train(code, n)
    assert losses[-1] < 0.5 * np.log(7)


def test_odd_rows_of_scores(spark):
    df = docs(spark, ODD).withColumns({c: F.lit("clash") for c in ("n_tokens", "t", "d", "t1", "c0", "m", "word")})
    got = sorted(((r["doc_id"], r["n_tokens"], r["mean_log_likelihood"], r["n_novel"]) for r in lmscore.score(df, text_col="text", carry=["doc_id", "t", "n_tokens", "d"]).collect()), key=str)
    assert len(got) == len(ODD) and [g for g in got if g[0] in (1, 2, 3)] == [(i, 0, None, 0) for i in (1, 2, 3)]
    assert {g[0]: g[3] for g in got} == {None: 4, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 2}
    assert lmscore.score(df.limit(0), text_col="text", carry=["doc_id"]).count() == 0


def spelled_model(beyond, vocabulary, counts):
    code, n = np.unique(lmscore.trigrams(beyond)[0], return_counts=True)
    words_ = lmscore.Vocabulary(vocabulary, counts)
    totals = np.bincount(words_.cls[words_.numbers(beyond)], minlength=lmscore.CLASSES).astype(float)
    for w, k in zip(vocabulary, counts):
        totals[words_.cls[words_[w]]] += k
    spelling = lmscore.Spelling(code, n).compiled()
    return words_, spelling, lmscore.word_shares(words_, totals, spelling)


def test_words_of_a_class_add_up_to_one(monkeypatch):
    monkeypatch.setattr(lmscore, "LETTERS", np.array([97, 98, 99]))
    rng = np.random.default_rng(1)
    words_, spelling, shares = spelled_model([bytes(rng.choice([97, 98, 99], rng.integers(1, 4)).astype(np.uint8)) for _ in range(300)], [b"ab", b"abc", b"c"], [50, 20, 9])
    by = np.zeros(lmscore.CLASSES)
    for k in range(1, 13):
        every = [bytes(w) for w in itertools.product(b"abc", repeat=k)] if k < 11 else []
        if every:
            numbers = words_.numbers(every)
            spelled = np.where(numbers > 3, spelling.each(every), 0)
            by += np.bincount(words_.cls[numbers], np.exp(shares[numbers] + spelled) * (words_.cls[numbers] >= lmscore.CLASSES - lmscore.SHARED), lmscore.CLASSES)
    used = by > 0
    assert used.sum() > 5 and by[used] == pytest.approx(np.ones(used.sum()), abs=0.01)


def test_words_beyond_the_vocabulary_score_by_their_spelling():
    rng = np.random.default_rng(3)
    prose = ["".join(rng.choice(list("stnr")) + rng.choice(list("aeio")) for _ in range(4)).encode() for _ in range(3000)]
    words_, spelling, shares = spelled_model(prose, [b"the", b"of"], [900, 500])
    score = lambda w: shares[words_[w]] + spelling.each([w])[0]
    for w in prose[:40]:
        other = bytes(rng.integers(98, 123, 6, dtype=np.uint8)) + w[-2:]  # the same class
        assert words_[other] == words_[w] and score(w) > score(other) + 5


def test_spelling_is_a_distribution():
    seen = [b"ab", b"ba", b"abc", b"ab"]
    code, n = np.unique(lmscore.trigrams(seen)[0], return_counts=True)
    assert len(lmscore.trigrams(seen)[0]) == sum(len(w) + 1 for w in seen)
    s = lmscore.Spelling(code, n).compiled()
    p = np.exp(s.p.reshape(256, 256, 256)[:, lmscore.LETTERS])  # after a letter
    assert p.sum(axis=2) == pytest.approx(np.ones(p.shape[:2]), abs=1e-4)
    assert s.each([b"ab", b"zz"]) == pytest.approx([s.each([w])[0] for w in (b"ab", b"zz")])
    step = lambda *x: s.p[(x[0] << 16) | (x[1] << 8) | x[2]]
    assert s.each([b"ab"])[0] == pytest.approx(step(32, 32, 97) + step(32, 97, 98) + step(97, 98, 32), rel=1e-5)
    assert s.endings().sum() == pytest.approx(1, abs=1e-3)


def test_twice_given_texts_have_no_word_of_their_own(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) + str(rnd.randrange(200_000)) for _ in range(40)) for _ in range(80)]
    rows = [(i, t, "en", "s") for i, t in enumerate([*texts, *texts[:10]])]
    got = {r["doc_id"]: r["n_novel"] for r in lmscore.score(docs(spark, rows), text_col="text", carry=["doc_id"]).collect()}
    assert all((got[i] == 0) == (i < 10 or i >= 80) for i in got)


def test_training_grows_with_the_contexts():
    assert lmscore.steps_for(np.arange(10) * lmscore.CLASSES) == lmscore.LEAST_STEPS
    many = 50_000
    assert lmscore.steps_for(np.arange(many) * lmscore.CLASSES) * lmscore.BATCH >= lmscore.DRAWS * many
