"""URL filtering: a blocked Bloom filter passes possible hits to an exact hash join.

Each url has few candidate rules: every suffix of its host at a label border with every prefix of its path
whose length occurs among the listed rules. The candidates are tested against a blocked Bloom filter of
the list (one 256-bit block per key, six bits in it), so that a url off the list leaves no row to join.
What passes is joined with the list by its canonical key; false positives find no partner there.

Native DataFrame operations only.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm.common import carried, seeded

WORDS_PER_BLOCK = 4
BITS_PER_KEY = 16
PROBES = 6
#: Largest filter kept as a literal (1 MB) and longest list joined by broadcast; beyond either, joins are shuffled.
MAX_LITERAL_WORDS = 1 << 17
MAX_BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host with A-Z lower-cased; both empty for null or without ``://``."""
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\x00"), path)


def _bits(key: Column, n_blocks: int) -> tuple[Column, list[tuple[Column, Column]]]:
    """Block number, then (word in the block, bit in the word) of each probe."""
    block = F.pmod(seeded(1, key), F.lit(n_blocks)).cast("int")
    h = seeded(2, key)
    probe = lambda j: F.shiftright(h, 8 * j).bitwiseAND(F.lit(255))
    return block, [(F.shiftright(probe(j), 6).cast("int"), probe(j).bitwiseAND(F.lit(63)).cast("int")) for j in range(PROBES)]


def build_filter(rules: DataFrame, n_blocks: int) -> DataFrame:
    """(block, words): the non-empty blocks of the filter of ``rules.key``, OR-ed together in the cluster."""
    block, probes = _bits(F.col("key"), n_blocks)
    one = F.lit(1).cast("long")
    bits = F.array(*[F.struct(w.alias("w"), F.call_function("shiftleft", one, b).alias("x")) for w, b in probes])
    words = (
        rules.select(block.alias("block"), F.explode(bits).alias("p"))
        .groupBy("block")
        .agg(*[F.bit_or(F.when(F.col("p.w") == i, F.col("p.x")).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(WORDS_PER_BLOCK)])
    )
    return words.select("block", F.array(*[f"w{i}" for i in range(WORDS_PER_BLOCK)]).alias("words"))


def _hit(words: Column, offset: Column, probes: list[tuple[Column, Column]]) -> Column:
    tests = [F.call_function("shiftright", F.get(words, offset + w), b).bitwiseAND(F.lit(1).cast("long")) == 1 for w, b in probes]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """A list of (host, path, verdict) as a DataFrame; a rule listed twice counts once, ``block`` first."""
    rows = json.dumps([{"host": h, "path": p, "verdict": v} for h, p, v in rules])
    parsed = F.from_json(F.lit(rows), "array<struct<host:string,path:string,verdict:string>>")
    return spark.range(1).select(F.explode(parsed).alias("r")).select("r.*")


def judge_urls(urls: DataFrame, rules: DataFrame, *, url_col: str = "url", carry: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """carry columns, url, host, path, rule (``host + path`` or null) and verdict of every row of ``urls``.

    A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the
    rule's; of several, the longest ``host + path`` wins, then the longer host. No rule: ``default``.
    Null urls and urls without ``://`` have empty host and path and meet only a rule of empty host;
    repeated rows stay repeated; an empty list gives ``default`` throughout, an empty table an empty result.
    A long host costs as many candidates as the longest listed host has labels. A carried column named like
    an added one gives way to it.
    """
    spark = urls.sparkSession
    listed = (
        rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where(F.col("host").isNotNull())
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("key", _key(F.col("host"), F.col("path")))
    )
    n_rules = listed.count()
    n_blocks = max(1, -(-n_rules * BITS_PER_KEY // (64 * WORDS_PER_BLOCK)))
    lengths = [r[0] for r in listed.select(F.length("path").alias("n")).distinct().orderBy("n").collect()]
    host, path = split_url(F.col(url_col))
    inner, back = carried(urls, list(carry), ["url", "host", "path", "rule", "verdict"])
    rows = urls.select(*inner, F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    # only the last labels of a host, as many as the longest listed host has
    n_labels = listed.agg(F.coalesce(F.max(F.size(F.split("host", r"\.", -1))), F.lit(1))).first()[0]
    labels = F.split(F.substring_index("host", ".", -n_labels), r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice(F.col("labels"), i, F.size("labels")), "."))
    prefixes = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), F.substring("path", 1, n).alias("p")) for n in lengths]), lambda s: F.length(s["p"]) == s["n"]) if lengths else None
    shape = [F.col(f"c{i}") for i in range(len(inner))] + [F.col(c) for c in ("url", "host", "path")]
    back += [F.col(c) for c in ("url", "host", "path")]
    if prefixes is None:
        return rows.select(*back, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = F.flatten(F.transform("suffixes", lambda s: F.transform("prefixes", lambda p: _key(s, p["p"]))))
    cand = rows.withColumn("labels", labels).withColumns({"suffixes": suffixes, "prefixes": prefixes}).withColumn("keys", keys)
    built = build_filter(listed, n_blocks)
    if n_blocks * WORDS_PER_BLOCK <= MAX_LITERAL_WORDS:
        flat = [0] * (n_blocks * WORDS_PER_BLOCK)
        for r in built.collect():  # at most n_blocks rows, under the bound above
            flat[r["block"] * WORDS_PER_BLOCK : (r["block"] + 1) * WORDS_PER_BLOCK] = r["words"]
        words = F.from_json(F.lit(json.dumps(flat)), "array<bigint>")

        def passes(k: Column) -> Column:
            block, probes = _bits(k, n_blocks)
            return _hit(words, block * WORDS_PER_BLOCK, probes)

        possible = cand.withColumn("keys", F.filter("keys", passes)).select(*shape, F.posexplode_outer("keys").alias("pos", "key"))
    else:
        flat_keys = cand.select(*shape, F.posexplode_outer("keys").alias("pos", "key"))
        block, probes = _bits(F.col("key"), n_blocks)
        tested = flat_keys.withColumn("block", block).join(built, "block", "left")
        keep = F.coalesce(_hit(F.col("words"), F.lit(0), probes), F.lit(False))
        possible = tested.withColumn("key", F.when(keep, F.col("key"))).drop("block", "words")
    exact = listed.select("key", F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("m"), F.concat("host", "path").alias("rule"), "verdict").alias("hit"))
    if n_rules <= MAX_BROADCAST_RULES:
        exact = F.broadcast(exact)
    first = (F.coalesce("pos", F.lit(0)) == 0).cast("long")
    best = possible.join(exact, "key", "left").groupBy(*shape).agg(F.max("hit").alias("hit"), F.sum(first).alias("copies"))
    out = [*back, F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict")]
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*out)
