from collections import Counter

import corpus_pipeline as cp
from helpers import DOCS, table_rows, words
from pyspark.sql import functions as F
from test_sharding_mixing_urls import water_fill
from test_text_operators import brute_components, brute_list, brute_statistics

from gridlore.llm import quality
from gridlore.llm.decontam import normal_words
from gridlore.llm.registry import oracle_sql, queries


def test_registry():
    assert {n.split("_")[0] for n in queries()} == {f"op{i}" for i in range(1, 11)}
    assert set(oracle_sql()) <= set(queries())
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "mix_sources", "shard"]


def test_each_stage_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r for r in table_rows(spark, sf, "documents")}
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = [r.asDict() for r in docs.collect()]
        ids = Counter(r["doc_id"] for r in rows)
        if i < 4:
            assert docs.columns == columns
        assert all({c: r[c] for c in columns} == before[r["doc_id"]] for r in rows)
        if name == "quality_rules":
            rules = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), text_col="text", id_col="doc_id", base=quality.base_rule())
            measured = {k: brute_statistics(v["text"]) for k, v in before.items()}
            want = {k for k, (base, stats) in measured.items() if not base and not brute_list(rules, stats)}
        elif name == "near_dedup":
            found = brute_components([(k, v["text"]) for k, v in before.items()], 5, 80)
            want = {k for k, v in found.items() if v[2]}
        elif name == "decontaminate":
            norm = lambda t: f" {' '.join(normal_words(t))} "
            items = [norm(r["text"]) for r in table_rows(spark, sf, "benchmark")]
            want = {k for k, v in before.items() if not any(t in norm(v["text"]) for t in items)}
        if name in ("mix_sources", "shard"):
            sizes = {k: len(words(v["text"])) for k, v in before.items()}
            if name == "mix_sources":
                assert max(ids.values()) <= 2
                totals, taken, largest = Counter(), Counter(), Counter()
                for k, v in before.items():
                    totals[v["source"]] += sizes[k]
                    taken[v["source"]] += sizes[k] * ids[k]
                    largest[v["source"]] = max(largest[v["source"]], sizes[k])
                for source, target in water_fill(totals).items():
                    assert abs(taken[source] - target) <= largest[source]
                total = len(rows)
            else:
                per = Counter(r["shard"] for r in rows)
                assert len(rows) == total and max(per.values()) - min(per.values()) <= 1
                for s, n in per.items():
                    assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
        else:
            assert set(ids) == want and set(ids.values()) == {1}
        before = {r["doc_id"]: {c: r[c] for c in columns} for r in rows}


CLASH = ["n_words", "kept", "skey", "size", "taken", "rate", "target", "copies", "source_size", "__h", "__b", "__text", "base_failed", "given0", "c0", "id", "t1", "root", "digest", "rest", "copy"]


def test_odd_tables(spark, sf, tmp_path):
    long_text = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [(1, long_text, "en", "a", 1), (1, long_text, "en", "a", 1), (None, long_text, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0), (4, long_text + " More.", None, None, 5), (5, " ".join(f"big{i}" for i in range(60_000)), "en", "a", 1)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, DOCS).withColumns({c: F.lit(f"clash {c}") for c in CLASH})
        for i, (name, stage) in enumerate(cp.STAGES):
            path = str(tmp_path / f"{name}-{len(given)}")
            columns = docs.columns
            stage(spark, docs, sf).write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.columns == (columns if i < 4 else [*columns, "shard", "slot"])
        got = docs.collect()
        assert bool(got) == bool(given) and all(r[c] == f"clash {c}" for r in got for c in CLASH)


def test_dedup_keeps_one_row_of_a_component_and_no_text_is_lost(spark, sf):
    one, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, one, "en", "z", 1), (1, one, "en", "a", 1), (None, one, "en", "a", 1), (1, other, "en", "a", 1), (9, other, "en", "a", 1), (2, None, None, None, None), (2, None, None, None, None), (3, "", "en", "b", 0), (4, one + " More.", None, None, 5), (None, "no id " + other, "en", "c", 1), (None, "all alone here with no id", "en", "c", 1)]
    kept = [tuple(r) for r in cp.near_dedup(spark, spark.createDataFrame(rows, DOCS), sf).collect()]
    assert Counter(kept) == Counter([(1, one, "en", "a", 1), (1, other, "en", "a", 1), (2, None, None, None, None), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "all alone here with no id", "en", "c", 1)])


def test_decontamination_is_by_text(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    clean = " ".join(f"clean{i}" for i in range(50))
    rows = [(None, f"before {item} after", "en", "a", 1), (None, clean, "en", "a", 1), (1, item, "en", "a", 1), (1, clean, "en", "a", 1), (2, None, "en", "a", 1)]
    assert sorted(str(r["text"]) for r in cp.decontaminate(spark, spark.createDataFrame(rows, DOCS), sf).collect()) == ["None", clean, clean]


def test_run_is_registered(spark, sf):
    import __spark_entry__ as e

    assert "pipeline" in e.queries() and e.oracle_sql().get("pipeline") == cp.ORACLE_SQL
