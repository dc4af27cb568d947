import os
import random

import pytest

import corpus_pipeline as P
from tests.llm.test_decontaminate import brute as brute_windows
from tests.llm.test_neardup import brute as brute_groups
from tests.llm.test_substring import brute as brute_repeats


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(5)
    path = str(tmp_path_factory.mktemp("sf"))
    vocab = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{i}" for i in range(900)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    bench = [(i, text(20)) for i in range(5)]
    shared = text(60)
    rows, labels = [], []
    for i in range(260):
        t = text(rng.randrange(12, 150))
        toxic = int(i % 6 == 0)
        if toxic:
            t += " Vilegrub " + text(4) + " vilegrubs"
        elif i % 17 == 0:
            t += " " + bench[i % 5][1].upper()
        elif i % 13 == 0:
            t += " " + shared + " " + text(5)
        elif i % 11 == 0:
            t = rows[i - 3][1]
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
        labels.append((i, 1, toxic))
    rows += [(900, None, None, None, None), (901, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(os.path.join(path, "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(os.path.join(path, "labels.parquet"))
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(os.path.join(path, "benchmark.parquet"))
    return path


def test_stages_against_brute_force(spark, sf_dir):
    from ledgerscope.llm.store import write_table
    docs = spark.read.parquet(sf_dir + "/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = write_table(stage(spark, docs, sf_dir), "test-stage")
        after = docs.collect()
        if name != "mixing":
            assert docs.columns == columns
            left = {r.doc_id: r.text for r in after}
        if name == "toxicity":
            assert {i for i, t in before if not (t and "ilegrub" in t)} <= set(left)
            assert sum("ilegrub" in (t or "") for t in left.values()) <= 2
        elif name == "near_duplicates":
            assert sorted(left) == sorted(i for i, _, _, kept in brute_groups(before, 5) if kept)
        elif name == "substring_dedup":
            same = {i: t for i, t in before}
            for i, n, removed, kept in brute_repeats(before, 35):
                assert left[i] == (kept if removed else same[i])
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
        elif name == "decontamination":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(sf_dir + "/benchmark.parquet").collect()]
            assert sorted(left) == sorted(i for i, _, hit, _ in brute_windows(before, bench) if not hit)
        else:
            assert sorted(r.doc_id for r in after) == sorted(i for i, _ in before)
            assert all(0 <= r.taken <= 3 * r["size"] for r in after)


def test_repeated_row_keeps_its_text(spark, sf_dir):
    docs = spark.read.parquet(sf_dir + "/documents.parquet").where("doc_id BETWEEN 1 AND 40")
    long = " ".join(f"only{i}" for i in range(80))
    more = spark.createDataFrame([(500, long, "en", "s1", len(long))] * 2, docs.schema)
    out = P.cut_repeats(spark, P.drop_near_duplicates(spark, docs.union(more), sf_dir), sf_dir)
    assert [r.text for r in out.where("doc_id = 500").collect()] == [long]


def test_columns_with_clashing_names_pass(spark, sf_dir):
    docs = spark.read.parquet(sf_dir + "/documents.parquet").where("doc_id BETWEEN 1 AND 40").selectExpr(
        "*", "'a' AS score", "1 AS hits", "2 AS kept_text", "3 AS spans", "4 AS `odd name`", "5 AS n_words", "6 AS items", "7 AS key")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        row = out.where("doc_id = 1").collect()[0]
        assert (row.score, row.hits, row.kept_text, row["odd name"]) == ("a", 1, 2, 4)


def test_run_is_registered(spark, sf_dir):
    import __spark_entry__ as E
    assert E.queries()["pipeline"] is P.run and len(P.STAGES) == 5
    assert P.run(spark, sf_dir).count() > 100
