"""The corpus pipeline: stage contracts, decisions against brute force, edge cases, native plans."""

import random

import corpus_pipeline
import pytest
from calltide.llm import queries
from test_operators import SCHEMA, brute_components, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, docs, labels = random.Random(21), [], []
    items = [(k, prose(rng, 30)) for k in range(3)]
    copies = prose(rng, 80)
    for i in range(160):
        good, text = i % 8 != 5, prose(rng, rng.randint(60, 150)).capitalize() + "."
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split()[:20]) * 4
        elif i % 10 == 1:
            text = copies if i % 20 == 1 else copies + " end"
        elif i % 10 == 2:
            text += " " + items[i % 3][1] + " " + prose(rng, 5)
        elif i % 10 == 3:
            text = "12 34 56 78. " * 20
        docs.append((i, text, "en" if i % 2 else "de", "s", len(text), "x", "y"))
        labels.append((i, int(good), 0))
    docs += [(None, None, None, None, None, None, None), (900, "", "en", None, 0, None, None)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_take_effect_one_after_the_other(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns
        after = after.cache()
        kept.append({r.doc_id: r.text for r in after.collect()})
        docs = after
    good, identified, distinct, clean = kept
    assert not any(i is not None and i % 8 == 5 and i < 160 for i in good)
    assert sum(i % 8 != 5 for i in range(160)) - sum(i is not None and i < 160 for i in good) < 25
    assert set(identified) == {i for i, t in good.items() if any(c.isalpha() for c in t or "")}
    alone = brute_components(identified.items(), 80)
    assert set(distinct) == {i for i, (_, _, k) in alone.items() if k}
    assert set(clean) == {i for i in distinct if i % 10 != 2 or i % 8 == 5}
    pieces = corpus_pipeline.packed(spark, docs, folder).collect()
    assert {r.doc_id for r in pieces} == set(clean)


def test_run_equals_its_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.count() > 20 and corpus_pipeline.ORACLE_SQL is None


def test_empty_corpus(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op3_chat", "op10_licenses"])
def test_native_operators_run_no_python(spark, name):
    df = queries.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_there_is_a_query_for_each_operator():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
