"""Every stage of the pipeline on rows with nulls, ties, repeats, very long texts, empty tables and clashing column names."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from moments.llm import decontam, secrets, sharding

CLASHING = "id row key0 mix_id copy leak_row place_text places nth at q kept text_hash class_id size taken pii label rank".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
COMMON = "the of and to in a is that for it on was with as be by".split()
ITEM = "which of the seven old bridges over the green river was built of stone before the great winter flood"


def prose(rnd, k, n=140):
    return " ".join(rnd.choice(COMMON) if rnd.random() < 0.5 else f"{rnd.choice('abcdefgh')}{rnd.choice(['lor', 'min', 'tas'])}{k}{rnd.randrange(90)}" for _ in range(n))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rnd = random.Random(8)
    own = [f"c{i}" for i in range(len(CLASHING))]
    texts = [prose(rnd, i) for i in range(40)]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[0], "en", "s0", 1), (0, texts[0], "en", "s0", 1), (101, texts[1] + " more", "en", "s1", 1)]  # copies, a repeated row
    rows += [(102, "tiny", "en", "s1", 1), (103, "", "en", "s1", 0), (None, None, None, None, None), (None, prose(rnd, 77), None, None, None)]
    rows += [(104, texts[2] + " " + ITEM + " " + prose(rnd, 78), "en", "s2", 1), (105, prose(rnd, 79, 30_000), "en", "s3", 1)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*r, *own) for r in rows], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def keys(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_each_stage(spark, sf, name, stage):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = stage(spark, docs, sf)
    before, after = keys(docs), keys(out)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert out.filter(" or ".join(f"{c} <> 'c{i}'" for i, c in enumerate(CLASHING))).count() == 0
    gone = {k[0] for k in before if k not in after}
    texts = {i: t for i, t in before if i is not None}
    if name == "quality_rules":
        assert {102, 103} <= gone and {k: n for k, n in after.items()} == {k: n for k, n in before.items() if k in after}
        assert len(gone - {102, 103, None}) == 0 and sum(1 for k in after if k[0] is None) == 1
    elif name == "ngram_jaccard_join":
        assert gone == {100, 101, None} and set(after.values()) == {1}  # the null text is as the empty one
    elif name == "benchmark_decontamination":
        assert gone == {104} and all(after[k] == before[k] for k in after)
    elif name == "source_mixing":
        assert set(after) <= set(before) and all(n <= 2 * before[k] for k, n in after.items())
        assert texts[103] not in {k[1] for k in after} and 105 in {k[0] for k in after}
    else:
        assert after == before and out.select("shard", "slot").distinct().count() == docs.count()
        assert all(0 <= r.shard < 40 for r in out.select("shard").distinct().collect())
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert {"shard", "slot"} <= set(out.columns) and not ids & {100, 101, 102, 103, 104} and len(ids) > 30


def test_a_gram_of_very_many_items_in_parts(monkeypatch):
    rnd = random.Random(4)
    shared = "abcdefghij" * 3
    items = [(i, shared + "".join(rnd.choice("klmnop") for _ in range(30))) for i in range(60)]
    text = "x" * 50 + items[7][1] + shared * 5 + items[9][1]
    whole = decontam._Matcher(items, decontam.LeakRules()).matches(text)
    monkeypatch.setattr(decontam._Index, "PART", 7)
    assert decontam._Matcher(items, decontam.LeakRules()).matches(text) == whole and {7, 9} <= {m[0] for m in whole}


def test_rows_that_nothing_tells_apart(spark):
    df = spark.createDataFrame([(None, None)] * 5 + [(1, "")] * 3, "doc_id long, text string")
    assert secrets.secrets(df).count() == 8 and sharding.assign_shards(df).select("shard", "slot").distinct().count() == 8
    assert secrets.secrets(df.withColumn("tokens", F.lit(1)).withColumn("assign", F.lit(2))).count() == 8
