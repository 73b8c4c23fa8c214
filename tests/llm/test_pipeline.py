import os

import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_passages import without_passages

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    told = stage["language"](spark, docs, SF)
    assert told.columns == docs.columns and told.count() >= 0.99 * docs.count()
    comp = brute.near_duplicates(rows.items(), 5, 80)
    once = stage["near_duplicates"](spark, docs, SF)
    assert {r["doc_id"] for r in once.collect()} == {i for i, (_, c) in comp.items() if i == c}
    cut = stage["repeated_passages"](spark, docs, SF).collect()
    want = without_passages(rows.items(), corpus_pipeline.PASSAGE_WORDS, corpus_pipeline.PASSAGE_BYTES)
    assert sorted(((r["doc_id"], r["text"] or "") for r in cut), key=str) == want and all(r["n_chars"] == len(r["text"]) for r in cut)
    assert stage["mixture"](spark, docs, SF).exceptAll(docs).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert out["doc_id"].nunique() > 100 and out.groupby("sequence_id")["length"].sum().max() <= 1024


HARD = [
    (1, None, "en", "a", None, "x"), (2, "", "en", None, 0, "x"), (3, "   ", None, "a", 3, "x"), (4, "The cat sat on the mat and looked at the dog.", "en", "a", 1, None),
    (4, "The cat sat on the mat and looked at the dog.", "en", "a", 1, None), (None, "Nobody knows who wrote this line of plain words.", "en", "b", 7, "y"), (5, "word " * 30_000, None, "b", 7, "y"),
    (6, "The cat sat on the mat and looked at the dog.", None, "c", 2, "y"), (7, "été " * 70, "fr", "c", 2, "y"),
]
NAMES = "doc_id long, text string, lang string, source string, n_chars long"


CLASHES = ["k1", "_k1", "extra 0", "spans", "_text", "slot", "size", "lang_pred", "window", "cid"]


def test_hard_rows_go_through_all_stages(spark):
    stage = dict(corpus_pipeline.STAGES)
    every = spark.createDataFrame([(*r, *(r[-1:] * (len(CLASHES) - 1))) for r in HARD], NAMES + "".join(f", `{c}` string" for c in CLASHES)).repartition(3)
    assert {r["doc_id"] for r in stage["language"](spark, every, "").collect()} <= {4, 5, 6, 7, None}
    once = [r["doc_id"] for r in stage["near_duplicates"](spark, every, "").collect()]
    assert sorted(x for x in once if x) == [1, 2, 3, 4, 5, 7] and None in once
    cut = [(r["doc_id"], r["text"]) for r in stage["repeated_passages"](spark, every, "").collect()]
    assert len(cut) == len(HARD) and {x for i, x in cut if i in (1, 2, 3)} == {None, "", "   "} and dict(cut)[5].strip() == ""
    mixed = stage["mixture"](spark, every, "")
    assert mixed.exceptAll(every).count() == 0 == every.exceptAll(mixed).count()
    packed = stage["packing"](spark, every, "").toPandas()
    assert len(packed[packed["piece"] == 0]) == len(HARD) and packed.groupby("sequence_id")["length"].sum().max() <= 1024
    for name, f in corpus_pipeline.STAGES:
        none = f(spark, every.limit(0), "")
        assert none.count() == 0 and (name == "packing" or set(none.columns) == set(every.columns)), name


def test_packing_follows_the_mixture(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"{i} " + "word " * (i * 7 % 90), "en", "abc"[i % 3], 0) for i in range(6_000)], NAMES)
    docs.repartitionByRange(12, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/mixed")
    got = corpus_pipeline.packing(spark, spark.read.parquet(f"{tmp_path}/mixed"), "").toPandas()
    files = spark.read.parquet(f"{tmp_path}/mixed").select("doc_id", "_metadata.file_name").toPandas()
    per = got.merge(files.assign(w=files["file_name"].rank(method="dense")), on="doc_id").groupby("sequence_id")["w"].agg(["min", "max"]).sort_index()
    early = per.iloc[: len(per) * 3 // 4]
    assert (early["min"] == early["max"]).all() and early["min"].is_monotonic_increasing and got["doc_id"].nunique() == 6_000
