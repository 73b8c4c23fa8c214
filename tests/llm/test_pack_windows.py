import random

from pyspark.sql import functions as F

from skirmish.llm import packing
from skirmish.llm.queries import vocabulary


def test_sequences_follow_the_windows(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("river field wind barley spring".split()) for _ in range(rng.randrange(1, 60))), i * 6 // 6000) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, w int").repartition(5)
    got = packing.pack_documents(docs, *vocabulary(), window=F.col("w")).join(docs.select("doc_id", "w"), "doc_id").toPandas()
    assert set(got["doc_id"]) == {r[0] for r in rows} and got.groupby("sequence_id")["length"].sum().max() <= packing.CAPACITY
    per = got.groupby("sequence_id")["w"].agg(["min", "max"]).sort_index()
    own = per[per["min"] == per["max"]]["min"]
    mixed = per[per["min"] != per["max"]]
    assert len(mixed) <= 6 < len(own)
    before = own[own.index < (mixed.index.min() if len(mixed) else len(per))]
    assert before.is_monotonic_increasing and set(before) == set(range(6)) and len(per) == per.index.max() + 1
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g["offset"]) == list(g["length"].cumsum() - g["length"])
    assert len(per) <= packing.pack_documents(docs, *vocabulary()).select("sequence_id").distinct().count() + 6
