from pathlib import Path

from skirmish.llm import packing
from skirmish.llm.queries import vocabulary


def test_files_are_as_many_as_cores_not_as_partitions(spark, tmp_path):
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in held}
    docs = spark.createDataFrame([(i, f"river {i} field " * (i % 7)) for i in range(2000)], "doc_id long, text string").repartition(40)
    most = max(packing.PARTITIONS, spark.sparkContext.defaultParallelism)
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    before = set(folder.rglob("part-*"))
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        packing.pack_documents(docs, *vocabulary()).write.parquet(f"{tmp_path}/packed")
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert len(set(folder.rglob("part-*")) - before) <= most
    assert len(list(Path(f"{tmp_path}/packed").glob("part-*"))) <= most
    got = spark.read.parquet(f"{tmp_path}/packed").toPandas()
    assert sorted(got["doc_id"]) == list(range(2000)) and got.groupby("sequence_id")["length"].sum().max() <= packing.CAPACITY
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g["offset"]) == list(g["length"].cumsum() - g["length"])
