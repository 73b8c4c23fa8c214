import random

from pyspark.sql import functions as F

from skirmish.llm import sharding


def plain(rows, leaves, width):
    """Row keys by leaf: rows are (key, {dim: value}, weight)."""
    if leaves == 1 or not rows:
        return [[r[0] for r in rows]] + [[] for _ in range(leaves - 1)]
    dims = list(rows[0][1])
    spread = {d: (max(r[1][d] for r in rows) - min(r[1][d] for r in rows)) / width[d] for d in dims}
    dim = max(dims, key=lambda d: spread[d])
    rows = sorted(rows, key=lambda r: (r[1][dim], r[0]))
    target, below = sum(r[2] for r in rows) * (leaves // 2) / leaves, 0
    for i, r in enumerate(rows):
        if below + r[2] >= target:
            cut = i + 1 if target - below > below + r[2] - target else i
            break
        below += r[2]
    return plain(rows[:cut], leaves // 2, width) + plain(rows[cut:], leaves - leaves // 2, width)


def test_shards_are_those_of_the_plain_tree(spark):
    for seed, leaves in ((1, 8), (2, 5), (3, 13)):
        rng = random.Random(seed)
        rows = [(i, rng.choice([0, 1, 2, 7]), rng.randrange(10**12), rng.randrange(-50, 50), rng.choice([1, 3, 40])) for i in range(700)]
        df = spark.createDataFrame(rows, "key long, a long, b long, c long, w long").repartition(5)
        got = {r["key"]: r["shard"] for r in sharding.kd_shards(df, ["a", "b", "c"], "w", leaves=leaves, ties=("key",)).collect()}
        width = {d: max(1, max(r[i] for r in rows) - min(r[i] for r in rows)) for i, d in ((1, "a"), (2, "b"), (3, "c"))}
        want = plain([(r[0], {"a": r[1], "b": r[2], "c": r[3]}, r[4]) for r in rows], leaves, width)
        assert got == {k: i for i, keys in enumerate(want) for k in keys}


def test_equal_texts_share_a_shard_unless_a_cut_must_pass(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(500)]
    rows = [(i, rng.choice(texts), rng.choice(["de", "en", None]), rng.choice([f"src{k}" for k in range(20)])) for i in range(4_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)
    for whole, parted, even in ((0.002, 7, 1.02), (0.05, 0, 1.06)):
        got = sharding.shard_documents(docs, whole=whole).join(docs.select("doc_id", "text"), "doc_id")
        assert got.groupBy("text").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() <= parted
        sizes = [r["s"] for r in got.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
        assert len(sizes) == 8 and max(sizes) < even * min(sizes)
    rows += [(10_000 + i, "the same text " * 20, "en", "src1") for i in range(3_000)] + [(1, rows[0][1], "en", "src1")] * 2
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7))
    sizes = [r["s"] for r in out.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert out.count() == len(rows) and len(sizes) == 8 and max(sizes) < 1.02 * min(sizes)
