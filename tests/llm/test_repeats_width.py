import hashlib
import random

from skirmish.llm import queries


def test_query_removes_strings_of_400_bytes_and_keeps_passages_of_fewer(spark, tmp_path):
    rng = random.Random(11)
    passage = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60))[:n]
    short, long = passage(399), passage(400)
    assert len(short.split()) > 50
    texts = [f"<{short}>", f"[{short}]", f"<{long}>", f"[{long}]"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op8_suffix_dedup(spark, str(tmp_path)).collect()}
    left = [texts[0], texts[1], "<>", "[]"]
    assert got == {i: (len(t), len(t) - len(x), int(t != x), hashlib.sha256(x.encode()).hexdigest(), x) for i, (t, x) in enumerate(zip(texts, left, strict=True))}
