import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from skirmish.llm import repeats


def without_passages(rows, words, least):
    """Texts without the bytes of repeated runs of `words` words or strings of `least` bytes."""
    data = [(t or "").encode() for _, t in rows]
    runs = []
    for b in data:
        w = [m.span() for m in re.finditer(rb"[^ \t-\r]+", b)]
        runs.append([(x, x + least) for x in range(len(b) - least + 1)] + [(w[i][0], w[i + words - 1][1]) for i in range(len(w) - words + 1)])
    # a run of bytes counts as a run of words only where it is one in both places
    kinds = [Counter(), Counter()]
    for b, r in zip(data, runs, strict=True):
        n = max(0, len(b) - least + 1)
        for k, (x, y) in enumerate(r):
            kinds[k >= n][b[x:y]] += 1
    out = []
    for (i, _), b, r in zip(rows, data, runs, strict=True):
        n, gone = max(0, len(b) - least + 1), set()
        for k, (x, y) in enumerate(r):
            if kinds[k >= n][b[x:y]] > 1:
                gone.update(range(x, y))
        out.append((i, bytes(c for x, c in enumerate(b) if x not in gone).decode("utf-8", "ignore")))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment", [1 << 22, 90])
def test_removed_words_are_those_of_all_windows(spark, monkeypatch, segment):
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.choice([1, 1, 2, 9])))
    base = [[word() for _ in range(40)] for _ in range(4)]
    rows = []
    for i in range(70):
        w = [word() for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            a = rng.randrange(30)
            w += rng.choice(base)[a : a + rng.randrange(25)] + [word() for _ in range(rng.randrange(6))]
        rows.append((None if i == 7 else i, None if i == 9 else rng.choice(["", " "]) + rng.choice([" ", " ", "\n", "  "]).join(w)))
    rows += [*rows[10:13], (100, "a " * 60), (101, "b " * 7 + "b"), (102, "b " * 7 + "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"] or "") for r in repeats.remove_repeats(docs, 40, 12, 8).collect()]
    want = without_passages(rows, 8, 40)
    assert sorted(got, key=str) == want != without_passages(rows, 99, 40)


def test_pipeline_cuts_passages_of_51_short_words(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(400)]
    run = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long, short = run(51), run(50)
    assert len(long) < corpus_pipeline.PASSAGE_BYTES
    texts = [f"One {long} two", f"Three {long} four", f"Five {short} six", f"Seven {short} eight"]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["repeated_passages"](spark, docs, "").collect()}
    assert got == {0: "One  two", 1: "Three  four", 2: texts[2], 3: texts[3]}
