import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skirmish.llm import bwt, common, graph, language, mixing, multi_index, neardup, packing, pages, repeats, sharding, toxicity, voronoi
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "x " * 20000, None, "b", 40000), (2, "x " * 20000, None, "b", 40000), (3, "12 !!", "en", None, 5), (4, "ñandú übermäßig", "es", "b", 15)]
EXTRA = {"score": "s", "rank": 1, "size": "z", "shard": 0, "k1": 1, "spans": 2, "_k1": 3, "block": 4, "class": "c"}


def clashing(df):
    return df.withColumns({k: F.lit(v) for k, v in EXTRA.items()})


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    texts = []
    for _ in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(1, 80))]
        texts.append(" ".join(w))
        for _ in range(rng.choice([0, 0, 1, 3])):  # near copies
            v = list(w)
            for _ in range(rng.randint(0, 2)):
                v[rng.randrange(len(v))] = rng.choice(vocabulary)
            texts.append(" ".join(v).upper() if rng.random() < 0.3 else "  ".join(v))
    rows = [(i, t, rng.choice(["en", "de"]), f"s{min(i % 7, 3)}", len(t)) for i, t in enumerate(texts)]
    return clashing(spark.createDataFrame(rows, DOCS))


# Packing


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), min_size=1, max_size=12))
@settings(max_examples=150, deadline=None)
def test_bulk_best_fit_is_best_fit(histogram):
    assert packing.best_fit(histogram, 30).bins == brute.best_fit(histogram, 30)
    assert packing.lower_bound(histogram, 30) <= packing.best_fit(histogram, 30).bins


@given(st.dictionaries(st.integers(0, 4), st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_plan_places_every_item_once(histograms):
    plan, report = packing.pack(histograms, 30)
    bins, seen = {}, {}
    for g, r in plan:
        for x in range(r.lo, r.hi):
            k = x - r.lo + r.phase
            assert seen.setdefault((g, r.length, x), True) and (g, r.length, x) in seen
            bins.setdefault(r.bin + k // r.each, []).append((r.offset + k % r.each * r.length, r.length))
    assert len(seen) == sum(n for h in histograms.values() for n in h.values()) and len(bins) == report["bins"] >= report["bound"]
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 30


@pytest.fixture(scope="module")
def vocabulary():
    from skirmish.llm.queries import vocabulary

    return vocabulary()


def test_packed_documents(spark, odd, some, vocabulary):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary[0])
    special = spark.createDataFrame([(9, "a<|endoftext|>b c", None, None, 0)], DOCS)
    docs = odd.union(special).unionByName(some.select(*odd.columns))
    got = packing.pack_documents(clashing(docs), *vocabulary).toPandas()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = []
    for i, t in texts:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        at = [0, *range(first, len(ids), 1024)]
        want += [(i, j, a, b - a, zlib.crc32(ids[a:b].tobytes())) for j, (a, b) in enumerate(zip(at, [*at[1:], len(ids)], strict=True))]
    key = lambda rows: sorted(tuple(-1 if v is None or v != v else int(v) for v in r) for r in rows)
    assert key(got[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy()) == key(want)
    v = got.sort_values(["sequence_id", "offset"])
    assert (v["offset"] == v.groupby("sequence_id")["length"].cumsum() - v["length"]).all() and v.groupby("sequence_id")["length"].sum().max() <= 1024
    assert packing.pack_documents(docs.limit(0), *vocabulary).count() == 0


# Sharding


def test_shards_are_even_and_gapless(spark, some, odd):
    docs = clashing(spark.createDataFrame([(i % 400, "y" * (i % 97), None, None, 0) for i in range(900)] + [(i, "same", None, None, 0) for i in range(500)], DOCS))
    got = sharding.shard_documents(docs).toPandas()
    assert len(got) == 1400 and set(got["shard"]) == set(range(8)) and got["grown_shard"].isna().all()
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 3 * got["size"].max()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert got["text_crc32"].max() <= 2**32 - 1 and (got.loc[got["size"] == 5, "text_crc32"] == zlib.crc32(b"same")).sum() >= 500
    few = sharding.shard_documents(odd).toPandas()
    assert len(few) == len(ODD) and few["size"].sum() == sum(len((r[1] or "").encode()) + 1 for r in ODD)
    assert sharding.shard_documents(odd.limit(0)).count() == 0


def test_target_bytes_decide_the_number_of_leaves(spark):
    rows = spark.range(1000).selectExpr("id", "id % 17 AS a", "id % 5 AS b", "id % 3 + 1 AS w")
    got = sharding.kd_shards(rows, ["a", "b"], "w", target_bytes=300)
    assert got.groupBy("shard").agg(F.sum("w").alias("w")).where("w BETWEEN 270 AND 300").count() == 7


# Near-duplicates


@pytest.mark.parametrize(("small", "likely", "width"), [(1024, 36, 4), (4, 36, 4), (1024, 36, 5)])
def test_components_are_those_of_all_pairs(some, monkeypatch, small, likely, width):
    monkeypatch.setattr(neardup, "SMALL", small)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(some, width).collect()}
    want = brute.near_duplicates([(r["doc_id"], r["text"]) for r in some.collect()], width, 80)
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_large_cloud_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 16)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w), None, None, 0))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS), 4).collect()}
    assert got == brute.near_duplicates([r[:2] for r in rows], 4, 80)


def test_near_duplicates_of_odd_rows(odd):
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(odd, 4).collect())
    assert got == [(-1, 0, None, True), (1, 0, 1, True), (1, 0, 1, True), (2, 1, 2, True), (2, 1, 2, True), (3, 1, 3, True), (4, 1, 4, True)]
    kept = neardup.unique_documents(clashing(odd), 4)
    assert kept.columns == [*odd.columns, *EXTRA] and kept.count() == 5
    assert neardup.near_duplicates(odd.limit(0), 4).count() == 0


def test_graph_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    got = {r["id"]: r["comp"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute.components({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if k in got} and {k for k in want if want[k] != k} <= set(got)


# Repeats


@pytest.mark.parametrize(("large", "segment"), [(512, 1 << 22), (2, 1 << 22), (512, 90)])
def test_removed_bytes_are_those_of_all_windows(spark, monkeypatch, large, segment):
    monkeypatch.setattr(repeats, "LARGE", large)
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    rng = random.Random(5)
    word = lambda n, a="abcdé ": "".join(rng.choice(a) for _ in range(n))
    base, rows = [word(300) for _ in range(4)], []
    for i in range(60):
        k = rng.random()
        s = "ab" * rng.randrange(60) if k < 0.1 else rng.choice(base) if k < 0.2 else word(rng.randrange(80))
        for _ in range(rng.randrange(3) if k >= 0.2 else 0):
            a = rng.randrange(200)
            s += rng.choice(base)[a : a + rng.randrange(100)] + word(rng.randrange(30), "abcd")
        rows.append((None if i == 7 else i, None if i == 9 else s))
    rows += rows[10:13]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    out = repeats.remove_repeats(docs, 40, 12)
    assert out.columns == [*docs.columns, "_bytes", "_removed", "_spans", "_sha256"]
    got = [tuple(r) for r in out.select("doc_id", "_bytes", "_removed", F.size("_spans"), "_sha256").collect()]
    assert sorted(got, key=str) == brute.without_repeats(rows, 40)


def test_repeats_of_odd_rows(odd):
    got = {(r["doc_id"], r["text"]) for r in repeats.remove_repeats(odd).collect()}
    assert got == {(None, None), (1, ""), (2, ""), (3, "12 !!"), (4, "ñandú übermäßig")}
    assert repeats.remove_repeats(odd.limit(0)).count() == 0


@given(st.lists(st.text("ab", max_size=30), min_size=1, max_size=8), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_transform_finds_all_repeated_starts(texts, least):
    data = [t.encode() for t in texts]
    seen = {}
    for i, s in enumerate(data):
        for x in range(len(s) - least + 1):
            seen.setdefault(s[x : x + least], set()).add((i, x))
    want = [[x for x in range(len(s) - least + 1) if len(seen[s[x : x + least]]) > 1] for s in data]
    assert [list(map(int, x)) for x in bwt.repeated_starts(data, np.arange(len(data)) * 1000, least)] == want


# Language


def test_language_is_learned_and_foreign_text_rejected(spark, odd):
    rng = random.Random(3)
    parts = {"en": "the of and ing tion er th wh".split(), "de": "sch ein ung keit der und zu ß".split(), "fr": "eau ou les é ç tre ment des".split()}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(k := rng.choice(list(parts)), rng.randint(1, 60)), k, None, 0) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    got = language.identify_documents(docs).toPandas().merge(docs.toPandas()[["doc_id", "lang"]])
    held = got[got["held_out"]]
    assert 60 < len(held) < 200 and (held["lang_pred"] == held["lang"]).mean() > 0.97 and not got["rejected"].mean() > 0.01
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(got["doc_id"], got["held_out"], strict=True))
    model = language.fit(docs)
    r = language.identify(spark.createDataFrame([(1, "Привет мир как твои дела сегодня", None, None, 0), (2, text("en", 5000), None, None, 0)], DOCS).withColumn("score", F.lit("x")), model).collect()
    assert r[0]["rejected"] and r[1]["lang_pred"] == "en" and r[1]["score"] > 0.9
    e = sorted((r["doc_id"] or 0, r["lang_pred"], r["score"]) for r in language.identify(odd, model).where("lang_pred = 'und'").collect())
    assert e == [(0, "und", 0), (1, "und", 0), (1, "und", 0), (3, "und", 0)]
    assert language.identify_documents(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.identify_documents(docs.withColumn("lang", F.lit(None).cast("string")).limit(5)).collect()} <= {"und"}


# Vectors


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16)).round(2)
    x[100:160] = x[100]  # ties
    x[7] = 0
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows[20] = (20, None, 0)
    rows[21] = (21, [None, *rows[21][1][1:]], 0)
    rows[22] = (22, [float("nan"), *rows[22][1][1:]], 0)
    rows += [rows[50], (None, rows[50][1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows


def table_of(rows, zeros):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows if i is not None and v is not None and all(a is not None and np.isfinite(a) for a in v)]
    return [(i, v) for i, v in good if zeros or v.any()]


def test_exact_top_k(vectors):
    df, rows = vectors
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in voronoi.top_documents(df).collect())
    data = [(i, np.floor(256 * v).astype(int)) for i, v in table_of(rows, True)]
    queries = {i: v for i, v in data if i % 50 == 0}
    want = {q: sorted((-int(v @ x), i) for i, x in data if i != q)[:5] for q, v in queries.items()}
    assert {(q, s, i) for q, _, i, s in got if q != 50} == {(q, -s, i) for q, w in want.items() if q != 50 for s, i in w}
    assert [r for q, r, _, _ in got if q == 0] == [1, 2, 3, 4, 5]
    assert voronoi.top_documents(df.limit(0)).count() == 0


def test_multi_index_recall_and_scores(vectors):
    df, rows = vectors
    data = table_of(rows, False)
    got = multi_index.nearest(df, df.where(F.col("vec_id") % 20 == 0), 20, centroids=8).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    values = dict(data)
    for q, f in found.items():
        want = [i for _, i in sorted((-float(values[q] @ x), i) for i, x in data if i != q)[:20]]
        hits, total = hits + len(set(want) & {i for _, i, _ in f}), total + 20
        assert [r for r, _, _ in sorted(f)] == list(range(1, 21)) and all(s == pytest.approx(values[q] @ values[i]) for _, i, s in f)
        assert sorted(f) == sorted(f, key=lambda x: (-x[2], x[1]))
    assert hits / total >= 0.9 and 20 not in found and 0 in found
    every = multi_index.nearest(df.limit(15), df.limit(1), 20).collect()
    assert len(every) == 13  # all candidates: without the zero vector and the query itself
    assert multi_index.nearest_documents(df.limit(0)).count() == 0


def test_traversal_order():
    a, b, held = np.array([3.0, 1.0]), np.array([2.0, 0.5, 0.0]), np.array([[1, 0, 5], [1, 1, 1]])
    assert multi_index.traverse(a, b, held, 100) == [(0, 0), (0, 2), (1, 0), (1, 1), (1, 2)] and multi_index.traverse(a, b, held, 2) == [(0, 0), (0, 2)]


# Pages


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = int(rng.integers(1, 9))
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        odds, pair = rng.normal(size=n), rng.normal(size=(2, 2))
        total = on = 0
        on = np.zeros(n)
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            p = np.exp(sum(o * v for o, v in zip(odds, y, strict=True)) + sum(pair[y[q], y[i]] for i, q in enumerate(parent) if q >= 0))
            total, on = total + p, on + p * np.array(y)
        assert np.allclose(pages.marginals(np.array(parent), pages.depths(parent), odds, pair), on / total)


def test_held_out_pages():
    model, good, n = pages.train(), 0, 0
    for page in pages.labelled_pages(100, seed=5):
        t = pages.parse(page, labelled=True)
        p = pages.marginals(np.array(t.parent), pages.depths(t.parent), model.unary(t), model.pair) >= 0.5
        for want, got, own in zip(t.label, p, t.own, strict=True):
            if want >= 0 and own:
                good, n = good + (want == got), n + 1
    assert good / n > 0.93


def test_extraction(spark):
    nav = "<nav><ul>" + "<li><a href=x>Item</a></li>" * 5 + "</ul></nav>"
    body = f"<body>{nav}<div class='ad'>Buy this now &amp; save</div><article><h1>Big   news</h1><p><b>First &eacute;t&eacute; line,<br>still first<p>Second <a href=y>link</a> line that goes on for a while, with words.</p><script>var x='</p>'</script></article><div class=comments><p>I disagree with you</p></div><footer>&copy; 2026 Someone</footer>"
    rows = [(1, "u", f"<!DOCTYPE html><html><head><title>T</title></head>{body}</body></html>"), (2, None, None), (3, "v", ""), (4, "w", body), (5, "x", "a < b"), (None, "y", "<p" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit("clash")})
    got = {r["page_id"]: r for r in pages.extract(df).collect()}
    want = "Big news\nFirst été line, still first\nSecond link line that goes on for a while, with words."
    assert got[1]["text"] == want == got[4]["text"] and got[1]["n_chars"] == len(want) and got[2]["text"] == got[3]["text"] == "" and len(got) == 6
    assert pages.extract(df.limit(0)).count() == 0


# Toxicity


def test_toxicity_chain(spark, odd):
    rng = random.Random(6)
    plain = [f"word{i}" for i in range(50)]
    bad = ["idiot", "moron", "scum", "trash", "grumpfel"]
    rows, labels = [], []
    for i in range(600):
        toxic = rng.random() < 0.3
        w = [rng.choice(plain) for _ in range(rng.randint(3, 40))]
        for _ in range(2 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), None, None, 0))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, DOCS)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs.where("doc_id < 400"), known)
    assert [c.category for c in chain.links][-1] == "toxic" and "insult" in [c.category for c in chain.links]
    got = toxicity.judge(docs.where("doc_id >= 400").withColumn("toxic", F.lit("clash")), chain).toPandas()
    want = dict((i, bool(t)) for i, _, t in labels)
    assert np.mean([want[i] == t for i, t in zip(got["doc_id"], got["toxic"], strict=True)]) > 0.98
    few = toxicity.judge(odd, chain).collect()
    assert len(few) == len(ODD) and not any(r["toxic"] for r in few)
    none = toxicity.fit(docs.limit(0), known.limit(0))
    assert not any(r["toxic"] for r in toxicity.judge(docs.limit(5), none).collect())


# Mixing


@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(1, 9), st.integers(0, 40)), min_size=1))
@settings(max_examples=150, deadline=None)
def test_schedule(sources):
    shares, blocks = {k: v[0] for k, v in sources.items()}, {k: v[1] for k, v in sources.items()}
    plan, seen = mixing.phases(blocks, shares), {}
    for k, n in blocks.items():
        if n:
            slot, release, due = mixing.slot_of(plan, k, np.arange(n))
            assert (np.diff(slot) > 0).all() and (slot >= release).all() and (slot < due).all()
            assert not set(slot.tolist()) & set(seen)
            seen |= dict.fromkeys(slot.tolist(), k)
    assert sorted(seen) == list(range(sum(blocks.values())))
    alive = {k for k, n in blocks.items() if n}
    total, count = sum(shares[k] for k in alive), dict.fromkeys(alive, 0)
    for t in range(plan[1].start if len(plan) > 1 else len(seen)):
        count[seen[t]] += 1
        assert all(abs(count[k] - (t + 1) * shares[k] / total) < 1 for k in alive)


def test_mixed_documents(some, odd):
    got = mixing.mix_documents(some, {"s0": 2}, block_bytes=500).toPandas()
    assert len(got) == some.count() and got.groupby("slot")["source"].nunique().max() == 1
    assert (got.groupby(["source", "block"])["size"].sum() - got.groupby(["source", "block"])["size"].max() <= 500).all()
    out = mixing.mixed(some, block_bytes=500)
    assert out.columns == some.columns and out.exceptAll(some).count() == 0 and some.exceptAll(out).count() == 0
    assert mixing.mix_documents(odd).count() == len(ODD) == mixing.mixed(odd).count() and mixing.mixed(odd.limit(0)).count() == 0


# Shared


def test_numbering(spark):
    df = spark.range(500).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id % 11 as string) END AS k", "id % 5 AS w").repartition(7)
    pdf = common.numbered(df, "k", weight="w").toPandas()
    for _, g in pdf.groupby("k"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(len(g))) and list(g["before"]) == list(g["w"].cumsum() - g["w"])


def test_sieve_loses_nothing(spark):
    rows = spark.range(20000).select(F.xxhash64("id").alias("k1"))
    wanted = rows.where(F.col("k1") % 37 == 5)
    assert common.sieve(rows, wanted).join(wanted, "k1").count() == wanted.count() and common.sieve(rows, wanted).count() < 1.1 * wanted.count()
    assert common.sieve(rows, wanted.limit(0)).count() == 0
