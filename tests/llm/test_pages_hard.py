import time

import pytest

from skirmish.llm import pages

STORY = "The river rose in spring and the fields stood under water for a week, until the wind turned and the farmers went out again to sow the barley."


@pytest.mark.parametrize("value", ['"abc"', '""', '"1.5"', '"0"', "'-'", "x", '"99999999999999999999"'])
def test_attributes_of_training_mean_nothing_in_a_page(value):
    page = f"<body><article data-y={value}><p data-y={value}>{STORY}</p></article></body>"
    assert pages.texts_of([page], pages.train()) == [STORY]


@pytest.mark.parametrize("page", [
    "<b>" * 40_000 + "</i>" * 40_000,
    "<b>" * 40_000 + "<div></div>" * 40_000,
    "<p><table><td>" + "<b>" * 40_000 + "<div></div>" * 40_000,
    "<li><ul>" + "<div>" * 2_000 + "<li></li>" * 40_000,
    "<a>" * 40_000 + "x" + "</a>" * 40_000,
    "<!--" * 40_000,
    "<script>" * 40_000,
    "<p " * 40_000,
    "<a href='" * 40_000,
    "<" * 200_000,
])
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    pages.parse(page)
    assert time.process_time() - began < 3


def test_long_and_repeated_pages(spark):
    lines = [f"{STORY} {i}." for i in range(8_000)]
    long = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Floods</h1>" + "".join(f"<p>{x}</p>" for x in lines) + "</article></body></html>"
    assert len(long) > 1_000_000
    rows = [(1, "a", long), (2, "b", f"<article><p>{STORY}</p></article>"), (2, "b", f"<article><p>{STORY}</p></article>"), (None, None, None), (3, "c", "")]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in pages.extract(df).collect())
    whole = "\n".join(["Floods", *lines])
    assert got == [(0, "", 0), (1, whole, len(whole)), (2, STORY, len(STORY)), (2, STORY, len(STORY)), (3, "", 0)]
