from hypothesis import given, settings
from hypothesis import strategies as st

from skirmish.llm import packing


def test_certified_partitions_exchange():
    plan, report = packing.pack({g: {2: 1} for g in range(8)}, 1024)
    assert report["bins"] == report["bound"] == 1 and sorted(r.offset + r.phase * r.length for _, r in plan) == list(range(0, 16, 2)) and {r.bin for _, r in plan} == {0}
    _, report = packing.pack({0: {6: 2, 4: 3, 3: 2}, 1: {2: 1}}, 10)
    assert report["bins"] == report["bound"]


@given(st.dictionaries(st.integers(0, 4), st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_never_more_bins_than_apart(histograms):
    assert packing.pack(histograms, 30)[1]["bins"] <= sum(packing.best_fit(h, 30).bins for h in histograms.values())
