from skirmish import catalog
from skirmish.operators import features as X


def test_registered_lists_are_whole():
    assert set(catalog.RANK_FEATURES) == set(X.BASE)
    assert set(catalog.STATS_COLUMNS) == {*X.BASE, "player_survive_time", "normalized_placement"}
