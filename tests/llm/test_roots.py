from skirmish.llm import neardup


def test_roots_use_different_positions():
    used = {p for t in range(neardup.TREES) for p in neardup.positions(neardup.root_offset(t))}
    assert len(used) == neardup.TREES * neardup.CHOSEN and used <= set(range(neardup.TOKENS))
