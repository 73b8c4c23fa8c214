from skirmish import catalog


def test_kmeans_centers_has_all_restarts(monkeypatch):
    class Seen(Exception):
        pass

    def k_means(*args, **kwargs):
        assert len(args) == 3 and kwargs.get("restarts", 10) == 10
        raise Seen

    monkeypatch.setattr(catalog.K, "k_means", k_means)
    monkeypatch.setattr(catalog, "table", lambda *_: Rows())
    monkeypatch.setattr(catalog.F, "col", lambda _: Rows())
    try:
        catalog.kmeans_centers(None, "")
    except Seen:
        return
    raise AssertionError("k_means was not called")


class Rows:
    def select(self, *_):
        return self

    cast = alias = select
