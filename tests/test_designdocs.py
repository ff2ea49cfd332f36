import pytest

from quillgrid.errors import NotFound, QueryError
from quillgrid.operators.designdocs import DesignDoc, ViewCatalog, validators
from quillgrid.operators.views import View, ViewQuery
from quillgrid.sources.store import Store


def by_n(doc, emit):
    emit(doc["n"], doc["_id"])


@pytest.fixture()
def catalog(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    store.bulk([{"_id": f"d{i}", "n": i} for i in range(4)] + [{"_id": "_design/x", "n": 99}])
    return ViewCatalog(store, f"file://{tmp_path}/views")


def test_views_are_built_refreshed_and_cleaned(catalog):
    ddoc = DesignDoc("dd", views={"v": View(map=by_n, reduce="_count")})
    catalog.register(ddoc)
    found = lambda **q: [r["id"] for r in catalog.query("dd", "v", ViewQuery(reduce=False, **q)).rows.collect()]
    assert found() == ["d0", "d1", "d2", "d3"]
    store = catalog.store
    store.put({"_id": "d0", "_rev": store.get("d0")["_rev"], "n": 7})
    store.delete("d1", store.get("d1")["_rev"])
    assert found(update="false") == ["d0", "d1", "d2", "d3"]
    assert found(update="lazy") == ["d0", "d1", "d2", "d3"] and catalog.info("dd")["waiting"]
    catalog.run_later()
    assert found(update="false") == ["d2", "d3", "d0"] and catalog.info("dd")["update_seq"] == store.last_seq()
    assert [r["value"] for r in catalog.query("dd", "v").collect()] == [3]
    assert catalog.cleanup() == []
    catalog.register(DesignDoc("dd", views={"w": View(map=by_n)}))
    assert len(catalog.cleanup()) == 1
    with pytest.raises(NotFound):
        catalog.query("dd", "v")


def test_include_design_and_unknown_reducers(catalog):
    catalog.register(DesignDoc("dd", views={"v": View(map=by_n)}, options={"include_design": True}))
    assert catalog.query("dd", "v").total_rows() == 5
    with pytest.raises(QueryError):
        catalog.register(DesignDoc("bad", views={"v": View(map=by_n, reduce="_nope")}))


def test_update_show_list_validate(catalog):
    ddoc = DesignDoc(
        "dd",
        views={"v": View(map=by_n)},
        updates={"bump": lambda doc, req: ({**(doc or {"_id": "new"}), "n": (doc or {"n": 0})["n"] + 1}, "ok")},
        shows={"s": lambda doc, req: f"<{doc['n']}>"},
        lists={"l": lambda head, req, rows: (f"{r['key']}={r['value']};" for r in rows)},
        validate=lambda new, old: ("forbidden", "negative") if new.get("n", 0) < 0 else None,
    )
    catalog.register(ddoc)
    assert catalog.update("dd", "bump", "d3", {})[0].startswith("2-") and catalog.show("dd", "s", "d3", {}) == "<4>"
    assert catalog.update("dd", "bump", None, {})[1] == "ok"
    assert "".join(catalog.list("dd", "l", "v", {}, ViewQuery(limit=2))) == "0=d0;1=d1;"
    with pytest.raises(QueryError) as bad:
        catalog.store.put({"_id": "z", "n": -1}, validators([ddoc]))
    assert bad.value.status == 403
