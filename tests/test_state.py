"""Versions of a table that is changed by key: whole ones only, whoever writes or dies at the same time."""

import pytest

from driftline.sources import state

SCHEMA = "id int, status string, at int"


def _rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _read(spark, path, version=None):
    return sorted(map(tuple, state.load(spark, path, version).collect()), key=repr)


def test_upsert_by_key(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    assert state.load(spark, path) is None and state.manifest(spark, path) is None and state.versions(spark, path) == []
    assert state.upsert(_rows(spark, [(1, "a", 1), (2, "b", 1), (2, "c", 2), (None, "n", 1)]), path, ["id"], "at", {"run": "r1"}) == 1
    assert _read(spark, path) == [(1, "a", 1), (2, "c", 2), (None, "n", 1)]
    assert state.upsert(_rows(spark, [(2, "d", 3), (None, "m", 2), (3, None, None)]), path, ["id"], "at") == 2
    assert _read(spark, path) == [(1, "a", 1), (2, "d", 3), (3, None, None), (None, "m", 2)]
    assert _read(spark, path, 1) == [(1, "a", 1), (2, "c", 2), (None, "n", 1)]
    assert state.upsert(_rows(spark, []), path, ["id"]) == 3 and len(_read(spark, path)) == 4
    with pytest.raises(ValueError):
        state.upsert(_rows(spark, []).drop("at"), path, ["id"])
    assert not state.is_stale(None, "r1") and not state.is_stale(state.manifest(spark, path, 1), "r1")
    assert state.is_stale(state.manifest(spark, path, 1), "r2") and state.is_stale(state.manifest(spark, path), "r1")
    assert state.cleaned(spark, path, 1) == 2 and state.versions(spark, path) == [3] and len(_read(spark, path)) == 4


def test_a_dead_writer_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/store"
    state.save(_rows(spark, [(1, "a", 1)]), path)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(state._Folder, "publish", dies)
        with pytest.raises(KeyboardInterrupt):
            state.upsert(_rows(spark, [(1, "z", 9)]), path, ["id"])
    assert state.versions(spark, path) == [1] and _read(spark, path) == [(1, "a", 1)]
    assert len(list((tmp_path / "store/versions").iterdir())) == 2
    assert state.upsert(_rows(spark, [(2, "b", 1)]), path, ["id"]) == 2 and _read(spark, path) == [(1, "a", 1), (2, "b", 1)]
    state.cleaned(spark, path, 2)
    assert len(list((tmp_path / "store/versions").iterdir())) == 2


def test_two_writers(spark, tmp_path, monkeypatch):
    """One is overtaken between reading and publishing: it starts again and loses nothing of the other's."""
    path = f"file://{tmp_path}/store"
    state.save(_rows(spark, [(1, "a", 1)]), path)
    plain, once = state._Folder.publish, []

    def overtaken(self, name, text):
        if not once:
            once.append(1)
            state.save(_rows(spark, [(1, "a", 1), (2, "other", 1)]), path, base=1)
        return plain(self, name, text)

    with monkeypatch.context() as m:
        m.setattr(state._Folder, "publish", overtaken)
        assert state.upsert(_rows(spark, [(3, "mine", 1)]), path, ["id"]) == 3
    assert _read(spark, path) == [(1, "a", 1), (2, "other", 1), (3, "mine", 1)]
    with pytest.raises(state.Conflict):
        state.save(_rows(spark, []), path, base=1)
    assert state.versions(spark, path) == [1, 2, 3] and len(_read(spark, path)) == 3
