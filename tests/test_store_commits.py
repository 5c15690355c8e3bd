"""Commits of tables: tried again, by several writers, with filters that spare files."""

import threading

from ferrule.sources import store


def keys(spark, *ids, batch="b"):
    return spark.createDataFrame([(i, batch) for i in ids], "id long, batch string")


def held(spark, path):
    return sorted((r.id, r.batch) for r in store.read(spark, path).collect())


def test_a_numbered_append_may_come_again(spark, tmp_path):
    path = str(tmp_path / "t")
    store.append_new(keys(spark, 1, 2), path, "id", 0)
    for _ in range(3):
        assert store.append_new(keys(spark, 2, 3), path, "id", 1) == 1
        assert held(spark, path) == [(1, "b"), (2, "b"), (3, "b")]
    assert store.append_new(keys(spark, 1, 2), path, "id", 0) == 0
    assert store.versions(spark, path) == [0, 1] and len(held(spark, path)) == 3


def test_a_try_that_failed_before_its_commit_is_forgotten(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    store.append_new(keys(spark, 1), path, "id", 0)
    with monkeypatch.context() as m:
        m.setattr(store._Files, "create", lambda self, name, text: (_ for _ in ()).throw(OSError("lost")))
        try:
            store.append_new(keys(spark, 2), path, "id", 1)
        except OSError:
            pass
    assert held(spark, path) == [(1, "b")]
    store.append_new(keys(spark, 2), path, "id", 1)
    assert held(spark, path) == [(1, "b"), (2, "b")]


def test_a_commit_whose_folder_was_not_renamed_counts(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    store.append_new(keys(spark, 1), path, "id", 0)
    with monkeypatch.context() as m:
        m.setattr(store._Files, "move", lambda self, old, new: None)
        store.append_new(keys(spark, 2), path, "id", 1)
    assert held(spark, path) == [(1, "b"), (2, "b")]
    store.append_new(keys(spark, 2, 3), path, "id", 2)
    assert held(spark, path) == [(1, "b"), (2, "b"), (3, "b")]


def test_two_writers_lose_and_double_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    failed = []

    def add(name, ids):
        try:
            for n, start in enumerate(ids):
                store.append_new(keys(spark, *range(start, start + 4), batch=name), path, "id", n, writer=name)
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=add, args=a) for a in (("a", (0, 6, 12)), ("b", (2, 8, 14)))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert [i for i, _ in held(spark, path)] == list(range(18))
    before = held(spark, path)
    add("a", (0, 6, 12))
    assert held(spark, path) == before and len(store.versions(spark, path)) == 6


def test_a_number_taken_meanwhile(spark, tmp_path, monkeypatch):
    """Another writer commits the same key under the number that this one was about to take."""
    path = str(tmp_path / "t")
    store.append_new(keys(spark, 1), path, "id")
    commit, others = store._commit, iter([True])

    def late(df, *args, **more):
        if next(others, False):
            store.append_new(keys(spark, 2, 5, batch="other"), path, "id")
        return commit(df, *args, **more)

    monkeypatch.setattr(store, "_commit", late)
    assert store.append_new(keys(spark, 2, 3), path, "id") == 2
    assert held(spark, path) == [(1, "b"), (2, "other"), (3, "b"), (5, "other")]


def test_only_files_that_may_hold_a_key_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    for start in (0, 1000, 2000):
        store.append_new(keys(spark, *range(start, start + 1000)), path, "id")
    every = [f for n in store.versions(spark, path) for f in (tmp_path / "t" / store.commits(spark, path)[n].folder).glob("*.parquet")]
    found = store.holders(spark, path, keys(spark, 1500), "id")
    assert len(found) < len(every) / 2 and any("added-1/" in f for f in found)
    assert store.holders(spark, path, keys(spark, 999_999), "id") == [] or len(store.holders(spark, path, keys(spark, 999_999), "id")) <= 1
    for some in (range(0, 3000, 7), [2999], [0, 1999, 50_000]):
        files = store.holders(spark, path, keys(spark, *some), "id")
        assert {r.id for r in spark.read.parquet(*files).collect()} >= {i for i in some if i < 3000}
    store.append_new(keys(spark, *range(2900, 3100)), path, "id")
    assert [i for i, _ in held(spark, path)] == list(range(3100))


def test_null_text_and_empty_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    store.append_new(rows(), path, "k")
    store.append_new(rows(None, "", "é", None), path, "k")
    store.append_new(rows(None, "", "é", "x" * 5000), path, "k")
    assert sorted((r.k for r in store.read(spark, path).collect()), key=str) == sorted([None, "", "é", "x" * 5000], key=str)


def test_a_whole_stands_for_what_it_was_made_of(spark, tmp_path):
    path = str(tmp_path / "t")
    for ids in ((1, 2), (2, 3)):
        store.append_new(keys(spark, *ids), path, "id")
    assert store.compact(spark, path, "id") == 1 and store.commits(spark, path)[1].kind == "version"
    store.append_new(keys(spark, 3, 4), path, "id")
    assert [i for i, _ in held(spark, path)] == [1, 2, 3, 4]
    assert all("added-1/" not in f for f in store.holders(spark, path, keys(spark, 3), "id"))
