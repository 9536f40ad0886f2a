"""The chunk table: which files a change touches, and what is left of one that is stopped at any step."""

import pytest
from pyspark.sql import functions as F

from corpuslake.engine import Engine
from corpuslake.operators import store


def rows_of(spark, names, n=3, **more):
    made = spark.createDataFrame([(f"{s}-{i}", f"text {i} of {s}", s) for s in names for i in range(n)], "chunk_id string, document string, source string")
    return made.withColumns({k: F.lit(v) for k, v in more.items()})


def files_under(path):
    return {str(p.relative_to(path)): p.stat().st_ino for p in path.rglob("*.parquet")}


def content(spark, path):
    return sorted((r.chunk_id, r.source, r.is_active) for r in store.scan(spark, path).collect())


NAMES = [f"/docs/file{i}.txt" for i in range(40)]


def test_a_change_writes_its_buckets_only(spark, tmp_path):
    path = f"file://{tmp_path}/chunks"
    store.add(rows_of(spark, NAMES, is_active=True), path)
    store.add(rows_of(spark, NAMES[:2], is_active=False), path)
    before = files_under(tmp_path)
    number = store.bucket_of(spark, NAMES[5])
    assert number in store.buckets(store.scan(spark, path)) and store.scan(spark, path, [number]).filter(F.col("source") == NAMES[5]).count() == 3
    kept = store.without_source(store.scan(spark, path, [number]), NAMES[5])
    store.replace(kept, path, [number])
    after = files_under(tmp_path)
    assert {k for k in before if before[k] != after.get(k)} == {k for k in before if f"/bucket={number}/" in k}
    assert {r[1] for r in content(spark, path)} == set(NAMES) - {NAMES[5]} and len(content(spark, path)) == 3 * 39 + 6
    plan = store.scan(spark, path, [number])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    with pytest.raises(ValueError):
        store.replace(rows_of(spark, NAMES), path, [number])
    store.recover(spark, path)
    assert files_under(tmp_path) == after
    store.replace(store.scan(spark, path).limit(0), path, list(range(store.BUCKETS)))
    assert content(spark, path) == [] and store.stats(store.scan(spark, path)).first()["chunks"] == 0


class Stopped(Exception):
    pass


@pytest.mark.parametrize("kind", ["add", "replace"])
def test_a_change_stopped_at_any_step_leaves_the_old_or_the_new_table(spark, tmp_path, monkeypatch, kind):
    """Every rename and delete is refused in turn, before it is made; opening the table then ends or undoes the change."""
    names = NAMES[:3]
    seen, step = set(), 0
    while True:
        path = f"file://{tmp_path}/{step}/chunks"
        store.add(rows_of(spark, names, is_active=True), path)
        old = content(spark, path)
        numbers = store.buckets(store.scan(spark, path))
        if kind == "add":
            new = sorted(old + [(f"{s}-0", s, False) for s in NAMES[2:4]])
        else:
            new = [r if r[1] != names[0] else (r[0], r[1], False) for r in old if r[1] != names[1]]
        left = [step]

        def guarded(f):
            def run(*a):
                if not left[0]:
                    raise Stopped
                left[0] -= 1
                return f(*a)

            return run

        with monkeypatch.context() as m:
            m.setattr(store, "_rename", guarded(store._rename))
            m.setattr(store, "_delete", guarded(store._delete))
            try:
                if kind == "add":
                    store.add(rows_of(spark, NAMES[2:4], 1, is_active=False), path)
                else:
                    rows = store.without_source(store.scan(spark, path), names[1])
                    store.replace(store.set_active(rows, names[0], False), path, numbers)
                done = True
            except Stopped:
                done = False
        store.recover(spark, path)
        found = content(spark, path)
        assert found in (old, new), step
        assert not (tmp_path / str(step) / "chunks.next").exists()
        seen.add(found == new)
        store.recover(spark, path)  # and again changes nothing
        assert content(spark, path) == found
        if done:
            assert found == new
            break
        step += 1
    assert seen == {False, True} and step > 3


def test_opening_the_engine_recovers(spark, tmp_path, monkeypatch):
    (tmp_path / "docs").mkdir()
    for name in ("a", "b"):
        (tmp_path / "docs" / f"{name}.txt").write_text(f"{name} words of this file " * 30, "utf-8")
    home = f"file://{tmp_path}/home"
    e = Engine(spark, home)
    e.index(f"file://{tmp_path}/docs")
    total = e.chunks.count()
    source = e.chunks.filter("file_name = 'a.txt'").first()["source"]
    with monkeypatch.context() as m:
        m.setattr(store, "_delete", lambda *_: (_ for _ in ()).throw(Stopped()))
        with pytest.raises(Stopped):
            e.delete(source)
    again = Engine(spark, home)
    assert 0 < again.chunks.count() < total and not again.chunks.filter("file_name = 'a.txt'").count()
    assert again.search(["words"], top_k=3).count()
