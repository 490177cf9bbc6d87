"""Updates of a versioned table appear whole or not at all, and old folders go."""

import os

import pytest

from forumloom.plans import jobs
from forumloom.schema import COMMENT_SCHEMA
from forumloom.sources import versions


def rows(spark, *texts):
    return spark.createDataFrame([(key, "p", forum, text, 1) for forum, key, text in texts], COMMENT_SCHEMA)


def held(spark, path, version=None):
    return {(r.subreddit, r.comment_id): r.text for r in versions.read_versioned(spark, path, version).collect()}


OLD = (("a", "1", "one"), ("a", "2", "two"), ("b/ =", "1", "odd name"), (None, "9", "no forum"))
NEW = (("a", "2", "two again"), ("c", "3", "three"), (None, "9", "none again"))


def test_an_update_that_stops_before_the_switch_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert versions.upsert_versioned(rows(spark, *OLD), path) == 1
    before = {(f, k): t for f, k, t in OLD}
    assert held(spark, path) == before

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(versions, "publish", stop)
        with pytest.raises(RuntimeError):
            versions.upsert_versioned(rows(spark, *NEW), path)
    assert held(spark, path) == before
    assert os.path.isdir(f"{path}/data/version=2")

    versions.read_manifest(spark, path, 1).write.parquet(f"{path}/manifest/3")  # stopped inside the last write
    os.remove(f"{path}/manifest/3/_SUCCESS")
    assert held(spark, path) == before

    assert versions.upsert_versioned(rows(spark, *NEW), path) == 4
    after = before | {(f, k): t for f, k, t in NEW}
    assert held(spark, path) == after
    assert held(spark, path, 1) == before
    assert versions.versions(spark, path) == [1, 4]


def test_old_versions_go_and_what_is_named_stays(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.upsert_versioned(rows(spark, *OLD), path)
    versions.upsert_versioned(rows(spark, *NEW), path)
    versions.upsert_versioned(rows(spark, ("c", "3", "last")), path)
    last = held(spark, path)
    versions.drop_old_versions(spark, path, keep=1)
    assert held(spark, path) == last
    assert versions.versions(spark, path) == [3]
    left = {v: sorted(f for f in os.listdir(f"{path}/data/{v}") if f.startswith("subreddit")) for v in os.listdir(f"{path}/data")}
    assert [len(left[f"version={n}"]) for n in (1, 2, 3)] == [1, 2, 1]  # the odd name; a and no forum; c
    with pytest.raises(ValueError):
        versions.read_versioned(spark, path, 1)


def test_empty_updates_and_missing_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.read_versioned(spark, path)
    versions.upsert_versioned(rows(spark), path)
    assert held(spark, path) == {}
    versions.upsert_versioned(rows(spark, *OLD), path)
    versions.upsert_versioned(rows(spark), path)
    assert len(held(spark, path)) == len(OLD)


def test_the_collect_job_writes_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    raw = spark.createDataFrame([("1", "p", "a", "text", 3), ("2", "p", "a", "[deleted]", 0)], "id string, post_id string, subreddit string, body string, ups long")
    jobs.collect_comments(raw, path, versioned=True)
    jobs.collect_comments(raw.limit(0), path, versioned=True)
    assert held(spark, path) == {("a", "1"): "text"}
