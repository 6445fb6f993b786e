"""The watch: leases, kept states, pending changes, rebuilds in the background."""

import threading

import pytest

from graphloom.streaming.watch import Freshness, Lease, Watch, touched

FILES = "source_file string, hash string, file_size long, file_mtime_ns long"


def files(spark, **hashes):
    return spark.createDataFrame([(k, v, 1, 0) for k, v in hashes.items()], FILES)


def events(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, kind string")


def test_lease_has_one_owner(spark, tmp_path):
    a, b = Lease(spark, str(tmp_path / "l")), Lease(spark, str(tmp_path / "l"))
    assert a.take() and a.take() and not b.take()
    a.renew()
    with pytest.raises(RuntimeError):
        b.renew()
    a.free()
    assert b.take() and not a.mine()
    c = Lease(spark, str(tmp_path / "l"), seconds=0)
    assert c.take() and not b.mine()


def test_states_are_kept(spark, tmp_path):
    s = Freshness(spark, str(tmp_path / "s"))
    assert s.now() == "IDLE"
    s.become("REBUILDING", "why")
    with pytest.raises(ValueError):
        s.become("INCREMENTAL")
    assert Freshness(spark, str(tmp_path / "s")).now() == "REBUILDING" and s.history()[0]["why"] == "why"


def test_overflow_compares_all(spark):
    old, new = files(spark, a="1", b="2", c="3"), files(spark, a="9", b="8", d="4")
    of = lambda *e: sorted(map(tuple, touched(events(spark, *e), old, new).collect()))
    assert of(("a", "MODIFY"), ("c", "DELETE"), ("zz", "CREATE")) == [("a", "changed"), ("c", "deleted")]
    assert of(("a", "MODIFY"), (None, "OVERFLOW")) == [("a", "changed"), ("b", "changed"), ("c", "deleted"), ("d", "added")]


def test_failed_changes_come_again(spark, tmp_path):
    seen, works = [], [False]

    def apply(changes):
        if not works[0]:
            raise RuntimeError("not now")
        seen.append(sorted(r.source_file for r in changes.collect()))

    w = Watch(spark, str(tmp_path / "w"), lambda: files(spark, a="9", b="8"), lambda: files(spark, a="1", b="2"), apply, lambda: None, attempts=2, delay=0)
    assert w.step(events(spark, ("a", "MODIFY"))) == "FAILED"
    works[0] = True
    assert w.step(events(spark, ("b", "MODIFY"))) == "IDLE" and seen == [["a", "b"]]
    assert [x["state"] for x in w.state.history()] == ["INCREMENTAL", "FAILED", "INCREMENTAL", "IDLE"]
    assert w.step(events(spark, ("c", "MODIFY"))) == "IDLE" and len(seen) == 1


def test_events_during_a_rebuild_wait(spark, tmp_path):
    go, seen = threading.Event(), []
    w = Watch(spark, str(tmp_path / "w"), lambda: files(spark, a="9", b="8"), lambda: files(spark, a="1", b="2"), lambda c: seen.append(c.count()), go.wait, cap=1)
    assert w.step(events(spark, (None, "OVERFLOW"))) == "REBUILDING"
    assert w.step(events(spark, ("a", "MODIFY"))) == "REBUILDING" and seen == []
    go.set()
    w.settle(wait=True)
    assert w.state.now() == "IDLE" and w.step(events(spark)) == "IDLE" and seen == [1]
