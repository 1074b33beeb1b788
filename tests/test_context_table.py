"""The table of contexts under several writers, writers that die, time to live, compaction."""

import os
import threading
import time

from mistveil.operators.context import ContextTable

SCHEMA = "context string, token string, replacement string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def content(table):
    return {(r.context, r.token): r.replacement for r in table.read().collect()}


def test_first_value_stays_and_puts_replace(spark, tmp_path):
    table = ContextTable(spark, str(tmp_path / "t"))
    assert content(table) == {} and table.get("a", "x") is None
    table.add(rows(spark, ("a", "x", "1"), ("b", "x", "2")))
    table.add(rows(spark, ("a", "x", "3"), ("a", "y", "4"), (None, "x", "5")))
    assert content(table) == {("a", "x"): "1", ("b", "x"): "2", ("a", "y"): "4", (None, "x"): "5"}
    table.put(rows(spark, ("a", "x", "6")))
    table.put(rows(spark, ("a", "x", "7")))
    table.add(rows(spark, ("a", "x", "8")))
    assert table.get("a", "x") == "7"
    table.clear("a")
    assert content(table) == {("b", "x"): "2", (None, "x"): "5"}
    table.add(rows(spark, ("a", "x", "9")))
    assert table.get("a", "x") == "9"


def test_writers_at_once(spark, tmp_path):
    """Writers that all found a token missing: every reader gets the value of the one whose entry stands first, and no entry is lost."""
    path, n = str(tmp_path / "t"), 6
    start, failed = threading.Barrier(n), []

    def write(i):
        try:
            own = ContextTable(spark, path)
            mine = rows(spark, ("c", "shared", str(i)), ("c", f"own{i}", str(i)))
            name = own._write(mine.selectExpr("context", "token", "replacement", "CAST(NULL AS double) AS at"))
            start.wait(60)
            own._publish({"op": "add", "data": name, "by": i})
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(n)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    table = ContextTable(spark, path)
    entries = table.entries()
    assert [e["number"] for e in entries] == list(range(1, n + 1)) and {e["by"] for e in entries} == set(range(n))
    want = {("c", f"own{i}"): str(i) for i in range(n)} | {("c", "shared"): str(entries[0]["by"])}
    assert content(table) == want == content(ContextTable(spark.newSession(), path))
    table.compact()
    assert content(table) == want and len(table.entries()) == 1


def test_writers_that_die(spark, tmp_path):
    """Rows that no entry names, and entries that never got their name, count for nothing; vacuum takes them away."""
    table = ContextTable(spark, str(tmp_path / "t"))
    table.add(rows(spark, ("c", "x", "1")))
    table._write(rows(spark, ("c", "x", "0"), ("c", "z", "0")).selectExpr("*", "CAST(NULL AS double) AS at"))
    (tmp_path / "t" / "log" / ".half").write_text('{"op": "cle')
    assert content(table) == {("c", "x"): "1"}
    table.put(rows(spark, ("c", "y", "2")))
    table.compact()
    table.clear("d")
    table.vacuum(older_seconds=0)
    assert content(table) == {("c", "x"): "1", ("c", "y"): "2"}
    assert len(os.listdir(tmp_path / "t" / "data")) == 1 and sorted(x for x in os.listdir(tmp_path / "t" / "log") if not x.endswith(".crc")) == ["000000000003.json", "000000000004.json"]


def test_entries_made_while_compacting(spark, tmp_path):
    table = ContextTable(spark, str(tmp_path / "t"))
    table.add(rows(spark, ("c", "x", "1")))
    seen = table.entries()
    table.add(rows(spark, ("c", "y", "2")))  # by another writer, after the compaction has read the log
    table._publish({"op": "compact", "upto": seen[-1]["number"], "data": table._write(table._state(seen))})
    table.put(rows(spark, ("c", "x", "3")))
    assert content(table) == {("c", "x"): "3", ("c", "y"): "2"}


def test_time_to_live(spark, tmp_path):
    table = ContextTable(spark, str(tmp_path / "t"), ttl_seconds=3)
    table.add(rows(spark, ("c", "x", "1")))
    assert table.get("c", "x") == "1"
    table.compact()
    time.sleep(3.2)
    table.add(rows(spark, ("c", "y", "2")))
    assert content(table) == {("c", "y"): "2"}
    table.compact()
    assert content(table) == {("c", "y"): "2"} and content(ContextTable(spark, str(tmp_path / "t"))) == {("c", "y"): "2"}


def test_compaction_comes_by_itself(spark, tmp_path):
    table = ContextTable(spark, str(tmp_path / "t"), compact_after=3)
    for i in range(4):
        table.add(rows(spark, ("c", str(i), str(i))))
    assert content(table) == {("c", str(i)): str(i) for i in range(4)} and len(table.entries()) == 2
