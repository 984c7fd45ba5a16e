"""Change feeds, refreshed lists and keyed streaming state on small fixtures."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import changes, inbound, keyed
from tessera.streaming.buckets import Buckets

ROW = "id long, list string, at int, text string"


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


def by_key(rows):
    return {r[0]: r for r in rows if r[0] is not None}


def test_changes(spark):
    old = [(1, "a", 1, "x"), (2, "a", 1, "x"), (3, None, 1, None), (4, "b", 1, "é"), (None, "b", 1, "y"), (6, "c", 1, "z"), (6, "c", 1, "z")]
    new = [(1, "a", 1, "x"), (2, "b", 1, "x"), (3, None, None, None), (5, "b", 1, "n"), (None, "b", 2, "y"), (6, "c", 1, "z")]
    got = changes.changes(spark.createDataFrame(old, ROW), spark.createDataFrame([(t, a, x, i) for i, x, a, t in new], "text string, at int, list string, id long"), ["id"])
    found = {r["id"]: (r["op"], r["before"] and (r["before"]["list"], r["before"]["at"]), r["after"] and (r["after"]["list"], r["after"]["at"])) for r in got.collect()}
    assert found == {2: ("UPDATE", ("a", 1), ("b", 1)), 3: ("UPDATE", (None, 1), (None, None)), 4: ("DELETE", ("b", 1), None), 5: ("INSERT", None, ("b", 1))}
    assert rows_of(changes.affected(got, ["list"])) == [("a",), ("b",)]
    none = spark.createDataFrame([], ROW)
    assert changes.changes(none, none, ["id"]).count() == 0
    assert {r["op"] for r in changes.changes(none, spark.createDataFrame(new, ROW), ["id"]).collect()} == {"INSERT"}


def test_changes_of_repeated_keys_and_of_several_columns(spark):
    one, two = (7, "a", 1, "x"), (7, "a", 1, "y")
    first = changes.changes(spark.createDataFrame([one, two, one], ROW), spark.createDataFrame([two, one], ROW), ["id"])
    assert first.count() == 0  # the same row stands for the key on both sides
    keyed = changes.changes(spark.createDataFrame([(1, "a", 1, "x"), (1, "b", 1, "x")], ROW), spark.createDataFrame([(1, "b", 2, "x")], ROW), ["id", "list"])
    assert rows_of(keyed, "id", "list", "op") == [(1, "a", "DELETE"), (1, "b", "UPDATE")]


def history(n, seed):
    """Versions of a table: rows come, go, change and move between lists; one list holds a third of all rows."""
    r = random.Random(seed)
    held = {i: (i, r.choice(["hot", f"l{i % 40}", f"l{i % 7}"]), r.randrange(50), f"t{i}") for i in range(150)}
    yield list(held.values())
    for _ in range(n):
        for i in r.sample(range(200), 12):
            what = r.random()
            if what < 0.3:
                held.pop(i, None)
            else:
                held[i] = (i, r.choice(["hot", f"l{r.randrange(40)}", None]), r.randrange(50), f"t{r.randrange(9)}")
        yield list(held.values())


def lists_of(rows, n=5):
    out = []
    for name in {r[1] for r in rows if r[1] is not None}:
        own = sorted((r for r in rows if r[1] == name), key=lambda r: (-r[2], r[0]))[:n]
        out += [(name, k, r[0], r[3]) for k, r in enumerate(own, 1)]
    return sorted(out)


@pytest.mark.parametrize("most", [1000, 0])
def test_lists_follow_changes(spark, tmp_path, monkeypatch, most):
    """After each batch, and after each batch run twice, the lists are those of a full build."""
    monkeypatch.setattr(changes, "MOST_PUSHED", most)
    versions = list(history(4, 3))
    frames = [spark.createDataFrame(v, ROW) for v in versions]
    now, built = [frames[0]], []

    def build(rows):
        built.append(rows.select("list").distinct().count())
        return changes.first_rows(rows, ["list"], [F.desc("at"), F.asc("id")], 5)

    sink = changes.ListRefresh(str(tmp_path / "lists"), "list string, place int, id long, text string", ["list"], lambda _: now[0], build, buckets=8)
    sink.refresh(frames[0].select("list").where("list is not null").distinct(), 0)
    assert rows_of(sink.lists(spark, 0), "list", "place", "id", "text") == lists_of(versions[0])
    for k in range(1, 5):
        now[0] = frames[k]
        events = changes.changes(frames[k - 1], frames[k], ["id"])
        assert rows_of(changes.applied(frames[k - 1], events, ["id"])) == rows_of(frames[k])
        for _ in range(2 if k in (2, 4) else 1):
            sink(events, k)
            assert rows_of(sink.lists(spark, k), "list", "place", "id", "text") == lists_of(versions[k])
        touched = {r[1] for v in (versions[k - 1], versions[k]) for r in v if by_key(versions[k - 1]).get(r[0]) != by_key(versions[k]).get(r[0])} - {None}
        assert built[-1] <= len(touched) < 41
    assert sorted(p.name for p in (tmp_path / "lists" / "manifest").iterdir() if p.name.isdigit()) == ["3", "4"]


def test_change_stream(spark, tmp_path):
    """The same through a stream of event files, and through a second run that finds nothing new."""
    versions = list(history(2, 5))
    frames = [spark.createDataFrame(v, ROW) for v in versions]
    for k in (1, 2):
        changes.changes(frames[k - 1], frames[k], ["id"]).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    sink = changes.ListRefresh(str(tmp_path / "lists"), "list string, place int, id long, text string", ["list"], lambda _: frames[2], lambda rows: changes.first_rows(rows, ["list"], [F.desc("at"), F.asc("id")], 5), buckets=8)
    sink.refresh(frames[0].select("list").where("list is not null").distinct(), -1 + 1)
    shape = spark.read.parquet(str(tmp_path / "events")).schema
    for _ in range(2):
        feed = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
        changes.start(feed, lambda batch, number: sink(batch, number + 1), str(tmp_path / "check")).awaitTermination(240)
        assert rows_of(sink.lists(spark, 2), "list", "place", "id", "text") == lists_of(versions[2])


def test_buckets_open_only_what_they_must(spark, tmp_path):
    store = Buckets(str(tmp_path), "k string, v int", ["k"], 16)
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(50)], "k string, v int")
    first = store.write(rows, 0, {}, store.touched(rows))
    some = rows.where("k = 'k7'")
    (only,) = store.touched(some)
    assert {f.split("bucket=")[1].split("/")[0] for f in store.read(spark, first, {only}).inputFiles()} == {str(only)}
    after = store.write(some.limit(0), 1, first, {only})
    assert "k7" not in {r["k"] for r in store.read(spark, after).collect()} and store.read(spark, {}).count() == 0


SENT = "provider_id string, conversation string, ts timestamp, preview string"


def sent_rows(n):
    """Out of order, repeated and without ids; one conversation has a third of all."""
    r = random.Random(9)
    rows = []
    for i in range(n):
        c = "hot" if i % 3 == 0 else f"c{i % 11}"
        rows.append((f"{c}-{i}" if i % 9 else None, c, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randrange(60)), f"p{i}"))
    rows += [x for x in rows[: n // 3] if x[0] is not None]
    r.shuffle(rows)
    return rows


def put(spark, rows, folder, files):
    for k in range(files):
        spark.createDataFrame(rows[k::files], SENT).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder):
    return spark.readStream.schema(SENT).option("maxFilesPerTrigger", 1).parquet(str(folder))


def kept(df):
    return rows_of(df, "conversation", "last_at", "preview", "unread")


def test_keyed_state_equals_batch_and_restarts(spark, tmp_path):
    rows = sent_rows(180)
    want = kept(inbound.conversation_state(inbound.once(spark.createDataFrame(rows, SENT))))
    put(spark, rows[:120], tmp_path / "in", 2)
    keyed.start(stream(spark, tmp_path / "in"), str(tmp_path / "check")).awaitTermination(240)
    half = kept(inbound.conversation_state(inbound.once(spark.createDataFrame(rows[:120], SENT))))
    assert kept(keyed.states(spark, str(tmp_path / "check"))) == half != want
    # More input after a restart, then a run without any.
    put(spark, [*rows[120:], (None, None, dt.datetime(2024, 1, 1), "no conversation"), ("x", "c1", None, "no time")], tmp_path / "in", 1)
    for _ in range(2):
        keyed.start(stream(spark, tmp_path / "in"), str(tmp_path / "check"), str(tmp_path / "out")).awaitTermination(240)
        assert kept(keyed.states(spark, str(tmp_path / "check"))) == want
    assert kept(keyed.states(spark, str(tmp_path / "check"), 1)) == half
    # A batch tells of the conversations it has messages of.
    told = spark.read.parquet(str(tmp_path / "out"))
    assert {r["batch"] for r in told.collect()} == {2} and {r["conversation"] for r in told.collect()} == {r[1] for r in rows[120:]}
    assert rows_of(keyed.seen(spark, str(tmp_path / "check"))) == sorted({(c, i) for i, c, *_ in rows if i is not None})


def test_ids_are_forgotten_and_quiet_is_told(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    put(spark, [("a", "c", at, "one")], tmp_path / "in", 1)
    run = lambda: keyed.start(stream(spark, tmp_path / "in"), str(tmp_path / "check"), str(tmp_path / "out"), remember_ms=1, quiet_ms=1).awaitTermination(240)
    run()
    put(spark, [("a", "c", at, "again"), ("b", "d", at, "two")], tmp_path / "in", 1)
    run()
    put(spark, [("b2", "d", at, "three")], tmp_path / "in", 1)
    run()
    assert kept(keyed.states(spark, str(tmp_path / "check"))) == [("c", at, "one", 2), ("d", at, "three", 2)]
    told = rows_of(spark.read.parquet(str(tmp_path / "out")), "batch", "conversation", "kind", "unread")
    assert (0, "c", "message", 1) in told and (2, "c", "quiet", 2) in told and (2, "d", "message", 2) in told


def test_payload_stream(spark, tmp_path):
    said = lambda i, t: json.dumps({"data": {"key": {"id": i, "remoteJid": "551@s.net"}, "message": {"conversation": t}}})
    rows = [(said("a", "one"), dt.datetime(2024, 1, 1)), (said("a", "one"), dt.datetime(2024, 1, 2)), (said("b", "two"), dt.datetime(2024, 1, 3)), ("{broken", None)]
    spark.createDataFrame(rows, "payload string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    payloads = spark.readStream.schema("payload string, ts timestamp").parquet(str(tmp_path / "in"))
    inbound.start_payloads(payloads, str(tmp_path / "check")).awaitTermination(120)
    assert kept(keyed.states(spark, str(tmp_path / "check"))) == [("551", dt.datetime(2024, 1, 3), "two", 2)]
