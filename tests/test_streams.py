"""Replayed streams against their batch twins."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from shelfwise.streaming import streams as st

SCHEMA = "k STRING, slot BIGINT, seq BIGINT, v STRING"


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(path)


def test_keep_last_table(spark, tmp_path):
    log, cp = str(tmp_path / "log"), str(tmp_path / "cp")
    first = [(f"k{i % 7}", i % 3, i, f"a{i}") for i in range(40)]
    second = [(f"k{i % 7}", i % 3, 100 + i, f"b{i}") for i in range(5)] + first[:10]
    table = st.KeepLastTable(spark, str(tmp_path / "t"), ["k", "slot"], "seq", SCHEMA, fan=2)
    write(spark, first, log)
    st.run_batches(st.read_log(spark, log, SCHEMA), table.merge, cp)
    write(spark, second, log)
    st.run_batches(st.read_log(spark, log, SCHEMA), table.merge, cp)
    whole = spark.createDataFrame(first + second, SCHEMA)
    want = sorted(tuple(r) for r in st.batch_twin(whole, ["k", "slot"], "seq").select("k", "slot", "seq", "v").collect())
    assert sorted(tuple(r) for r in table.table().select("k", "slot", "seq", "v").collect()) == want
    st.run_batches(st.read_log(spark, log, SCHEMA), table.merge, cp)          # nothing new
    table.merge(spark.createDataFrame([("k0", 0, 10**6, "replayed")], SCHEMA), 0)   # an old batch again
    assert sorted(tuple(r) for r in table.table().select("k", "slot", "seq", "v").collect()) == want


def test_keep_last_table_writes_what_a_batch_brings_and_drops_old_runs(spark, tmp_path):
    table = st.KeepLastTable(spark, str(tmp_path / "t"), ["k", "slot"], "seq", SCHEMA, fan=3)
    rows = []
    for batch in range(10):
        new = [(f"k{(batch * 7 + i) % 30}", 0, batch * 10 + i % 4, f"{batch}.{i}") for i in range(20)]
        rows += new
        table.merge(spark.createDataFrame(new, SCHEMA), batch)
        live = [r for r, _ in table.runs()[1]]
        folders = {p.name for p in (tmp_path / "t" / "data").iterdir()}
        assert set(live) <= folders and len(live) <= 6 and len(folders) <= 12
        assert spark.read.parquet(str(tmp_path / "t" / "data" / f"{batch}-0")).count() <= 20 if f"{batch}-0" in folders else True
    assert {level for _, level in table.runs()[1]} >= {0, 2}        # nine batches are one run of level 2
    assert len(list((tmp_path / "t" / "manifest").iterdir())) == 2
    want = sorted(map(tuple, st.batch_twin(spark.createDataFrame(rows, SCHEMA), ["k", "slot"], "seq").select("k", "slot", "seq", "v").collect()))
    assert sorted(map(tuple, table.table().select("k", "slot", "seq", "v").collect())) == want


def test_registry_keeps_first_sighting(spark, tmp_path):
    reg = st.NameRegistry(spark, str(tmp_path / "r"))
    schema = "ts timestamp, key string"
    t = [datetime(2024, 1, 1, 0, m) for m in range(4)]
    reg.add(spark.createDataFrame([(t[1], "a"), (t[0], "a"), (t[1], "b")], schema), 0)
    reg.add(spark.createDataFrame([(t[2], "a"), (t[3], "c")], schema), 1)
    reg.add(spark.createDataFrame([(t[2], "a"), (t[3], "c")], schema), 1)     # the batch runs again
    got = {r.key: r.first_ts for r in reg.table().collect()}
    assert got == {"a": t[0], "b": t[1], "c": t[3]}


SIGHT = "ts TIMESTAMP, key STRING"
T0 = datetime(2024, 1, 1)


def sights(spark, folder, rows):
    """One file of sightings: (minute, name)."""
    spark.createDataFrame([(T0 + timedelta(minutes=m), k) for m, k in rows], SIGHT).coalesce(1).write.mode("append").json(folder)


def test_discovery_forgets_old_names_but_adds_none_twice(spark, tmp_path):
    log, cp, reg = str(tmp_path / "log"), str(tmp_path / "cp"), st.NameRegistry(spark, str(tmp_path / "r"), buckets=4)
    want, states = {}, []
    for hour in range(6):
        names = [(hour * 60 + i % 50, f"h{hour}_{i}") for i in range(30)] + [(hour * 60 + 3, "always"), (hour * 60 + 1, "h0_1")]
        sights(spark, log, names)
        for m, k in names:
            want.setdefault(k, T0 + timedelta(minutes=m))
        # every file is a run of its own: the state and the registry are found again
        states += st.run_batches(st.fresh_names(st.read_log(spark, log, SIGHT), 60), reg.add, cp, mode="update")
    assert {r.key: r.first_ts for r in reg.table().collect()} == want and reg.table().count() == len(want) == 181
    assert max(s["state_rows"] for s in states) <= 100             # 181 names, some 32 an hour


def test_intervals_take_late_names_up_to_the_watermark(spark, tmp_path):
    log, schema = str(tmp_path / "log"), "key STRING, first_ts TIMESTAMP"
    files = [[("a", 0), ("b", 1), ("c", 30)], [("d", 25), ("e", 29), ("f", 31)], [("g", 1), ("h", 45)], [("i", 2), ("j", 44)]]
    board, cp = st.IntervalBoard(spark, str(tmp_path / "b")), str(tmp_path / "cp")
    seen = []
    for f in files:
        spark.createDataFrame([(k, T0 + timedelta(minutes=m)) for k, m in f], schema).coalesce(1).write.mode("append").parquet(log)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(log)
        seen += st.run_batches(st.names_per_interval(stream, "10 minutes", "10 minutes"), board.show, cp, mode="update")
    got = {int((r.start - T0).total_seconds() // 60): r.n_new for r in board.table().collect()}
    # d and e come 5 minutes late and count; g and i come when their window has left the state
    assert got == {0: 2, 20: 2, 30: 2, 40: 2}
    assert sum(s["late_rows"] for s in seen) == 2 and max(s["state_rows"] for s in seen) <= 3


def test_gate_lets_in_who_becomes_eligible(spark, tmp_path):
    log, schema = str(tmp_path / "log"), "user STRING, seq BIGINT, status STRING"
    files = [[("u", 1, "ok"), ("v", 2, "bad"), ("w", 3, "ok")], [("u", 4, "ok"), ("v", 5, "ok"), ("w", 6, "bad")], [("v", 7, "ok"), ("w", 8, "ok"), ("u", 9, "bad")]]
    states = st.KeepLastTable(spark, str(tmp_path / "s"), ["user"], "seq", schema, fan=2)
    gate = st.Gate(states, "user", str(tmp_path / "out"), F.col("status") == "ok", ["user", "seq"])
    for f in files:
        spark.createDataFrame(f, schema).coalesce(1).write.mode("append").json(log)
        st.run_batches(st.read_log(spark, log, schema), gate.step, str(tmp_path / "cp"))
    rows = spark.read.schema("user STRING, seq BIGINT").parquet(str(tmp_path / "out")).collect()
    assert sorted((r.seq, r.user) for r in rows) == [(1, "u"), (3, "w"), (4, "u"), (5, "v"), (7, "v"), (8, "w")]
