"""Remaining quirks: documents, services, tasks, traces, sessions, exports, sources."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import documents as d
from tidewatch.operators import export, services, sessions, tasks, traces
from tidewatch.operators.steps import StepRegistry
from tidewatch.sources.json_files import read_json_records


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v string")


def test_breaks_and_printable(spark):
    row = texts(spark, "  a\r\nbé!\t").select(
        d.clean_breaks(F.col("v")), d.clean_breaks(F.col("v"), "$"), d.clean_breaks(F.col("v"), "|", True),
        d.printable(F.col("v")), d.no_capitals(F.col("v"))).first()
    assert tuple(row) == ("  abé!\t", "  a$$bé!\t", "  a\r|\n|bé!\t", "a\r\nb", True)


def test_tokens_in_list_order(spark):
    got = texts(spark, "a[1] $x (y)").select(d.replace_tokens(F.col("v"), [("[1]", "$1"), ("$1", "Z"), ("(y)", "\\")])[-1]).first()[0]
    assert got == "aZ $x \\"


@pytest.mark.parametrize("seconds, expected", [
    (0, "00 secs ago"), (1, "01 sec  ago"), (59, "59 secs ago"), (60, "01 min  ago"), (-90, "02 mins from now"),
    (86400, "01 day  ago"), (86400 * 30, "01 month  ago"), (86400 * 360 * 2, "02 years ago"), (86400 * 360 * 1000, "N/A")])
def test_age(spark, seconds, expected):
    df = spark.createDataFrame([(seconds,)], "s bigint")
    assert df.select(d.age_text(F.col("s"))).first()[0] == expected


def test_yesterday(spark):
    df = spark.createDataFrame([(1,), (0,), (3,), (-2,)], "n int")
    assert [r[0] for r in df.select(d.ago_words(F.col("n"), "day")).collect()] == [
        " -yesterday- ", None, " 03 days ago ", " 02 days from now "]


@pytest.mark.parametrize("value, form, ms", [
    ("2010-11-06 14:44:51", "sql", 1289054691000), ("Sat Nov 6 14:44:51 PST 2010", "words", 1289054691000),
    ("", "N/A", None), ("soon", "N/A", None)])
def test_dates(spark, value, form, ms):
    row = texts(spark, value).withColumns(d.date_parts(F.col("v"))).withColumn("ms", d.epoch_ms()).first()
    assert (row.form, row.ms) == (form, ms)


def test_flat_and_nested(spark):
    df = spark.createDataFrame([(1, '{"queryObject": {"param": {"key1": "val"}}, "n": 1.0, "e": {}, "z": null, "l": [true, [2]]}'),
                                (2, "{bad"), (3, None)], "id int, body string")
    got = sorted((r.id, r.path, r.value) for r in d.json_to_flat(df, "id", "body").collect())
    assert got == [(1, "l.0", "true"), (1, "l.1.0", "2"), (1, "n", "1"), (1, "queryObject.param.key1", "val")]
    flat = spark.createDataFrame([(1, "queryObject.param.key1", '"val"', 1), (1, "a", '""', 2), (1, "a.b", "1", 3),
                                  (1, "c", "5", 4), (1, "c.d", "1", 5), (1, "x", "1", 6), (1, "x", "2", 7)],
                                 "id int, path string, value string, ord int")
    assert d.flat_to_json(flat, "id").first().json == '{"queryObject":{"param":{"key1":"val"}},"a":{"b":1},"c":5,"x":2}'


def test_wire(spark):
    rows = texts(spark, "SUCCESS: x__ROW__a,b__COMMA__c__ROW__", "SUCCESS: raw,text", "SUCCESS: ", "FAIL: why", "?")
    got = [tuple(r) for r in rows.select(*d.decode_wire(F.col("v")).values()).collect()]
    assert got == [(True, None, [["a", "b,c"], [""]]), (True, None, [["raw,text"]]), (True, None, []), (False, "why", []),
                   (False, "Unrecognized response from node: ?", [])]


def test_json_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1}\n{bad\n')
    got = sorted((str(r.k), r.success) for r in read_json_records(spark, str(tmp_path), "k int").collect())
    assert got == [("1", True), ("None", False)]
    with pytest.raises(ValueError):
        read_json_records(spark, "", "k int")


def test_increment_of_an_absent_value(spark):
    log = spark.createDataFrame([("a", "increment", None, 1, 1), ("b", "set", 5, 1, 2), ("b", "increment", None, 2, 3),
                                 ("c", "set", 1, 1, 4), ("c", "delete", None, 2, 5), ("d", "increment", None, 1, 6)],
                                "key string, op string, value bigint, ts_us bigint, event_id bigint")
    defaults = spark.createDataFrame([("d", 10), ("e", 3)], "key string, value bigint")
    got = {r.key: (r.state, r.value) for r in services.fold_changes(log, defaults).collect()}
    assert got == {"a": ("nan", None), "b": ("set", 6), "c": ("absent", None), "d": ("set", 11), "e": ("set", 3)}


def test_no_compose(spark):
    calls = spark.createDataFrame([("s",), (None,)], "service string")
    compose = spark.createDataFrame([("s", "p")], "service string, package string")
    got = {r.service: r.reason for r in services.validate_compose(calls, compose, composed=False).collect()}
    assert got == {"s": services.NO_COMPOSE, None: "must specify service name in queryObject"}


def test_read_only_poll_writes_nothing(spark):
    runs = spark.createDataFrame([(1, 1, False, "r", True)], "id int, task_id int, success boolean, reason string, rerun boolean")
    rows = tasks.record_outcomes(runs, readonly=True).collect()
    assert [(r.action, r.written) for r in rows] == [("outcome", False), ("requeue", False)]
    queue = spark.createDataFrame([(1, True), (2, True)], "id int, outstanding boolean")
    after = {r.id: r.outstanding for r in tasks.requeued(queue, tasks.record_outcomes(runs)).collect()}
    assert after == {1: True, 2: True}
    after = tasks.requeued(queue, tasks.record_outcomes(runs.withColumn("rerun", F.lit(False))))
    assert {r.id: r.outstanding for r in after.collect()} == {1: False, 2: True}


def test_nested_failure_has_five_levels(spark):
    calls = spark.createDataFrame([("t", i, i + 1 if i < 4 else None, f"<{i}>") for i in range(5)],
                                  "trace string, node int, parent int, entry string")
    got = {r.node: (r.depth, r.stack_text) for r in traces.call_stacks(calls, ["trace"]).collect()}
    assert got[0] == (5, "<0><1><2><3><4>") and got[4] == (1, "<4>")


def test_a_cycle_of_calls_is_refused(spark):
    calls = spark.createDataFrame([("t", i, (i + 1) % 3, "x") for i in range(3)], "trace string, node int, parent int, entry string")
    with pytest.raises(ValueError, match="cycle"):
        traces.call_stacks(calls, ["trace"])


def test_hot_traces_and_keys(spark):
    """One key with most rows, with the hot path forced by a low limit."""
    from tidewatch.functions import skew
    rows = [("hot" if i % 4 else f"t{i % 40}", i, i not in (61, 90, 80)) for i in range(400)]
    steps = spark.createDataFrame(rows, "trace string, pos int, ok boolean")
    names = sorted({r[0] for r in rows})
    names_df = spark.createDataFrame([(n,) for n in names], "trace string")
    limit, results = skew.attach.__defaults__, []
    try:
        for hot_rows in (3, 10 ** 9):
            skew.attach.__defaults__ = (hot_rows,)
            results.append({r.trace: (r.success, r.failed_step, r.counted, r.ignored)
                            for r in traces.first_failures(names_df, steps, ["pos"]).collect()})
    finally:
        skew.attach.__defaults__ = limit
    expect = {}
    for n in names:
        oks = [ok for t, _, ok in rows if t == n]
        at = oks.index(False) + 1 if False in oks else None
        expect[n] = (at is None, at, at or len(oks), len(oks) - (at or len(oks)))
    assert results == [expect, expect]


def test_script_over_chunk_borders(spark):
    """Random texts in short chunks against the rule written as a loop, with one hot connection."""
    rng = random.Random(11)
    script = ["ab", "bca", "c", "aab"]
    rows = []
    for conn in range(12):
        for seq in range(80 if conn == 0 else 10):
            rows.append((conn, seq, "".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 1, 2, 3])))))
    df = spark.createDataFrame(rows, "conn int, seq bigint, t string")
    for slices in (1, 6):
        got = {r.conn: (r.matched, r.done_seq, r.success) for r in
               sessions.match_script(df, "conn", "seq", "t", script, slices).collect()}
        for conn in range(12):
            acc, step, done, end = "", 0, None, None
            for c, seq, t in rows:
                if c != conn or not t:
                    continue
                end = seq
                if step < len(script):
                    acc += t
                    if script[step] in acc:
                        acc, step, done = "", step + 1, seq
            assert got[conn] == (step, done, step == len(script) and end == done), conn


@pytest.mark.parametrize("slices", [1, 5])
def test_frames_in_any_chunking(spark, slices):
    rng = random.Random(5)
    rows, expect = [], {}
    for conn in range(8):
        body = "".join(rng.choice("xyz\r\n") for _ in range(rng.randrange(0, 60)))
        text = f"HTTP/1.1 200 OK\r\nCONTENT-LENGTH: {len(body)}\r\nother: 1\r\n\r\n{body}"
        sent = text if conn % 3 else text[:-1]
        expect[conn] = body if sent == text else None
        at = seq = 0
        sent += "tail" if conn % 2 and sent == text else ""
        while at < len(sent):
            n = rng.randrange(1, 9)
            rows.append((conn, seq, sent[at:at + n]))
            at, seq = at + n, seq + 1
    df = spark.createDataFrame(rows, "conn int, seq bigint, t string")
    got = {r.conn: r.body for r in sessions.content_length_frames(df, "conn", "seq", "t", slices).collect()}
    assert got == expect


def test_first_step_group_wins_and_unknown_names_fail_first(spark):
    ran = []

    def step(df):
        ran.append(1)
        return df

    steps = StepRegistry().register(a=lambda df: df.limit(1)).register(a=step, b=step)
    df = spark.range(3)
    assert steps.run(df, [("a",), ("b",)]).count() == 1 and ran == [1]
    with pytest.raises(KeyError, match="Could not find a processor"):
        steps.run(df, [("b",), ("missing",)])
    assert ran == [1]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, 3.0)], "id int, name string, n double")
    lines = lambda fmt: [r.line for r in export.export_lines(df, "id", fmt).collect()]
    assert lines("tsv") == ["id\tname\tn", "1\ta\t2.5", "2\t\t3"]
    assert lines("ssv") == ["id name n   ", "", "1  a    2.5 ", "2  null 3   "]
    assert lines("json")[1].removesuffix(",") == '  {\n    "id": 1,\n    "name": "a",\n    "n": 2.5\n  }'
    with pytest.raises(ValueError, match="invalid serialization format"):
        lines("xml")
    export.write_lines(export.export_lines(df, "id", "tsv"), str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines() == lines("tsv")


def test_written_tables_can_be_dropped(spark):
    import os

    from tidewatch import session
    kept = len(session._written)
    table = session.checkpointed(spark.range(5))
    path = session._written[-1].removeprefix("file:")
    assert table.count() == 5 and os.path.isdir(path)
    assert session.drop_checkpoints(spark, kept) == 1 and not os.path.isdir(path)


def test_target_urls_and_their_parts(spark):
    from tidewatch.operators.services import target_parts, target_url
    df = spark.createDataFrame([("box", 80), ("box", None), (None, 1)], "h string, p int")
    urls = df.select(target_url(F.col("h"), F.col("p")).alias("u"))
    assert [r.u for r in urls.collect()] == ["http://box:80", None, None]
    parts = urls.select(*[c.alias(n) for n, c in target_parts(F.col("u")).items()]).first()
    assert tuple(parts) == ("box", "80")


def test_access_log_is_appended(spark, folder, tmp_path):
    from tidewatch.sources.views import requests
    from tidewatch.streaming.sinks import append_access_log
    log = requests(spark, folder).withColumns({"recorded_us": F.lit(0).cast("bigint"), "peer": F.col("ip")})
    path = str(tmp_path / "log")
    append_access_log(log, path)
    append_access_log(log, path)
    assert spark.read.parquet(path).count() == 2 * log.count()
    with pytest.raises(ValueError):
        append_access_log(log, "")


def test_a_json_report_is_a_document(spark, tmp_path):
    import json

    from tidewatch.operators.export import export_lines, write_lines
    rows = spark.sql("""SELECT * FROM VALUES (1, 'a"b', 1e33D, array(1, 2), named_struct('x', null, 'y', map('k', 0.00001D)), true),
      (2, null, double('NaN'), array(), null, null) AS t(id, s, d, l, o, f)""")
    write_lines(export_lines(rows, "id", "json"), str(tmp_path / "report"))
    files = sorted((tmp_path / "report").glob("part-*"))
    assert json.loads("".join(f.read_text() for f in files)) == [
        {"id": 1, "s": 'a"b', "d": 1e33, "l": [1, 2], "o": {"x": None, "y": {"k": 1e-5}}, "f": True},
        {"id": 2, "s": None, "d": None, "l": [], "o": None, "f": None}]
    empty = export_lines(rows.where("id > 5"), "id", "json").collect()
    assert [r.line for r in empty] == ["[]"]
