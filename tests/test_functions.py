import random
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.functions import identity, json_text, text, times, vectors
from eventloom.operators import ranges
from eventloom.operators.filters import EventFilters, filter_text, id_prefix

DENSE = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1100, 0x11FF), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3130, 0x318F), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF)]


def plain_tokens(s):
    out, run = [], ""

    def flush():
        nonlocal run
        at = 0
        while run:
            out.append(run[at : at + 32].lower())
            if at + 32 >= len(run):
                break
            at += 24
        run = ""

    for c in s:
        if any(a <= ord(c) <= b for a, b in DENSE):
            flush()
            out.append(c.lower())
        elif c.isalnum():
            run += c
        else:
            flush()
    flush()
    return out


def test_tokens(spark):
    r = random.Random(3)
    cases = ["", "Hello, World-42", "x" * 33, "y" * 32, "z" * 80, "漢字kanaかな", "snake_case::path/to.rs", "Straße ÉCOLE", "한국어 text"]
    cases += ["".join(r.choice("aB9 漢あ한ก_-.é") for _ in range(r.randint(0, 90))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, s string").select("i", text.tokens(F.col("s")).alias("t")).collect()
    for row in rows:
        assert row["t"] == plain_tokens(cases[row["i"]])


def test_query_terms(spark):
    assert text.query_terms(spark, [" Fix the Parser ", "", "parser"]) == ["fix", "parser", "the"]
    with pytest.raises(ValueError):
        text.query_terms(spark, [" ".join(f"w{i}" for i in range(33))])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", min_size=0, max_size=5000))
def test_chunk_spans(s):
    spans = vectors.chunk_spans(s)
    assert [] == spans if not s else spans[0][0] == 0 and spans[-1][1] == len(s)
    for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
        assert 0 < b - a <= 1200 and c == b - 200 and d > b
        assert s[b - 1].isspace() or not any(x.isspace() for x in s[b - 150 : b])


def test_times():
    now = datetime(2024, 3, 31, tzinfo=timezone.utc)
    assert times.since_ms("30d", now) == times.instant_ms("2024-03-01T00:00:00Z")
    assert times.instant_ms("2024-03-01T02:00:00.250+02:00") == 1709251200250
    for bad in ("2024-03-01T00:00:00.0001Z", "yesterday"):
        with pytest.raises(ValueError):
            times.instant_ms(bad)


def test_identity():
    assert identity.fnv1a64(b"") == 0xCBF29CE484222325
    assert identity.fnv1a64(b"a") == 0xAF63DC4C8601EC8C


def test_leaf_sum_is_a_sum_modulo_2_256(spark):
    leaves = ["f" * 64, "0" * 63 + "2", "8" + "0" * 63, "8" + "0" * 63]
    got = spark.createDataFrame([(x,) for x in leaves], "x string").agg(identity.leaf_sum(F.col("x")).alias("s")).first()["s"]
    assert int(got, 16) == sum(int(x, 16) for x in leaves) % (1 << 256)


def test_cursors():
    filters = EventFilters(providers=["b", "a", "a"], workspace=" Src ")
    key = (None, 3, "00ab")
    cursor = ranges.encode_cursor("g1", filters, key)
    assert ranges.decode_cursor(cursor, "g1", EventFilters(providers=["a", "b"], workspace="src")) == key
    for generation, chosen, text_ in (("g2", filters, cursor), ("g1", EventFilters(), cursor), ("g1", filters, "A" + cursor[1:]), ("g1", filters, "x" * 600)):
        with pytest.raises(ValueError):
            ranges.decode_cursor(text_, generation, chosen)
    with pytest.raises(ValueError):
        ranges.decode_cursor(cursor, "g1", filters, descending=True)


def test_filter_errors():
    for bad in (EventFilters(content_scope="calls", event_type="message"), EventFilters(agent_scope="both"), EventFilters(since_ms=5, until_ms=5), EventFilters(file=" ")):
        with pytest.raises(ValueError):
            bad.column()
    for bad in ("1234567", "1234-5678", "xyzxyzxy"):
        with pytest.raises(ValueError):
            id_prefix(bad)
    with pytest.raises(ValueError):
        filter_text("x" * 5000)


def test_json_references_and_commands():
    assert json_text.references('{"a": {"file_path": "x.rs", "Paths": ["y", 3]}, "url": "http://z"}') == [("file", "x.rs"), ("file", "y"), ("url", "http://z")]
    assert json_text.references("no json") == []
    assert json_text.command_words("git commit -m 'a b'") == ["git", "commit", "-m", "a b"]
    assert json_text.command_words("a | b") is None and json_text.command_words("a '") is None


def test_json_expressions(spark):
    rows = [('{"role":"assistant","content":[{"type":"tool_use","name":"x"}]}', "assistant"), ('{"parts":[{"text":"p"}]}', "user"), ('{"content":"s"}', "developer"), ('{"content":[{"type":"tool_result","content":[{"text":"deep"}]}]}', "user")]
    got = spark.createDataFrame(rows, "v string, r string").select(json_text.event_type(F.col("v"), F.col("r")).alias("e"), json_text.block_text(F.col("v")).alias("t"), json_text.message_id(F.col("v"), F.lit(7)).alias("i")).collect()
    assert [r["e"] for r in got] == ["tool_call", "message", "notice", "tool_output"]
    assert [r["t"] for r in got] == ["tool call: x", "p", "s", "deep"]
    assert got[0]["i"] == "message-7"


def test_snippets(spark):
    body = "a" * 500 + " needle here " + "b" * 500
    got = spark.createDataFrame([(body,), ("short needle",), ("",)], "b string").select(text.snippet(F.col("b"), ["Needle HERE", "zzz"]).alias("s")).collect()
    assert "needle here" in got[0]["s"]["snippet"] and len(got[0]["s"]["snippet"]) == 320 and got[0]["s"]["truncated"]
    assert got[1]["s"]["snippet"] == "short needle" and not got[1]["s"]["truncated"]
    assert got[2]["s"]["snippet"] == ""


def test_document_chunks_cover_whole_texts(spark, tmp_path):
    from eventloom.queries import rollups

    text = "some words of a text " * 5000
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(rollups.document_chunks(spark, str(tmp_path)).select("start_char", "end_char").collect())
    assert [tuple(r) for r in rows] == vectors.chunk_spans(text)
    assert rows[-1]["end_char"] == len(text) > vectors.SOURCE_CHARS


def test_repeated_keys_take_a_record_its_authority(spark):
    from eventloom.functions.json_text import keys_are_unique

    texts = {'{"a": 1, "b": {"a": 2}}': True, '{"a": 1, "a": 1}': False, '[{"x": {"k": 0, "k": 1}}]': False, "{": False, "NaN": False, "": False, None: False, "[" * 100000: False, "7": True}
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", keys_are_unique("text").alias("ok")).collect()
    assert {r["text"]: r["ok"] for r in rows} == texts


def test_commands_of_the_program_itself(spark):
    from eventloom.operators.retrieval_class import Routes, classified, command_class, tool_class
    from eventloom.schema import conform

    routes = Routes("recall", ("find", "read turn"), ("tidy",), "recall-tools", ("find",))
    lines = {
        "recall find x": "derived",
        " recall  read   turn 4": "derived",
        "recall read": "unknown",
        "recall finding x": "unknown",
        "recall tidy": "ordinary",
        "recall find x > f": "unknown",
        "recall find $(id)": "unknown",
        "cat recall find": "unknown",
        "": "unknown",
        None: "unknown",
    }
    df = spark.createDataFrame([(t,) for t in lines], "line string")
    assert {r["line"]: r["c"] for r in df.select("line", command_class(F.col("line"), routes).alias("c")).collect()} == lines
    tools = {("recall-tools", "find"): "derived", ("recall-tools", "tidy"): "ordinary", ("other", "find"): "unknown", (None, "find"): "unknown"}
    df = spark.createDataFrame(list(tools), "server string, tool string")
    assert {(r["server"], r["tool"]): r["c"] for r in df.select("*", tool_class(F.col("server"), F.col("tool"), routes).alias("c")).collect()} == tools
    assert df.select(command_class(F.col("tool"), Routes("find", ())).alias("c")).distinct().collect()[0]["c"] == "unknown"

    rows = [
        ("c1", "s", "tool_call", "k1", "recall-tools", "find", None, None, None),
        ("r1", "s", "tool_output", "k1", None, None, "succeeded", None, None),
        ("r2", "s", "tool_output", "k1", None, None, "failed", None, None),
        ("r3", "other", "tool_output", "k1", None, None, "succeeded", None, None),
        ("c2", "s", "command_started", "k2", None, "shell", None, [("command", "recall read turn 1")], None),
        ("r4", "s", "command_finished", "k2", None, None, "succeeded", None, None),
        ("c3", "s", "tool_call", "k3", None, "shell", None, [("command", "ls")], None),
        ("r5", "s", "tool_output", "k3", None, None, "succeeded", None, "private"),
        ("m", "s", "message", None, None, None, None, None, None),
    ]
    events = conform(spark.createDataFrame(rows, "event_id string, session_id string, event_type string, call_id string, server string, tool string, result_status string, facts array<struct<kind:string,value:string>>, discovery_exclusion string"))
    got = {r["event_id"]: r["discovery_exclusion"] for r in classified(events, routes).collect()}
    assert got == {"c1": "retrieval_derived", "r1": "retrieval_derived", "r2": None, "r3": None, "c2": "retrieval_derived", "r4": "retrieval_derived", "c3": None, "r5": "private", "m": None}


def test_shell_words(spark):
    from eventloom.functions.text import shell_quoted

    words = {"a/b_c.d:e@f-1": "a/b_c.d:e@f-1", "": "''", "it's": "'it'\\''s'", "a b": "'a b'", "a\n": "'a\n'", None: None}
    df = spark.createDataFrame([(t,) for t in words], "w string")
    assert {r["w"]: r["q"] for r in df.select("w", shell_quoted(F.col("w")).alias("q")).collect()} == words
