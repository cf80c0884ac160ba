import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.errors import CapabilityError, ConfigurationError
from tracewright.functions.text import TERMINATORS, WHITESPACE, decode_source, frame
from tracewright.operators import patterns as pt
from tracewright.operators.parsing import Context, canonicalize, enrich, parse_documents
from tracewright.plans.capabilities import Capabilities
from tracewright.sources.lines import frame_lines, frame_lines_native, read_documents
from tracewright.sources.partitions import LinePartitioner, pack_records, rebase

TEXT = st.text(st.sampled_from("ab é🙂\r\n" + TERMINATORS), max_size=30)


def test_white_space_table():
    assert set(WHITESPACE) == {c for c in map(chr, range(0x110000)) if c.isspace()}


@given(TEXT)
def test_frame_equals_splitlines(text):
    assert [x for x, _ in frame(text)] == text.splitlines()
    assert [w for _, w in frame(text)] == [len(x.encode()) for x in text.splitlines(keepends=True)]


@settings(max_examples=15, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8), st.integers(0, 100))
def test_both_framings_agree(spark, texts, offset):
    df = spark.createDataFrame([(str(i), t, offset) for i, t in enumerate(texts)], "source_id string, text string, source_offset long")
    a, b = (sorted(map(tuple, f(df).collect())) for f in (frame_lines, frame_lines_native))
    assert a == b
    assert len(a) == sum(len(t.splitlines()) for t in texts)


def test_sources(spark, tmp_path):
    assert decode_source(b"\xc3\xa9") == "é"
    with pytest.raises(UnicodeDecodeError):
        decode_source(b"\xff")
    with pytest.raises(TypeError):
        decode_source(5)
    (tmp_path / "a.log").write_bytes(b"x\r\ny")
    assert read_documents(spark, f"{tmp_path}/a.log").first().text == "x\r\ny"
    (tmp_path / "b.log").write_bytes(b"\xff")
    with pytest.raises(Exception, match="(?i)utf"):
        read_documents(spark, f"{tmp_path}/b.log").collect()


LINES = ["service  down", "connection\x1frefused now ", "Login failed; timeout", "out of memory OOM", "retry 3", "attempt 12", "attempt x", "  Traceback (most recent call last):", "ERROR: database timeout  ", "WARNING: connection unstable", "errors", "warn", "é timeouté timeout", "permission denied forbidden", "TIMED OUT", "ERROR  x", "a" * 1000, "unavailableK retryſ"]


def test_native_signals_equal_python(spark):
    rng = random.Random(2)
    lines = LINES + ["".join(rng.choice(["timeout", " ", "ERROR", ":", "é", "retry", "\x1f", "　", "warn", "oom", "attempt ", "5", "x"]) for _ in range(rng.randrange(9))) for _ in range(300)]
    df = spark.createDataFrame([("s", "\n".join(lines))], "source_id string, text string")
    parser = pt.ApplicationLogParser()
    key = ["evidence.line_number", "event_type", "attributes_json", "severity", "evidence.pattern_name", "evidence.start_offset", "evidence.end_offset"]
    a = [tuple(r) for r in canonicalize(parser.native(frame_lines(df))).orderBy("seq").select(*key, "canonical").collect()]
    b = [tuple(r) for r in parse_documents(df, parser).events.orderBy("seq").select(*key, "canonical").collect()]
    assert a == b and len(a) > 100


def test_native_patterns_take_a_very_long_line(spark):
    line = "x " * 150_000 + "timeout" + " \t" * 50_000
    df = spark.createDataFrame([("s", line)], "source_id string, text string")
    rows = pt.ApplicationLogParser().native(frame_lines(df)).collect()
    assert [r.event_type for r in rows] == ["timeout"]


def test_signal_order_and_messages():
    parsed = pt.ApplicationLogParser().parse_text("ERROR: login failed forbidden timeout retry  \nWARN a \n", Context())
    assert [e.event_type for e in parsed.events] == ["authentication_failure", "authorization_failure", "timeout", "retry", "error", "warning"]
    assert parsed.events[0].attributes["message"] == "ERROR: login failed forbidden timeout retry"
    assert parsed.events[4].attributes["message"] == "login failed forbidden timeout retry  "
    assert parsed.events[5].attributes["message"] == "a " and parsed.events[5].severity == "WARNING"
    assert len(parsed.statistics) == 10 and parsed.statistics["oom"] == 0


def test_patterns():
    r = pt.RegexPattern("r", r"(?P<a>x)|(?P<b>y)", severity="LOW", event_type="t", metadata={"hidden": 1})
    assert r.match("zy").attributes == {"b": "y"} and r.match(5) is None and r.to_event(r.match("x")).event_type == "t"
    assert pt.ExactPattern("e", 1, {"k": 1}).match(True) is None and pt.ExactPattern("e", 1, {"k": 1}).match(1).attributes == {"k": 1}
    assert pt.PredicatePattern("p", lambda v: v == 2).match(2).attributes == {}
    s = pt.StructuredPattern("s", lambda v: "k" in v)
    assert s.match({"k": 1}).attributes == {"k": 1} and s.match("k") is None
    with pytest.raises(ConfigurationError):
        pt.RegexPattern("bad", "(")


def test_first_match_registration_and_order():
    a, b, c = pt.RegexPattern("b", "x"), pt.RegexPattern("a", "x"), pt.RegexPattern("c", "x", priority=9)
    parser = pt.PatternParser([a, b, c])
    assert [e.pattern for e in parser.parse_text("x", Context()).events] == ["c", "a", "b"]
    first = pt.PatternParser([a, b, c], first_match_only=True)
    assert [e.pattern for e in first.parse_text("x\nx", Context()).events] == ["c", "c"]
    with pytest.raises(ConfigurationError):
        parser.register(pt.RegexPattern("a", "y"))
    parser.register(pt.RegexPattern("a", "y"), replace=True)
    parser.unregister("c")
    assert [e.pattern for e in parser.parse_text("x", Context()).events] == ["b"]


def test_native_first_match_and_statistics(spark):
    df = spark.createDataFrame([("s", "GET /x\nping\nPOST"), ("t", "nothing")], "source_id string, text string")
    parser = pt.PatternParser([pt.RegexPattern("get", "GET"), pt.RegexPattern("path", "/x", priority=1), pt.ExactPattern("ping", "ping", {"k": 1}, severity="INFO")], first_match_only=True)
    events = parser.native(frame_lines(df))
    assert [(r.event_type, r.attributes_json, r.severity) for r in events.orderBy("seq").collect()] == [("path", "{}", None), ("ping", '{"k":1}', "INFO")]
    stats = {(r.source_id, r.pattern_name): r.matches for r in pt.pattern_statistics(events, df, ["get", "path", "ping"]).collect()}
    assert stats == {("s", "get"): 0, ("s", "path"): 1, ("s", "ping"): 1, ("t", "get"): 0, ("t", "path"): 0, ("t", "ping"): 0}
    assert pt.PatternParser([pt.RegexPattern("r", r"(?P<x>\d+)")]).native(frame_lines(df)) is None


def test_enrichment_counts_empty_as_missing(spark):
    df = spark.createDataFrame([("s", "timeout")], "source_id string, text string")
    e = enrich(parse_documents(df, pt.ApplicationLogParser()).events, parser=pt.ApplicationLogParser(), correlation_id="c", partition_id="").first().evidence
    assert (e.correlation_id, e.parser_name) == ("c", "application-log")


def test_continue_on_error(spark):
    df = spark.createDataFrame([("a", bytearray(b"timeout"), 0), ("b", bytearray(b"\xff"), 1)], "source_id string, content binary, input_index long")
    parsing = parse_documents(df, pt.ApplicationLogParser(), continue_on_error=True)
    results = {r.source_id: r for r in parsing.results.collect()}
    assert results["b"].errors[0].error_type == "UnicodeDecodeError" and results["b"].errors[0].input_index == 1 and not results["a"].errors
    assert parsing.events.count() == 1
    with pytest.raises(Exception, match="UnicodeDecodeError"):
        parse_documents(df, pt.ApplicationLogParser()).results.collect()


def test_partitions(spark):
    assert [p.text for p in pack_records(iter(["a\r\n", "b", "c\n"]), 2)] == ["a\nb\n", "c"]
    for bad in (["a\nb"], ["x" * 9]):
        with pytest.raises(ValueError):
            list(pack_records(iter(bad), max_bytes=8))
    lines = [f"é line {i} " + ["timeout", "retry", "x"][i % 3] for i in range(300)]
    df = spark.createDataFrame([("s", "\r\n".join(lines)), ("t", "")], "source_id string, text string")
    parser = pt.ApplicationLogParser()
    parts = LinePartitioner(max_lines=50).partition(df, parser.capabilities)
    assert parts.count() == 6
    moved = rebase(parse_documents(parts, parser).events, parts).orderBy("seq")
    whole = parse_documents(spark.createDataFrame([("s", "\n".join(lines))], "source_id string, text string"), parser).events.orderBy("seq")
    key = ["event_type", "attributes_json", "evidence.line_number", "evidence.start_offset", "evidence.end_offset"]
    last = lambda rows: [tuple(r)[:4] for r in rows]  # noqa: E731  the last span may lack a terminator
    assert last(moved.select(*key).collect()) == last(whole.select(*key).collect())
    with pytest.raises(CapabilityError):
        LinePartitioner().partition(df, Capabilities())


def test_capability_rules():
    for bad in ({"partitionable": True}, {"partitionable": True, "parallel_safe": True, "stateful": True, "partition_framing": "line"}, {"partition_framing": "line"}):
        with pytest.raises(ConfigurationError):
            Capabilities(**bad)
    assert re.search("deterministic", str(Capabilities()))
