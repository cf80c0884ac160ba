import pytest

from tracewright.errors import ConfigurationError, ParseError
from tracewright.functions import strict_json as sj
from tracewright.operators import builtin as bi
from tracewright.operators import mixed as mx
from tracewright.operators.code_detection import RuleCodeDetector
from tracewright.operators.parsing import Context, parse_documents
from tracewright.operators.patterns import ApplicationLogParser, RegexPattern
from tracewright.operators.spans import covered_lines, uncovered_lines
from tracewright.sources.lines import frame_lines

C = Context(source_id="s")


@pytest.mark.parametrize("bad", ['{"a":1,"a":2}', "NaN", "[Infinity]", "1e400", "[1] [2]", '"\\ud800"', "[" * 300 + "]" * 300, "{'a':1}", "[1,]", "", "01"])
def test_strict_json_rejects(bad):
    with pytest.raises(ValueError):
        sj.loads(bad)


def test_strict_json_is_exact():
    assert sj.loads(str(2**100)) == 2**100 and sj.loads("[" * 256 + "]" * 256)
    assert sj.loads("-" + "9" * 6000) == -(10**6000 - 1)
    assert sj.canonical({"b": 1, "a": {"d": "é\x1f", "c": 1e16}}) == '{"a":{"c":1e+16,"d":"é\\u001f"},"b":1}'
    for bad in ({1: 2}, {"a": float("nan")}, {"a": {1}}, "\ud800"):
        with pytest.raises(ValueError):
            sj.checked(bad)
    assert sj.repaired("a\ud800") == "a\\ud800"
    with pytest.raises(ValueError):
        sj.exact_fields({"a": 1, "c": 2}, {"a"})


def test_timestamped_log():
    text = "2026-10-01T08:00:00+05:30 INFO started\r\n20261001T080002Z ERROR x  y \n"
    a, b = bi.TimestampedLogParser().parse_text(text, C).events
    assert a.timestamp.isoformat() == "2026-10-01T08:00:00+05:30" and b.attributes == {"level": "ERROR", "message": "x  y "} and (b.start, b.end) == (40, len(text))
    for bad, told in (("x", "invalid timestamped log at line 1"), ("2026-10-01T08:00:00 INFO a", "log timestamp must have a timezone"), ("abc INFO a", "invalid log timestamp"), (text + "\n", "at line 3"), ("2026-10-01T08:00:00Z info a", "invalid timestamped log")):
        with pytest.raises(ParseError, match=told):
            bi.TimestampedLogParser().parse_text(bad, C)
    with pytest.raises(ConfigurationError):
        bi.TimestampedLogParser(r"(?P<at>x)")


def test_json_parser():
    p = bi.JSONParser()
    good = p.parse_text('{"é": [1, 2]}', Context(source_offset=10))
    assert good.events[0].attributes == {"value": {"é": [1, 2]}} and (good.events[0].start, good.events[0].end, good.events[0].line) == (10, 24, 1)
    bad = p.parse_text("{bad}", C)
    assert bad.events[0].event_type == "unparsed" and bad.errors[0]["error_type"] == "ParseError"
    assert p.parse_text({"a": 1}, C).events[0].line is None
    with pytest.raises(UnicodeDecodeError):
        p.parse_text(b"\xff", C)


def test_traceback(spark):
    text = 'Traceback (most recent call last):\n  File "a.py", line 3, in main\n    run()\n  File "b.py", line 7, in run\n    raise KeyError("shop")\nKeyError: \'shop\'\n'
    e = bi.PythonTracebackParser().parse_text(text, C).events[0]
    assert e.attributes == {"exception_type": "KeyError", "message": "'shop'", "frames": [{"file": "a.py", "line": 3, "function": "main"}, {"file": "b.py", "line": 7, "function": "run"}]}
    with pytest.raises(ParseError):
        bi.PythonTracebackParser().parse_text("no exception here !", C)
    df = spark.createDataFrame([("s", text), ("t", "no exception !")], "source_id string, text string")
    r = bi.traceback_frames(frame_lines(df)).collect()
    assert len(r) == 1 and (r[0].exception_type, r[0].message) == ("KeyError", "'shop'") and [f.line for f in r[0].frames] == [3, 7]


DF = "Filesystem 1K-blocks Used Available Use% Mounted on\n/dev/sda1 100 70 30 70% /\n/dev/sdb1 100 96 4 96% /var data\n"


def test_command_output():
    df = bi.CLIOutputParser(command="df").parse_text(DF, C)
    assert [(e.attributes["mounted_on"], e.attributes["use_percent"], e.line) for e in df.events] == [("/", 70, None), ("/var data", 96, None)]
    assert bi.CLIOutputParser(command="kv").parse_text("a = 1\nb: x\n", C).events[0].attributes == {"a": "1", "b": "x"}
    assert bi.CLIOutputParser(command="csv").parse_text("a,b\n1,2\n", C).events[0].attributes == {"a": "1", "b": "2"}
    bad = bi.CLIOutputParser(command="csv").parse_text("a,b\n1\n", C)
    assert bad.events[0].event_type == "unparsed" and bad.errors
    assert bi.CLIOutputParser(command="table").parse_text("a b\n", C).warnings
    assert bi.CLIOutputParser([RegexPattern("x", "x")]).parse_text("x", C).events[0].event_type == "x"
    for k in ({}, {"command": "ls_s"}, {"command": "nope"}, {"command": "df", "patterns": []}):
        with pytest.raises(ConfigurationError):
            bi.CLIOutputParser(**k)


def test_sql_script():
    text = "-- note; here\nSELECT a FROM t WHERE x = 'a;b';\n\nWITH c AS (SELECT 1 FROM u) SELECT * FROM c JOIN s.v ON 1=1;\nINSERT INTO w (a) VALUES (1)"
    events = bi.SQLStatementParser().parse_text(text, C).events
    assert [e.attributes["message"] for e in events] == ["select t", "select u,s.v", "insert w"] and [e.line for e in events] == [2, 4, 5]
    with pytest.raises(ParseError):
        bi.SQLStatementParser().parse_text("GRANT x;", C)


PROSE = ["the night shift was told at once", "job=nightly-7 stage=copy rows=12", "ready", "skip", "phase: loading", "Accept: text/plain", "Sum (rounded)", "update the visitors about the new hall", "GAUGE queue: 3", '{"unit":"pump","mode":"idle"}', "Remark: the pump ran dry.", "2. Open the valve"]
CODE = [("import json", "python"), ("def drain(tank):\n    return tank.level('now')", "python"), ("function g(n) {\n  return n * 2;\n}", "javascript"), ("package tanks", "go"), ('fn run() {\n    println!("dry");\n}', "rust"), ("#include <math.h>", "c"), ("UPDATE plant.tanks SET level = 0 WHERE tank = 12;", "sql"), ("select level from tanks;", "sql"), ("return level", "python")]


def test_code_detection():
    d = RuleCodeDetector()
    assert [t for t in PROSE if d.detect(t)] == [] and [(t, d.detect(t)) for t, _ in CODE] == CODE


def kinds(parser, text, context=C):
    return [(e.event_type, e.line) for e in parser.parse_text(text, context).events]


def mixed():
    json = bi.JSONParser()
    return mx.MixedContentParser(routes=[(RegexPattern("ts", r"^\d{4}-\d\d-\d\dT\S+ (INFO|ERROR)"), bi.TimestampedLogParser()), (RegexPattern("json-line", r"^\s*[{\[]"), json)], fence_routes={"log": ApplicationLogParser(), "json": json})


INCIDENT = '2031-02-03T04:05:06+00:00 ERROR pump timeout\n{"unit": "pump",\r\n "mode": "idle }"}\nremark: valve opened\n```log\nconnection reset by pump 2\n```\ndef drain(tank):\n    return empty(tank)\n2031-02-03T04:09:06+00:00 INFO running\n'


def test_mixed_incident():
    parsed = mixed().parse_text(INCIDENT, C)
    assert [(e.event_type, e.line, e.parser_name) for e in parsed.events] == [
        ("log", 1, "timestamped-log"), ("json_record", 2, "json"), ("other", 4, None), ("fence", 5, None), ("connection_failure", 6, "application-log"),
        ("fence", 7, None), ("code", 8, None), ("code", 9, None), ("log", 10, "timestamped-log"),
    ]
    data = INCIDENT.encode()
    assert data[parsed.events[1].start : parsed.events[1].end].decode().endswith('}"}\n')
    assert parsed.statistics["code_fence"] == 2 and parsed.statistics["code_fence:log:connection_failure"] == 1 and parsed.statistics["ts:log"] == 2


@pytest.mark.parametrize("text,want", [
    ("~~~~js\nERROR in code\n~~~\n~~~~\nERROR real", [("fence", 1), ("code", 2), ("code", 3), ("fence", 4), ("log", 5)]),
    ('{"a": ]\ntext', [("unparsed", 1), ("other", 2)]),
    ('{"a": [\nERROR now', [("unparsed", 1), ("log", 2)]),
    ("```json\n{\"a\": 1}\n```\n```json\n{bad}\n```", [("fence", 1), ("json_record", 2), ("fence", 3), ("fence", 4), ("code", 5), ("fence", 6)]),
    ("```python\nx = 1", [("fence", 1), ("code", 2)]),
    ("@cached\ndef f():\n    pass\n\nSELECT a\nFROM t\nWHERE x = 1;", [("code", 1), ("code", 2), ("code", 3), ("other", 4), ("code", 5), ("code", 6), ("code", 7)]),
])
def test_mixed_cases(text, want):
    assert kinds(mixed(), text) == want


def test_mixed_levels_and_rules():
    e = mx.MixedContentParser().parse_text("  warn: slow  ", Context(source_offset=5)).events[0]
    assert e.attributes == {"level": "warn", "message": "slow", "text": "  warn: slow  "} and e.severity == "WARN" and e.start == 5
    assert kinds(mx.MixedContentParser([RegexPattern("m", "METRIC")]), "ERROR unknown\nMETRIC x") == [("other", 1), ("m", 2)]
    for bad in ([RegexPattern("code", "x")], [RegexPattern("a", "x"), RegexPattern("a", "y")]):
        with pytest.raises(ConfigurationError):
            mx.MixedContentParser(bad)
    assert not mx.MixedContentParser().capabilities.partitionable


def test_no_line_is_lost(spark):
    df = spark.createDataFrame([("s", INCIDENT), ("t", "x\n```\n\n```")], "source_id string, text string")
    events, lines = parse_documents(df, mixed()).events, frame_lines(df)
    assert uncovered_lines(lines, events).count() == 0 and covered_lines(lines, events).count() == lines.count() == 14


def test_phrases_have_single_spaces():
    parser = ApplicationLogParser()
    found = lambda text: [e.event_type for e in parser.parse_text(text, C).events]
    for text in ("service  down", "out\tof  memory", "attempt   3", "permission denied", "timed  out"):
        assert found(text) == []
    assert found("Service Down, oom at attempt 3") == ["service_down", "oom", "retry"]


@pytest.mark.parametrize("text", ["ValueError:x", "Traceback ValueError", 'File "a.py", line 3', "a b"])
def test_lines_that_name_no_exception(text):
    with pytest.raises(ParseError):
        bi.PythonTracebackParser().parse_text(text, C)


def test_frames_are_whole(spark):
    text = '  File "a "b".py", line 3, in f\n  File "c.py", line 4\nKeyError\n'
    e = bi.PythonTracebackParser().parse_text(text, C).events[0]
    assert e.attributes == {"exception_type": "KeyError", "message": "", "frames": [{"file": 'a "b".py', "line": 3, "function": "f"}]} and e.line == 1
    (r,) = bi.traceback_frames(frame_lines(spark.createDataFrame([("s", text)], "source_id string, text string"))).collect()
    assert (r.exception_type, r.message, [(f.file, f.line, f.function) for f in r.frames]) == ("KeyError", "", [('a "b".py', 3, "f")])
