import json

import pytest
from pyspark.sql import functions as F

from tracewright import streaming
from tracewright.errors import CapabilityError, CodecError, ConfigurationError, ReviewError
from tracewright.functions.sizes import approximate_tokens
from tracewright.functions.strict_json import compact, loads
from tracewright.operators import builtin as bi
from tracewright.operators import evidence as ev
from tracewright.operators.code_detection import RuleCodeDetector
from tracewright.operators.parsing import Event, Parsed
from tracewright.operators.patterns import ApplicationLogParser, RegexPattern
from tracewright.plans import codecs, contracts, review
from tracewright.plans.capabilities import Capabilities
from tracewright.plans.engine import Engine
from tracewright.plans.observability import CompositeSink, LoggingSink, MemorySink, Sink, observed
from tracewright.plans.registry import ParserRegistry
from tracewright.sources.partitions import LinePartitioner

LOG = "2026-10-01T08:00:00+00:00 ERROR db timeout\n2026-10-01T08:00:01+00:00 INFO ok\n2026-10-01T08:00:02+00:00 ERROR db timeout"


@pytest.fixture
def engine(spark):
    return Engine(spark, sink=MemorySink())


def test_engine_round_trip(engine):
    docs = engine.inputs([("a", LOG), ("b", LOG + "\n")])
    stored = engine.aggregate("timestamped-log", engine.parse("timestamped-log", docs).events)
    text = engine.serialize(stored).cache()
    assert json.loads(text.first().document)["format"] == codecs.FORMAT
    again = engine.deserialize(text)
    assert ev.differences(stored, again).count() == 0
    assert engine.materialize("timestamped-log", again, docs).count() == 6
    with pytest.raises(CapabilityError):
        engine.materialize("timestamped-log", again)
    assert {"ParserSelected", "ParseStarted", "ParseCompleted", "AggregationCompleted", "MaterializeFailed"} <= {e.name for e in engine.sink.events}
    assert engine.merge(stored.where("source_id = 'a'"), stored.where("source_id = 'b'")).count() == 2
    assert engine.count(engine.parse_one("application-log", "timeout\ntimeout").events).first()["count"] == 2


def test_engine_inputs_keep_order_and_errors(engine):
    got = list(engine.parse_iter("application-log", [("x", "timeout"), ("y", b"\xff"), ("z", "ok")], continue_on_error=True))
    assert [r.source_id for r in got] == ["x", "y", "z"] and got[1].errors[0].input_index == 1
    parts = engine.parse_partitions("application-log", engine.inputs([("s", "timeout\n" * 30)]).select("source_id", F.col("content").cast("string").alias("text")), LinePartitioner(max_lines=7))
    assert sorted(r.n for r in parts.select(F.col("evidence.line_number").alias("n")).collect()) == list(range(1, 31))
    assert engine.parse_lines("application-log", engine.inputs([("s", "timeout")])).count() == 1


def test_parsers_that_are_not_reproducible_retain(engine):
    class Model(bi.SemanticParser):
        name = "model"

        async def parse_async(self, text, context):
            return Parsed([Event("said", {"message": self.model + text}, line=1)])

    parser = Model("m")
    stored = engine.aggregate(parser, engine.parse(parser, engine.inputs([("a", "x")])).events).cache()
    assert json.loads(engine.materialize(parser, stored).first().canonical)["attributes"] == {"message": "mx"}
    assert ev.differences(stored, engine.deserialize(engine.serialize(stored))).count() == 0
    with pytest.raises(CapabilityError):
        engine.aggregate(bi.FunctionParser("f", lambda t, c: [], capabilities=Capabilities()), engine.parse(parser, engine.inputs([])).events)


def test_result_documents(engine, tmp_path):
    docs = codecs.result_documents(engine.parse("json", engine.inputs([("a", '{"k": 1}'), ("b", "{bad"), ("c", "")]))).cache()
    decoded = {r.source_id: codecs.decode_result(r.document) for r in docs.collect()}
    assert decoded["a"]["events"][0]["attributes"] == {"value": {"k": 1}} and decoded["b"]["errors"][0]["error_type"] == "ParseError"
    codecs.write_ndjson(docs, str(tmp_path / "out"))
    assert engine.spark.read.text(str(tmp_path / "out")).count() == 3
    for bad in ("{}", "[", docs.first().document.replace('"warnings"', '"w"')):
        with pytest.raises(CodecError):
            codecs.decode_result(bad)


def test_result_documents_read_their_rows_once_and_join_nothing(engine):
    """A join's smaller side may be broadcast by the driver, and inputs parsed again may be numbered otherwise."""
    inputs = engine.spark.createDataFrame([(7, "a", b'{"k": 1}\n{"k": "\xc3\xa9"}'), (7, "b", b"[2.50, 1e3]"), (8, "b", b""), (None, "c", b"3")], "input_index long, source_id string, content binary")
    parsing = engine.parse("json", inputs)
    made = codecs.result_documents(parsing)
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    events = {}
    for r in sorted(parsing.events.collect(), key=lambda r: r.seq):
        events.setdefault((r.source_id, r.input_index), []).append(json.loads(r.canonical))
    got = {(r.source_id, r.input_index): r.document for r in made.collect()}
    assert made.count() == len(got) == 4 and set(got) == {("a", 7), ("b", 7), ("b", 8), ("c", None)}
    for key, document in got.items():
        decoded = codecs.decode_result(document)
        assert decoded["events"] == events.get(key, []) and document == compact(decoded)
    assert events["c", None] and len(events["b", 7]) == 1


def test_aggregate_codec_rejects(engine):
    good = engine.serialize(engine.aggregate("timestamped-log", engine.parse("timestamped-log", engine.inputs([("a", LOG)])).events)).first().document
    codec = codecs.EvidenceCodec()
    assert codec.encode(codec.decode(good)) == good and json.loads(codec.encode(codec.decode(good), 2)) == json.loads(good)
    for old, new in (('"count":3', '"count":4'), ('"positions":[1,3]', '"positions":[1]'), (codecs.FORMAT, "x/1"), ('"severity"', '"sev"')):
        assert old in good
        with pytest.raises(CodecError):
            codec.decode(good.replace(old, new))
    with pytest.raises(CodecError):
        codec.encode([{"count": 1}])


def test_contracts(spark, engine):
    contracts.check_parser(ApplicationLogParser(), ["timeout\nretry", "", "é\r\n"])
    contracts.check_pattern(RegexPattern("r", "x+"), ["axx"], ["b", 1])
    contracts.check_aggregation(spark, ApplicationLogParser(), ["timeout retry\ntimeout", ""])
    contracts.check_codec(codecs.EvidenceCodec(), engine.aggregate("timestamped-log", engine.parse("timestamped-log", engine.inputs([("a", LOG)])).events))
    contracts.check_json_codec(compact, loads)
    contracts.check_partitioner(spark, LinePartitioner(max_lines=2), "a\r\né\n\nb")
    contracts.check_registry(ParserRegistry(), ApplicationLogParser(), bi.JSONParser())
    contracts.check_tokenizer(spark, approximate_tokens())
    contracts.check_detector(RuleCodeDetector(), [("import os", "python")], ["done"])
    contracts.check_backend(bi.BuiltinBackend(), "kv", "a=1", 1)
    for s in (Sink(), MemorySink(), LoggingSink(), CompositeSink(MemorySink())):
        contracts.check_sink(s)

    class Unstable(bi.FunctionParser):
        calls = 0

        def parse_text(self, text, context):
            type(self).calls += 1
            return Parsed([Event(f"e{self.calls}")])

    for broken in (lambda: contracts.check_parser(Unstable("u", None), ["x"]), lambda: contracts.check_json_codec(json.dumps, json.loads), lambda: contracts.check_pattern(RegexPattern("r", "x"), ["y"], [])):
        with pytest.raises(AssertionError):
            broken()
    assert contracts.valid_json("[]") and not contracts.valid_json("[1,]")
    assert codecs.json_codec(compact, loads) and engine.registry.metadata("json").parser_type == "JSONParser" and engine.registry.discover("none.such") == []
    with pytest.raises(ConfigurationError):
        engine.registry.get("none")


def test_sinks_never_raise():
    class Bad(Sink):
        def emit(self, event):
            raise OSError

    memory = MemorySink()
    from tracewright.plans.observability import tell

    tell(CompositeSink(Bad(), memory), "X")
    tell(Bad(), "X")
    assert [e.name for e in memory.events] == ["X"]


def test_observed_counts(engine):
    rows, seen = observed(engine.parse("json", engine.inputs([("a", "1"), ("b", "{")])).rows)
    rows.count()
    rows.collect()
    assert seen.get["events"] == 2 and seen.get["results"] == 2 and seen.get["errors"] == 1


FACTS = [review.Fact("e0", "s", "log", "ERROR", "db timeout 30", 2, (1, 3)), review.Fact("e1", "s", "log", "INFO", "ok", 1, (2,)), review.Fact("e2", "s", "fence", None, "```", 1, (4,))]


def draft(*claims):
    return json.dumps({"claims": [dict(zip(("text", "evidence_ids", "occurrences", "context_ids"), c, strict=False)) for c in claims]})


@pytest.mark.parametrize("text,told", [
    (draft(("Timeouts after 30", ["e0"], 2)), None), ("{", "form"), (draft(("x", ["e9"], 2)), "unknown"), (draft(("x", ["e0"], 3)), "occurrences"), (draft((" ", ["e0"], 2)), "no text"),
    (draft(("at 08:00", ["e0"], 2)), "times"), (draft(("7 errors", ["e0"], 2)), "number"), (draft(("ok", ["e1"], 1)), "not cited"), (draft(("x", ["e0"], 2), ("y", ["e0"], 2)), "another claim"),
    (draft(("x", ["e0", "e0"], 4)), "twice"), (draft(("x", ["e0"], 2, ["e2"])), "fence"),
])
def test_claim_checks(text, told):
    _, issues = review.check_claims(text, FACTS)
    assert not issues if told is None else any(told in i for i in issues)


def test_summaries(engine):
    aggregates = engine.aggregate("timestamped-log", engine.parse("timestamped-log", engine.inputs([("a", LOG)])).events)

    class Model(review.LanguageModel):
        answers = ["{", draft(("The database timed out", ["e0"], 2))]

        def complete(self, messages):
            return self.answers[min(len(messages) - 2, 1)]

    contracts.check_model(Model())
    s = review.EvidenceSummarizer(Model(), lambda d, f: []).summarize(aggregates)
    assert (s.calls, s.batches) == (2, 1) and "The database timed out (2x; a: lines 1, 3)" in s.text and "Source record. ok" in s.text and "Order of findings" in s.text
    with pytest.raises(ReviewError):
        review.EvidenceSummarizer(Model(), max_revisions=0).summarize(aggregates)
    assert review.with_summary(engine.parse_one("json", "1").results, s).first().llm_result == s.text


def test_claim_faults_as_joins(spark):
    claims = spark.createDataFrame([(1, "e0"), (2, "e0"), (2, "e9")], "claim int, evidence_id string")
    facts = spark.createDataFrame([("e0", "ERROR", "log"), ("e1", "warn", "log"), ("e2", "ERROR", "fence")], "id string, severity string, event_type string")
    assert sorted(map(tuple, review.claim_faults(claims, facts).collect())) == [("counted twice", "e0"), ("not cited", "e1"), ("unknown", "e9")]


def test_streams_equal_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(4):
        (src / f"{i}.log").write_text("timeout\nretry\nok\n" * (i + 1))
    events = streaming.parse_stream(streaming.document_stream(spark, str(src), max_files=2), ApplicationLogParser())
    streaming.write_batches(events, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    q = streaming.running_counts(events).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.event_type: r["count"] for r in spark.table("running").collect()} == {"timeout": 10, "retry": 10}


def test_ordered_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"source_id": "s", "line_number": n, "text": t}) for n, t in ((3, "end"), (1, "begin"), (2, "x"))))

    def step(state, line):
        return ("open", []) if line == "begin" else ("", ["closed"] if state == "open" else []) if line == "end" else (state, [])

    lines = spark.readStream.schema("source_id string, line_number long, text string").json(str(src))
    q = streaming.ordered_parse(lines, step).writeStream.format("memory").queryName("ordered").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("ordered").collect()] == [("s", 3, "closed")]
