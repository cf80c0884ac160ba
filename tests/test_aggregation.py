import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.errors import AggregationError
from tracewright.functions.sizes import approximate_tokens, compression
from tracewright.operators import counts as ct
from tracewright.operators import evidence as ev
from tracewright.operators.builtin import FunctionParser, TimestampedLogParser
from tracewright.operators.parsing import Context, Event, Parsed, Parser, parse_documents
from tracewright.operators.patterns import ApplicationLogParser

TEXTS = {"a": "2026-10-01T08:00:00+00:00 ERROR x\n2026-10-01T10:00:00+02:00 ERROR x\n2026-10-01T09:00:00+00:00 INFO y\n2026-10-01T09:00:00+00:00 ERROR x", "b": "2026-10-01T08:00:00Z INFO z"}


def docs(spark, texts=TEXTS):
    return spark.createDataFrame(list(texts.items()), "source_id string, text string")


def parsed(spark, texts=TEXTS, parser=None):
    return parse_documents(docs(spark, texts), parser or TimestampedLogParser()).events.cache()


def test_evidence_against_brute_force(spark):
    events = parsed(spark)
    rows = {r.source_id: r for r in ev.aggregate_evidence(events).collect()}
    a = rows["a"]
    assert (a["count"], a.first_seen, a.last_seen) == (4, "2026-10-01T08:00:00+00:00", "2026-10-01T09:00:00+00:00")
    assert [(g.pattern, g.severity, [(e.message_json, e.occurrences, e.positions) for e in g.evidence]) for g in a.groups] == [("log", "ERROR", [('"x"', 3, [1, 2, 4])]), ("log", "INFO", [('"y"', 1, [3])])]
    canon = [r.canonical for r in events.where("source_id = 'a'").orderBy("seq").collect()]
    assert a.events_sha256 == hashlib.sha256("".join(c + "\n" for c in canon).encode()).hexdigest()
    record = json.loads(canon[1])
    assert record["timestamp"] == "2026-10-01T10:00:00+02:00" and list(record) == sorted(record) and record["evidence"]["line_number"] == 2
    assert {r.source_id: r.n for r in ev.aggregate_evidence(events).select("source_id", ev.occurrences(F.col("groups")).alias("n")).collect()} == {"a": 4, "b": 1}


def test_rebuild_and_tampering(spark):
    stored = ev.aggregate_evidence(parsed(spark)).cache()
    assert ev.rebuild(stored, parsed(spark)).count() == 5
    for bad in ({**TEXTS, "b": "2026-10-01T08:00:00Z INFO q"}, {"a": TEXTS["a"]}, {**TEXTS, "c": TEXTS["b"]}, {**TEXTS, "a": TEXTS["a"] + "\n"}):
        with pytest.raises(AggregationError):
            ev.rebuild(stored, parsed(spark, bad))
    with pytest.raises(AggregationError):
        ev.rebuild(stored.union(stored), parsed(spark))
    with pytest.raises(Exception, match="CapabilityError"):
        ev.merge_evidence(stored, stored).collect()
    assert ev.merge_evidence(stored.where("source_id = 'a'"), stored.where("source_id = 'b'")).count() == 2
    assert ev.rebuild(stored.limit(0), parsed(spark).limit(0)).count() == 0


def test_retained_events(spark):
    events = parsed(spark)
    kept = ev.aggregate_evidence(events, reproducible=False).cache()
    got = ev.retained_events(kept)
    assert sorted(r.canonical for r in got.collect()) == sorted(r.canonical for r in events.collect())
    with pytest.raises(AggregationError):
        ev.retained_events(kept.withColumn("events_sha256", F.lit("0")))
    routed = ev.route_evidence(events, retained={"timestamped-log"})
    assert routed.where(ev.retains_events(F.col("groups"))).count() == routed.count() == 2
    assert ev.route_evidence(events, retained={"other"}).where(ev.retains_events(F.col("groups"))).count() == 0


def test_order_faults(spark):
    class Back(Parser):
        name = "back"

        def parse_text(self, text, context):
            return Parsed([Event("x", line=2), Event("x"), Event("x", line=1), Event("x", line=3, parser_version="9")])

    assert sorted(r.fault for r in ev.order_faults(parsed(spark, {"s": ""}, Back())).collect()) == ["a parser has two versions", "events go back a line"]
    assert ev.order_faults(parsed(spark)).count() == 0


def test_message_identity(spark):
    def events(text, context):
        return [Event("t", a) for a in ({"message": "m"}, {"message": 5}, {"k": 1}, {}, {"message": "null"}, {"message": '{"k":1}'})]

    got = ev.entries(ev.aggregate_evidence(parsed(spark, {"s": ""}, FunctionParser("f", events)))).orderBy("entry_no").collect()
    assert [r.message_json for r in got] == ['"m"', '{"message":5}', '{"k":1}', "null", '"null"', '"{\\"k\\":1}"'] and all(r.positions == [None] for r in got)


def test_line_endings_do_not_move_positions(spark):
    for end in ("\n", "\r\n", "\r", "\u2028"):
        text = end.join(["ERROR x", "ERROR x", "", "ERROR x"])
        got = ev.entries(ev.aggregate_evidence(parsed(spark, {"s": text}, ApplicationLogParser()))).collect()
        assert [r.positions for r in got] == [[1, 2, 4]]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.sampled_from([{"k": True}, {"k": 1}, {"k": 1.0}, {"k": "1"}, {}, {"k": None}, {"k": {"b": 1, "a": 2}}]), min_size=1, max_size=20))
def test_counts_keep_json_types_apart(spark, attributes):
    df = docs(spark, {str(i): json.dumps(a) for i, a in enumerate(attributes)})
    events = parse_documents(df, FunctionParser("f", lambda t, c: [Event("e", json.loads(t))])).events
    got = {r.key_attributes_json: r["count"] for r in ct.count_events(events, ["k"]).collect()}
    want: dict = {}
    for a in attributes:
        key = json.dumps({"k": a.get("k")}, sort_keys=True, separators=(",", ":"))
        want[key] = want.get(key, 0) + 1
    assert got == want


def test_counts_merge_in_any_order(spark):
    events = parsed(spark)
    whole = {tuple(r) for r in ct.count_events(events, ["level"]).collect()}
    a, b = (ct.count_events(events.where(w), ["level"]) for w in ("source_id = 'a'", "source_id = 'b'"))
    assert {tuple(r) for r in ct.merge_counts(a, b).collect()} == {tuple(r) for r in ct.merge_counts(b, a).collect()} == whole
    acc = ct.CountAccumulator()
    for w in ("source_id = 'b'", "source_id = 'a'"):
        acc.add(events.where(w), ["level"])
    assert {tuple(r) for r in acc.result().collect()} == whole
    info = next(r for r in ct.count_events(events, ["level"]).collect() if "INFO" in r.key_attributes_json)
    assert (info["count"], info.first_seen, info.last_seen) == (2, "2026-10-01T08:00:00+00:00", "2026-10-01T09:00:00+00:00")


def test_facts_and_severities(spark):
    stored = ev.aggregate_evidence(parsed(spark)).cache()
    twice = ev.facts(stored.union(stored)).where("message_json = '\"x\"'").first()
    assert (twice.occurrences, twice.positions) == (6, [1, 1, 2, 2, 4, 4])
    assert {r.severity: r.occurrences for r in ev.severity_inventory(stored).collect()} == {"ERROR": 3, "INFO": 2}


def test_compression(spark):
    df = spark.createDataFrame([("abcdé" * 4, "x"), ("", "abc"), (None, "x")], "a string, b string")
    r = df.select(compression(F.col("a"), F.col("b")).alias("m"), approximate_tokens()(F.col("a")).alias("t")).collect()
    assert (r[0].m.input_bytes, r[0].m.saved_bytes, r[0].t, r[0].m.saved_tokens) == (24, 23, 6, 5)
    assert r[1].m.saved_bytes == -3 and r[1].m.saved_bytes_percent is None and r[2].m.input_bytes is None
    assert Context().base == 0


def test_aggregators_keep_their_contract_and_are_routed_to(spark):
    from tracewright.errors import CapabilityError, ConfigurationError
    from tracewright.operators import aggregators as ag
    from tracewright.operators.builtin import TimestampedLogParser
    from tracewright.operators.parsing import parse_documents
    from tracewright.operators.patterns import ApplicationLogParser
    from tracewright.plans.contracts import check_aggregator

    docs = spark.createDataFrame([(f"s{i}", f"2031-02-03T04:05:0{i}+00:00 ERROR pump timeout\n2031-02-03T04:05:0{i}+00:00 INFO on") for i in range(3)], "source_id string, text string")
    logs, signals = (parse_documents(docs, p).events.cache() for p in (TimestampedLogParser(), ApplicationLogParser()))
    for a in (ag.CountAggregator(["level"]), ag.EvidenceAggregator(), ag.EvidenceAggregator(False)):
        check_aggregator(a, logs)
    routing = ag.RoutingAggregator(ag.EvidenceAggregator(), {"timestamped-log": ag.EvidenceAggregator(False)})
    both = logs.unionByName(signals)
    kept = routing.aggregate(both)
    assert routing.lossless and routing.requires_source and {r: t.select("parser_name").distinct().collect()[0][0] for r, t in kept.items()} == {None: "application-log", "timestamped-log": "timestamped-log"}
    texts = lambda df: sorted(r.canonical for r in df.select("canonical").collect())
    assert texts(routing.materialize(kept, both)) == texts(both)
    for wrong in (lambda: routing.materialize(kept), lambda: ag.CountAggregator().materialize(logs)):
        with pytest.raises(CapabilityError):
            wrong()
    with pytest.raises(ConfigurationError):
        ag.RoutingAggregator(ag.CountAggregator(), {"x": "count"})
