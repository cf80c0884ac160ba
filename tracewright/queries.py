"""Registered queries over the test tables, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.sizes import approximate_tokens, compression
from tracewright.operators import aggregators, counts, evidence, spans
from tracewright.operators.builtin import LEVELS, CLIOutputParser, JSONParser, PythonTracebackParser, SQLStatementParser, TimestampedLogParser, traceback_frames
from tracewright.operators.mixed import MixedContentParser
from tracewright.operators.parsing import canonicalize, parse_documents
from tracewright.operators.patterns import ApplicationLogParser, ExactPattern, PatternParser, PredicatePattern, RegexPattern, StructuredPattern, pattern_statistics
from tracewright.plans import codecs
from tracewright.plans.review import claim_faults
from tracewright.sources.lines import frame_lines, frame_lines_native, line_widths
from tracewright.sources.partitions import LinePartitioner, rebase

FAILURES = ["database timeout", "connection refused", "authentication failed", "service unavailable", "out of memory", "permission denied"]
#: Lines of one source; a longer history of a user group becomes further sources, so no text grows with the data.
SPAN = 2000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source_id"), "text")


def log_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Log documents made of the events: one line an event, in event order."""
    e = table(spark, sf, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").when(F.col("event_type") == "view", "DEBUG").otherwise("INFO")
    failure = F.element_at(F.array(*map(F.lit, FAILURES)), (F.col("event_id") % 6 + 1).cast("int"))
    said = F.when(F.col("event_type") == "error", failure).when(F.col("event_type") == "signup", "retrying signup").otherwise(F.concat("event_type", F.lit(" ok")))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00 "), level, F.lit(" user "), F.col("user_id").cast("string"), F.lit(" "), said)
    source = F.concat((F.col("user_id") % 50).cast("string"), F.lit("-"), F.expr(f"event_id div {SPAN}").cast("string"))
    rows = e.select(source.alias("source_id"), F.struct("event_id", line.alias("line")).alias("x"))
    return rows.groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_list("x")).getField("line"), "\n").alias("text"))


def flat(events: DataFrame) -> DataFrame:
    e = "evidence"
    return events.select("source_id", F.col(f"{e}.line_number").alias("line_number"), F.col(f"{e}.start_offset").alias("start_offset"), F.col(f"{e}.end_offset").alias("end_offset"), "event_type", F.get_json_object("attributes_json", "$.message").alias("message"), "severity")


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return ApplicationLogParser().native(frame_lines(log_corpus(spark, sf)))


def logs(spark: SparkSession, sf: str) -> DataFrame:
    return parse_documents(log_corpus(spark, sf), TimestampedLogParser()).events


def stored(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.aggregate_evidence(canonicalize(signals(spark, sf)))


# -- SQL pieces ------------------------------------------------------------------------------

_T = r"\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}"


def _sql_lines(rows: str) -> str:
    """CTE ``ln`` of the lines of ``rows`` (source_id, text)."""
    return f"""parts AS (SELECT source_id, unnest(p) AS part, generate_subscripts(p, 1) AS line_number FROM (SELECT source_id, regexp_extract_all(text, '[^{_T}]*(?:\\r\\n|[{_T}])|[^{_T}]+') AS p FROM ({rows}))),
ln AS (SELECT source_id, line_number::BIGINT AS line_number, regexp_replace(part, '(\\r\\n|[{_T}])$', '') AS text,
  (sum(strlen(part)) OVER w - strlen(part))::BIGINT AS start_offset, (sum(strlen(part)) OVER w)::BIGINT AS end_offset FROM parts WINDOW w AS (PARTITION BY source_id ORDER BY line_number))"""


DOCS = "SELECT doc_id::VARCHAR AS source_id, text FROM documents"
_FAILURES = "[" + ", ".join(f"'{f}'" for f in FAILURES) + "]"
LOG = f"""ev AS (SELECT concat((user_id % 50)::VARCHAR, '-', (event_id // {SPAN})::VARCHAR) AS source_id, event_id, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
  'user ' || user_id::VARCHAR || ' ' || CASE event_type WHEN 'error' THEN {_FAILURES}[event_id % 6 + 1] WHEN 'signup' THEN 'retrying signup' ELSE event_type || ' ok' END AS said FROM events),
nr AS (SELECT *, iso || ' ' || level || ' ' || said AS text, row_number() OVER (PARTITION BY source_id ORDER BY event_id) AS line_number, count(*) OVER (PARTITION BY source_id) AS n FROM ev),
wd AS (SELECT *, strlen(text) + CASE WHEN line_number < n THEN 1 ELSE 0 END AS w FROM nr),
lg AS (SELECT source_id, line_number::BIGINT AS line_number, text, level, said, iso, ts, (sum(w) OVER o - w)::BIGINT AS start_offset, (sum(w) OVER o)::BIGINT AS end_offset FROM wd WINDOW o AS (PARTITION BY source_id ORDER BY line_number))"""
#: Written out, not taken from the operator, so that the comparison can tell a wrong phrase.
_SIGNALS = r"""('service_down', '(?i)\b(?:service down|service stopped|unavailable)\b', 20, 'ERROR'),
  ('connection_failure', '(?i)\b(?:connection refused|connection reset|connect failed)\b', 20, 'ERROR'),
  ('authentication_failure', '(?i)\b(?:authentication failed|invalid credentials|login failed)\b', 20, 'ERROR'),
  ('authorization_failure', '(?i)\b(?:authorization failed|permission denied|forbidden)\b', 20, 'ERROR'),
  ('timeout', '(?i)\b(?:timeout|timed out)\b', 15, 'ERROR'), ('oom', '(?i)\b(?:oom|out of memory)\b', 15, 'CRITICAL'), ('retry', '(?i)\b(?:retry|retrying|attempt [0-9]+)\b', 10, NULL)"""
SIG = f"""{LOG}, sg(name, re, priority, severity) AS (VALUES {_SIGNALS}, ('error', '(?i)\\bERROR\\b', 5, 'ERROR'), ('warning', '(?i)\\bWARN(?:ING)?\\b', 5, 'WARNING')),
hit AS (SELECT lg.*, name, priority, severity, CASE name WHEN 'error' THEN regexp_extract(text, '(?i)\\bERROR\\b[: ]?\\s*(.*)', 1) WHEN 'warning' THEN regexp_extract(text, '(?i)\\bWARN(?:ING)?\\b[: ]?\\s*(.*)', 1) ELSE text END AS message
  FROM lg JOIN sg ON regexp_matches(text, re)),
canon AS (SELECT *, concat('{{"attributes":{{"message":"', message, '"}},"confidence":null,"event_type":"', name, '","evidence":{{"correlation_id":null,"end_offset":', end_offset, ',"line_number":', line_number,
  ',"parser_name":"application-log","parser_version":"1","partition_id":null,"pattern_name":"', name, '","source_id":"', source_id, '","start_offset":', start_offset, '}},"schema_version":"1","severity":',
  CASE WHEN severity IS NULL THEN 'null' ELSE '"' || severity || '"' END, ',"timestamp":null}}') AS c FROM hit)"""
ENTRIES = f"{SIG}, en AS (SELECT source_id, name AS event_type, severity, '\"' || message || '\"' AS message_json, count(*)::BIGINT AS occurrences, string_agg(line_number::VARCHAR, ',' ORDER BY line_number) AS positions FROM hit GROUP BY 1, 2, 3, 4)"

# -- Queries ---------------------------------------------------------------------------------

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


@query(f"WITH {_sql_lines(DOCS)} SELECT * FROM ln")
def frame_lines_query(spark, sf):
    return frame_lines(texts(spark, sf))


@query(f"WITH {_sql_lines('SELECT page_id::VARCHAR AS source_id, html AS text FROM pages')} SELECT source_id, line_number, start_offset, end_offset FROM ln")
def frame_lines_catalyst(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("source_id"), F.col("html").alias("text"))
    return frame_lines_native(pages).select("source_id", "line_number", "start_offset", "end_offset")


@query(f"WITH {_sql_lines(DOCS)} SELECT source_id, count(*)::BIGINT AS n_lines, sum(end_offset - start_offset)::BIGINT AS n_bytes, max(end_offset - start_offset)::BIGINT AS widest FROM ln GROUP BY 1")
def line_byte_spans(spark, sf):
    w = line_widths(frame_lines(texts(spark, sf)))
    return w.groupBy("source_id").agg(F.count("*").alias("n_lines"), F.sum("width").alias("n_bytes"), F.max("width").alias("widest"))


@query(f"WITH {LOG} SELECT source_id, line_number, regexp_extract(text, 'user ([0-9]+) ', 1) AS user_id, regexp_extract(text, 'user [0-9]+ (.*) ok', 1) AS action FROM lg WHERE regexp_matches(text, 'user ([0-9]+) (.*) ok')")
def regex_pattern(spark, sf):
    events = parse_documents(log_corpus(spark, sf), PatternParser([RegexPattern("user", r"user (?P<user>\d+) (?P<action>.*) ok")])).events
    return events.select("source_id", F.col("evidence.line_number").alias("line_number"), F.get_json_object("attributes_json", "$.user").alias("user_id"), F.get_json_object("attributes_json", "$.action").alias("action"))


@query("SELECT event_id::VARCHAR AS source_id, 1::BIGINT AS line_number, 'ERROR' AS severity FROM events WHERE event_type = 'error'")
def exact_pattern(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("source_id"), F.col("event_type").alias("text"))
    return PatternParser([ExactPattern("failed", "error", {"k": 1}, severity="ERROR")]).native(frame_lines(e)).select("source_id", F.col("evidence.line_number").alias("line_number"), "severity")


@query("SELECT event_type, count(*)::BIGINT AS n FROM events WHERE length(event_type) > 4 GROUP BY 1")
def predicate_pattern(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("source_id"), F.col("event_type").alias("text"))
    events = parse_documents(e, PatternParser([PredicatePattern("long", lambda v: len(v) > 4, lambda v: {"message": v})])).events
    return events.groupBy(F.get_json_object("attributes_json", "$.message").alias("event_type")).agg(F.count("*").alias("n"))


@query("SELECT event_id::VARCHAR AS source_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE json_extract(props, '$.k')::BIGINT % 2 = 0")
def structured_pattern(spark, sf):
    import json

    pattern = StructuredPattern("even", lambda v: v.get("k", 1) % 2 == 0)
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("source_id"), F.col("props").alias("text"))
    as_value = PredicatePattern("even", lambda v: pattern.match(json.loads(v)) is not None, lambda v: json.loads(v))
    return parse_documents(e, PatternParser([as_value])).events.select("source_id", F.get_json_object("attributes_json", "$.k").cast("bigint").alias("k"))


@query(f"WITH {LOG} SELECT source_id, line_number, CASE WHEN contains(text, 'ERROR') THEN 'high' ELSE 'user' END AS event_type FROM lg")
def first_match_only(spark, sf):
    parser = PatternParser([RegexPattern("user", "user"), RegexPattern("high", "ERROR", priority=5)], first_match_only=True)
    return parser.native(frame_lines(log_corpus(spark, sf))).select("source_id", F.col("evidence.line_number").alias("line_number"), "event_type")


@query(f"WITH {SIG}, pn AS (SELECT DISTINCT source_id, p FROM lg, (SELECT name AS p FROM sg UNION ALL SELECT 'stack_trace')) SELECT pn.source_id, p AS pattern_name, count(name)::BIGINT AS matches FROM pn LEFT JOIN hit ON hit.source_id = pn.source_id AND name = p GROUP BY 1, 2")
def pattern_statistics_query(spark, sf):
    docs = log_corpus(spark, sf)
    return pattern_statistics(ApplicationLogParser().native(frame_lines(docs)), docs, [p.name for p in ApplicationLogParser().patterns])


@query(f"WITH {SIG} SELECT source_id, line_number, start_offset, end_offset, name AS event_type, message, severity FROM hit")
def app_log_events(spark, sf):
    return flat(signals(spark, sf))


@query("""SELECT event_id::VARCHAR AS source_id, CASE event_id % 8 WHEN 0 THEN 'service_down' WHEN 1 THEN 'oom' WHEN 2 THEN 'retry' END AS event_type,
  CASE event_id % 8 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'CRITICAL' END AS severity FROM events WHERE event_id % 8 < 3""")
def signal_phrases(spark, sf):
    """Phrases with other blanks than one space between their words are none."""
    said = ["service down", "out of memory", "attempt 3", "service  down", "out\tof  memory", "attempt   3", "permission\u00a0denied", "retried"]
    e = table(spark, sf, "events")
    docs = e.select(F.col("event_id").cast("string").alias("source_id"), F.element_at(F.array(*map(F.lit, said)), (F.col("event_id") % 8 + 1).cast("int")).alias("text"))
    return parse_documents(docs, ApplicationLogParser()).events.select("source_id", "event_type", "severity")


@query(f"WITH {SIG} SELECT name AS event_type, '{{}}' AS key_attributes_json, count(*)::BIGINT AS \"count\" FROM hit GROUP BY 1")
def app_log_counts(spark, sf):
    return counts.count_events(signals(spark, sf)).select("event_type", "key_attributes_json", "count")


@query(f"WITH {LOG} SELECT 'log' AS event_type, concat('{{\"level\":\"', level, '\"}}') AS key_attributes_json, count(*)::BIGINT AS \"count\", epoch_us(min(ts))::BIGINT AS first_us, epoch_us(max(ts))::BIGINT AS last_us FROM lg GROUP BY level")
def count_merge(spark, sf):
    events = logs(spark, sf)
    halves = [counts.count_events(events.where(F.pmod(F.xxhash64("source_id"), F.lit(2)) == k), ["level"]) for k in (0, 1)]
    return counts.merge_counts(*halves).select("event_type", "key_attributes_json", "count", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


@query(f"WITH {LOG} SELECT source_id, line_number, start_offset, end_offset, level AS severity, said AS message, epoch_us(ts)::BIGINT AS us FROM lg")
def timestamped_log(spark, sf):
    return flat(logs(spark, sf).withColumn("event_type", F.unix_micros("ts"))).withColumnRenamed("event_type", "us")


@query("SELECT event_id::VARCHAR AS source_id, props AS text, 1::BIGINT AS line_number, strlen(props)::BIGINT AS end_offset, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_records(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("source_id"), F.col("props").alias("text"))
    parsed = parse_documents(e, JSONParser()).events.select(F.col("source_id").alias("s"), F.col("evidence.line_number").alias("line_number"), F.col("evidence.end_offset").alias("end_offset"), F.get_json_object("attributes_json", "$.value.k").cast("bigint").alias("k"))
    return e.join(parsed, e["source_id"] == parsed["s"]).drop("s")


@query("SELECT event_id::VARCHAR AS source_id, 'ValueError' AS exception_type, event_type AS message, 2::BIGINT AS n_frames, (user_id % 100)::BIGINT AS last_line FROM events WHERE event_type = 'error'")
def traceback_frames_query(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'")
    text = F.concat(F.lit('Traceback (most recent call last):\n  File "a.py", line 3, in main\n    run()\n  File "b.py", line '), (F.col("user_id") % 100).cast("string"), F.lit(", in run\n    raise ValueError(x)\nValueError: "), F.col("event_type"))
    docs = e.select(F.col("event_id").cast("string").alias("source_id"), text.alias("text"))
    return traceback_frames(frame_lines(docs)).select("source_id", "exception_type", "message", F.size("frames").cast("bigint").alias("n_frames"), F.element_at("frames", -1).getField("line").cast("bigint").alias("last_line"))


@query("""SELECT event_id::VARCHAR AS source_id, 'KeyError' AS exception_type, CASE event_id % 3 WHEN 0 THEN user_id::VARCHAR ELSE '' END AS message, 1::BIGINT AS line_number,
  CASE event_id % 3 WHEN 2 THEN 0 ELSE 1 END::BIGINT AS n_frames, 'ERROR' AS severity FROM events WHERE event_type = 'error'""")
def traceback_parser(spark, sf):
    """A line without ``, in`` is no frame, and a type that a colon follows without a space names no exception."""
    e = table(spark, sf, "events").where("event_type = 'error'")
    kind = F.col("event_id") % 3
    raised = F.when(kind == 0, F.concat(F.lit("KeyError: "), F.col("user_id").cast("string"))).otherwise(F.lit("KeyError\nValueError:x"))
    place = F.when(kind == 2, F.lit("")).otherwise(F.lit(", in f"))
    docs = e.select(F.col("event_id").cast("string").alias("source_id"), F.concat(F.lit('  File "a "b".py", line 1'), place, F.lit("\n"), raised).alias("text"))
    events = parse_documents(docs, PythonTracebackParser()).events
    read = lambda name: F.get_json_object("attributes_json", f"$.{name}")
    frames = F.coalesce(F.json_array_length(read("frames")), F.lit(0)).cast("bigint")
    return events.select("source_id", read("exception_type").alias("exception_type"), read("message").alias("message"), F.col("evidence.line_number").alias("line_number"), frames.alias("n_frames"), "severity")


@query("SELECT event_id::VARCHAR AS source_id, event_type AS kind, user_id::VARCHAR AS \"user\" FROM events")
def cli_kv(spark, sf):
    e = table(spark, sf, "events")
    docs = e.select(F.col("event_id").cast("string").alias("source_id"), F.concat(F.lit("kind: "), "event_type", F.lit("\nuser: "), F.col("user_id").cast("string")).alias("text"))
    return parse_documents(docs, CLIOutputParser(command="kv")).events.select("source_id", F.get_json_object("attributes_json", "$.kind").alias("kind"), F.get_json_object("attributes_json", "$.user").alias("user"))


@query("SELECT o_orderkey::VARCHAR AS source_id, 'update orders' AS message, 1::BIGINT AS line_number FROM orders UNION ALL SELECT o_orderkey::VARCHAR, 'select customer', 2 FROM orders")
def sql_statements(spark, sf):
    o = table(spark, sf, "orders")
    docs = o.select(F.col("o_orderkey").cast("string").alias("source_id"), F.concat(F.lit("UPDATE orders SET note = 'a;b' WHERE k = "), F.col("o_orderkey").cast("string"), F.lit(";\nSELECT * FROM customer c WHERE c.k = "), F.col("o_custkey").cast("string")).alias("text"))
    return flat(parse_documents(docs, SQLStatementParser()).events).select("source_id", "message", "line_number")


@query(f"WITH {ENTRIES} SELECT source_id, event_type, event_type AS pattern, severity, message_json, occurrences, positions FROM en")
def evidence_entries(spark, sf):
    return evidence.entries(stored(spark, sf)).select("source_id", "event_type", "pattern", "severity", "message_json", "occurrences", F.array_join("positions", ",").alias("positions"))


@query(f"WITH {SIG} SELECT source_id, name AS event_type, count(*)::BIGINT AS \"count\", sha256(string_agg(c || chr(10), '' ORDER BY line_number)) AS events_sha256 FROM canon GROUP BY 1, 2")
def evidence_checksum(spark, sf):
    return stored(spark, sf).select("source_id", "event_type", "count", "events_sha256")


@query(f"WITH {SIG} SELECT source_id, name AS event_type, count(*)::BIGINT AS n FROM hit GROUP BY 1, 2")
def materialize_verify(spark, sf):
    again = parse_documents(log_corpus(spark, sf), ApplicationLogParser()).events
    return evidence.rebuild(stored(spark, sf), again).groupBy("source_id", "event_type").agg(F.count("*").alias("n"))


@query(f"WITH {SIG} SELECT 'application-log' AS parser_name, name AS event_type, count(*)::BIGINT AS n, false AS retained FROM hit GROUP BY 2 UNION ALL SELECT 'timestamped-log', 'log', count(*)::BIGINT, true FROM lg")
def routing_aggregate(spark, sf):
    both = canonicalize(signals(spark, sf)).unionByName(logs(spark, sf))
    routed = evidence.route_evidence(both, retained={"timestamped-log"})
    return routed.groupBy("parser_name", "event_type").agg(F.sum("count").alias("n"), F.bool_or(evidence.retains_events(F.col("groups"))).alias("retained"))


@query(f"""WITH {SIG} SELECT source_id, name AS event_type, max(length(message))::BIGINT AS "value" FROM hit GROUP BY 1, 2
UNION ALL SELECT source_id, 'log', max(line_number)::BIGINT FROM lg GROUP BY 1""")
def routed_aggregators(spark, sf):
    """Events of two parsers, each by a user's aggregator, as partial aggregates that are merged."""

    class Most(aggregators.Aggregator):
        def __init__(self, column):
            self.column = column

        def aggregate(self, events):
            return events.groupBy("source_id", "event_type").agg(F.max(self.column).cast("bigint").alias("value"))

        def merge(self, partials):
            return reduce(DataFrame.unionByName, partials).groupBy("source_id", "event_type").agg(F.max("value").alias("value"))

    routing = aggregators.RoutingAggregator(Most(F.length(F.get_json_object("attributes_json", "$.message"))), {"timestamped-log": Most(F.col("evidence.line_number"))})
    both = signals(spark, sf).unionByName(logs(spark, sf))
    halves = [routing.aggregate(both.where(F.col("evidence.line_number") % 2 == k)) for k in (0, 1)]
    return reduce(DataFrame.unionByName, routing.merge(halves).values())


@query(f"WITH {SIG} SELECT count(DISTINCT (source_id, name))::BIGINT AS n_aggregates, count(*)::BIGINT AS n_events FROM hit")
def merge_evidence(spark, sf):
    a = stored(spark, sf)
    half = F.pmod(F.xxhash64("source_id"), F.lit(2))
    return evidence.merge_evidence(a.where(half == 0), a.where(half == 1)).agg(F.count("*").alias("n_aggregates"), F.sum("count").alias("n_events"))


@query(f"WITH {LOG}, n AS (SELECT source_id, count(*) AS n, max(line_number) AS m FROM lg GROUP BY 1) SELECT count(*)::BIGINT AS n_sources, sum(ceil(n / 10.0))::BIGINT AS n_parts, sum(n)::BIGINT AS n_lines FROM n")
def line_partitions(spark, sf):
    parts = LinePartitioner(max_lines=10).partition(log_corpus(spark, sf))
    per = parts.withColumn("n", F.size(F.split(F.rtrim("text", F.lit("\n")), "\n")))
    return per.agg(F.count_distinct("source_id").alias("n_sources"), F.count("*").alias("n_parts"), F.sum("n").cast("bigint").alias("n_lines"))


@query(f"WITH {SIG} SELECT source_id, name AS event_type, line_number, start_offset, message FROM hit")
def partition_parity(spark, sf):
    parser = ApplicationLogParser()
    parts = LinePartitioner(max_lines=10).partition(log_corpus(spark, sf), parser.capabilities)
    return flat(rebase(parse_documents(parts, parser).events, parts)).select("source_id", "event_type", "line_number", "start_offset", "message")


@query(f"WITH {SIG} SELECT DISTINCT source_id, line_number FROM hit")
def range_covered_lines(spark, sf):
    lines = frame_lines(log_corpus(spark, sf))
    return spans.covered_lines(lines, ApplicationLogParser().native(lines)).select("source_id", "line_number")


@query(f"WITH {SIG} SELECT source_id, line_number FROM lg WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.source_id = lg.source_id AND hit.line_number = lg.line_number)")
def uncovered_lines(spark, sf):
    lines = frame_lines(log_corpus(spark, sf))
    return spans.uncovered_lines(lines, ApplicationLogParser().native(lines)).select("source_id", "line_number")


@query(f"""WITH {ENTRIES}, ev2 AS (SELECT source_id, event_type, severity, sum(occurrences) AS n, sum(strlen(concat('{{"message":', message_json, ',"occurrences":', occurrences, ',"positions":[', positions, ']}}')) + 1) - 1 AS w FROM en GROUP BY 1, 2, 3),
ag AS (SELECT source_id, sum(strlen(concat('{{"source_id":"', source_id, '","event_type":"', event_type, '","parser_name":"application-log","parser_version":"1","count":', n, ',"events_sha256":"', repeat('0', 64),
  '","groups":[{{"pattern":"', event_type, '","severity":', CASE WHEN severity IS NULL THEN 'null' ELSE '"' || severity || '"' END, ',"evidence":[]}}]}}')) + w + 1) - 1 + strlen('{{"format":"{codecs.FORMAT}","aggregates":[]}}') AS output_bytes FROM ev2 GROUP BY 1),
sz AS (SELECT source_id, max(end_offset)::BIGINT AS input_bytes FROM lg GROUP BY 1)
SELECT source_id, input_bytes, output_bytes::BIGINT AS output_bytes, (input_bytes - output_bytes)::BIGINT AS saved_bytes, ceil(input_bytes / 4.0)::BIGINT AS input_tokens FROM sz JOIN ag USING (source_id)""")
def compression_metrics(spark, sf):
    """Each log against the document that its aggregates are stored as."""
    kept = codecs.encode_aggregates(stored(spark, sf)).withColumnRenamed("source_id", "s")
    both = log_corpus(spark, sf).join(kept, F.col("source_id") == F.col("s"))
    return both.select("source_id", compression(F.col("text"), F.col("document")).alias("m")).select("source_id", "m.input_bytes", "m.output_bytes", "m.saved_bytes", "m.input_tokens")


@query("SELECT source, count(*)::BIGINT AS n, sum(ceil(strlen(text) / 4.0))::BIGINT AS n_tokens FROM documents GROUP BY 1")
def approx_tokens(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(approximate_tokens()(F.col("text"))).alias("n_tokens"))


@query(f"WITH {ENTRIES} SELECT source_id, event_type, message_json, occurrences * 2 AS occurrences FROM en")
def facts_merge(spark, sf):
    a = stored(spark, sf)
    return evidence.facts(a.unionByName(a)).select("source_id", "event_type", "message_json", "occurrences")


@query(f"WITH {SIG} SELECT upper(coalesce(severity, 'UNSPECIFIED')) AS severity, count(*)::BIGINT AS occurrences FROM hit GROUP BY 1")
def severity_inventory(spark, sf):
    return evidence.severity_inventory(stored(spark, sf))


@query(f"WITH {LOG}, r AS (SELECT source_id, level, CASE WHEN lag(level) OVER (PARTITION BY source_id ORDER BY line_number) = level THEN 0 ELSE 1 END AS b FROM lg), s AS (SELECT source_id, level, sum(b) AS runs FROM r GROUP BY 1, 2) SELECT source_id, max(runs) > 1 AS interleaved FROM s GROUP BY 1")
def interleaving(spark, sf):
    rows = logs(spark, sf).select("source_id", F.col("severity").alias("owner"), F.col("evidence.line_number").alias("line_number"))
    return spans.interleaving(rows, "owner")


@query(f"WITH {ENTRIES} SELECT 'not cited' AS kind, event_type || '/' || source_id || '/' || message_json AS id FROM en WHERE severity IN ('ERROR', 'WARN', 'WARNING', 'CRITICAL', 'FATAL') AND occurrences > 1")
def claim_checks(spark, sf):
    facts = evidence.entries(stored(spark, sf)).select(F.concat_ws("/", "event_type", "source_id", "message_json").alias("id"), "severity", "event_type", "occurrences")
    claims = facts.where("occurrences = 1").select(F.col("id").alias("claim"), F.col("id").alias("evidence_id"))
    return claim_faults(claims, facts)


@query(f"WITH {LOG} SELECT source_id, line_number, 'log' AS event_type, said AS message, level AS severity FROM lg")
def mixed_routed_logs(spark, sf):
    log = RegexPattern("log-line", r"^\d{4}-\d\d-\d\dT\S+ (?:" + "|".join(LEVELS) + ")")
    events = parse_documents(log_corpus(spark, sf), MixedContentParser(routes=[(log, TimestampedLogParser())])).events
    return flat(events).select("source_id", "line_number", "event_type", "message", "severity")


@query("""SELECT event_type, line_number::BIGINT AS line_number, parser_name, (SELECT count(*) FROM orders)::BIGINT AS n FROM (VALUES ('log', 1, 'timestamped-log'), ('json_record', 2, 'json'), ('other', 4, 'mixed-content'),
  ('fence', 5, 'mixed-content'), ('connection_failure', 6, 'application-log'), ('fence', 7, 'mixed-content'), ('code', 8, 'mixed-content'), ('code', 9, 'mixed-content')) AS v(event_type, line_number, parser_name) WHERE (SELECT count(*) FROM orders) > 0""")
def mixed_content(spark, sf):
    """Fenced code, JSON, notes and logs in one document per order."""
    o = table(spark, sf, "orders")
    text = F.concat(F.lit("2026-10-01T08:00:00+00:00 ERROR order "), F.col("o_orderkey").cast("string"), F.lit(' timeout\n{"order": '), F.col("o_orderkey").cast("string"), F.lit(',\n "ok": false}\nnote: checked\n```log\nconnection refused\n```\ndef f(x):\n    return x\n'))
    docs = o.select(F.col("o_orderkey").cast("string").alias("source_id"), text.alias("text"))
    parser = MixedContentParser(routes=[(RegexPattern("ts", r"^\d{4}-\d\d-\d\dT"), TimestampedLogParser()), (RegexPattern("json-line", r"^\s*\{"), JSONParser())], fence_routes={"log": ApplicationLogParser()})
    return parse_documents(docs, parser).events.groupBy("event_type", F.col("evidence.line_number").alias("line_number"), F.col("evidence.parser_name").alias("parser_name")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS k, kind FROM (SELECT o_orderkey, unnest(['log', 'json_record', 'other', 'fence', 'connection_failure', 'fence', 'code', 'code']) AS kind FROM orders)")
def mixed_kinds(spark, sf):
    o = table(spark, sf, "orders")
    text = F.concat(F.lit("2026-10-01T08:00:00+00:00 ERROR order\n"), F.lit('{"order": '), F.col("o_orderkey").cast("string"), F.lit("}\nnote: checked\n```log\nconnection refused\n```\ndef f(x):\n    return x\n"))
    docs = o.select(F.col("o_orderkey").cast("string").alias("source_id"), text.alias("text"))
    parser = MixedContentParser(routes=[(RegexPattern("ts", r"^\d{4}-\d\d-\d\dT"), TimestampedLogParser()), (RegexPattern("json-line", r"^\s*\{"), JSONParser())], fence_routes={"log": ApplicationLogParser()})
    return parse_documents(docs, parser).events.select(F.col("source_id").cast("bigint").alias("k"), F.col("event_type").alias("kind"))


@query("SELECT conv_id::VARCHAR AS source_id, (turn + 1)::BIGINT AS line_number, role AS event_type FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn2 FROM conversations) WHERE turn = turn2")
def conversation_turns(spark, sf):
    c = table(spark, sf, "conversations")
    docs = c.groupBy(F.col("conv_id").cast("string").alias("source_id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", "role"))).getField("role"), "\n").alias("text"))
    parser = PatternParser([ExactPattern(r, r) for r in ("user", "assistant", "system")])
    return parser.native(frame_lines(docs)).select("source_id", F.col("evidence.line_number").alias("line_number"), "event_type")


@query("SELECT event_id::VARCHAR AS source_id, event_id % 3 <> 0 AS valid FROM events")
def strict_json(spark, sf):
    e = table(spark, sf, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"k":1,"k":'), F.col("event_id").cast("string"), F.lit("}"))).otherwise(F.col("props"))
    docs = e.select(F.col("event_id").cast("string").alias("source_id"), text.alias("text"))
    return parse_documents(docs, JSONParser()).events.select("source_id", (F.col("event_type") == "json_record").alias("valid"))


@query("SELECT event_id::VARCHAR AS source_id, event_id % 5 = 0 AS failed FROM events")
def continue_on_error(spark, sf):
    e = table(spark, sf, "events")
    content = F.when(F.col("event_id") % 5 == 0, F.unhex(F.lit("FF"))).otherwise(F.encode("event_type", "UTF-8"))
    docs = e.select(F.col("event_id").cast("string").alias("source_id"), content.alias("content"))
    return parse_documents(docs, ApplicationLogParser(), continue_on_error=True).results.select("source_id", (F.size("errors") > 0).alias("failed"))


@query(f"WITH {SIG} SELECT DISTINCT source_id, true AS same FROM hit")
def codec_round_trip(spark, sf):
    a = stored(spark, sf)
    again = codecs.decode_aggregates(codecs.encode_aggregates(a))
    odd = evidence.differences(a, again).select(F.col("source_id").alias("s")).distinct()
    return a.select("source_id").distinct().join(odd, F.col("source_id") == F.col("s"), "left").select("source_id", F.col("s").isNull().alias("same"))


@query()
def result_documents(spark, sf):
    return codecs.result_documents(parse_documents(log_corpus(spark, sf), ApplicationLogParser()))
