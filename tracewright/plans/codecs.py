"""Results and aggregates as JSON documents, and back."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.errors import CodecError
from tracewright.functions.strict_json import DOCUMENT_DEPTH, compact, exact_fields, loads
from tracewright.operators.parsing import Parsing
from tracewright.schema import AGGREGATES, EVIDENCE_FIELDS, VERSION

FORMAT = "tracewright.aggregates/1"
_RESULT = {"schema_version", "events", "warnings", "errors", "pattern_statistics", "parser_name", "parser_version", "correlation_id", "llm_result"}
_EVENT = {"schema_version", "event_type", "attributes", "timestamp", "severity", "confidence", "evidence"}


def result_documents(parsing: Parsing) -> DataFrame:
    """One row per input: source_id, input_index and ``document``, its result as compact JSON with all events.

    The rows are read once and never joined: parsing again could number the inputs otherwise, and Spark may
    take the events for a table small enough to broadcast. The events' canonical texts are put in as they are.
    """

    def rest(r: dict[str, Any]) -> str:
        """What follows the events in the document."""
        return compact({k: r[k] for k in ("warnings", "errors", "pattern_statistics", "parser_name", "parser_version", "correlation_id", "llm_result")})[1:]

    def run(batches):
        for batch in batches:
            told = pa.array([r and rest(r) for r in batch.column(4).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], told], names=["source_id", "input_index", "seq", "canonical", "rest"])

    rows = parsing.rows.select("source_id", "input_index", "seq", "canonical", F.when(F.col("kind") == "result", F.col("result")))
    rows = rows.mapInArrow(run, "source_id string, input_index long, seq long, canonical string, rest string")
    event = F.when(F.col("rest").isNull(), F.struct("seq", "canonical"))
    inputs = rows.groupBy("source_id", "input_index").agg(F.array_sort(F.collect_list(event)).getField("canonical").alias("events"), F.collect_list("rest").alias("rests"))
    document = F.concat(F.lit(f'{{"schema_version":{compact(VERSION)},"events":['), F.array_join("events", ","), F.lit("],"), F.col("rest"))
    return inputs.withColumn("rest", F.explode("rests")).select("source_id", "input_index", document.alias("document"))


def write_ndjson(documents: DataFrame, path: str) -> None:
    """One document a line."""
    documents.select(F.col("document").alias("value")).write.text(path)


def decode_result(payload: str | bytes) -> dict[str, Any]:
    """A result document with exactly its fields, or CodecError."""
    try:
        r = exact_fields(loads(payload, DOCUMENT_DEPTH), _RESULT, what="result")
        if r["schema_version"] != VERSION:
            raise ValueError(f"unknown version {r['schema_version']!r}")
        for e in r["events"]:
            exact_fields(e, _EVENT, what="event")
            exact_fields(e["evidence"], set(EVIDENCE_FIELDS), what="evidence")
        names = [exact_fields(s, {"pattern_name", "matches"}, what="statistic")["pattern_name"] for s in r["pattern_statistics"]]
        if len(set(names)) != len(names):
            raise ValueError("a pattern has two statistics")
    except (ValueError, TypeError) as error:
        raise CodecError(f"invalid result: {error}") from error
    return r


class AggregateCodec:
    """A wire format of one source's aggregates: rows as dicts to text and back."""

    format = FORMAT

    def encode(self, aggregates: list[dict[str, Any]], indent: int | None = None) -> str:
        raise NotImplementedError

    def decode(self, text: str) -> list[dict[str, Any]]:
        raise NotImplementedError


class EvidenceCodec(AggregateCodec):
    def encode(self, aggregates: list[dict[str, Any]], indent: int | None = None) -> str:
        out = []
        for a in aggregates:
            if "groups" not in a or "events_sha256" not in a:
                raise CodecError("only evidence aggregates can be stored")
            kept = {k: a[k] for k in ("source_id", "event_type", "parser_name", "parser_version", "count", "events_sha256")}
            kept |= {k: a[k] for k in ("first_seen", "last_seen") if a[k] is not None}
            kept["groups"] = [{"pattern": g["pattern"], "severity": g["severity"], "evidence": [self._entry(e) for e in g["evidence"]]} for g in a["groups"]]
            out.append(kept)
        return json.dumps({"format": self.format, "aggregates": out}, ensure_ascii=False, indent=indent, separators=(",", ": ") if indent else (",", ":"), allow_nan=False)

    @staticmethod
    def _entry(e: dict[str, Any]) -> dict[str, Any]:
        out = {"message": json.loads(e["message_json"]), "occurrences": e["occurrences"], "positions": e["positions"]}
        if e["events"]:
            out |= {"events": [json.loads(x) for x in e["events"]], "sequence": e["sequence"]}
        return out

    def decode(self, text: str) -> list[dict[str, Any]]:
        from tracewright.functions.strict_json import canonical

        try:
            document = exact_fields(loads(text, DOCUMENT_DEPTH), {"format", "aggregates"}, what="document")
            if document["format"] != self.format:
                raise ValueError(f"unknown format {document['format']!r}")
            out = []
            for a in document["aggregates"]:
                a = exact_fields(a, {"source_id", "event_type", "parser_name", "parser_version", "count", "events_sha256", "groups"}, {"first_seen", "last_seen"}, "aggregate")
                groups = []
                for g in a["groups"]:
                    g = exact_fields(g, {"pattern", "severity", "evidence"}, what="group")
                    entries = []
                    for e in g["evidence"]:
                        e = exact_fields(e, {"message", "occurrences", "positions"}, {"events", "sequence"}, "entry")
                        if e["occurrences"] != len(e["positions"]) or e["occurrences"] < 1 or ("events" in e) != ("sequence" in e):
                            raise ValueError("an entry's occurrences do not fit its positions")
                        entries.append({"message_json": canonical(e["message"]), "occurrences": e["occurrences"], "positions": e["positions"], "events": [canonical(x) for x in e.get("events", ())], "sequence": e.get("sequence", [])})
                    if not entries:
                        raise ValueError("a group has no evidence")
                    groups.append({"pattern": g["pattern"], "severity": g["severity"], "evidence": entries})
                if a["count"] != sum(e["occurrences"] for g in groups for e in g["evidence"]):
                    raise ValueError("an aggregate's count does not fit its evidence")
                out.append({k: a.get(k) for k in ("source_id", "event_type", "parser_name", "parser_version", "count", "first_seen", "last_seen", "events_sha256")} | {"groups": groups})
        except (ValueError, TypeError, KeyError) as error:
            raise CodecError(f"invalid aggregates: {error}") from error
        return out


def encode_aggregates(aggregates: DataFrame, codec: AggregateCodec | None = None, indent: int | None = None) -> DataFrame:
    """source_id and ``document``: all aggregates of the source, by event type and parser."""
    codec = codec or EvidenceCodec()
    rows = aggregates.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "parser_name", F.struct(*aggregates.columns).alias("a")))).getField("a").alias("a"))

    def run(batches):
        for batch in batches:
            found = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["source_id"] for r in found], pa.string()), pa.array([codec.encode(r["a"], indent) for r in found], pa.string())], names=["source_id", "document"])

    return rows.mapInArrow(run, "source_id string, document string")


def decode_aggregates(documents: DataFrame, codec: AggregateCodec | None = None) -> DataFrame:
    """Aggregates of the ``document`` column; an invalid document raises."""
    codec = codec or EvidenceCodec()
    schema = documents.sparkSession.createDataFrame([], AGGREGATES).schema
    import pyspark.sql.pandas.types as pt

    arrow = pt.to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            found = [a for text in batch.column(0).to_pylist() for a in codec.decode(text)]
            yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return documents.select("document").mapInArrow(run, AGGREGATES)


def json_codec(encode: Callable[[Any], str], decode: Callable[[str], Any]) -> tuple[Callable[[Any], str], Callable[[str], Any]]:
    """A user's JSON codec, for ``JSONParser(decode=...)``; checked to round-trip before use."""
    probe = {"a": [1, 2.5, "é", None, True, {"b": 2**70}]}
    if decode(encode(probe)) != probe:
        raise CodecError("the JSON codec does not give back what it was given")
    return encode, decode
