"""Columns of the tables."""

EVIDENCE = (
    "struct<source_id:string,start_offset:bigint,end_offset:bigint,line_number:bigint,parser_name:string,"
    "parser_version:string,pattern_name:string,partition_id:string,correlation_id:string>"
)
EVIDENCE_FIELDS = ("source_id", "start_offset", "end_offset", "line_number", "parser_name", "parser_version", "pattern_name", "partition_id", "correlation_id")
ISSUE = "struct<error_type:string,message:string,source_id:string,input_index:bigint,traceback:string>"
STATISTIC = "struct<pattern_name:string,matches:bigint>"

LINES = "source_id string, line_number bigint, text string, start_offset bigint, end_offset bigint"
#: ``canonical`` and ``message_json`` carry the event's canonical text and its message as JSON.
EVENTS = (
    "source_id string, input_index bigint, seq bigint, event_type string, attributes_json string, ts timestamp, timestamp_iso string, "
    f"severity string, confidence double, evidence {EVIDENCE}, message_json string, canonical string"
)
RESULTS = (
    "source_id string, input_index bigint, parser_name string, parser_version string, correlation_id string, "
    f"warnings array<string>, errors array<{ISSUE}>, pattern_statistics array<{STATISTIC}>, llm_result string"
)
ENTRY = "struct<message_json:string,occurrences:bigint,positions:array<bigint>,events:array<string>,sequence:array<bigint>>"
GROUPS = f"array<struct<pattern:string,severity:string,evidence:array<{ENTRY}>>>"
AGGREGATES = (
    "source_id string, event_type string, parser_name string, parser_version string, count bigint, first_seen string, last_seen string, "
    f"events_sha256 string, groups {GROUPS}"
)
PARTITIONS = "source_id string, partition_id string, start_line bigint, source_offset bigint, text string"
VERSION = "1"
