"""Lossless evidence aggregates: what was found, where, and a checksum of the events it stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.errors import AggregationError, CapabilityError
from tracewright.operators.parsing import EVENT_COLUMNS
from tracewright.sources.tables import written

KEY = ["source_id", "event_type", "parser_name"]


def _flat(events: DataFrame) -> DataFrame:
    return events.select("source_id", "event_type", F.col("evidence.parser_name").alias("parser_name"), F.col("evidence.parser_version").alias("parser_version"), F.col("evidence.pattern_name").alias("pattern"), "severity", "message_json", F.col("evidence.line_number").alias("line"), "seq", "ts", "timestamp_iso", "canonical")


def order_faults(events: DataFrame) -> DataFrame:
    """Sources whose events go back a line (unknown lines aside), or in which a parser has two versions."""
    w = Window.partitionBy("source_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    flat = _flat(events)
    back = flat.withColumn("before", F.max("line").over(w)).where("before > line").select("source_id", F.lit("events go back a line").alias("fault"))
    versions = flat.groupBy("source_id", "parser_name").agg(F.count_distinct("parser_version").alias("n"), F.max(F.col("parser_version").isNull().cast("int")).alias("none")).where("n + none > 1")
    return back.union(versions.select("source_id", F.lit("a parser has two versions").alias("fault"))).distinct()


def checksum(texts: Column) -> Column:
    """SHA-256 of the lines of an ordered array of texts, each ended by LF."""
    return F.sha2(F.concat(F.array_join(texts, "\n"), F.lit("\n")), 256)


def aggregate_evidence(events: DataFrame, *, reproducible: bool = True) -> DataFrame:
    """One aggregate per source, event type and parser; order everywhere is that of first appearance.

    Without ``reproducible`` the entries keep their events and places in the sequence, since parsing
    again would not give them back. Equal times with different offsets show the first one met.
    """
    flat = _flat(events)
    occurrence = F.struct("seq", "line", *([] if reproducible else ["canonical"]))
    entry_key = [*KEY, "pattern", "severity", "message_json"]
    # Messages first: partial aggregation cannot shrink lists, but no list outgrows its message.
    entries = flat.groupBy(*entry_key).agg(F.array_sort(F.collect_list(occurrence)).alias("o"), F.min("seq").alias("first"))
    kept = (F.col("o.canonical"), F.col("o.seq")) if not reproducible else (F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    entry = F.struct("first", F.struct(F.col("message_json"), F.size("o").cast("bigint").alias("occurrences"), F.col("o.line").alias("positions"), kept[0].alias("events"), kept[1].alias("sequence")).alias("e"))
    groups = entries.withColumn("entry", entry).groupBy(*KEY, "pattern", "severity").agg(F.array_sort(F.collect_list("entry")).alias("entries"), F.min("first").alias("first"))
    group = F.struct("first", F.struct("pattern", "severity", F.col("entries.e").alias("evidence")).alias("g"))
    shape = groups.withColumn("group", group).groupBy(*KEY).agg(F.array_sort(F.collect_list("group")).getField("g").alias("groups"))
    timed = F.col("ts").isNotNull()
    totals = flat.groupBy(*KEY).agg(
        F.first("parser_version", ignorenulls=True).alias("parser_version"), F.count("*").alias("count"),
        F.min_by("timestamp_iso", F.when(timed, F.struct("ts", "seq"))).alias("first_seen"), F.max_by("timestamp_iso", F.when(timed, F.struct("ts", -F.col("seq")))).alias("last_seen"),
        checksum(F.array_sort(F.collect_list(F.struct("seq", "canonical"))).getField("canonical")).alias("events_sha256"),
    )
    on = totals["source_id"].eqNullSafe(shape["source_id"]) & (totals["event_type"] == shape["event_type"]) & totals["parser_name"].eqNullSafe(shape["parser_name"])
    return totals.join(shape, on).select(totals["source_id"], totals["event_type"], totals["parser_name"], "parser_version", "count", "first_seen", "last_seen", "events_sha256", "groups")


def occurrences(groups: Column) -> Column:
    """Occurrences in all entries of an aggregate's groups."""
    inner = lambda g: F.aggregate(g["evidence"], F.lit(0).cast("bigint"), lambda n, e: n + e["occurrences"])
    return F.aggregate(groups, F.lit(0).cast("bigint"), lambda n, g: n + inner(g))


def retains_events(groups: Column) -> Column:
    return F.exists(groups, lambda g: F.exists(g["evidence"], lambda e: F.size(e["events"]) > 0))


def entries(aggregates: DataFrame) -> DataFrame:
    """A row per entry: aggregate key, pattern, severity, message_json, occurrences, positions."""
    groups = aggregates.select(*KEY, "parser_version", F.posexplode("groups").alias("group_no", "g"))
    rows = groups.select(*KEY, "parser_version", "group_no", "g.pattern", "g.severity", F.posexplode("g.evidence").alias("entry_no", "e"))
    return rows.select(*KEY, "parser_version", "group_no", "pattern", "severity", "entry_no", "e.*")


def merge_evidence(*sets: DataFrame) -> DataFrame:
    """All aggregates; two for one source, event type and parser cannot be merged and raise when read."""
    whole = sets[0]
    for s in sets[1:]:
        whole = whole.unionByName(s)
    again = F.count("*").over(Window.partitionBy(*KEY))
    checked = whole.withColumn("n", again).withColumn("n", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("CapabilityError: two aggregates for "), F.to_json(F.struct(*KEY))))).otherwise(F.col("n")))
    return checked.where("n = 1").drop("n")


def differences(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Keys whose aggregates are missing on a side, double, or not equal in every field and order."""
    text = lambda df, name: df.groupBy(*KEY).agg(F.count("*").alias(f"n_{name}"), F.min(F.to_json(F.struct("parser_version", "count", "first_seen", "last_seen", "events_sha256", "groups"), {"ignoreNullFields": "false"})).alias(name))
    a, b = text(stored, "stored"), text(rebuilt, "rebuilt").select(*[F.col(k).alias(f"r_{k}") for k in KEY], "n_rebuilt", "rebuilt")
    on = F.lit(True)
    for k in KEY:
        on = on & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    both = a.join(b, on, "full_outer")
    fault = F.when(F.col("stored").isNull(), "not stored").when(F.col("rebuilt").isNull(), "not rebuilt").when((F.col("n_stored") > 1) | (F.col("n_rebuilt") > 1), "double").when(F.col("stored") != F.col("rebuilt"), "different")
    return both.select(*[F.coalesce(k, f"r_{k}").alias(k) for k in KEY], fault.alias("fault")).where("fault is not null")


def rebuild(aggregates: DataFrame, events: DataFrame) -> DataFrame:
    """Events parsed again, once they are shown to be exactly those the aggregates stand for.

    They are parsed once and kept as a table in the shared folder, which the comparison and the reader share.
    """
    events = written(events, "rebuilt")
    faults = differences(aggregates, aggregate_evidence(events)).limit(5).collect()
    if faults:
        raise AggregationError("the events do not match: " + "; ".join(f"{r.source_id}/{r.event_type}/{r.parser_name} {r.fault}" for r in faults))
    return events


def retained_events(aggregates: DataFrame) -> DataFrame:
    """Canonical texts of retained events, with source and sequence; their checksums are verified when read."""
    rows = entries(aggregates).select(*KEY, F.explode(F.arrays_zip("events", "sequence")).alias("x")).select(*KEY, F.col("x.events").alias("canonical"), F.col("x.sequence").alias("seq"))
    sums = rows.groupBy(*KEY).agg(checksum(F.array_sort(F.collect_list(F.struct("seq", "canonical"))).getField("canonical")).alias("sum"))
    stored = aggregates.select(*[F.col(k).alias(f"a_{k}") for k in KEY], "events_sha256")
    on = F.lit(True)
    for k in KEY:
        on = on & F.col(k).eqNullSafe(F.col(f"a_{k}"))
    bad = sums.join(stored, on, "full_outer").where("sum is null or events_sha256 is null or sum <> events_sha256")
    if bad.limit(1).count():
        raise AggregationError("retained events do not match their checksums")
    return rows


def require_lossless(reproducible: bool, aggregates: DataFrame) -> None:
    if not reproducible and aggregates.where(~retains_events(F.col("groups"))).limit(1).count():
        raise CapabilityError("events of a parser that is not reproducible must be retained")


# -- Routing by parser -----------------------------------------------------------------------


def route_evidence(events: DataFrame, *, retained: set[str] = frozenset()) -> DataFrame:
    """Aggregate each parser's events in its own way: those of ``retained`` parsers keep their events."""
    of = F.coalesce(F.col("evidence.parser_name").isin(*retained) if retained else F.lit(False), F.lit(False))
    return aggregate_evidence(events.where(~of)).unionByName(aggregate_evidence(events.where(of), reproducible=False)) if retained else aggregate_evidence(events)


def in_document_order(events: DataFrame) -> DataFrame:
    return events.select(*EVENT_COLUMNS).orderBy("source_id", F.col("evidence.line_number").asc_nulls_first(), F.col("evidence.start_offset").asc_nulls_first(), "seq")


# -- Facts -----------------------------------------------------------------------------------


def facts(aggregates: DataFrame) -> DataFrame:
    """Findings over all runs: equal source, parser, type, pattern, severity and message are one; positions sorted."""
    key = ["source_id", "parser_name", "parser_version", "event_type", "pattern", "severity", "message_json"]
    return entries(aggregates).groupBy(*key).agg(F.sum("occurrences").cast("bigint").alias("occurrences"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))


def severity_inventory(aggregates: DataFrame) -> DataFrame:
    """Occurrences by upper-case severity; none counts as UNSPECIFIED."""
    return entries(aggregates).groupBy(F.upper(F.coalesce("severity", F.lit("UNSPECIFIED"))).alias("severity")).agg(F.sum("occurrences").cast("bigint").alias("occurrences"))
