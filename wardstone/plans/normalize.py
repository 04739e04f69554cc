"""Text lines -> canonical events: detect, parse, map and validate in narrow projections, without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import event
from ..functions.text import choose
from ..operators import registry as sources
from ..operators.registry import Context, Registry


def _context(ingest_ms: int | None, year: int | None, zone: str) -> Context:
    now = F.unix_millis(F.current_timestamp()) if ingest_ms is None else F.lit(ingest_ms).cast("long")
    return Context(now, F.year(F.current_date()) if year is None else F.lit(year), zone)


def normalize(
    lines: DataFrame,
    line: str = "value",
    ingest_ms: int | None = None,
    assume_year: int | None = None,
    linux_zone: str = "UTC",
    uid_mode: str = "compat",
    registry: Registry | None = None,
) -> DataFrame:
    """Adds to each row: source, the event's fields, parse_error, validation_error, time_source, event_date.

    Lines that no source takes have source ''; fields are null wherever parse_error is not. A line without a stamp
    of its own gets ``ingest_ms`` (the present, if None). Linux stamps lie in ``assume_year`` (the present one) and
    ``linux_zone``. ``uid_mode`` 'compat' takes Linux's ID field as identifier, 'safe' always a digest of the line; 'random'
    gives each line of the other sources an identifier of its own, so that identical lines stay apart (one that is
    read again, after a failure too, gets another).

    Each line is read and routed once, and nothing is shuffled. All parsers stand side by side in staged projections;
    a parser's columns are evaluated for its own lines only, and what a parser uses more than once is a column of an
    earlier stage. Fields that nobody reads are pruned from all stages.
    """
    options = (line, ingest_ms, assume_year, linux_zone, uid_mode)
    x = _default_expressions(SparkContext._gateway, *options) if registry is None else _expressions(registry, *options)
    own = [F.col(f"`{c}`") for c in lines.columns if c not in {"source", *event.FIELDS}]
    df = lines.select(*own, *x.routed)
    for stage in x.stages:
        df = df.select("*", *stage)
    df = df.select(*own, "source", *x.parts)
    for stage in x.verdict:
        df = df.select("*", *stage)
    return df.select(*own, "source", *x.fields)


@dataclass(frozen=True)
class _Expressions:
    """The columns of each projection. None of them depends on the frame, so those of the default sources are made once."""

    routed: list[Column]
    stages: list[list[Column]]
    parts: list[Column]
    verdict: list[list[Column]]
    fields: list[Column]


@lru_cache(16)
def _default_expressions(gateway: object, *options) -> _Expressions:
    return _expressions(sources.default(), *options)


def _expressions(registry: Registry, line: str, ingest_ms: int | None, assume_year: int | None, linux_zone: str, uid_mode: str) -> _Expressions:
    context = _context(ingest_ms, assume_year, linux_zone)
    found = registry.ordered()
    routed = [F.col(f"`{line}`").alias("__line"), registry.detect(F.col(f"`{line}`")).alias("source")]
    text, source = F.col("__line"), F.col("source")
    have: dict[str, list[str]] = {s.name: [] for s in found}
    seen = lambda s: {n: F.col(f"__{s.name}_{n}") for n in have[s.name]}
    stages = []
    for k in range(max((len(s.steps) for s in found), default=0)):
        new = {s.name: s.steps[k](text, seen(s)) for s in found if k < len(s.steps)}
        stages.append([F.when(source == s, c).alias(f"__{s}_{n}") for s, cs in new.items() for n, c in cs.items()])
        for s, cs in new.items():
            have[s] += cs
    own = {s.name: s.parse(text, seen(s), context) for s in found}
    parts = {s: event.blank() | p for s, p in own.items()}
    if uid_mode == "safe" and "linux" in parts:
        parts["linux"]["uid"] = event.digest(parts["linux"]["raw"])
    if uid_mode == "random":
        routed.append(F.expr("uuid()").alias("__uid"))
        for name in own.keys() - {"linux"}:
            parts[name] |= {n: F.col("__uid") for n in own[name].keys() & {"uid", "correlation"}}
    elif uid_mode not in ("compat", "safe"):
        raise ValueError(f"no uid_mode {uid_mode!r}")
    names = list(dict.fromkeys(n for p in parts.values() for n in p))
    p = {n: F.col(f"_p_{n}") for n in [*names, "activity_id"]}
    # The generator is a fence: filters on the verdict stay above it and don't repeat each field's expression.
    broken = F.when((source != "") & p["error"].isNull(), event.violation(event.parts(p)))
    fence = F.explode(F.array(F.struct(p["error"].alias("error"), broken.alias("broken")))).alias("__x")
    error, broken = F.col("__x.error"), F.col("__x.broken")
    strict = source.isin([s.name for s in found if s.validates])
    good = (source != "") & F.col("parse_error").isNull()
    return _Expressions(
        routed,
        stages,
        [_by_source(source, {s: v[n] for s, v in parts.items() if n in v}, n).alias(f"_p_{n}") for n in names],
        [
            [event.canonical_activity(p["class_uid"], p["activity"]).alias("_p_activity_id")],
            [fence],
            [F.coalesce(error, F.when(strict, F.concat("source", F.lit(": "), broken))).alias("parse_error")],
        ],
        [
            *[F.when(good, c).alias(f) for f, c in event.build(p).items()],
            F.col("parse_error"),
            F.when(good, broken).alias("validation_error"),
            F.when(good, p["time_source"]).alias("time_source"),
            F.when(good, F.to_date(F.timestamp_millis(p["time"]))).alias("event_date"),
        ],
    )


def _by_source(source: Column, of: dict[str, Column], name: str) -> Column:
    """The value that a line's source gives, in the type of that part; null for other lines."""
    kind = event.PART_TYPES.get(name, "string")
    return choose([(source == s, c.cast(kind)) for s, c in of.items()], F.lit(None).cast(kind))


def event_of(df: DataFrame) -> Column:
    """The fields of a normalized row as one event."""
    return F.struct(*[F.col(f) for f in event.FIELDS])


def accepted(df: DataFrame) -> DataFrame:
    """The rows that were detected, parsed and found valid."""
    return df.filter((F.col("source") != "") & F.col("parse_error").isNull() & F.col("validation_error").isNull())


def rejected(df: DataFrame) -> DataFrame:
    """The others, with the reason."""
    reason = F.when(F.col("source") == "", "no source").otherwise(F.coalesce("parse_error", "validation_error"))
    return df.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def flat(df: DataFrame, *keep: str) -> DataFrame:
    """One scalar column for each part of the event; maps as sorted k=v joined by ';'."""
    pairs = F.transform(F.array_sort(F.map_entries("unmapped")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    scalar = [f for f in event.FIELDS if f not in ("metadata", "observables", "unmapped", "src_endpoint", "dst_endpoint", "traffic")]
    return df.select(
        *keep,
        "source",
        *scalar,
        F.col("metadata.product.name").alias("product"),
        F.col("metadata.product.vendor").alias("vendor"),
        F.col("metadata.product.version").alias("version"),
        F.col("metadata.uid").alias("uid"),
        F.col("src_endpoint.ip").alias("src_ip"),
        F.col("src_endpoint.port").alias("src_port"),
        F.col("dst_endpoint.ip").alias("dst_ip"),
        F.col("dst_endpoint.port").alias("dst_port"),
        F.col("traffic.packets").alias("packets"),
        F.col("traffic.bytes").alias("bytes"),
        F.array_join(pairs, ";").alias("unmapped"),
        F.array_join(F.transform("observables", lambda o: F.concat(o["name"], F.lit("="), o["value"])), ";").alias("observables"),
        "parse_error",
        "validation_error",
        "time_source",
        "event_date",
    )
