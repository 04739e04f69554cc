"""Ordered registry of log sources; the first whose detector holds parses a line, and no other is tried."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import choose
from . import cisco_asa, fortigate, linux, panos, suricata


@dataclass(frozen=True)
class Context:
    """What parsing takes from outside the line: the time to assume where it has none, and Linux stamps' year and zone."""

    ingest_ms: Column
    year: Column
    zone: str = "UTC"


@dataclass(frozen=True)
class Source:
    """A plug-in: all functions map Columns to Columns. ``steps`` name, one after the other, what later steps and ``parse``
    use more than once; each is a projection of its own, so nothing is evaluated twice.

    A source that ``validates`` rejects invalid events itself (parse_error); of others they are found invalid later.
    """

    name: str
    detect: Callable[[Column], Column]
    steps: tuple[Callable[[Column, dict[str, Column]], dict[str, Column]], ...]
    parse: Callable[[Column, dict[str, Column], Context], dict[str, Column]]
    validates: bool = True


class Registry:
    def __init__(self) -> None:
        self._order: list[Source] = []
        self._by_name: dict[str, Source] = {}

    def register(self, source: Source) -> None:
        """Appends a source. One of a known name is what get() and parsing find from then on; lines are still routed by
        the detector that was registered first, in its place."""
        if source.name not in self._by_name:
            self._order.append(source)
        self._by_name[source.name] = source

    def get(self, name: str) -> Source | None:
        return self._by_name.get(name)

    def names(self) -> list[str]:
        return sorted(self._by_name)

    def ordered(self) -> list[Source]:
        """The sources that parse, in the order of routing."""
        return [self._by_name[s.name] for s in self._order]

    def detect(self, line: Column) -> Column:
        """The name of the first source that takes the line; '' if none does."""
        return choose([(F.coalesce(s.detect(line), F.lit(False)), s.name) for s in self._order], "")


def default() -> Registry:
    """FortiGate, Linux, Cisco ASA, Suricata, in this order."""
    r = Registry()
    r.register(Source(fortigate.NAME, fortigate.detect, fortigate.STEPS, lambda line, s, c: fortigate.parse(line, s), validates=False))
    r.register(Source(linux.NAME, linux.detect, linux.STEPS, lambda line, s, c: linux.parse(line, s, c.ingest_ms, c.year, c.zone)))
    r.register(Source(cisco_asa.NAME, cisco_asa.detect, cisco_asa.STEPS, lambda line, s, c: cisco_asa.parse(line, s, c.ingest_ms)))
    r.register(Source(suricata.NAME, suricata.detect, suricata.STEPS, lambda line, s, c: suricata.parse(line, s, c.ingest_ms)))
    return r


def extended() -> Registry:
    """The default sources and, after them, PAN-OS."""
    r = default()
    r.register(Source(panos.NAME, panos.detect, panos.STEPS, lambda line, s, c: panos.parse(line, s, c.ingest_ms)))
    return r
