"""Input relations, the binding of the driver tables, and sinks."""

from spendlens.sources.relations import SCHEMAS, conform, one_per_key
from spendlens.sources.sinks import write_report

__all__ = ["SCHEMAS", "conform", "one_per_key", "write_report"]
