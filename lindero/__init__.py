"""Set-at-a-time parcel location, planning enrichment and offset calibration on Spark."""

from lindero.registry import DEFAULT_REGISTRY, Municipality

__all__ = ["DEFAULT_REGISTRY", "Municipality"]
