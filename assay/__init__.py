"""Evidence scoring over an append-only log of scans and verdicts, as Spark jobs."""

from .params import Bands, Params, Skew

__all__ = ["Bands", "Params", "Skew"]
