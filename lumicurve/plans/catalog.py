"""All queries of the light-curve engine: importing this registers them."""

from lumicurve.plans import frames, match, numeric, photometry, reports, rollup, series, trials  # noqa: F401
from lumicurve.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
