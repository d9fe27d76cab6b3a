"""All registered queries of the engine and the SQL they are checked against."""

from . import browse, more, quality, search, stored, telemetry

_PLANS = (search, browse, telemetry, quality, more, stored)
QUERIES: dict = {k: v for p in _PLANS for k, v in p.QUERIES.items()}
ORACLES: dict = {k: v for p in _PLANS for k, v in p.ORACLES.items()}
