"""All queries of the engine by name, each with the SQL it is held against."""

from __future__ import annotations

from landshift.plans import events, imagery, reports, shapes, upkeep

QUERIES: dict = {**imagery.QUERIES, **events.QUERIES, **reports.QUERIES, **upkeep.QUERIES, **shapes.QUERIES}
ORACLES: dict = {**imagery.ORACLES, **events.ORACLES, **reports.ORACLES, **upkeep.ORACLES, **shapes.ORACLES}
