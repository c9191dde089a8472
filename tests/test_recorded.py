"""Recorded sources, of every raster."""

import os

import pytest

from landshift.operators import baseline
from landshift.plans import upkeep
from landshift.plans.bindings import Domain

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_no_raster_has_lost_its_sources(spark):
    d = Domain(spark, SF)
    rasters = {r.id for r in d.change_raster.select("id").collect()}
    held = {r.scene_id for r in baseline.trailing(d.optical).where("place > 1").collect()} & rasters
    replaced = {r.change_raster_id for r in upkeep.sources_replaced(spark, SF).collect()}
    assert replaced == {i for i in rasters if i % 4 > 0}
    got = {r.scene_id for r in upkeep.rebuilt_deltas(spark, SF).collect()}
    assert any(i % 19 == 0 for i in held) and any(i % 19 == 0 for i in got)
    # Half of a raster's priors have a stored index at least, but for those whose number is a multiple of 13.
    named = {r.change_raster_id for r in upkeep.recorded_sources(spark, SF).collect()}
    assert {i for i in held if i % 19 == 0} & named and len(held - named) < len(held) / 100
