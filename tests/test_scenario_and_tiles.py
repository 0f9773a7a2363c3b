from datetime import datetime

import pytest

from gridloom.functions.nests import solve_nests
from gridloom.plans.scenario import Scenario
from gridloom.sources.drivers import Piece
from gridloom.sources.tile_source import TileDataSource, TileReader


def test_scenario(tmp_path):
    (tmp_path / "s.yaml").write_text("start: 2026-06-01T00:00:00\ncenter: {lon: -96.8, lat: 32.8}\nduration_days: 2\n")
    s = Scenario.load(tmp_path / "s.yaml")
    assert s.end == datetime(2026, 6, 3) and s.max_dom == s.fire_domain == 3
    text = s.namelist_input()
    assert " ifire = 0, 0, 1," in text and " e_we = 112, 169, 253," in text and " time_step = 54," in text and "&chem" not in text
    assert " sr_x = 0, 0, 10," in text and " end_day = 3, 3, 3," in text
    smoke = Scenario(0, 0, s.start, s.nests, smoke=True, fire_level=2)
    assert " chem_opt = 17, 17, 17," in smoke.namelist_input() and " ifire = 0, 1, 0," in smoke.namelist_input()
    assert " start_date = '2026-06-01_00:00:00'," in Scenario(0, 0, s.start, tuple(solve_nests(100, [1000]))).namelist_preprocessor()
    with pytest.raises(ValueError):
        Scenario(0, 0, s.start, ())


def ask(piece: Piece):
    return [[piece.row + i for _ in range(piece.width)] for i in range(piece.height)][:-1] if piece.row else [[0.0] * piece.width] * piece.height


def test_tile_reader():
    reader = TileReader({"ask": f"{__name__}:ask", "height": "5", "width": "3", "max_px": "3"})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(reader.partitions()) == 2 and len(rows) == 15
    assert {r[2] for r in rows if r[0] == 3} == {3.0} and {r[2] for r in rows if r[0] == 4} == {-9999.0}


def test_tile_data_source(spark):
    spark.dataSource.register(TileDataSource)
    df = spark.read.format("gridloom_tiles").option("ask", f"{__name__}:ask").option("height", 4).option("width", 2).load()
    assert df.columns == ["row", "col", "value"]
