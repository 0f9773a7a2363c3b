"""A Spark data source over a ``TileService``: spark.read.format("gridloom_tiles").

Options: ask ("module:function", from a piece to its rows of values), height,
width, and what ``TileService`` takes. Each piece of the plan is a partition.
"""

from __future__ import annotations

from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.sources.drivers import NODATA, Piece, TileService

SCHEMA = "row int, col int, value double"


class PiecePartition(InputPartition):
    def __init__(self, piece: Piece):
        super().__init__(piece)
        self.piece = piece


class TileReader(DataSourceReader):
    def __init__(self, options):
        module, _, function = options["ask"].partition(":")
        numbers = {k: float(options[k]) if k == "wait_s" else int(options[k]) for k in ("max_px", "min_px", "retries", "wait_s") if k in options}
        self.ask, self.numbers = (module, function), numbers
        self.size = int(options["height"]), int(options["width"])

    def _service(self) -> TileService:
        return TileService(getattr(import_module(self.ask[0]), self.ask[1]), **self.numbers)

    def partitions(self):
        return [PiecePartition(p) for p in self._service().plan(*self.size)]

    def read(self, partition):
        for piece, values in self._service().read(partition.piece):
            have = [list(v) for v in values]
            for i in range(piece.height):
                for j in range(piece.width):
                    there = i < len(have) and j < len(have[i])
                    yield piece.row + i, piece.col + j, float(have[i][j]) if there else float(NODATA)


class TileDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridloom_tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TileReader:
        return TileReader(self.options)
