"""Blocks of small pieces draw what their pieces would draw, and hand on less."""

import pytest
from pyspark.sql import functions as F

from regdata.operators import resample


@pytest.mark.parametrize("piece, fan", [(16, 1024), (4, 3), (100, 2)])
def test_blocks_draw_as_their_pieces(spark, monkeypatch, piece, fan):
    rows = spark.range(250).select(F.when(F.col("id") < 230, "a").otherwise("b").alias("g"), "id", (F.col("id") % 17 * 1.5).alias("_x"), (F.col("id") % 5 + 1.0).alias("_w"))
    monkeypatch.setattr(resample, "CHUNK", 100)  # a split of several chunks

    def sums():
        found = resample._drawn_sums(rows, ["g"], "id", 20, 3, piece, fan)
        return found.count(), {(r.g, r.rep): (r.a, r.b) for r in found.groupBy("g", "rep").agg(F.sum("_wx").alias("a"), F.sum("_ww").alias("b")).collect()}

    n, blocks = sums()
    assert n <= 20 * sum(-(-rows_of // (piece * fan)) for rows_of in (230, 20))  # before, up to one row per piece and replicate
    monkeypatch.setattr(resample, "BLOCK", 0)
    _, pieces = sums()
    assert len(pieces) == 40 and blocks.keys() == pieces.keys()
    assert all(blocks[k] == pytest.approx(v) for k, v in pieces.items())
