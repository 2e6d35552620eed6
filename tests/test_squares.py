"""Squares of boxes against a plain loop."""

import numpy as np

from strataframe.functions import geo
from strataframe.operators import grids

COLUMNS, ROWS, BANDS = ("ABCDEFGH", "JKLMNPQR", "STUVWXYZ"), "ABCDEFGHJKLMNPQRSTUV", "CDEFGHJKLMNPQRSTUVWXX"


def plainly(west, south, east, north):
    out = set()
    for zone in range(int((west + 180) // 6) + 1, int((east + 180) // 6) + 2):
        lon, lat = np.meshgrid(np.linspace(max(west, zone * 6 - 186), min(east, zone * 6 - 180), 12), np.linspace(south, north, 12))
        x, y = geo.metres_of(lon.ravel(), lat.ravel(), zone)
        for e in range(max(1, int((x.min() - 1e4) // 1e5)), min(8, int(x.max() // 1e5)) + 1):
            for n in range(int(y.min() // 1e5), int((y.max() + 1e4) // 1e5) + 1):
                _, middle = geo.degrees_of(np.array([e * 1e5 + 5e4]), np.array([n * 1e5 + 5e4]), zone)
                for at in (middle[0] - 0.5, middle[0], middle[0] + 0.5):
                    row = ROWS[(n + (5 if zone % 2 == 0 else 0)) % 20]
                    out.add(f"{zone:02d}{BANDS[int((at + 80) // 8)]}{COLUMNS[(zone - 1) % 3][e - 1]}{row}")
    return out


def test_squares_of_boxes(spark):
    boxes = [(1, 74.1, 35.6, 74.6, 36.1), (2, 71.4, 35.8, 72.7, 36.6), (3, -0.4, 50.9, 6.3, 52.0), (4, 74.1, 35.6, 74.6, 36.1)]
    df = spark.createDataFrame(boxes, "k int, west double, south double, east double, north double")
    rows = [(x.k, x.square) for x in grids.squares_for(df, "k").collect()]
    assert len(rows) == len(set(rows))
    for k, *box in boxes:
        assert {s for j, s in rows if j == k} == plainly(*box)
    assert {s[:2] for j, s in rows if j == 2} == {"42", "43"}
    assert grids.squares_for(df.filter("k > 9"), "k").count() == 0
