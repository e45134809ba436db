"""Every registered query of the core runs; those with SQL match it."""

import pytest

from pagelume.plans import queries
from tests.compare import DATA, same


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_its_sql(spark, name):
    same(queries.QUERIES[name](spark, DATA), queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() > 0


def test_skew_estimates_find_the_drawn_angles(spark):
    rows = queries.skew_estimates(spark, DATA).collect()
    assert len({r.drawn for r in rows}) > 20
    for r in rows:
        # Under half a degree a line of 144 pixels rises by about one, and whole rows draw the estimate to the level.
        assert r.ok and not r.railed and abs(r.deg - r.drawn) <= (0.4 if abs(r.drawn) > 0.5 else 0.65)
        assert r.spread is not None and r.spread <= 1
        assert abs(r.alt_deg - r.drawn) <= 1 and abs(r.left) <= 1.5 and abs(r.converge - (r.left - r.right)) < 1e-9
    total = queries.skew_totals(spark, DATA).first()
    assert tuple(total) == (len(rows), len(rows), len(rows))


def test_skew_census_tells_missing_and_unmeasured_rasters_apart(spark):
    from pagelume.operators import skew

    df = spark.createDataFrame([(None, None), (3, False), (900, True)], "points bigint, ok boolean")
    assert tuple(skew.census(df).first()) == (3, 2, 1)
    assert tuple(skew.census(df.limit(0)).first()) == (0, 0, 0)


@pytest.mark.parametrize("degrees", [-10.0, -2.0, -0.5, 0.5, 2.0, 10.0])
def test_skew_of_drawn_pages_is_counter_clockwise_and_square(degrees):
    import numpy as np

    from pagelume.operators import skew

    got = skew.measure(skew.ruled(degrees, np.zeros(64), side=900, pitch=20, thick=6, margin=120))
    # Over 660 pixels a line drawn in whole pixels can't tell angles nearer than about 0.05 apart.
    assert got["ok"] and abs(got["deg"] - degrees) <= 0.075 and abs(got["alt_deg"] - degrees) <= 0.1
    assert got["edges_ok"] and abs(got["left"]) <= 0.3 and abs(got["converge"]) <= 0.3 and 0 <= got["spread"] <= 0.1


def test_skew_tells_a_keystone_and_what_cannot_be_measured():
    import numpy as np

    from pagelume.operators import skew

    y, x = np.indices((900, 900))
    narrow = 120 + (y - 120) * np.tan(np.radians(3))
    page = np.where((y >= 120) & (y < 780) & (x >= narrow) & (x <= 899 - narrow) & (y % 20 < 6), 0, 255).astype(np.uint8)
    got = skew.measure(page)
    # A side lies 5 % in from the end of its lines, so nine tenths of the angle between the ends shows.
    assert got["ok"] and abs(got["deg"]) <= 0.075 and got["edges_ok"] and abs(abs(got["converge"]) - 5.4) <= 0.2
    noise = np.where(np.random.default_rng(1).random((400, 400)) < 0.1, 0, 255).astype(np.uint8)
    got = skew.measure(noise)
    assert not got["ok"] and got["deg"] == 0 and got["alt_deg"] == 0 and got["points"] > 500
    assert skew.measure(np.full((300, 300), 255, np.uint8))["spread"] == -1


def test_sauvola_kernel_at_its_window_matches_plain_sums():
    import numpy as np

    from pagelume.operators import raster

    grey = np.random.default_rng(3).integers(0, 256, (40, 50)).astype(np.uint8)
    want = np.zeros(grey.shape, bool)
    for i in range(40):
        for j in range(50):
            part = grey[max(0, i - 15) : i + 16, max(0, j - 15) : j + 16].astype(float)
            m = part.mean()
            want[i, j] = grey[i, j] < m * (1 + 0.5 * (np.sqrt(max((part**2).mean() - m * m, 0)) / 128 - 1))
    got = raster.sauvola(grey)
    assert got.shape == want.shape and (got == want).mean() > 0.999
