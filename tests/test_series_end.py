"""The last shot of a series is smoothed up to the horizon and settles after it."""

import pytest

from chronoweave.operators import series as sr

HOUR = 3_600_000


@pytest.mark.parametrize("last", [10, 800])
def test_last_shot_is_held_to_the_horizon(spark, last):
    rows = [(1, 0, 0, 5.0, False), (1, 1, last * HOUR, 7.0, True), (1, 2, (last + 2) * HOUR, 9.0, False)]
    x = sr.with_shots(spark.createDataFrame(rows, "series_id long, seq long, t_ms long, x double, cut boolean"))
    got = {(r.t_ms // HOUR, r.settle): r.value for r in sr.gaussian_smooth(x, "series_id", 2 * HOUR, HOUR, 31 * 24 * HOUR).collect()}
    held = last < 31 * 24
    assert set(got) == {(0, False), (6, True), (last, False), (last + 2, False)} | ({(last + 8, True)} if held else set())
    assert got[0, False] == pytest.approx(5.0) and (got[last + 2, False] > 8.2) == held
