"""The score map agrees with the score around each middle."""

import pytest

from cartospark import testmap
from cartospark.operators import scores

SF = "/root/testdata/sf0.001"


def test_cells_have_the_score_of_their_middle(spark):
    m = testmap.star(spark, SF)
    rows = {(r["cell_y"], r["cell_x"]): r for r in scores.walkability_map(m, radius=9000.0, bounds=(51.2, -0.3, 51.6, 0.3), cells=(2, 3)).collect()}
    assert len(rows) == 6
    for key in ((0, 0), (1, 2)):
        one = scores.walkability(m, rows[key]["lat"], rows[key]["lon"], 9000.0).first()
        for c in ("intersections", "n_food", "n_transit", "crossings", "signals", "greens", "grade"):
            assert rows[key][c] == one[c], c
        assert rows[key]["score"] == pytest.approx(one["score"])
    by_step = scores.walkability_map(m, step=20_000.0, radius=9000.0).collect()
    assert len(by_step) > 4 and {r["cell_y"] for r in by_step} == set(range(max(r["cell_y"] for r in by_step) + 1))
