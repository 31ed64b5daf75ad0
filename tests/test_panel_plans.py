"""The reports on the panel take the grid where it was exploded: coalescing by bytes could give one task any number of its rows."""

import re

import pytest

from panelcast.operators import panel
from panelcast.plans import jobs  # noqa: F401  (registers its queries)
from panelcast.plans.queries import QUERIES

NAMES = ["metrics_overall_and_group", "restricted_panel", "null_audit", "rolling_means", "export_projection", "interval_status", "bias", "champion", "error_by_hour", "latest_runs", "leaderboard", "model_board"]


def first_above(lines, i):
    """The first window, join or exchange on the way up from line i of a plan, by the names of its operators."""
    depth = lambda line: re.search(r"[A-Za-z]", line).start()
    at = depth(lines[i])
    for line in reversed(lines[:i]):
        if depth(line) < at:
            at = depth(line)
            name = re.search(r"\w+", line).group()
            if re.search(r"Window|Join|Exchange", name):
                return name


@pytest.mark.parametrize("name", NAMES)
def test_no_grid_is_shuffled_before_its_windows_and_joins(spark, data_dir, name, monkeypatch):
    monkeypatch.setattr(panel, "TASK_ROWS", 2_000, raising=False)
    lines = QUERIES[name](spark, data_dir)._jdf.queryExecution().executedPlan().toString().splitlines()
    grids = [i for i, line in enumerate(lines) if "Generate explode(" in line]
    assert grids and {first_above(lines, i) for i in grids}.isdisjoint({"Exchange", None})  # few active keys may be broadcast
