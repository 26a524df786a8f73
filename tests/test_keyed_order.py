"""The first row of a key without sorting frames, and parts of a stream without gathering rows."""

import inspect

import numpy as np
import pandas as pd

from gleanwork import queries_tables
from gleanwork.streaming.keyed import _least


def test_least_is_what_a_stable_sort_puts_first():
    random = np.random.default_rng(7)
    for n in (1, 2, 5, 40):
        for _ in range(50):
            rows = pd.DataFrame({"a": random.choice([1.0, 2.0, np.nan], n), "b": random.choice(["x", "y", None], n), "at": range(n)})
            for by in (["a", "b"], ["b", "a"], ["a"]):
                assert rows.iloc[_least(rows, by)]["at"] == rows.sort_values(by, kind="stable").iloc[0]["at"]
            assert _least(rows, []) == 0


def test_events_are_not_gathered_in_one_task():
    text = inspect.getsource(queries_tables.keyed_stream)
    assert "F.ntile(" not in text
    assert "coalesce(1)" not in text
