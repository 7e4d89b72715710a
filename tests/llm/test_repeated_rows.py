"""Substring dedup where the earliest row is repeated."""

import random

from chunklake.llm import suffixes

from . import brute
from .test_llm import _removed, prose


def test_a_repeated_earliest_row_stays(frame, monkeypatch):
    rnd = random.Random(6)
    shared = prose(rnd, 60, "abcdefghijklm")
    rows = [(1, prose(rnd, 30, "nopqrst") + " " + shared + " " + prose(rnd, 30, "nopqrst")), (2, prose(rnd, 30, "uvwxyz") + " " + shared + " " + prose(rnd, 30, "uvwxyz"))]
    expected = brute.substrings(rows)
    assert expected[1][1] == 0 < expected[2][1]
    for largest in (suffixes.LARGEST, 1):
        monkeypatch.setattr(suffixes, "LARGEST", largest)
        assert _removed(frame([rows[0], *rows])) == expected
