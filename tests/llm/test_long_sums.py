"""Likeness of texts with more equal lines than 16 bits count."""

import pytest

from lotlens.llm import multiset


def test_many_equal_lines():
    for many, fewer in ((40_000, 30_000), (100_000, 75_000)):
        whole = multiset.fingerprint("one line\n" * many)
        part = multiset.fingerprint("one line\n" * fewer)
        assert whole.likeness(part) == pytest.approx(1, abs=1e-6)
        assert (whole - multiset.fingerprint("one line\n" * (many - fewer))).hex() == part.hex()
    mixed = multiset.fingerprint("one line\n" * 100_000 + "another\n" * 100_000)
    assert 0.5 < mixed.likeness(multiset.fingerprint("one line\n" * 100_000)) < 0.9
