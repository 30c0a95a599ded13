"""Long and hostile lines of the secret scan, and recall of its random strings."""

import random
import string
import time

import pytest

from glyphlake.llm import secrets


@pytest.fixture(scope="module")
def test_of():
    return secrets.RandomStrings()


@pytest.mark.parametrize("line", [f"a1{c * 1_000_000}Ab3cd9x" for c in "-_=/+"] + ["a/" * 500_000, "aB3" * 300_000, "password" * 100_000], ids=lambda s: s[:6])
def test_long_lines_take_linear_time(test_of, line):
    began = time.perf_counter()
    secrets.spans(line, line.encode().lower(), test_of)
    assert time.perf_counter() - began < 10


@pytest.mark.parametrize(("letters", "n"), [(string.ascii_letters + string.digits, 16), (string.ascii_letters + string.digits, 20), (string.ascii_letters, 32), (string.ascii_letters + string.digits + "+/", 40)])
def test_random_strings_are_found(test_of, letters, n):
    rng = random.Random(n)
    lines = ["the key " + "".join(rng.choices(letters, k=n)) + " stands here" for _ in range(500)]
    lines += ["connection_string_for_database=" + "".join(rng.choices(letters, k=n)) for _ in range(500)]
    assert sum(bool(list(test_of.spans(s))) for s in lines) >= 0.99 * len(lines)
