import random

import pytest

from loomspark.llm.suffixes import suffix_array


@pytest.mark.parametrize("seed", range(6))
def test_against_sorting(seed):
    r = random.Random(seed)
    for _ in range(400):
        text = [r.randint(1, r.choice([1, 2, 3, 255])) for _ in range(r.randint(0, 60))]
        if r.random() < 0.3:
            text = text[: len(text) // 3] * 3
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_long_runs():
    for text in (b"a" * 5000, b"ab" * 3000, bytes(range(1, 256)) * 20, b"mississippi" * 300):
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
