import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """A maker of invented texts: the same seed gives the same words."""

    def make(seed, n=120, vocabulary=400):
        r = random.Random(seed)
        words = [f"w{i}" for i in range(vocabulary)]
        return " ".join(r.choice(words) for _ in range(n))

    return make
