import random

import pytest


@pytest.fixture(scope="session")
def prose():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    return lambda n: " ".join(rng.choice(words) for _ in range(n))
