"""Made-up texts."""

WORDS = "alpha beta gamma delta report library river stone paper garden music window market summer winter silver copper forest".split()


def prose(rng, n):
    """Words that do not repeat in a pattern."""
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") + rng.choice("klmnop") for _ in range(n))
