"""Texts that the tests of this folder share."""

import random


def words(seed, n: int) -> str:
    """Some text of n words."""
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


#: Null, empty, blank and very long texts, equal texts, rows that repeat, a missing id.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one  two\nthree"), (6, "one two three"), (6, "one two three"), (7, words(1, 60_000)),
       (8, words(1, 60_000)), (9, "ÀÉ ñ ß 日本語   x  y"), (None, "no id"), (10, "x" * 3000), (11, words(2, 40)), (12, words(2, 40) + " more")]
