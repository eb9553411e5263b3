"""The alignment of pages, at any length."""

import itertools
import random

from loanlens.llm import wrappers


def test_alignment_does_not_depend_on_length():
    """The longest common row, by a plain table on small lists, and on gaps of over four million pairs."""
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("uvwxyz") for _ in range(rng.randrange(30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        blocks = wrappers._common(a, b)
        assert sum(n for *_, n in blocks) == table[-1][-1]
        assert all(a[x : x + n] == b[y : y + n] for x, y, n in blocks)
        assert all(p[0] + p[2] <= q[0] and p[1] + p[2] <= q[1] for p, q in itertools.pairwise(blocks))
    body = ["<b", ">b", "<i", ">i"]
    small, large = (["<p"] + body * k + ["<u"] + body * k + [">p"] for k in (10, 700))
    for a in (small, large):
        b = ["<q"] + a[1:-1] + [">q"]
        b[len(b) // 2] = "<s"
        assert sum(n for *_, n in wrappers.matching(a, b)) == len(a) - 3
