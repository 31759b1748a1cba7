"""Texts at the edges, and random ones."""

import random

DATA = "/root/testdata/sf0.001"

#: Texts at the edges: null, empty, white space, few words, other scripts, ties, very long.
ODD = [
    None,
    "",
    "   ",
    " \n\t\r\x0b\x0c ",
    "a",
    "one two three",
    "One TWO three",
    "one two three four",
    "  lead and  double   spaces \n\n and lines \n",
    "café ünïcode 漢字 テスト 🎉🎉 ½ ² 　wide\xa0space",
    "special <|endoftext|> </s> [INST] x [/INST] <s> ▁meta ▁",
    "nul \x00 and \x1c separators",
    "mail a.b@c.example.com, +1 (543) 555-1435 4111 1111 1111 1111 10.0.0.255 999.1.1.1",
    "x" * 70_000,
    "word " * 30_000,
    "1.2.3.4 " * 3_000,
]


def odd_rows():
    """(doc_id, text) with every odd text twice and a null id."""
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100 + k, t) for k, t in enumerate(ODD)]
    return [*rows, (None, "a row without an id"), (200, "same id"), (200, "same id")]


def noise(seed, n, alphabet, longest=60):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, longest))) for _ in range(n)]
