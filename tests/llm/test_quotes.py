"""Verbatim quotes from the middle of a longer benchmark item, at all offsets."""

import random

from glossa.llm import decontam
from tests.llm.test_small import words


def test_quotes_at_all_offsets_are_found():
    rng = random.Random(8)
    item = words(rng, 70, 10**6)
    index = decontam.Index.of([(1, s) for _, s in decontam.segments(item.encode())])
    assert len(item) > 400
    for k in range(len(item) - 111 + 1):
        quote = item[k:k + 111]
        text = f"{words(rng, 8, 10**6)} {quote} {words(rng, 8, 10**6)}"
        assert any(d == 0 for _, d, _, _ in index.find(text.encode())), k
