"""Collocations: a word's occurrence makes one fragment at most, whatever the size of a group of equal texts."""

import numpy as np

from rankforge.llm import collocations


def test_fragments_grow_with_words_not_with_groups():
    words = [f"w{i}".encode() for i in range(30)]
    places = collocations.Places({"en": {w: 1000 - i for i, w in enumerate(words)}}, None, 200_000)
    every_pair = np.full(1 << 12, 255, np.uint8)
    rng = np.random.default_rng(3)
    texts = [b" ".join(words[i] for i in rng.integers(0, 30, 40)).decode() for _ in range(5)] + ["w1 w2 " * 20]
    sizes = []
    for copies in (1, 10, 100):
        cut = collocations.cut_out(places, every_pair, "en", texts * copies, 4)
        assert len(cut) <= sum(len(t.split()) for t in texts) * copies
        sizes.append((len(cut), len(set(cut))))
    assert sizes[1][0] == 10 * sizes[0][0] and sizes[2][0] == 100 * sizes[0][0], "in proportion to the copies"
    assert sizes[0][1] == sizes[1][1] == sizes[2][1], "equal fragments of a task are one row"
