"""Rare toxic words in a large sample."""

import numpy as np

from loomgraph.llm import toxicity


def test_rare_words_are_learned():
    """A word that 4 of 3,000 texts hold, as one that 4 of 300 hold."""
    rng = np.random.default_rng(7)
    plain = ["".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(400)]
    for n in (300, 3000):
        texts = [" ".join(rng.choice(plain, 12)) for _ in range(n)]
        labels = np.zeros(n, np.int64)
        for i in range(0, n, 3):
            labels[i], texts[i] = 1, texts[i] + " grumblefuzz"
        for i in range(1, 61, 15):
            labels[i], texts[i] = 1, texts[i] + " kwhyxvq"
        table = toxicity.train(texts, labels)
        bucket, _ = toxicity.features(["kwhyxvq"])
        assert not np.isnan(table[bucket]).any()
        assert np.mean(table[bucket]) > 0
