from __future__ import annotations

import numpy as np

from tonegrid.llm import quality


def network():
    rng = np.random.default_rng(6)
    shape = (2 * quality.PAIRS, quality.EMBED, quality.FILTERS)
    return quality.Network(rng.normal(size=(256, quality.EMBED)), rng.normal(size=shape), np.zeros(quality.FILTERS), np.ones(quality.FILTERS), 0.0)


def test_a_pattern_is_found_at_even_and_odd_offsets():
    net, size = network(), 2 * quality.PAIRS
    text = "The quick brown fox jumps over the lazy dog"
    raw = np.frombuffer(text.encode().ljust(2 * quality.CHUNK + size, b"\0"), np.uint8)
    from_every_byte = np.array([np.einsum("ke,kef->f", net.embed[raw[i : i + size]], net.filters) for i in range(2 * quality.CHUNK)])
    assert np.allclose(net.pooled(text), np.maximum(from_every_byte.max(0), 0), rtol=1e-4, atol=1e-4)


def test_training_sees_a_pattern_at_odd_offsets():
    rng = np.random.default_rng(8)

    def text(y, odd):
        words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(12)]
        return " " * (20 + odd) + " ".join(words[:6]) + (" ZQXJ " if y else " ") + " ".join(words[6:])

    model = quality.fit([(text(i % 2, 0), i % 2) for i in range(160)], epochs=8)
    right = [(model.score(text(i % 2, 1)) >= 0.5) == bool(i % 2) for i in range(100)]
    assert np.mean(right) >= 0.95
