import random

import numpy as np

from groundling.llm import _bwt


def test_boundaries_are_not_copied_each_round(monkeypatch):
    """Strings of ``least`` bytes that occur again, by brute force, over enough rounds for both lists of boundaries; no round may insert into all of them."""
    monkeypatch.setattr(_bwt.np, "insert", lambda *a, **b: (_ for _ in ()).throw(AssertionError("inserted")))
    for seed in range(6):
        r = random.Random(seed)
        word = [bytes(r.choices(b"abcd", k=r.randint(20, 90))) for _ in range(12)]
        texts = list({b"".join(r.choices(word, k=r.randint(1, 12))): 1 for _ in range(60)})
        times = [r.choice((1, 1, 2)) for _ in texts]
        count: dict[bytes, int] = {}
        for t, n in zip(texts, times, strict=True):
            for i in range(len(t) - 59):
                count[t[i : i + 60]] = count.get(t[i : i + 60], 0) + n
        for t, got in zip(texts, _bwt.long_prefixes(texts, 60, times), strict=True):
            assert got.tolist() == np.flatnonzero([count[t[i : i + 60]] > 1 for i in range(len(t) - 59)]).tolist()
