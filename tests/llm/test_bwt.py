import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from groundling.llm._bwt import long_prefixes


def brute(texts, k):
    n = Counter(t[i : i + k] for t in texts for i in range(len(t) - k + 1))
    return [[i for i in range(len(t) - k + 1) if n[t[i : i + k]] > 1] for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab\x00", max_size=40).map(str.encode), min_size=1, max_size=6, unique=True), st.integers(1, 12))
def test_small_alphabet(texts, k):
    assert [x.tolist() for x in long_prefixes(texts, k)] == brute(texts, k)


def test_long_overlaps():
    rng = random.Random(3)
    base = bytes(rng.randrange(97, 123) for _ in range(400))
    texts = {base[rng.randrange(100) : 300 + rng.randrange(100)] for _ in range(40)}
    for _ in range(60):
        t = bytearray(base)
        for _ in range(rng.randrange(3)):
            t[rng.randrange(400)] = rng.randrange(97, 123)
        texts.add(bytes(t))
    texts |= {b"q" * 350, b"ab" * 170, bytes(rng.randrange(256) for _ in range(3000))}
    texts = sorted(texts)
    assert [x.tolist() for x in long_prefixes(texts, 200)] == brute(texts, 200)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), st.integers(1, 2)), min_size=1, max_size=8, unique_by=lambda t: t[0]), st.integers(1, 8))
def test_texts_that_stand_twice(texts, least):
    """As if they were listed twice."""
    both = [t for t, n in texts for _ in range(n)]
    starts = [t[i : i + least] for t in both for i in range(len(t) - least + 1)]
    got = long_prefixes([t for t, _ in texts], least, [n for _, n in texts])
    for (t, _), found in zip(texts, got, strict=True):
        assert found.tolist() == [i for i in range(len(t) - least + 1) if starts.count(t[i : i + least]) > 1]
