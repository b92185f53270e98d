import numpy as np

from groundling.llm import packing


def test_few_parts_at_a_time():
    """However many new words a batch has, a few thousand are tokenised at a time, and ids are as without."""
    tokens = packing.WordTokens(packing.vocabulary_path())
    text = " ".join(f"w{i}x" for i in range(30_000)).encode()
    real, most = tokens.tokenizer, []

    class Spy:
        def encode_batch_fast(self, parts, **k):
            most.append(len(parts))
            return real.encode_batch_fast(parts, **k)

    tokens.tokenizer = Spy()
    ids, bounds = tokens.encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert max(most) <= 10_000
    assert ids.tolist() == [*real.encode(text.decode(), add_special_tokens=False).ids, packing.END_ID] and bounds.tolist() == [0, len(ids)]
