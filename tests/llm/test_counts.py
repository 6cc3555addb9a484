"""Numbers of tokens are those of the ids."""

import random

import public_tokenizers

from trailhead.llm.bpe import Codec


def test_counts_are_the_ids_numbers():
    r = random.Random(7)
    words = ["a", "word", "  two", "\n", "\t x", "Straße", "don't", "x" * 70, "漢字", "123456", "", " ", "foo.bar", "é" * 40]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(30))) for _ in range(300)] + ["", "word " * 600_000]
    c = Codec.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for cache in (96 << 20, 2000):
        c.cache = cache
        for lo in range(0, len(texts), 50):
            part = texts[lo : lo + 50]
            assert c.count_batch(part) == [len(x) // 4 for x in c.encode_batch(part)]
        assert not cache > 2000 or c.counts.of
        c.forget()
        assert not c.counts.of
