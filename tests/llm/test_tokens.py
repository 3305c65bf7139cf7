import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnout.llm import simple8b, tokens


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=700))
@settings(max_examples=150, deadline=None)
def test_round_trip(ids):
    data = simple8b.write_segment([1], np.array([len(ids)]), np.array(ids, np.uint64))
    keys, sizes, back = simple8b.read_segment(data)
    assert keys == [1] and list(sizes) == [len(ids)] and back.tolist() == ids


def test_packing_is_dense():
    words, _, escapes = simple8b.pack(np.zeros(12800, np.uint64))
    assert len(words) == 300 and not len(escapes)
    assert len(simple8b.pack(np.full(1280, 2**61, np.uint64))[2]) == 1280


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    plain, own = Tokenizer.from_file(path), tokens.Encoder(path)
    rng = random.Random(4)
    parts = ["'s", "'", "'re", "'ll", "'ve", "'d", " ", "  ", "\n", "\t", "\r\n", "abc", "é", "日本", "12", "٣", "!",
             "--", " ", " ", "x", "s", "don't", "I'LL", "<|endoftext|>", "\x00", "👍🏽", "​", "\x85", "　", "á"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(4000)]
    ids, counts = own.encode([t.encode() for t in texts])
    expected = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [len(e) for e in expected] == counts.tolist()
    assert ids.tolist() == [i for e in expected for i in e]


@pytest.mark.parametrize("extra", [False, True])
def test_files(spark, documents, extra):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_tokenizer())
    rows = [(5, "b c"), (3, None), (4, ""), (None, "no id"), (9, "long text " * 20000), (5, "b c"), (1, "ünï")]
    out = tokens.tokenized(documents(*rows, extra=extra)).collect()
    start, expected = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        expected.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in out), key=lambda r: r[1]) == expected


def test_empty(documents):
    assert tokens.tokenized(documents()).count() == 0
