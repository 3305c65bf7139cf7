import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from turnout.llm import alignment, queries

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(FILES[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
_own = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE = {chr(b): b for b in _own} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(_own)))}


def whole(text):
    """[(id, low, high)] of each tokenizer over the whole text; empty if they don't give it back."""
    if not text:
        return [], []
    out = []
    ids = A.encode(" " + text, add_special_tokens=False).ids
    for tokens in ([(i, bytes(BYTE[c] for c in A.id_to_token(i))) for i in ids],
                   [(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else
                     B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]):
        if b"".join(t for _, t in tokens) != (" " + text).encode():
            return [], []
        at, spans = 0, []
        for i, t in tokens:
            spans.append((i, at, at + len(t)))
            at += len(t)
        out.append(spans)
    return tuple(out)


def brute(texts):
    coded = [whole(t) for t in texts]
    links = [[(i, j) for i, low, high in a for j, lo, hi in b if low < hi and lo < high] if len(a) < 200 else
             fast_links(a, b) for a, b in coded]
    counts = Counter(x for own in links for x in own)
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for (a, b), own in zip(coded, links):
        both = sorted({x[2] for x in a} & {x[2] for x in b})
        groups = []
        for low, high in zip([0, *both], both):
            groups.append("|".join(",".join(str(i) for i, s, _ in side if low <= s < high) for side in (a, b))
                          if len(a) < 200 else (low, high))
        if len(a) >= 200:
            groups = fast_groups(a, b, both)
        out.append((len(a), len(b), len(both), len(own), sum(counts[x] == best[x[1]] for x in own),
                    sum(counts[x] for x in own), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    return out


def fast_links(a, b):
    lows = np.array([x[1] for x in b])
    highs = np.array([x[2] for x in b])
    return [(i, b[k][0]) for i, low, high in a for k in range(np.searchsorted(highs, low, "right"), np.searchsorted(lows, high))]


def fast_groups(a, b, both):
    def by_group(side):
        out = [[] for _ in both]
        for (i, _, _), g in zip(side, np.searchsorted(both, [x[2] for x in side])):
            out[g].append(str(i))
        return [",".join(x) for x in out]
    return ["|".join(x) for x in zip(by_group(a), by_group(b))]


def texts():
    rng = random.Random(5)
    pieces = ["the", " Quick", "'s", "'re", "'", "  ", "\n", "\n\n", "\t", " \n ", "Straße", "naïve", "日本語", "中文字", "😀👍🏽", "é",
              "é", " ", "　", "\x00", "\x7f", "​", "ﬀ", "12345", "3.14", "aaaaaaaaaaaaaaaaaaaa", "----", "=======",
              "<|endoftext|>", "<s>", "</s>", "<0x41>", "<unk>", "don't", "WE'LL", "́", "Ω", "пример", "слово", "�", "\U0010ffff", ".", ",",
              "https://a.b/c?d=e", "_", "()", "ing", "ation", " ", " ", " ", " "]
    out = [None, "", " ", "  ", "\n", "a", "▁", "a▁b", "x ▁ y " * 40, "word", "<|endoftext|>", "\x00"]
    for size in [1, 2, 3, 5, 8, 13] * 12 + [40, 80, 200, 400] * 6:
        out.append("".join(rng.choice(pieces) for _ in range(size)))
    out += ["a" * 700, "日本" * 300, " " * 500, "=" * 300 + "\n" * 200 + "x", "-+" * 200, "Ώ" * 200]
    return out + ["Some plain words of a sentence, said twice. " * 30] * 3


@pytest.mark.parametrize("chunk,hot", [(1 << 16, 1 << 17), (1 << 16, 0), (100, 50), (17, 300)])
def test_rows_equal_whole_texts(spark, chunk, hot):
    rows = texts()
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(rows)], "doc_id long, text string, pairs string, row int")
    out = sorted(alignment.aligned(frame.repartition(4), chunk=chunk, hot=hot).collect(), key=lambda r: r.doc_id)
    expected = brute(rows)
    for i, (r, e) in enumerate(zip(out, expected, strict=True)):
        assert (i, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (r.doc_id, *e), rows[i]


def test_ranges_hold_the_whole_text():
    tool = alignment.aligner(*FILES)
    open_ = 0
    for text in texts():
        if not text:
            continue
        data = b" " + text.encode()
        for chunk in (1, 7, 64):
            parts = list(alignment.ranges(text.encode(), tool, chunk))
            for side in "ab":
                assert b"".join(r.data[slice(*getattr(r, side))] for r in parts) == data
            assert all(data[r.base:r.base + len(r.data)] == r.data for r in parts)
            open_ += sum(bool(f.fragment.prefix) for f in tool.align(parts))
    assert open_ > 100


def test_fragments_are_associative():
    rng = random.Random(3)
    tool = alignment.aligner(*FILES)
    for text in texts():
        if not text or "▁" in text:
            continue
        found = tool.align(list(alignment.ranges(text.encode(), tool, 11)))

        def reduced(low, high):
            if high - low == 1:
                return found[low].fragment, list(found[low].texts)
            k = rng.randrange(low + 1, high)
            (left, one), (right, two) = reduced(low, k), reduced(k, high)
            both, groups = left.followed_by(right)
            return both, one + [g.text() for g in groups] + two

        a, b = whole(text)
        expected = fast_groups(a, b, sorted({x[2] for x in a} & {x[2] for x in b}))
        for _ in range(3):
            fragment, groups = reduced(0, len(found))
            assert fragment.closed and not fragment.prefix and not fragment.suffix
            assert b";".join(groups).decode() == ";".join(expected)


def test_repeated_rows_and_no_ids(spark):
    frame = spark.createDataFrame([(1, "two words"), (1, "two words"), (None, "two words"), (None, None)], "doc_id long, text string")
    out = alignment.aligned(frame).collect()
    assert sorted((r.doc_id or 0, r.n_groups) for r in out) == [(0, 0), (0, 2), (1, 2), (1, 2)]
    assert {r.count_sum for r in out} == {0, 6}
    assert alignment.aligned(frame.limit(0)).collect() == []


def test_query_equals_whole_texts(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    out = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op11_tokenizer_alignment"](spark, folder).collect()}
    assert out == dict(zip([r.doc_id for r in docs], brute([r.text for r in docs])))
