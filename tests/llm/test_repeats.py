import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnout.llm import passages, repeats, substrings


def brute(rows, window, words):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        s = (re.findall(r"[^\x20\x09-\x0D]+", text or "")) if words else (text or "").encode()
        gone = [False] * len(s)
        for p in range(len(s) - window + 1):
            w = tuple(s[p:p + window])
            if w in seen:
                gone[p:p + window] = [True] * window
            seen.add(w)
        kept = [x for x, g in zip(s, gone) if not g]
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(s), sum(gone), spans, " ".join(kept) if words else bytes(kept)))
    return sorted(out, key=repr)


@given(st.lists(st.lists(st.binary(max_size=6), max_size=30), max_size=9))
@settings(max_examples=200, deadline=None)
def test_merge(runs):
    runs = [sorted(r) for r in runs]
    share = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    commons = [[0] + [share(a, b) for a, b in zip(r, r[1:])] for r in runs]
    owner, common = substrings.merge(runs, commons)
    heads, out = [0] * len(runs), []
    for r in owner:
        out.append(runs[r][heads[r]])
        heads[r] += 1
    assert out == sorted(x for r in runs for x in r)
    assert common[1:] == [share(a, b) for a, b in zip(out, out[1:])]


@given(st.lists(st.integers(0, 5), min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_subtree(common):
    common[0] = 0
    tree = passages.Subtree(np.array(common))
    for length in range(1, 6):
        same = np.cumsum(np.array(common) < length)
        loci = tree.loci(length)
        for a in range(len(common)):
            for b in range(len(common)):
                assert (loci[a] == loci[b]) == (same[a] == same[b])


def corpus(rng, unit):
    """Documents with shared passages, copies, near copies, periodic and odd ones."""
    rows, shared = [], [unit(rng, 60) for _ in range(6)]
    for k in range(60):
        parts = [unit(rng, int(rng.integers(1, 40))) for _ in range(4)]
        parts.insert(int(rng.integers(4)), shared[k % 6][: int(rng.integers(1, 400))])
        rows.append((100 - k, " ".join(parts)))
    rows += [(200 + k, rows[k % 7][1]) for k in range(15)]
    rows += [(300 + k, rows[0][1][:150] + f" changed{k} " + rows[0][1][170:]) for k in range(90)]
    rows += [(500, "ab " * 300), (501, "a" * 700), (502, None), (503, ""), (504, "short"), (505, "\x00" * 250 + "x\x00y"),
             (506, "\x00" * 180), (507, "é" * 333), (508, "ab  \n" * 90)]
    return rows


def unit(rng, n):
    return " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 5))) for _ in range(n))


@pytest.mark.parametrize("frequent, size", [(1 / 16, 1 << 25), (0.0, 1 << 25), (1 / 16, 1000)])
def test_bytes(spark, documents, monkeypatch, frequent, size):
    monkeypatch.setattr(repeats, "FREQUENT", frequent)
    monkeypatch.setattr(repeats, "GROUP_BYTES", size)
    rows = corpus(np.random.default_rng(2), unit)
    out = substrings.without_repeats(documents(*rows, extra=bool(frequent) and size > 1000), window=30, core=12).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.starts), bytes(r.kept)) for r in out), key=repr)
    assert got == brute(rows, 30, False)


@pytest.mark.parametrize("frequent, size", [(1 / 16, 1 << 25), (0.0, 1 << 25), (1 / 16, 1000)])
def test_words(spark, documents, monkeypatch, frequent, size):
    monkeypatch.setattr(repeats, "FREQUENT", frequent)
    monkeypatch.setattr(repeats, "GROUP_BYTES", size)
    rows = corpus(np.random.default_rng(3), unit)
    out = passages.without_repeats(documents(*rows, extra=bool(frequent) and size > 1000), window=9, core=4).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, len(r.starts), r.kept) for r in out), key=repr)
    assert got == brute(rows, 9, True)


@pytest.mark.parametrize("operator", [substrings, passages])
def test_edges(documents, operator):
    assert operator.without_repeats(documents()).count() == 0
    text = "one two three four five six seven eight nine ten " * 4
    out = operator.without_repeats(documents((1, text[:-40]), (None, text), (1, text[:-40]), (2, "x"))).collect()
    removed = sorted((r.doc_id or 9, r.n_removed) for r in out)
    assert [d for d, _ in removed] == [1, 1, 2, 9]
    assert removed[1][1] == (len(text[:-40]) if operator is substrings else len(text[:-40].split()))
    assert removed[2] == (2, 0) and removed[3][1] > 0


def _group_sizes(spark, monkeypatch, operator, docs, size, **kind):
    """(most suffixes in a group, tasks times groups) of the exchange that ``operator`` sorts."""
    monkeypatch.setattr(repeats, "GROUP_BYTES", size)
    seen, plain = [], repeats.exchanged

    def spy(rows, dealt, *order):
        if not order and len(rows.columns) > 6:
            seen.append((rows, dealt))
        return plain(rows, dealt, *order)

    monkeypatch.setattr(repeats, "exchanged", spy)
    operator.without_repeats(docs, **kind)
    rows, dealt = seen[0]
    counts = {}
    for r in rows.where("kind = 0").select("part", "at").collect():
        counts[r.part] = counts.get(r.part, 0) + len(r["at"]) // 4
    return max(counts.values()), dealt[0] * dealt[1]


@pytest.mark.parametrize("operator, notice", [
    (substrings, "All rights reserved. See the license for details of the use."),
    (passages, "all rights reserved see the license for details of its use today")])
def test_a_shared_notice_is_spread(spark, documents, monkeypatch, operator, notice):
    """A notice in every text that is shorter than a window: its suffixes go to many groups."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows = [(k, " ".join([*(word() for _ in range(30)), notice, *(word() for _ in range(30))])) for k in range(400)]
    most, parts = _group_sizes(spark, monkeypatch, operator, documents(*rows), 4000)
    assert parts >= 32
    assert most <= 400  # one group for each core would hold the slices of all texts


def test_groups_follow_the_text(spark, documents, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_BYTES", 100)
    tasks, each = repeats.groups(documents((1, "x" * 5000), (2, None)))
    assert each == -(-5000 // (100 * tasks))
    assert repeats.groups(documents())[1] == 1
