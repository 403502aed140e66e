"""What the CPU time of the Katz model rests on: plain sorts in place of sorted places, no Python loop over contexts."""

import numpy as np
import pytest

from pointmill.llm import common, katz


@pytest.mark.parametrize(
    "values",
    [[], [5], [7, 7, 7], [3, 0, 2**40, 3, 0], [2**63 - 1, 0, 2**63 - 1, 2**62], [2**62 + 1, 2**62, 2**62 + 1, 2**62 + 3, 5]],
)
@pytest.mark.parametrize("kind", [np.int64, np.uint64])
def test_ranks_equal_unique(values, kind):
    # the last ones differ only in bits that their places take
    values = np.array(values, kind)
    for got, want in zip(common.ranked(values), np.unique(values, return_inverse=True), strict=True):
        assert got.dtype == want.dtype and got.tolist() == want.tolist()


def test_ranks_of_many_hashes_equal_unique():
    values = common.mix64(np.random.default_rng(5).integers(0, 5_000, 40_000))
    for got, want in zip(common.ranked(values), np.unique(values, return_inverse=True), strict=True):
        assert (got == want).all()


def chunk_of(tokens, held, n, order, hot, buckets):
    """A chunk of words 0, 1, ..., the last of which is the end of texts, with numbers a stranger would give."""
    hashes = np.sort(np.append(common.mix64(np.arange(1, tokens.max() + 2)), katz._END))
    end = int(np.searchsorted(hashes, katz._END))
    tokens = tokens + (tokens >= end)
    numbers = katz.FIRST + np.random.default_rng(1).permutation(hashes.size)
    total = np.bincount(tokens, minlength=hashes.size) + 1
    total[end] = len(n)
    row = {"words": common.packed_sorted(hashes), "held": common.squeezed(held.astype(np.int64)), "n": common.squeezed(n), "tokens": common.squeezed(tokens)}
    return katz.Chunk(row, [{"a": common.squeezed(numbers), "b": common.squeezed(total)}], buckets, hot, order), tokens, numbers, end


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("hot", [10**6, 500])
def test_a_chunk_is_built_without_sorting_places(monkeypatch, order, hot):
    rng = np.random.default_rng(2)
    n = np.array([0, 3_000, 1, 0, 6_999])
    held = np.array([False, False, True, True, False])
    sorted_places, unique = [], np.unique
    with monkeypatch.context() as m:
        m.setattr(np, "unique", lambda x, *a, **k: (sorted_places.append(x.size), unique(x, *a, **k))[1])
        c, tokens, numbers, end = chunk_of((rng.random(n.sum()) ** 3 * 200).astype(np.int64), held, n, order, hot, 7)
    assert sum(sorted_places) == 0
    # the n-grams of every token, by plain Python
    grams, counts, at = [], {}, 0
    for size, out in zip(n.tolist(), held.tolist(), strict=True):
        s = [katz.BEGIN] * (order - 1) + [int(numbers[t]) for t in [*tokens[at : at + size], end]]
        at += size
        for j in range(order - 1, len(s)):
            grams.append((s[j - 1], s[j], *s[j - 2 : j - 1]) if order == 3 else (s[j - 1], s[j]))
            counts[grams[-1]] = counts.get(grams[-1], 0) + (not out)
    bigram = c.gram[0]
    assert [tuple(x) for x in np.stack([c.names[c.head[bigram]], c.names[c.tail[bigram]]], 1).tolist()] == [g[:2] for g in grams]
    if order == 3:
        assert (c.parent[0][c.gram[1]] == bigram).all() and c.names[c.key[0][c.gram[1]]].tolist() == [g[2] for g in grams]
    assert len(set(c.gram[-1].tolist())) == len(counts) == c.counts().size
    assert [counts[g] for g in grams] == c.counts()[c.gram[-1]].tolist()
    assert (np.diff(c.bucket) >= 0).all() and len({*zip(c.bucket.tolist(), c.head.tolist(), c.tail.tolist(), strict=True)}) == c.bucket.size
    spread = [len({*c.bucket[c.names[c.head] == x].tolist()}) for x in c.names.tolist()]
    assert (max(spread) > 1) == (hot == 500)


def test_split_contexts_equal_the_formula_one_by_one():
    rng = np.random.default_rng(3)
    names = np.sort(rng.choice(10**6, 50, replace=False))
    pick = lambda: rng.integers(0, names.size, 200)
    near, far = pick(), pick()
    sums = {}
    for v in near.tolist():
        sums.setdefault((0, v, v), (float(rng.integers(1, 9)), float(rng.integers(1, 9)), rng.random()))
    del sums[0, near[0].item(), near[0].item()]
    for v, u in zip(near.tolist(), far.tolist(), strict=True):
        sums[1, v, u] = (9.0, 9.0 if u % 2 else 7.5, rng.random() / 2)
    keys = list(sums)
    row = lambda some: {"a": common.squeezed(np.array([(k, names[v], names[u]) for k, v, u in some]).T.ravel()), "b": np.array([sums[k] for k in some]).tobytes()}
    split = katz.SplitContexts([row(keys[:120]), row(keys[100:])], names)
    other = (names.size - 1 - near) % names.size
    for level, v, u in ((0, near, near), (1, near, far), (1, other, far)):
        told, (weight, full) = split.whole(level, v, u)
        assert told.tolist() == [(level, *x) in sums for x in zip(v.tolist(), u.tolist(), strict=True)]
        for w, f, x in zip(weight, full, np.stack([v, u], 1)[told].tolist(), strict=True):
            n, mass, lower = sums[level, *x]
            if level and (shorter := sums.get((0, x[0], x[0]))):
                lower *= katz.scale_of(katz.backoff(*(np.array([shorter[j]]) for j in (1, 2, 0)))[1], np.array([shorter[0]]))[0]
            want = katz.backoff(*(np.array([y]) for y in (mass, lower, n)))
            assert (w, f) == (want[0][0], want[1][0])
    nothing, (weight, _) = katz.SplitContexts([], names).whole(1, near, far)
    assert not nothing.any() and not weight.size
