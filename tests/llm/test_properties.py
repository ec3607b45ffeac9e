"""Properties that hold for any input."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rivulet.llm.kd_search import search
from rivulet.llm.mixing import permuted, slots_for, targets
from rivulet.llm.near_dedup import min_hashes, mix, odd_sketch, packed, unpacked
from rivulet.llm.packing import BestFit, cut
from rivulet.llm.secrets import encode, infer


@given(st.lists(st.integers(1, 64), max_size=80), st.integers(1, 8))
def test_bins_never_overflow(lengths, open_bins):
    fit, filled = BestFit(64, open_bins), {}
    for n in lengths:
        b, offset = fit.add(n)
        assert filled.get(b, 0) == offset
        filled[b] = offset + n
        assert filled[b] <= 64 and fit.n_open <= open_bins


@given(st.integers(1, 10_000), st.integers(1, 600))
def test_pieces_cover_a_document(length, most):
    at = 0
    for k, (start, n) in enumerate(cut(length, most)):
        assert start == at and (n == most or k == 0) and 0 < n <= most
        at += n
    assert at == length


@given(st.lists(st.integers(0, 10_000), max_size=12))
def test_targets_share_all(sizes):
    got = targets(sizes)
    assert abs(sum(got) - 1.5 * sum(sizes)) < 1e-6 * max(1, sum(sizes))
    assert all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes, strict=True))
    assert all(slots_for(s, t, 64, 2) <= 2 * -(-s // 64) for t, s in zip(got, sizes, strict=True))


@given(st.integers(1, 3000), st.integers(0, 1 << 40))
@settings(max_examples=30)
def test_permutations(n, key):
    assert sorted(permuted(np.arange(n), n, key).tolist()) == list(range(n))


@given(st.lists(st.text("abcXYZ019=-_", min_size=1, max_size=12), min_size=1, max_size=60))
@settings(max_examples=40, deadline=None)
def test_automata_are_distributions(strings):
    a = infer(strings)
    assert np.allclose(np.exp(a.log_p).sum(axis=1), 1)
    assert a.following.min() >= 0 and a.following.max() < len(a.log_p)
    assert np.isfinite(a.likelihoods(*encode(strings))).all()


@given(st.integers(20, 400), st.floats(0.5, 0.99), st.integers(0, 1000))
@settings(max_examples=25, deadline=None)
def test_samples_estimate_similarity(n, share, seed):
    rng = np.random.default_rng(seed)
    both = mix(rng.integers(0, 1 << 63, n).astype(np.uint64))
    extra = mix(rng.integers(0, 1 << 63, 2 * max(1, int(n * (1 - share) / share / 2))).astype(np.uint64))
    x, y = np.r_[both, extra[::2]], np.r_[both, extra[1::2]]
    true = len(both) / (len(both) + len(extra))
    a, b = min_hashes(x), min_hashes(y)
    assert abs((a == b).mean() - true) < 0.25
    assert int(np.unpackbits((odd_sketch(a) ^ odd_sketch(b)).view(np.uint8)).sum()) <= 2 * int((a != b).sum())
    assert (unpacked(packed(x)) == (x & np.uint64((1 << 48) - 1))).all()


@given(st.integers(1, 60), st.integers(1, 6), st.integers(1, 5), st.integers(0, 99))
@settings(max_examples=30, deadline=None)
def test_search_is_exact(n, dim, k, seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-5, 6, (n, dim)).astype(float)
    ids = rng.permutation(n).astype(np.int64)
    got = search(ids, points, ids[:3], points[:3], np.full(3, -np.inf)[: len(ids[:3])], k)
    want = []
    for q, v in zip(ids[:3].tolist(), points[:3], strict=True):
        want += [(q, i, int(-s)) for s, i in sorted((-float(v @ w), i) for i, w in zip(ids.tolist(), points, strict=True) if i != q)[:k]]
    assert sorted(got) == sorted(want)
