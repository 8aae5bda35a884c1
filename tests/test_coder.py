import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from octoweave.plans import codec, ssm
from octoweave.plans.coder import TOTAL, integer_cdf
from octoweave.plans.predictor import CountModel


def model_of(lanes, order=1):
    table = np.zeros((256, 256) if order else (1, 256), np.int64)
    for x in lanes:
        for a, b in zip(x[:-1], x[1:]):
            table[a if order else 0, b] += 1
    return CountModel(table)


def check(lanes, model):
    streams = codec.encode(lanes, model)
    first, sizes = np.array([x[0] if len(x) else 0 for x in lanes]), np.array([len(x) for x in lanes])
    for a, b in zip(lanes, codec.decode(streams, first, sizes, model)):
        assert np.array_equal(a, b)
    return streams


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=80), min_size=1, max_size=6), st.sampled_from([0, 1]))
def test_round_trip(values, order):
    lanes = [np.frombuffer(v, np.uint8) for v in values]
    check(lanes, model_of(lanes, order))


@pytest.mark.parametrize("k", [2, 3, 17, 256])
def test_round_trip_of_skewed_symbols_meets_carries(k):
    rng = np.random.default_rng(k)
    weights = rng.pareto(0.3, k) + 1e-9
    lanes = [rng.choice(k, n, p=weights / weights.sum()).astype(np.uint8) for n in (0, 1, 2, 300, 299, 5000)]
    check(lanes, CountModel((weights / weights.sum() * 1e9).astype(np.int64)[None]))


def test_held_words_are_flushed_with_and_without_carry():
    seen = set()
    from octoweave.plans.coder import Encoder

    plain = Encoder._flush

    def spy(self, lanes, carry):
        seen.update(carry.tolist())
        plain(self, lanes, carry)

    Encoder._flush = spy
    try:
        rng = np.random.default_rng(1)
        for seed in range(40):
            w = np.ones((1, 256), np.int64)
            w[0, 255] = 10**9
            lanes = [np.where(rng.random(400) < 0.02, rng.integers(0, 256, 400), 255).astype(np.uint8) for _ in range(64)]
            check(lanes, CountModel(w))
    finally:
        Encoder._flush = plain
    assert seen == {True, False}


def test_near_the_ideal_length():
    rng = np.random.default_rng(3)
    p = np.array([0.7, 0.2, 0.05, 0.05])
    x = rng.choice(4, 20001, p=p).astype(np.uint8)
    bits = 32 * len(check([x], CountModel((p * 1e6).astype(np.int64)[None]))[0])
    ideal = -np.log2(p[x[1:]]).sum()
    assert ideal <= bits <= ideal * 1.005 + 64


def test_one_byte_and_empty_chunks_have_empty_streams():
    lanes = [np.zeros(0, np.uint8), np.array([7], np.uint8)]
    assert [len(s) for s in check(lanes, model_of([np.arange(9, dtype=np.uint8)]))] == [0, 0]


@given(st.lists(st.integers(0, 2**45), min_size=2, max_size=300))
@settings(max_examples=50, deadline=None)
def test_bounds_give_every_symbol_a_mass(weights):
    b = integer_cdf(np.array([weights]))[0].astype(np.int64)
    assert b[0] == 0 and b[-1] == TOTAL and (np.diff(b) >= 1).all()


def test_bounds_of_bad_floats_are_uniform():
    b = integer_cdf(np.array([[np.nan, 1.0], [0.0, 0.0]])).astype(np.int64)
    assert (np.abs(np.diff(b, axis=1) - TOTAL // 2) <= 1).all()


def test_counts_of_any_size_agree_after_scaling():
    w = np.array([[1, 2, 3, 4]])
    assert np.abs(integer_cdf(w * 2**50).astype(np.int64) - integer_cdf(w).astype(np.int64)).max() <= 2


def test_state_space_forward_is_stepping_and_lanes_are_independent():
    m = ssm.StateSpace(ssm.random_weights(16, 2, 32, seed=4), 16, 2, 32)
    x = np.random.default_rng(0).integers(0, 32, (5, 20))
    whole = m.forward(x)
    assert np.array_equal(whole[2:3], m.forward(x[2:3]))
    state = m.start(5)
    assert np.array_equal(whole[:, 0], m.step(state, x[:, 0]))


def test_state_space_codes_and_keeps_its_weights(tmp_path):
    m = ssm.StateSpace(ssm.random_weights(16, 1, 256, seed=5), 16, 1)
    lanes = [np.frombuffer(b"state and space", np.uint8), np.frombuffer(b"abc", np.uint8), np.zeros(0, np.uint8)]
    streams = check(lanes, m)
    again = codec.encode(lanes[1:2], m)
    assert np.array_equal(streams[1], again[0])
    ssm.save_flat(m, str(tmp_path / "w.bin"))
    back = ssm.load_flat(str(tmp_path / "w.bin"), 16, 1)
    assert back.fingerprint == m.fingerprint
    with pytest.raises(ValueError):
        ssm.load_flat(str(tmp_path / "w.bin"), 16, 2)


def test_parameter_count_of_the_flat_order():
    import math

    n = sum(math.prod(s) for name, s in ssm.shapes(256, 1, 256) if name not in ("0.in.b", "0.out.b"))
    assert n == 1_161_472


def test_lanes_fit_memory():
    assert ssm.lanes_for(1 << 34, 64, 1)[0] > ssm.lanes_for(1 << 26, 64, 1)[0] >= 1
    assert ssm.lanes_for(1 << 16, 256, 4)[1] == 256
