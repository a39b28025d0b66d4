import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.induced_sort import Arena, RunningMin, sort_suffixes


def naive(t, cap):
    order = sorted(range(len(t)), key=lambda i: t[i:])
    lcp = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < cap and a + k < len(t) and b + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        lcp.append(k)
    return order, lcp


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=90), st.integers(1, 3), st.sampled_from([3, 20, 400]), st.sampled_from([100, 1 << 30]))
def test_order_and_prefixes(part, times, cap, memory):
    t = part * times + [0]
    with Arena(memory) as arena:
        order, lcp = sort_suffixes(np.array(t), cap, arena)
        assert (order.tolist(), lcp.tolist()) == naive(t, cap)


@pytest.mark.parametrize("alphabet", [2, 60])
def test_long_texts_beyond_memory(alphabet):
    rng = np.random.default_rng(alphabet)
    t = rng.integers(1, alphabet + 1, 6000)
    t = np.concatenate([t, t[1000:4000], np.ones(800, int), t[:500], [0]])
    b = t.astype(np.uint8).tobytes()
    with Arena(50_000) as arena:
        order, lcp = (x.tolist() for x in sort_suffixes(t, 400, arena))
        assert arena.count > 0  # queues went to files
    assert order == sorted(range(len(b)), key=lambda i: b[i:])
    for x, y, n in zip(order, order[1:], lcp[1:]):
        assert b[x : x + n] == b[y : y + n] and (n == 400 or b[x + n : x + n + 1] != b[y + n : y + n + 1])


def test_running_min():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 500, 3000).astype(np.uint16)
    table, at = RunningMin(len(v), Arena(1 << 30)), 0
    while at < len(v):
        n = int(rng.integers(1, 150))
        table.append(v[at : at + n])
        at += n
    lo = rng.integers(0, len(v), 1000)
    hi = np.minimum(lo + rng.integers(0, 2000, 1000), len(v) - 1)
    assert table.query(lo, hi).tolist() == [v[a : b + 1].min() for a, b in zip(lo, hi)]
