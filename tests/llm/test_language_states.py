"""States of the language network against a plain forward pass, in values and in time."""

import time

import numpy as np

from lectern.llm import language_id


def plain(net, data, inside):
    """Probabilities (steps x windows x languages) by the network's formulas, with a row of units for each window."""
    h, (n, steps) = language_id.UNITS, data.shape
    sigmoid = lambda x: 0.5 * np.tanh(0.5 * x) + 0.5
    both = []
    for d in "fb":
        out, state = np.empty((steps, n, h), np.float32), np.zeros((n, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x, r = net.p["x" + d][data[:, t]], state @ net.p["u" + d]
            gates = sigmoid(x[:, : 2 * h] + r[:, : 2 * h])
            new = np.tanh(x[:, 2 * h :] + gates[:, :h] * r[:, 2 * h :])
            state = (new + gates[:, h:] * (state - new)) * inside[:, t, None].astype(np.float32)
            out[t] = state
        both.append(out)
    score = np.exp(np.concatenate(both, -1) @ net.p["o"] + net.p["c"])
    return score / score.sum(-1, keepdims=True)


def test_label_equals_a_plain_pass():
    rng, net = np.random.default_rng(3), language_id.Network(["a", "b", "c"])
    data = rng.integers(0, 256, (40, 90)).astype(np.uint8)
    low, high = rng.integers(0, 30, 40), rng.integers(31, 91, 40)
    inside = (np.arange(90) >= low[:, None]) & (np.arange(90) < high[:, None])
    want = plain(net, data, inside)
    assert np.abs(net.label(data, inside) - want).max() < 1e-5
    assert np.abs(net.label(data, inside, 7) - want[7:-7]).max() < 1e-5
    some = net.label(data[:1], inside[:1])
    assert some.shape == (90, 1, 3) and np.abs(some - want[:, :1]).max() < 1e-5


def test_a_step_runs_along_the_windows():
    rng, net = np.random.default_rng(4), language_id.Network(["a", "b", "c", "d"])
    data = rng.integers(97, 123, (language_id.WINDOWS, 128)).astype(np.uint8)
    inside = np.ones(data.shape, bool)

    def seconds(run):
        begin = time.process_time()
        run(data, inside)
        return time.process_time() - begin

    took = [(seconds(net.label), seconds(lambda *x: plain(net, *x))) for _ in range(7)]
    ours, theirs = (min(x) for x in zip(*took, strict=True))
    assert ours < 0.85 * theirs
