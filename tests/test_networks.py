"""Layers against plain loops, and the scorers over windows and sequences."""

import numpy as np
import pytest

from readlake.operators import models, networks as net

RNG = np.random.default_rng(8)


def test_convolutions():
    x, w, b = RNG.normal(size=(2, 3, 10)), RNG.normal(size=(4, 3, 5)), RNG.normal(size=4)
    padded = np.pad(x, ((0, 0), (0, 0), (2, 2)))
    want = np.array([[[(padded[n, :, i : i + 5] * w[o]).sum() + b[o] for i in range(10)] for o in range(4)] for n in range(2)])
    assert np.allclose(net.conv1d(x, w, b), want)
    y, v = RNG.normal(size=(2, 3, 7, 6)), RNG.normal(size=(4, 3, 3, 3))
    padded = np.pad(y, ((0, 0), (0, 0), (1, 1), (1, 1)))
    want = np.array([[[[(padded[n, :, i : i + 3, j : j + 3] * v[o]).sum() for j in range(0, 6, 2)] for i in range(0, 7, 2)] for o in range(4)] for n in range(2)])
    assert np.allclose(net.conv2d(y, v, 2), want)


def test_attention_and_halving():
    x = RNG.normal(size=(2, 4, 9))
    w = {"a.down": RNG.normal(size=(2, 4)), "a.up": RNG.normal(size=(4, 2)), "a.place": RNG.normal(size=(1, 2, 7))}
    s = lambda v: 1 / (1 + np.exp(-v))
    for n in range(2):
        fc = lambda v: w["a.up"] @ np.maximum(w["a.down"] @ v, 0)
        y = x[n] * s(fc(x[n].mean(1)) + fc(x[n].max(1)))[:, None]
        both = np.pad(np.stack([y.mean(0), y.max(0)]), ((0, 0), (3, 3)))
        want = y * np.array([s((both[:, i : i + 7] * w["a.place"][0]).sum()) for i in range(9)])
        assert np.allclose(net.attention(x, w, "a")[n], want)
    assert net.halved(np.array([[[1, 5, 2, 3, 9.0]]])).tolist() == [[[5, 3]]]


def test_window_net(spark):
    f = net.WindowNet.initial(filters=8, dense=4, reduction=4)
    x = RNG.normal(size=(3, 9, 64))
    one = f(x)
    assert one.shape == (3,) and ((one > 0) & (one < 1)).all() and np.allclose(one[1:2], f(x[1:2]))
    rows = [("c", 0, [(0, [float(i) for i in range(9)]), (7, [2.0] * 9)]), ("c", 1000, [(5, [-1.0] * 9)])]
    df = spark.createDataFrame(rows, "contig string, win_start bigint, feat array<struct<at: int, v: array<double>>>")
    got = {r.position: r.score for r in models.score_channels(df, f, [2.0] * 9).collect()}
    dense = np.zeros((1, 9, 1000))
    dense[0, :, 0], dense[0, :, 7] = np.arange(9), 2
    assert np.isclose(got[0], f(np.log1p(dense / 2))[0]) and len(got) == 2


def test_sequence_net():
    f = net.SequenceNet.initial(planes=4, blocks=(1, 2), size=16, heads=2, layers=2, inner=8)
    x = RNG.normal(size=(2, 5, 3, 32, 32))
    out = f(x)
    assert out.shape == (2, 5, 3) and np.isfinite(out).all() and np.allclose(out[1:], f(x[1:]))
    # What is marked as filling changes nothing for the others.
    used = np.ones((2, 5), bool)
    used[:, 4] = False
    y = x.copy()
    y[:, 4] += 3
    assert np.allclose(f(x, used)[:, :4], f(y, used)[:, :4]) and not np.allclose(f(x)[:, :4], f(y)[:, :4])
    q = f.w["mix0.q"]
    assert q.shape == (16, 16) and models.restore({"module." + k: v for k, v in f.w.items()}, list(f.w))[1] == []


def test_focal_loss(spark):
    from readlake.functions import reads as fn

    df = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.0, 1)], "p double, y int")
    got = [r[0] for r in df.select(fn.focal_loss("p", "y")).collect()]
    assert np.allclose(got, [-0.2 * 0.01 * np.log(0.9), -0.8 * 0.81 * np.log(0.1), -0.2 * (1 - 1e-6) ** 2 * np.log(1e-6)])


def test_onnx_hook():
    ort = pytest.importorskip("onnxruntime")
    with pytest.raises(Exception):
        models.onnx_scorer(b"no model")(np.zeros((1, 3)))
    assert ort is not None
