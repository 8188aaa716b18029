"""The network's pass against a plain one, its gradients against differences, and training."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquilt.operators import network as N

SHAPE = N.Shape(classes=3, start=4, widths=(6, 8, 10), k=4, scales=(2, 4, 6))


def clouds(n, scenes, seed=0):
    rng = np.random.default_rng(seed)
    xyz = rng.uniform(-1, 1, (n, 3))
    label = np.where(xyz[:, 2] > 0.3, 0, np.where(xyz[:, 0] > 0, 1, 2))
    return [(i, i % scenes, *map(float, xyz[i]), *map(float, np.eye(3)[label[i]] * 0.6 + rng.uniform(0, 0.4, 3)), int(label[i])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "idx long, scene long, x double, y double, z double, r double, g double, b double, label int")


def drawn_weights(shape, seed):
    """Weights whose stored means and variances and shifts are not those of the start."""
    rng, w = np.random.default_rng(seed), N.new_weights(shape, seed)
    return {n: v + rng.uniform(0, 0.5, v.shape) if not n.endswith(".w") else v for n, v in w.items()}


def plain_pass(rows, w, shape, seed=0):
    """One scene, written out: nested loops over points, levels from a sort of md5."""
    rows = sorted(rows)
    xyz, ids = np.array([r[2:5] for r in rows]), [r[0] for r in rows]
    layer = lambda n, x: np.maximum((x @ w[n + ".w"] - w[n + ".mean"]) / np.sqrt(w[n + ".var"] + 1e-5) * w[n + ".gain"] + w[n + ".shift"], 0)
    feats = {j: layer("start", np.array(rows[j][2:8])) for j in range(len(rows))}
    order = sorted(range(len(rows)), key=lambda j: (hashlib.md5(f"{seed}:{ids[j]}".encode()).hexdigest(), ids[j]))
    nearest = lambda j, of, k: sorted(of, key=lambda t: (((xyz[j] - xyz[t]) ** 2).sum(), ids[t]))[:k]
    levels, skips = [order[: max(len(rows) // 4**lv, 8)] if lv else order for lv in range(len(shape.widths))], []
    for lv, here in enumerate(levels):
        for block in (f"b{lv}0", f"b{lv}1"):
            new = {}
            for j in here:
                pools = shape.scales if block == "b00" else ()
                codes = []
                for t in nearest(j, here, max(pools) if pools else shape.k):
                    d = xyz[t] - xyz[j]
                    codes.append(layer(block + ".geo", np.r_[xyz[j], xyz[t], d, np.sqrt((d**2).sum())]) + layer(block + ".near", feats[t]))
                codes = np.array(codes)
                if pools:
                    pooled = np.concatenate([codes[:k].max(0) for k in pools])
                else:
                    s = np.array([(layer(block + ".score", c) @ w[block + ".weight.w"] + w[block + ".weight.shift"])[0] for c in codes])
                    a = np.exp(s - s.max())
                    pooled = (codes * (a / a.sum())[:, None]).sum(0)
                new[j] = np.maximum(layer(block + ".out", pooled) + layer(block + ".short", feats[j]), 0)
            feats = new
        skips.append(feats)
    cur = skips.pop()
    for lv in reversed(range(len(shape.widths) - 1)):
        skip = skips.pop()
        cur = {j: layer(f"up{lv}", np.r_[cur[nearest(j, levels[lv + 1], 1)[0]], skip[j]]) for j in levels[lv]}
    return {ids[j]: cur[j] @ w["end.w"] + w["end.shift"] for j in cur}


@pytest.mark.parametrize("scales", [(2, 4, 6), ()])
def test_pass_equals_a_plain_one(spark, scales):
    """Two scenes at once, one of few points: the logits of each on its own."""
    shape = N.Shape(classes=3, start=4, widths=(6, 8), k=4, scales=scales)
    rows = [r for r in clouds(90, 2) if r[1] == 0 or r[0] < 12]
    w, df = drawn_weights(shape, 1), frame(spark, rows)
    places = N.pyramid(df, shape, seed=5)
    got = {r["idx"]: r["logits"] for r in N.forward(places, N.inputs(df), w, shape).collect()}
    want = {i: v for s in (0, 1) for i, v in plain_pass([r for r in rows if r[1] == s], w, shape, seed=5).items()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(v, rel=1e-9, abs=1e-9) for i, v in want.items())
    scenes = N.packed(places, N.inputs(df), df.select("idx", "label"))
    pairs = sorted((r["label"], r["pred"]) for r in N.predictions(scenes, w, shape).collect())
    assert pairs == sorted((r[-1], int(np.argmax(want[r[0]]))) for r in rows)


def test_gradients(spark):
    """Of some numbers of every array of weights, against differences of the loss."""
    df = frame(spark, clouds(40, 1))
    row = N.packed(N.pyramid(df, SHAPE), N.inputs(df), df.select("idx", "label")).first()
    scene, w = N._scene(row, len(SHAPE.widths)), N.new_weights(SHAPE, 3)

    def loss(w):
        tape = N._Tape(w)
        out = N._scene_pass(tape, scene, SHAPE)
        return tape, N._loss(tape, out, scene.label)[0]

    tape, _ = loss(w)
    for back in reversed(tape.steps):
        back()
    rng = np.random.default_rng(0)
    for name in (n for n in w if not n.endswith((".mean", ".var"))):
        at = tuple(rng.integers(0, s) for s in w[name].shape)
        up, down = ({**w, name: w[name] + sign * 1e-7 * (np.indices(w[name].shape).T == at).all(-1).T} for sign in (1, -1))
        assert tape.grads[name][at] == pytest.approx((loss(up)[1] - loss(down)[1]) / 2e-7, rel=1e-3, abs=1e-4), name


def test_training(spark, tmp_path):
    """The loss falls, the best weights are kept, saved and read back, and tell held-out scenes."""
    df = frame(spark, clouds(640, 8, seed=4))
    places = N.pyramid(df, SHAPE)
    scenes = N.packed(places, N.inputs(df), df.select("idx", "label"))
    learnt, held = scenes.where("scene < 6"), scenes.where("scene >= 6")
    w, log = N.train(learnt, held, SHAPE, epochs=12, batch=2, rate=0.02, step=6)
    assert log[-1]["loss"] < 0.7 * log[0]["loss"] and max(e["miou"] for e in log) > 0.6
    N.save_weights(spark, w, f"{tmp_path}/w")
    back = N.load_weights(spark, f"{tmp_path}/w")
    assert back.keys() == w.keys() and all(np.array_equal(back[n], w[n]) for n in w)
    right = N.predictions(held, back, SHAPE).agg(F.avg(F.expr("int(label = pred)"))).first()[0]
    assert right > 0.75


def test_gradients_do_not_pass_through_the_driver(spark, monkeypatch):
    """Steps leave nothing with the driver, which takes the weights once an epoch."""
    from pyspark import RDD

    df = frame(spark, clouds(160, 8, seed=5))
    scenes = N.packed(N.pyramid(df, SHAPE), N.inputs(df), df.select("idx", "label"))
    taken, collect = [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda self: taken.append(1) or collect(self))
    monkeypatch.setattr(RDD, "reduce", lambda *_: pytest.fail("gradients came to the driver"))
    _, log = N.train(scenes, scenes, SHAPE, epochs=1, batch=1)
    assert len(log) == 1 and not taken
