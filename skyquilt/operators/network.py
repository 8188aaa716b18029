"""The segmentation network: a pyramid of sampled points, neighbour edges at each level, and training over scenes.

Everything about places is joins: which points a level keeps, who is near whom,
where a finer point takes its features from.  Matrix products are done with
numpy on batches of rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.operators import metrics
from skyquilt.operators.neighbours import knn
from skyquilt.operators.numbering import numbered
from skyquilt.operators.points import order_key
from skyquilt.storage import Scratch

EPS, MOMENTUM = 1e-5, 0.1  # of the normalisation
ROWS = 512  # points with their neighbours that are multiplied at once


@dataclass(frozen=True)
class Shape:
    """Widths of the levels (two blocks each), neighbours, and the neighbourhoods that the first block pools (none: a block like the others)."""

    classes: int = 6
    inputs: int = 6
    start: int = 8
    widths: tuple[int, ...] = (16, 32, 64, 128, 256)
    k: int = 16
    scales: tuple[int, ...] = (8, 16, 32)

    def neighbours(self, level: int) -> int:
        return max(self.k, *self.scales) if level == 0 and self.scales else self.k

    def blocks(self) -> list[tuple[str, int, int, int]]:
        """Name, level and widths in and out of each block."""
        ins = (self.start, *self.widths)
        return [(f"b{level}{i}", level, ins[level] if i == 0 else w, w) for level, w in enumerate(self.widths) for i in (0, 1)]

    def layers(self) -> dict[str, tuple[int, int, bool]]:
        """Of each product: widths in and out, and whether its result is normalised and cut at 0 (else it is plain, with a shift)."""
        out = {"start": (self.inputs, self.start, True)}
        for name, _, a, b in self.blocks():
            out |= {f"{name}.geo": (10, b, True), f"{name}.near": (a, b, True), f"{name}.short": (a, b, True)}
            if name == "b00" and self.scales:
                out[f"{name}.out"] = (b * len(self.scales), b, True)
            else:
                out |= {f"{name}.score": (b, b, True), f"{name}.weight": (b, 1, False), f"{name}.out": (b, b, True)}
        for level in range(len(self.widths) - 1):
            out[f"up{level}"] = (self.widths[level + 1] + self.widths[level], self.widths[level], True)
        return out | {"end": (self.widths[0], self.classes, False)}


Weights = dict[str, np.ndarray]


def new_weights(shape: Shape, seed: int = 0) -> Weights:
    rng, out = np.random.default_rng(seed), {}
    for name, (a, b, norm) in shape.layers().items():
        out[f"{name}.w"] = rng.uniform(-1, 1, (a, b)) / np.sqrt(a)
        out |= {f"{name}.gain": np.ones(b), f"{name}.shift": np.zeros(b), f"{name}.mean": np.zeros(b), f"{name}.var": np.ones(b)} if norm else {f"{name}.shift": np.zeros(b)}
    return out


def _dense(w: Weights, name: str, x: np.ndarray) -> np.ndarray:
    """A product of the network with its stored mean and variance."""
    y = x @ w[f"{name}.w"]
    if f"{name}.gain" not in w:
        return y + w[f"{name}.shift"]
    return np.maximum((y - w[f"{name}.mean"]) / np.sqrt(w[f"{name}.var"] + EPS) * w[f"{name}.gain"] + w[f"{name}.shift"], 0.0)


def _geometry(centre: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Centre, neighbour, their difference and distance: points x neighbours x 10."""
    apart = near - centre[:, None]
    return np.concatenate([np.broadcast_to(centre[:, None], near.shape), near, apart, np.sqrt((apart**2).sum(-1, keepdims=True))], -1)


# --- places ---------------------------------------------------------------------

@dataclass
class Pyramid:
    """For each level its points (``scene, idx, x, y, z``), their edges (``scene, src, dst, rank``) and, but at the last, ``up``: the nearest point of the next level for each."""

    points: list[DataFrame]
    edges: list[DataFrame]
    up: list[DataFrame]


def pyramid(points: DataFrame, shape: Shape, seed: int = 0) -> Pyramid:
    """The places of ``scene, idx, x, y, z``; ``idx`` is of one scene only.

    A level keeps, of every scene, a quarter of the points of the one before, but
    8 at least, by a seeded order of ``idx``.  Searches stay within scenes.
    """
    scratch = Scratch(points.sparkSession)
    here = scratch.save(points.select("scene", "idx", "x", "y", "z"))
    ordered = numbered(scratch, here.withColumn("_key", order_key(seed)), ["scene", "_key", "idx"], "_at").drop("_key")
    sizes = here.groupBy("scene").agg(F.count("*").alias("_n"))
    starts = ordered.groupBy("scene").agg(F.min("_at").alias("_first")).join(sizes, "scene")
    placed = scratch.save(ordered.join(starts, "scene").withColumn("_at", F.col("_at") - F.col("_first")).drop("_first"))
    out = Pyramid([], [], [])
    for level in range(len(shape.widths)):
        kept = F.greatest(F.floor(F.col("_n") / 4**level), F.lit(8)) if level else F.col("_n")
        here = placed.where(F.col("_at") < kept).select("scene", "idx", "x", "y", "z")
        if level:
            out.up.append(scratch.save(knn(out.points[-1], here, 1, within=("scene",), keep=()).select("src", "dst")))
        out.points.append(here)
        out.edges.append(scratch.save(knn(here, here, shape.neighbours(level), within=("scene",)).select("src", "dst", "rank")))
    return out


# --- one pass over whole clouds -------------------------------------------------

def _mapped(f: Callable[..., np.ndarray], *columns: Column | str) -> Column:
    """An array column made by ``f`` of array columns of one length, on batches of rows."""
    def run(*parts: pd.Series) -> pd.Series:
        return pd.Series(list(f(*[np.stack(p.to_numpy()) for p in parts]))) if len(parts[0]) else pd.Series([], dtype=object)

    return F.pandas_udf(run, "array<double>")(*columns)


def _block(w: Weights, shape: Shape, name: str) -> Callable[[pd.Series, pd.Series, pd.Series], pd.Series]:
    """The block on batches of points: place, features, and the neighbours' places and features by rank."""
    def together(centre: np.ndarray, own: np.ndarray, rows: np.ndarray) -> np.ndarray:
        code = _dense(w, f"{name}.geo", _geometry(centre, rows[..., :3])) + _dense(w, f"{name}.near", rows[..., 3:])
        if f"{name}.weight.w" in w:
            score = _dense(w, f"{name}.weight", _dense(w, f"{name}.score", code))
            share = np.exp(score - score.max(1, keepdims=True))
            pooled = (code * share / share.sum(1, keepdims=True)).sum(1)
        else:
            pooled = np.concatenate([code[:, :k].max(1) for k in shape.scales], -1)
        return np.maximum(_dense(w, f"{name}.out", pooled) + _dense(w, f"{name}.short", own), 0.0)

    def run(centre: pd.Series, own: pd.Series, near: pd.Series) -> pd.Series:
        out: list = [None] * len(near)
        sizes = near.map(len).to_numpy()
        for size in np.unique(sizes):  # one size but for scenes of few points
            some = np.flatnonzero(sizes == size)
            for part in np.split(some, range(ROWS, len(some), ROWS)):
                made = together(np.stack(centre.iloc[part]), np.stack(own.iloc[part]), np.stack([np.stack(t) for t in near.iloc[part]]))
                for i, row in zip(part, made, strict=True):
                    out[i] = row
        return pd.Series(out, dtype=object)

    return run


def forward(places: Pyramid, features: DataFrame, w: Weights, shape: Shape) -> DataFrame:
    """``idx, logits`` of all points, with the stored means and variances.

    ``features``: ``idx`` and the array ``f`` of inputs.  A block is a join of
    edges with features and one group of a point's neighbours, which are few; a
    finer level takes the features of its nearest coarser point.  Nothing holds a
    scene, so clouds may be of any size.
    """
    scratch = Scratch(features.sparkSession)
    f = scratch.save(features.select("idx", _mapped(lambda x: _dense(w, "start", x), "f").alias("f")))
    skips = []
    for name, level, _, _ in shape.blocks():
        here = places.points[level].join(f, "idx")
        limit = shape.k if name != "b00" or not shape.scales else max(shape.scales)
        row = F.concat(F.array("x", "y", "z"), F.col("f"))
        near = places.edges[level].where(F.col("rank") <= limit).join(here.select(F.col("idx").alias("dst"), row.alias("row")), "dst")
        near = near.groupBy(F.col("src").alias("idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "row"))), lambda x: x["row"]).alias("near"))
        block = F.pandas_udf(_block(w, shape, name), "array<double>")
        f = scratch.save(here.join(near, "idx").select("idx", block(F.array("x", "y", "z"), "f", "near").alias("f")))
        if name.endswith("1"):
            skips.append(f)
    f = skips.pop()
    for level in reversed(range(len(shape.widths) - 1)):
        taken = places.up[level].join(f.withColumnRenamed("idx", "dst"), "dst").select(F.col("src").alias("idx"), F.col("f").alias("g"))
        f = scratch.save(skips.pop().join(taken, "idx").select("idx", _mapped(lambda x, level=level: _dense(w, f"up{level}", x), F.concat("g", "f")).alias("f")))
    return f.select("idx", _mapped(lambda x: _dense(w, "end", x), "f").alias("logits"))


# --- training -------------------------------------------------------------------

@dataclass
class _Node:
    value: np.ndarray
    grad: np.ndarray | float = 0.0


@dataclass
class _Tape:
    """A pass over one scene that can be walked back: each step adds its share to the gradients of what it was made of."""

    w: Weights
    grads: Weights = field(default_factory=dict)
    moments: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    steps: list[Callable[[], None]] = field(default_factory=list)

    def made(self, value: np.ndarray, back: Callable[[np.ndarray], None]) -> _Node:
        node = _Node(value)
        self.steps.append(lambda: back(node.grad) if isinstance(node.grad, np.ndarray) else None)
        return node

    def weigh(self, name: str, g: np.ndarray) -> None:
        self.grads[name] = self.grads.get(name, 0.0) + g

    def dense(self, name: str, x: _Node) -> _Node:
        w, flat = self.w, x.value.reshape(-1, x.value.shape[-1])
        y = flat @ w[f"{name}.w"]
        norm = f"{name}.gain" in w
        if norm:
            mean, var = y.mean(0), y.var(0)
            self.moments[name] = (mean, var)
            size = np.sqrt(var + EPS)
            unit = (y - mean) / size
            y = np.maximum(unit * w[f"{name}.gain"] + w[f"{name}.shift"], 0.0)
        else:
            y = y + w[f"{name}.shift"]

        def back(grad: np.ndarray) -> None:
            g = grad.reshape(y.shape)
            if norm:
                g = g * (y > 0)
                self.weigh(f"{name}.gain", (g * unit).sum(0))
            self.weigh(f"{name}.shift", g.sum(0))
            if norm:
                u = g * w[f"{name}.gain"]
                g = (u - u.mean(0) - unit * (u * unit).mean(0)) / size
            self.weigh(f"{name}.w", flat.T @ g)
            x.grad = x.grad + (g @ w[f"{name}.w"].T).reshape(x.value.shape)

        return self.made(y.reshape(*x.value.shape[:-1], -1), back)

    def take(self, x: _Node, at: np.ndarray) -> _Node:
        def back(grad: np.ndarray) -> None:
            whole = np.zeros_like(x.value)
            np.add.at(whole, at, grad)
            x.grad = x.grad + whole

        return self.made(x.value[at], back)

    def plus(self, a: _Node, b: _Node, cut: bool = False) -> _Node:
        y = a.value + b.value
        y = np.maximum(y, 0.0) if cut else y

        def back(grad: np.ndarray) -> None:
            g = grad * (y > 0) if cut else grad
            a.grad, b.grad = a.grad + g, b.grad + g

        return self.made(y, back)

    def beside(self, parts: list[_Node]) -> _Node:
        edges = np.cumsum([p.value.shape[-1] for p in parts])[:-1]

        def back(grad: np.ndarray) -> None:
            for p, g in zip(parts, np.split(grad, edges, -1), strict=True):
                p.grad = p.grad + g

        return self.made(np.concatenate([p.value for p in parts], -1), back)

    def attend(self, x: _Node, score: _Node) -> _Node:
        share = np.exp(score.value - score.value.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)

        def back(grad: np.ndarray) -> None:
            g = grad[:, None]
            x.grad = x.grad + g * share
            s = (g * x.value).sum(-1, keepdims=True)
            score.grad = score.grad + share * (s - (share * s).sum(1, keepdims=True))

        return self.made((x.value * share).sum(1), back)

    def largest(self, x: _Node, k: int) -> _Node:
        at = x.value[:, :k].argmax(1)[:, None]

        def back(grad: np.ndarray) -> None:
            whole = np.zeros_like(x.value)
            np.put_along_axis(whole, at, grad[:, None], 1)
            x.grad = x.grad + whole

        return self.made(np.take_along_axis(x.value, at, 1)[:, 0], back)


@dataclass
class _Scene:
    """A scene in one row: places and neighbours of every level as positions in its arrays."""

    inputs: np.ndarray
    label: np.ndarray
    xyz: list[np.ndarray]
    near: list[np.ndarray]
    kept: list[np.ndarray]  # of the level's points those of the next
    up: list[np.ndarray]


def _scene_pass(tape: _Tape, scene: _Scene, shape: Shape) -> _Node:
    f = tape.dense("start", _Node(scene.inputs))
    skips = []
    for name, level, _, _ in shape.blocks():
        if level and name.endswith("0"):
            f = tape.take(f, scene.kept[level - 1])
        pools = shape.scales if name == "b00" else ()
        near = scene.near[level][:, : max(pools) if pools else shape.k]
        code = tape.plus(tape.dense(f"{name}.geo", _Node(_geometry(scene.xyz[level], scene.xyz[level][near]))), tape.dense(f"{name}.near", tape.take(f, near)))
        pooled = tape.beside([tape.largest(code, k) for k in pools]) if pools else tape.attend(code, tape.dense(f"{name}.weight", tape.dense(f"{name}.score", code)))
        f = tape.plus(tape.dense(f"{name}.out", pooled), tape.dense(f"{name}.short", f), cut=True)
        if name.endswith("1"):
            skips.append(f)
    f = skips.pop()
    for level in reversed(range(len(shape.widths) - 1)):
        f = tape.dense(f"up{level}", tape.beside([tape.take(f, scene.up[level]), skips.pop()]))
    return tape.dense("end", f)


def _loss(tape: _Tape, out: _Node, label: np.ndarray) -> tuple[float, int]:
    """The sum of cross entropies over points with a label; sets the gradient of the logits."""
    known = label >= 0
    shifted = out.value - out.value.max(1, keepdims=True)
    logs = shifted - np.log(np.exp(shifted).sum(1, keepdims=True))
    grad = np.exp(logs)
    rows = np.flatnonzero(known)
    grad[rows, label[rows]] -= 1.0
    grad[~known] = 0.0
    out.grad = grad
    return float(-logs[rows, label[rows]].sum()), len(rows)


def packed(places: Pyramid, features: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each scene, of bounded size as scenes are sampled to one: the arrays that training needs."""
    def listed(df: DataFrame, by: str, value: Column) -> DataFrame:
        return df.groupBy("scene").agg(F.transform(F.array_sort(F.collect_list(F.struct(by, value.alias("_v")))), lambda x: x["_v"]).alias("list"))

    whole = places.points[0].join(features, "idx").join(labels, "idx", "left")
    at = F.row_number().over(Window.partitionBy("scene").orderBy("idx")) - 1
    out = listed(whole, "idx", F.struct("f", F.coalesce("label", F.lit(-1)).alias("label"))).withColumnRenamed("list", "points")
    numbers = [p.select("scene", "idx", "x", "y", "z", at.alias("at")) for p in places.points]
    of = [n.select(F.col("idx").alias("dst"), F.col("at").alias("to")) for n in numbers]
    for level, (n, edges) in enumerate(zip(numbers, places.edges, strict=True)):
        joined = edges.join(of[level], "dst").groupBy(F.col("src").alias("idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "to"))), lambda x: x["to"]).alias("near"))
        rows = n.join(joined, "idx")
        last = level == len(numbers) - 1
        if not last:
            rows = rows.join(places.up[level].withColumnRenamed("src", "idx").join(of[level + 1], "dst").select("idx", F.col("to").alias("up")), "idx")
            rows = rows.join(numbers[level + 1].select("idx", F.lit(True).alias("kept")), "idx", "left")
        row = F.struct(F.array("x", "y", "z").alias("xyz"), "near", *([] if last else ["up", F.coalesce("kept", F.lit(False)).alias("kept")]))
        out = out.join(listed(rows, "idx", row).withColumnRenamed("list", f"level{level}"), "scene")
    return Scratch(features.sparkSession).save(out)


def _scene(row, levels: int) -> _Scene:
    of = [row[f"level{k}"] for k in range(levels)]
    return _Scene(
        np.array([p["f"] for p in row["points"]], float), np.array([p["label"] for p in row["points"]], int), [np.array([p["xyz"] for p in some], float) for some in of],
        [np.array([p["near"] for p in some], int) for some in of], [np.flatnonzero([p["kept"] for p in some]) for some in of[:-1]], [np.array([p["up"] for p in some], int) for some in of[:-1]],
    )


def train(scenes: DataFrame, checked: DataFrame, shape: Shape, *, epochs: int = 100, batch: int = 4, rate: float = 0.001, decay: float = 0.0001, step: int = 20, gamma: float = 0.5, seed: int = 0) -> tuple[Weights, list[dict]]:
    """The weights of the best mean IoU over ``checked``, and for each epoch its losses and scores.

    ``scenes`` and ``checked`` are tables of ``packed``.  In each step tasks walk
    back over the scenes of one batch and sum their gradients, one task adds the
    sums and makes one step of Adam of the whole; the rate falls by ``gamma``
    every ``step`` epochs.  Weights pass from step to step in the shared folder;
    the driver gets them once an epoch, for the scores.  Scenes go to batches by a
    seeded hash, anew in each epoch; they are written by batch, so a step reads
    its own and no others.
    """
    spark = scenes.sparkSession
    sc, levels, names, scratch = spark.sparkContext, len(shape.widths), sorted(new_weights(shape)), Scratch(spark)
    turns = max(1, round(scenes.count() / batch))
    learnt = [n for n in names if not n.endswith((".mean", ".var"))]
    w, best, log = new_weights(shape, seed), None, []

    def gradients(some: Iterator) -> Iterator:
        total: dict = {}
        for state, row in some:
            scene, tape = _scene(row, levels), _Tape(state["w"])
            out = _scene_pass(tape, scene, shape)
            loss, n = _loss(tape, out, scene.label)
            for back in reversed(tape.steps):
                back()
            moments = {f"{k}.{part}": v for k, pair in tape.moments.items() for part, v in zip(("mean", "var"), pair, strict=True)}
            total = _added(total, {**tape.grads, **moments, "loss": loss, "n": n, "scenes": 1})
        yield 0, total

    def stepped(epoch: int) -> Callable[[tuple[dict, dict]], dict]:
        def run(pair: tuple[dict, dict]) -> dict:
            got, old = pair
            if not got or not got["n"]:
                return old
            lost, seen = (old["lost"], old["seen"]) if old["epoch"] == epoch else (0.0, 0)
            w, steps, first, second = dict(old["w"]), old["steps"] + 1, dict(old["first"]), dict(old["second"])
            for n in learnt:
                g = got[n] / got["n"] + decay * w[n]
                first[n], second[n] = 0.9 * first[n] + 0.1 * g, 0.999 * second[n] + 0.001 * g * g
                w[n] = w[n] - rate * gamma ** (epoch // step) * (first[n] / (1 - 0.9**steps)) / (np.sqrt(second[n] / (1 - 0.999**steps)) + 1e-8)
            for n in names:
                if n not in learnt:
                    w[n] = (1 - MOMENTUM) * w[n] + MOMENTUM * got[n] / got["scenes"]
            return {"w": w, "steps": steps, "first": first, "second": second, "epoch": epoch, "lost": lost + got["loss"], "seen": seen + got["n"]}

        return run

    at = scratch.place()
    sc.parallelize([{"w": w, "steps": 0, "first": dict.fromkeys(learnt, 0.0), "second": dict.fromkeys(learnt, 0.0), "epoch": -1, "lost": 0.0, "seen": 0}], 1).saveAsPickleFile(at)
    for epoch in range(epochs):
        turn = F.udf(lambda scene, epoch=epoch: int(np.random.default_rng([seed, epoch, zlib.crc32(str(scene).encode())]).integers(turns)), "int")
        dealt = scenes.withColumn("_turn", turn("scene")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_turn", F.pmod(F.hash("scene"), F.lit(batch)))
        folder = scratch.place()
        dealt.write.partitionBy("_turn").parquet(folder)
        batches = spark.read.schema(dealt.schema).parquet(folder)
        for t in sorted(r["_turn"] for r in batches.select("_turn").distinct().collect()):
            state, old = sc.pickleFile(at, 1), at
            summed = state.cartesian(batches.where(F.col("_turn") == t).rdd).mapPartitions(gradients).reduceByKey(_added, 1)
            at = scratch.place()
            summed.values().cartesian(state).map(stepped(epoch)).saveAsPickleFile(at)
            scratch.remove(old)
        scratch.remove(folder)
        of_epoch, w, lost, seen = sc.pickleFile(at, 1).map(lambda s: (s["epoch"], s["w"], s["lost"], s["seen"])).first()
        lost, seen = (lost, seen) if of_epoch == epoch else (0.0, 0)
        scores = metrics.overall(metrics.confusion(predictions(checked, w, shape), shape.classes), shape.classes).first()
        log.append({"epoch": epoch, "loss": lost / max(seen, 1), "oa": scores["oa"], "miou": scores["miou"] or 0.0})
        if best is None or log[-1]["miou"] > best[0]:
            best = (log[-1]["miou"], w)
    scratch.remove(at)
    return (best[1] if best else w), log


def _added(a: dict, b: dict) -> dict:
    return {k: a[k] + b[k] if k in a and k in b else a.get(k, b.get(k)) for k in a.keys() | b.keys()}


def predictions(scenes: DataFrame, w: Weights, shape: Shape) -> DataFrame:
    """``label, pred`` of the points of packed scenes, with the stored means and variances."""
    levels, sent = len(shape.widths), scenes.sparkSession.sparkContext.broadcast(w)

    def run(some: Iterator) -> Iterator[tuple[int, int]]:
        for row in some:
            scene = _scene(row, levels)
            tape = _Stored(sent.value)
            pred = _scene_pass(tape, scene, shape).value.argmax(1)
            yield from zip(scene.label.tolist(), pred.tolist(), strict=True)

    return scenes.rdd.mapPartitions(run).toDF("label int, pred int")


class _Stored(_Tape):
    """A pass with the stored means and variances, which is not walked back."""

    def dense(self, name: str, x: _Node) -> _Node:
        return _Node(_dense(self.w, name, x.value))

    def made(self, value: np.ndarray, back: Callable[[np.ndarray], None]) -> _Node:
        return _Node(value)


def save_weights(spark, w: Weights, path: str) -> None:
    """Weights as a table of names, shapes and values."""
    rows = [(n, list(v.shape), v.ravel().tolist()) for n, v in w.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").write.mode("overwrite").parquet(path)


def load_weights(spark, path: str) -> Weights:
    return {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}


def cloud_scenes(points: DataFrame, size: int) -> DataFrame:
    """Points with ``scene``: runs of ``size`` by ``idx``, as a cloud is fed in pieces."""
    return points.withColumn("scene", F.floor(F.col("idx") / size))


def inputs(points: DataFrame, with_colour: bool = True) -> DataFrame:
    """``idx`` and the array ``f`` of the network's inputs."""
    return points.select("idx", F.array(*[F.col(c).cast("double") for c in ("x", "y", "z", "r", "g", "b")[: 6 if with_colour else 3]]).alias("f"))
