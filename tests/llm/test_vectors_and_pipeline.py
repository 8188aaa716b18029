import math
import random

import numpy as np

import corpus_pipeline
from test_text_operators import brute_lines, plain_distance
from skyquilt.llm import decontam, multi_index, quality
from skyquilt.operators.graph import components
from skyquilt.storage import Scratch

SF = "/root/testdata/sf0.001"


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    x = np.vstack([base, base[:15] + 0.05 * rng.normal(size=(15, 16)), base[:15] + 0.1 * rng.normal(size=(15, 16)), np.repeat(base[:1], 5, 0)]).astype(np.float32).astype(float)
    rows = [(int(i), [float(v) for v in r], "a") for i, r in enumerate(x)]
    rows += [(100, None, "a"), (101, [0.0] * 16, "a"), (102, [float("nan")] + [1.0] * 15, "a"), (103, [None] + [1.0] * 15, "a"), (104, [], "a"), (105, [1.0], "a"), (None, rows[0][1], "a"), (106, [float("inf")] * 16, "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, links string").withColumnRenamed("links", "mult")
    got = {r["vec_id"]: r for r in multi_index.near_vectors(df, recall=1.0).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = u @ u.T >= 0.95
    part = np.arange(len(x))
    for _ in range(len(x)):
        part = np.where(hit, part[None, :], 10**6).min(axis=1)
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (hit[i].sum() - 1, part[i], part[i] == i)
    for i in range(100, 107):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[None]["component_id"] is None and not got[None]["kept"]
    assert multi_index.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_one_id(spark):
    """Rows that share an id but not the vector, repeated rows, floats, and vectors of two lengths."""
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, 0.0, 1.0]), (4, [0.0, 0.01, 1.0]), (5, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in multi_index.near_vectors(df).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 0, 2), (2, 2, 1), (3, 1, 3), (4, 1, 3), (5, 0, 5)]


def test_recall_by_default(spark):
    """Pairs planted just above the least similarity, among strangers, scattered and in bunches."""
    for seed, centres in ((1, 0), (2, 40)):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(3000, 32))
        if centres:
            x = 0.6 * x + 2 * rng.normal(size=(centres, 32))[rng.integers(0, centres, 3000)]
        x /= np.linalg.norm(x, axis=1)[:, None]
        off = rng.normal(size=x.shape)
        off -= (off * x).sum(1)[:, None] * x
        off /= np.linalg.norm(off, axis=1)[:, None]
        cos = rng.uniform(0.9501, 0.955, 3000)[:, None]
        whole = np.vstack([x, cos * x + np.sqrt(1 - cos * cos) * off])
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(whole)], "vec_id long, embedding array<double>")
        got = {r["vec_id"]: r["n_links"] for r in multi_index.near_vectors(df).collect()}
        want = (whole @ whole.T >= 0.95).sum(1) - 1
        found = np.array([got[i] for i in range(len(whole))])
        assert (found <= want).all() and found.sum() >= 0.9 * want.sum()


def test_traversal_order():
    rng = np.random.default_rng(1)
    index = multi_index.MultiIndex(rng.normal(size=(300, 8)), 3000, cosine=0.95, recall=0.99)
    x = rng.normal(size=(50, 8))
    a, b = index.distances(x)
    every = np.sort((a[:, :, None] + b[:, None, :]).reshape(50, -1), axis=1)[:, : index.visits]
    cells = index.nearest_cells(x)
    got = a[np.arange(50)[:, None], cells // b.shape[1]] + b[np.arange(50)[:, None], cells % b.shape[1]]
    assert np.allclose(got, every)


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(20)] + [(40, 41), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(Scratch(spark), edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 41: 40}
    assert components(Scratch(spark), edges.limit(0)).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids, now = docs.columns, {r["doc_id"] for r in docs.collect()}, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        now = Scratch(spark).save(stage(spark, now, SF))
        kept[name] = {r["doc_id"]: r for r in now.collect()}
        assert set(kept[name]) <= ids
        ids = set(kept[name])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(labels[i] == 1 and i not in kept[names[0]] for i in labels) <= 0.05 * len(labels)
    assert set(kept[names[0]]) == set(kept[names[1]])
    bench = [r["text"].lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(b in r["text"].lower() for r in kept[names[3]].values() for b in bench)
    last = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {i: r["taken"] for i, r in last.items()} == {i: r["taken"] for i, r in kept[names[4]].items()}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_rows(spark):
    """Null ids, repeated rows and several texts of one id in the near-copy stage; documents that lost all their lines."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    near = {t: t + " end" for t in (a, b, c, d)}
    rows = [
        (1, a), (2, near[a]), (2, b), (3, near[b]), (3, near[b]), (4, near[b] + " more"),  # two texts of id 2; id 3 twice
        (5, c), (5, c), (None, near[c]), (None, d), (None, near[d]), (None, near[d]), (9, " "), (10, None), (11, ""),
    ]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, SF)
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert got.columns == docs.columns
    named = sorted((i, t or "") for i, t in kept if i is not None)
    assert named == [(1, a), (2, b), (5, c), (9, " "), (10, ""), (11, "")]
    nameless = [t for i, t in kept if i is None]
    assert len(nameless) == 1 and nameless[0] in (d, near[d])
    docs = spark.createDataFrame([(1, a, "en", "s", 0), (2, a + "\n", "en", "s", 0), (3, "", "en", "s", 0), (4, None, "en", "s", None)], docs.schema)
    lines = corpus_pipeline.drop_lines(spark, docs, SF)
    assert {r["doc_id"] for r in lines.collect()} == {1, 2, 3, 4}
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, lines, SF).collect()} == {1, 3, 4}


def plain_quality(field, text):
    """A text's score by the rule, a line at a time in ordinary probabilities, with the fitted weights."""
    lines = (text or "").split("\n")
    f, _ = quality.line_features(text)
    none = [0.0] * quality.N_FEATURES
    odds = []
    for k in range(len(lines)):
        near = [*f[k], *(f[k - 1] if k else none), *(f[k + 1] if k + 1 < len(lines) else none)]
        odds.append([1.0, math.exp(sum(a * b for a, b in zip(near, field.weights, strict=True)))])
    pair = [[math.exp(v) for v in row] for row in field.pairs]

    def passed(order, step):
        seen, now = {}, [1.0, 1.0]
        for k in order:
            seen[k] = now
            here = [now[y] * odds[k][y] for y in (0, 1)]
            now = [sum(here[z] * (pair[z][y] if step > 0 else pair[y][z]) for z in (0, 1)) for y in (0, 1)]
            now = [v / sum(now) for v in now]
        return seen

    before, after = passed(range(len(lines)), 1), passed(range(len(lines) - 1, -1, -1), -1)
    good = []
    for k in range(len(lines)):
        bad_way, good_way = (before[k][y] * odds[k][y] * after[k][y] for y in (0, 1))
        good.append(good_way / (bad_way + good_way))
    sizes = [len(x) + 1 for x in lines]
    mean = sum(g * n for g, n in zip(good, sizes, strict=True)) / sum(sizes)
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    return 1 / (1 + math.exp(-(field.scale * math.log(mean / (1 - mean)) + field.shift)))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_pipeline_stages_equal_brute_force(spark):
    """Every stage at the pipeline's own parameters against a plain version, with pairs at and about the thresholds."""
    labelled = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    field = quality.fit(labelled, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r["doc_id"] for r in labelled.collect() if plain_quality(field, r["text"]) >= 0.3}
    assert {r["doc_id"] for r in corpus_pipeline.keep_good(spark, labelled, SF).collect()} == want and 0 < len(want) < 60

    rng = random.Random(11)
    base = [[f"w{rng.randrange(60)}" for _ in range(n)] for n in (5, 8, 9, 10, 10, 12, 20)]

    def changed(words, n):
        words = list(words)
        for at in rng.sample(range(len(words)), min(n, len(words))):
            words[at] = f"x{rng.randrange(9)}"
        return " ".join(words)

    rows = [(i, "\n".join(changed(rng.choice(base), rng.randrange(4)) for _ in range(rng.randint(1, 4)))) for i in range(30)]
    gone = {(i, k) for i, k, *_ in brute_lines([(i, t, "s") for i, t in rows])}
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) or None for i, t in rows}
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_lines(spark, documents(spark, rows), SF).collect()} == want and gone and None in want.values()

    base = [[f"v{rng.randrange(10**6)}" for _ in range(60)] for _ in range(5)]
    rows = [(i, changed(base[i % 5][: rng.randint(48, 60)], rng.randrange(3))) for i in range(40)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    linked = {i: {j for j in sets if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])} for i in sets}
    smallest = {i: i for i in sets}
    for _ in sets:
        smallest = {i: min(smallest[j] for j in linked[i]) for i in sets}
    want = {i for i in sets if smallest[i] == i}
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, documents(spark, rows), SF).collect()} == want and 5 < len(want) < 40

    items = [decontam.words_of(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(12).collect()]
    every = [decontam.words_of(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(i, " ".join(["before"] * 5 + [changed(w, int(0.2 * len(w)) + i % 2)] + ["after"] * 5)) for i, w in enumerate(items)] + [(50, "nothing of it " * 20)]
    want = {i for i, t in rows if all(plain_distance(w, decontam.words_of(t)) > int(0.2 * len(w)) for w in every)}
    assert {r["doc_id"] for r in corpus_pipeline.drop_benchmark_leaks(spark, documents(spark, rows), SF).collect()} == want and 1 < len(want) < len(rows)


def test_regions_in_blocks(spark, monkeypatch):
    """Many regions and blocks, a third of all vectors about one spot, and chains: the same links as all pairs."""
    monkeypatch.setattr(multi_index, "REGION_ROWS", 40)
    monkeypatch.setattr(multi_index, "QUERY_BLOCK", 16)
    monkeypatch.setattr(multi_index, "INDEX_BLOCK", 8)
    rng = np.random.default_rng(5)
    turn = np.linspace(0, 2, 60)
    chain = np.stack([np.cos(turn), np.sin(turn), *np.zeros((6, 60))], axis=1)
    x = np.vstack([rng.normal(size=(240, 8)), rng.normal(size=8) + 0.25 * rng.normal(size=(150, 8)), chain]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in multi_index.near_vectors(df, recall=1.0).collect()}
    u = multi_index.unit(x)
    hit = u @ u.T >= 0.95
    part = np.arange(len(x))
    for _ in x:
        part = np.where(hit, part[None, :], 10**6).min(axis=1)
    assert got == {i: (hit[i].sum() - 1, part[i]) for i in range(len(x))}
    index = multi_index.MultiIndex(u.astype(float), len(x), cosine=0.95, recall=1.0)
    visited = multi_index.stops(index, u).to_pylist()
    assert len(set(index.regions(index.own(u)))) > 4
    for stops, cells in zip(visited, index.nearest_cells(u), strict=True):
        assert sorted(c for s in stops for c in s["cells"]) == sorted(cells) and len({s["region"] for s in stops}) == len(stops)
