"""Shards, manifests and spelling variants against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skyquilt.llm import manifest, sharding, spelling
from skyquilt.storage import Scratch

SF = "/root/testdata/sf0.001"
LONG = "Größer word " * 20_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, slot int, shard string, row string, at int, size string, crc int, digest string, _p int, leaf string, p int, word string, n string"


def table(spark, rows):
    """Rows (doc_id, text, source), with columns whose names the operators use too."""
    return spark.createDataFrame([(i, t, "en", s, 0, "x", 1, "y", "r", 3, "4", 5, "g", 1, "l", 2, "w", "n") for i, t, s in rows], SCHEMA)


ODD = [(1, None, "a"), (2, "", None), (None, "no id here", "a"), (None, None, None), (3, LONG, "b"), (4, "  \n\t ", "b"), (5, "same text twice over", "a"), (5, "same text twice over", "a"), (5, "another text of that id", "a")]


# --- shards ---------------------------------------------------------------------

def plain_place(x, n, seed, shards):
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    h = lambda i, v: int(hashlib.md5(f"{seed}:{i}:{v}".encode()).hexdigest()[:15], 16)
    while True:
        left, right = divmod(x, b)
        for i in range(4):
            if i % 2:
                right = (right + h(i, left)) % b
            else:
                left = (left + h(i, right)) % a
        x = left * b + right
        if x < n:
            return x % shards, x // shards


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 101, 1000])
def test_permutation(spark, n):
    order = sharding.Permutation(n, 17)
    shard, slot = sharding.place(F.col("id"), order, 8)
    rows = spark.range(n).select("id", shard.alias("s"), slot.alias("t")).withColumn("back", sharding.row_at(F.col("s"), F.col("t"), order, 8)).collect()
    assert [(r["s"], r["t"]) for r in rows] == [plain_place(r["id"], n, 17, 8) for r in rows] and all(r["back"] == r["id"] for r in rows)
    assert sorted(r["t"] * 8 + r["s"] for r in rows) == list(range(n))


def plain_shards(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode()), zlib.crc32((r[1] or "").encode()), int(hashlib.md5((r[1] or "").encode()).hexdigest()[:15], 16))
    return Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), "rows", *plain_place(k, len(rows), 17, 8), None) for k, r in enumerate(sorted(rows, key=key)))


def test_shards(spark):
    """Hot texts and ids, odd rows and clashing names: the plain version's rows."""
    rows = ODD + [(7, "copied", "a")] * 150 + [(i, f"text {i % 9} ü", "b") for i in range(40)]
    got = sharding.assign_shards(table(spark, rows).repartition(5))
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and Counter(map(tuple, got.collect())) == plain_shards(rows)
    assert sharding.assign_shards(table(spark, [])).collect() == []


def test_written_shards(spark, tmp_path):
    docs = table(spark, ODD + [(i, f"text {i}", "b") for i in range(100, 140)])
    sharding.write_shards(docs, f"{tmp_path}/out", shards=3)
    back = spark.read.parquet(f"{tmp_path}/out")
    want = Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.assign_shards(docs, shards=3).collect())
    assert Counter((r["row"]["doc_id"], zlib.crc32((r["row"]["text"] or "").encode()), r["shard"], r["slot"]) for r in back.collect()) == want
    assert back.select("row.*").columns == docs.columns


# --- manifest -------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """Root, and of every leaf the siblings before and after, level by level."""
    nodes, members, ways = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(nodes) > 1:
        runs = [list(range(i, min(i + 16, len(nodes)))) for i in range(0, len(nodes), 16)]
        for run in runs:
            for j in run:
                for i in members[j]:
                    ways[i].append(("".join(nodes[k] for k in run if k < j), "".join(nodes[k] for k in run if k > j)))
        nodes, members = [sha("".join(nodes[j] for j in run)) for run in runs], [[i for j in run for i in members[j]] for run in runs]
    return nodes[0], ways


def plain_manifest(rows):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, s: sha(value(i) + value(s) + value("en") + value(0) + value(t))
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups = {}
    for i, t, s in rows:
        other = leaf(i, lower(t), s) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else leaf(i, t, s)
        groups.setdefault(s, []).append((i is not None, i or 0, leaf(i, t, s), other, i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    root, high = plain_tree([trees[s][0] for s in order])
    out = Counter()
    for s, up in zip(order, high, strict=True):
        for x, way in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            way, d = way + up, x[3]
            for before, after in way:
                d = sha(before + d + after)
            out[x[4], x[2], trees[s][0], root, sha("".join(b + a for b, a in way)), d, d == root] += 1
    return out


def query(docs, **kw):
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest.manifest(docs, changed={"text": lowered}, where=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, **kw)


@pytest.mark.parametrize("per_range, n", [(1 << 17, 40), (50, 700), (7, 300)])
def test_manifest(spark, monkeypatch, per_range, n):
    """A group over many ranges, many small groups, odd rows: the plain tree's digests, proofs and roots."""
    monkeypatch.setattr(manifest, "PER_RANGE", per_range)
    rows = ODD + [(i, f"Text {i % 9} Ü", "hot" if i % 3 else f"s{i % 23}") for i in range(n)] + [(900, "Copied", "hot")] * 20
    got = query(table(spark, rows).repartition(5))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and Counter(map(tuple, got.collect())) == plain_manifest(rows)


@pytest.mark.parametrize("rows", [[], [(1, "a", "b")], [(None, None, None)], [(i, "T", "one") for i in range(17)], [(i, "T", f"g{i}") for i in range(18)]])
def test_small_manifests(spark, rows):
    assert Counter(map(tuple, query(table(spark, rows)).collect())) == (plain_manifest(rows) if rows else Counter())


def test_proofs_fold(spark):
    docs = table(spark, [(i, f"text {i}", f"g{i % 3}") for i in range(120)])
    rows = manifest.manifest(docs, proofs=True).select("root", "verified", manifest.fold(F.col("leaf"), F.col("proof")).alias("folded"), manifest.fold(F.sha2(F.lit(b"x"), 256), F.col("proof")).alias("wrong")).collect()
    assert len(rows) == 120 and all(r["verified"] and r["folded"] == r["root"] != r["wrong"] for r in rows)


# --- spelling -------------------------------------------------------------------

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, noise=97):
    counts = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % noise == 0 else run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: v if v and n[v] >= 2 * n[w] else None for w, v in best.items()}
    root = {}
    for w in n:
        at = w
        while form[at]:
            at = form[at]
        root[w] = at
    return {(w, form[w], root[w], n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def variant_rows(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abÀé" if k % 3 else "abcdefg") for _ in range(rng.randint(4, 9))) for k in range(60)] + ["ÉTUDE", "aaaaa", "aaaaaa", "aaaaaaa", "bbbbbbbbbbbbbbbbbbbb"]
    out = []
    for i in range(120):
        text = []
        for _ in range(60):
            w = rng.choice(words[: rng.choice([5, 20, 65])])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "b" + w[k:], w[:k] + "a" + w[k + 1 :], w.upper()])
            text.append(w)
        out.append((i, rng.choice([" ", "-", "1"]).join(text), "s"))
    return out


@pytest.mark.parametrize("most", [20_000, 4])
def test_variants(spark, monkeypatch, most):
    """Whole texts, whole vocabulary, with parts of the trie cut again and again: the plain version's rows."""
    monkeypatch.setattr(spelling, "MOST", most)
    rows = ODD + variant_rows(1) + [(500, "kbcdef " * 4 + "kbcdefg " * 12 + "kbcdefgh " * 40, "s")]
    got = spelling.spelling_variants(table(spark, rows).repartition(4), noise=97)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows_got = [tuple(r) for r in got.collect()]
    want = plain_variants(rows)
    assert len(rows_got) == len(set(rows_got)) and set(rows_got) == want and any(r[2] not in (r[0], r[1]) for r in want)
    assert spelling.spelling_variants(table(spark, [])).collect() == []


def test_trie_pairs():
    rng = random.Random(2)
    for _ in range(50):
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(40)})
        found = list(spelling.Trie([(w, k) for k, w in enumerate(words)]).pairs())
        assert len(found) == len(set(found)) and set(found) == {(a, b) for a, x in enumerate(words) for b, y in enumerate(words) if one_edit(x, y)}


def test_roots(spark):
    links = spark.createDataFrame([(f"w{i:02d}", f"w{i + 1:02d}") for i in range(20)] + [("x", "y")], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(Scratch(spark), links).collect()} == {**{f"w{i:02d}": "w20" for i in range(20)}, "x": "y"}
