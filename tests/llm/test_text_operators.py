import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyquilt.llm import decontam, licences, lines, mixing, ngram_join, pii, quality, secrets, tokens
from skyquilt.llm.shingles import Shingler

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, slot int, words string, th int, w int, n int, sig int, group string, part string, size string"


def table(spark, rows):
    """Rows (doc_id, text, source), with columns whose names the operators use too."""
    return spark.createDataFrame([(i, t, "en", s, 0, "x", 1, "y", 2, 3, 4, 5, "g", "p", "s") for i, t, s in rows], SCHEMA)


ODD = [(1, None, "a"), (2, "", None), (None, "no id here", "a"), (3, LONG, "b"), (4, "  \n\t ", "b"), (5, "same text twice over", "a"), (5, "same text twice over", "a")]


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r[0], []).append(r)
    return out


# --- mixing ---------------------------------------------------------------------

def test_mix_shares(spark):
    rng = random.Random(1)
    docs = [(i, "w " * rng.randint(0, 50), rng.choice(["a", "b", "c", "d", None])) for i in range(400)] + [(500, "w " * 3, "tiny")]
    rows = mixing.mix_sources(table(spark, docs)).collect()
    sizes = {s: sum(len(t.split()) for _, t, x in docs if x == s) for s in {d[2] for d in docs}}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, target = sum(sizes.values()), set(order), {}
    while True:  # plain repeated clamping
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= over
    target |= share
    source = {d[0]: d[2] for d in docs}
    for r in rows:
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]]) and 0 <= r["taken"] <= 3 * r["size"]
    for s in order:
        assert abs(sum(r["taken"] for r in rows if source[r["doc_id"]] == s) - target[s]) <= 5


def test_mix_odd(spark):
    got = by_id(mixing.mix_sources(table(spark, ODD)).select("doc_id", "size", "taken"))
    assert got[1][0]["size"] == 0 == got[2][0]["size"] == got[4][0]["taken"] and len(got[5]) == 2 and got[3][0]["size"] == 30_000
    assert mixing.mix_sources(table(spark, [])).count() == 0


# --- licences -------------------------------------------------------------------

def test_licences(spark):
    rows = [(1, "x\nReleased under the MIT License.", "a"), (2, "MIT-license, mit  LICENSE", "a"), (3, "Licensed under CC BY-NC 4.0.", "a"), (4, "the gnu general public license version 3 and cc by", "a"), (5, "mit éLicense license mit", "a"), (6, "this work are licensed under the gnu general public license version 3", "a")]
    got = {r["doc_id"]: r for r in licences.scan_licences(table(spark, rows + [(i + 10 if i else i, t, s) for i, t, s in ODD])).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["base_labels"], got[1]["labels"]) == (1, 4, "mit", "mit,mit-notice")
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"]) == (2, 0, 2)
    assert got[3]["base_labels"] == "cc-by" and "cc-by-nc-4.0" in got[3]["labels"] and "cc-by-4.0" not in got[3]["labels"]
    assert got[4]["base_labels"] == "cc-by,gpl" and got[4]["n_base"] == 2
    assert got[5]["n_base"] == 0 and got[5]["first_word"] is None and got[5]["score"] == 0
    assert "gpl-3.0" in got[6]["labels"] and 0.8 <= got[6]["score"] < 1
    assert got[11]["n_words"] == 0 and got[13]["n_words"] == 30_000 and None in got
    assert licences.scan_licences(table(spark, [])).count() == 0


def brute_licences(docs):
    """Every template laid at every place of every text."""
    texts = [[w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(licences.UPPER, licences.LOWER)))] for _, t, _ in docs]
    vocabulary = {w for phrase in licences.BASE.values() for w in phrase.split()} | {w for _, notice, _ in licences.NOTICES for w in notice.split()}
    idf = {w: math.log((len(docs) + 1) / (sum(w in t for t in texts) + 1)) + 1e-6 for w in vocabulary}
    out = []
    for (i, _, _), words in zip(docs, texts, strict=True):
        at = lambda k, words=words: words[k] if 0 <= k < len(words) else None
        places = [(s, label) for label, phrase in licences.BASE.items() for s in range(len(words)) if words[s : s + len(phrase.split())] == phrase.split()]
        shares = {}
        for label, notice, key in licences.NOTICES:
            notice, key = notice.split(), key.split()
            first = next(k for k in range(len(notice)) if notice[k : k + len(key)] == key)
            for s in range(-len(notice), len(words)):
                if s + first >= 0 and words[s + first : s + first + len(key)] == key:
                    share = sum(idf[w] for k, w in enumerate(notice) if at(s + k) == w) / sum(idf[w] for w in notice)
                    shares[label] = max(share, shares.get(label, 0.0))
        labels = {label for _, label in places} | {label for label, v in shares.items() if v >= licences.COVERAGE}
        starts = [s for s, _ in places]
        best = min(1.0, max([0.5 if places else 0.0, *shares.values()]))
        out.append((i, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places})), ",".join(sorted(labels)), round(best, 6)))
    return out


def test_licences_equal_brute_force(spark):
    rng = random.Random(4)
    phrases = [*licences.BASE.values(), *[n for _, n, _ in licences.NOTICES], *[k for _, _, k in licences.NOTICES]]
    docs = [(r["doc_id"], r["text"], "a") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for i in range(120):  # notices with words changed, left out and put in
        words = []
        for phrase in rng.sample(phrases, rng.randint(1, 3)):
            some = [rng.choice([w, w.upper(), "other", ""]) if rng.random() < 0.15 else w for w in phrase.split()]
            words += [*some, *rng.sample(["cc", "by", "gnu", "license", "x", "the", "mit"], rng.randint(0, 3))]
        docs.append((10_000 + i, rng.choice([" ", "-", ". ", "\n"]).join(words), "a"))
    got = sorted(tuple(r) for r in licences.scan_licences(table(spark, docs)).collect())
    want = sorted(brute_licences(docs))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[:7] == w[:7] and g[7] == pytest.approx(w[7], abs=2e-6)


# --- secrets --------------------------------------------------------------------

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


SCANNER = secrets.Scanner()
PIECES = st.sampled_from(["token", "SECRET", "api_key", "apikey", "passwd", "password", "=", ":", " ", '"', "'", "==", "AKIA", "AKIAABCDEFGH12345", "0123456789abcdef", "deadbeef" * 4, "x", "é", "Zz9_", "\n", "abcdefgh", "ghp_", "A" * 40])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_secrets_equal_re(text):
    data = text.encode()
    got = [(len(data[:s].decode()), r, len(data[:e].decode())) for s, r, e in SCANNER.spans(data) if r < 3]
    assert got == brute_secrets(text)


OWN = st.sampled_from(["ghp_", "gho_", "ghs_", "xoxb-", "xoxa-", "AIza", "sk_live_", "rk_test_", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "Ab1" * 7, "Zz9" * 14, "x" * 12, "_", "-", " ", "é", "k"])


@settings(max_examples=300, deadline=None)
@given(st.lists(OWN, max_size=12).map("".join))
def test_own_secrets_equal_re(text):
    data = text.encode()
    got = [(len(data[:s].decode()), r, len(data[:e].decode())) for s, r, e in SCANNER.spans(data) if r >= 3]
    want = [(m.start(), r, m.end()) for r, (_, _, pattern, least, _) in enumerate(secrets.RULES) if r >= 3 for m in re.finditer(pattern, text, re.ASCII) if len(m[0]) >= least]
    assert sorted(got) == sorted(want)


def test_secrets_odd(spark):
    rows = [(9, "é token = 'abcdefgh1' ghp_" + "Zq" * 18, "a")]
    got = by_id(secrets.scan_secrets(table(spark, ODD + rows)))
    assert got[9][0]["n_assign"] == 1 and got[9][0]["spans"] == "assign:2:20,github:22:62"
    assert got[9][0]["base_sha256"] == hashlib.sha256(b"assign:2:20").hexdigest()
    assert got[1][0]["spans"] == "" and len(got[5]) == 2 and None in got
    assert secrets.scan_secrets(table(spark, [])).count() == 0


# --- quality --------------------------------------------------------------------

def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "quality", "doc_id", "score").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and 0 <= r["score"] <= 1 for r in rows)
    for kind in (0, 1):
        some = [r for r in rows if r["quality"] == kind]
        assert sum(r["predicted"] == kind for r in some) >= 0.9 * len(some) > 0


def test_quality_odd(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score_quality(table(spark, ODD), none).collect()
    assert len(got) == 7 and {round(r["score"], 6) for r in got} == {0.5} and "n_chars" in got[0].asDict()
    assert quality.score_quality(table(spark, []), none).count() == 0


def test_quality_long_texts_and_clashing_columns(spark):
    """Texts of many lines bound the fit and are scored whole; columns of the result's names are replaced."""
    good, bad = "The committee met and agreed on the plan for next year.", "$$$ BUY!!! NOW | 99 | $$$"
    rows = [(i, "\n".join([good if i % 2 else bad] * (3000 if i < 4 else 2)), "x", -5.0, "y") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out string, score double, predicted string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels, max_lines=20).collect()}
    assert len(got) == 40 and all(r["predicted"] == i % 2 and 0 <= r["score"] <= 1 and isinstance(r["held_out"], bool) for i, r in got.items())
    f, sizes = quality.line_features(rows[0][1])
    some, some_sizes = quality.stretch(7, f, sizes, 20)
    assert len(f) == 3000 and len(some) == len(some_sizes) == 20
    assert len(quality.stretch(7, f[:5], sizes[:5], 20)[0]) == 5 and len(quality.stretch(7, f[:20], sizes[:20], 20)[0]) == 20


def test_forward_backward():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    field = quality.LineField(np.zeros(1), rng.normal(size=(2, 2)))
    logits, lengths = rng.normal(size=(3, 4)), np.array([4, 2, 1])
    good, pairs = field.marginals(logits, lengths, pairwise=True)
    want = np.zeros((2, 2))
    for d, n in enumerate(lengths):
        total, one = 0.0, np.zeros(n)
        both = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(sum(logits[d, i] * y[i] for i in range(n)) + sum(field.pairs[y[i], y[i + 1]] for i in range(n - 1)))
            total += p
            one += p * np.array(y)
            for i in range(n - 1):
                both[y[i], y[i + 1]] += p
        assert good[d, :n] == pytest.approx(one / total)
        want += both / total
    assert pairs == pytest.approx(want)


# --- benchmark leaks ------------------------------------------------------------

def plain_distance(pattern, text):
    """Least edit distance of the pattern to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row[0] = row[:], i
        for j, t in enumerate(text, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (p != t))
    return min(row)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    items = [(k, " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(3, 25)))) for k in range(12)]
    docs = []
    for i in range(60):
        words = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(40)]
        leak = items[i % 12][1].split()
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(leak))
            leak[at : at + rng.randint(0, 1)] = [rng.choice(["zz", "A,"])] * rng.randint(0, 1) or []
            leak = leak or ["q"]
        docs.append((i, " ".join(words[:10] + leak + words[10:]).title(), "a"))
    bench = spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.find_leaks(table(spark, docs + [(100 + (i or 0), t, s) for i, t, s in ODD]), bench, max_block_mb=0.0001).collect()}
    want = {}
    for i, text, _ in docs:
        for k, item in items:
            words = decontam.words_of(item)
            if len(words) >= 5 and (d := plain_distance(words, decontam.words_of(text))) <= int(0.2 * len(words)):
                want[i, k] = d
    assert got == want and want
    clean = decontam.drop_leaks(table(spark, docs), bench)
    assert {r["doc_id"] for r in clean.collect()} == {d[0] for d in docs} - {i for i, _ in want} and clean.columns == SCHEMA.replace(",", "").split()[::2]
    assert decontam.find_leaks(table(spark, []), bench).count() == 0
    assert decontam.find_leaks(table(spark, docs), bench.limit(0)).count() == 0


def test_leaks_of_short_and_unspaced_items(spark):
    """Short items match exactly; items without spaces are found with a few characters changed."""
    zh = "今天我们讨论一个关于整数分解的问题请给出所有可能的答案并说明理由"
    items = [(1, "Photosynthesis converts sunlight"), (2, "the cat"), (3, zh), (4, "光合作用需要阳光"), (5, "คนไทยกนขาวทกวนเชาเยนและดมนามากมายในบาน"), (6, "天气")]
    near = zh[:10] + "某" + zh[11:20] + zh[21:]
    docs = [
        (1, "we know photosynthesis, converts SUNLIGHT daily", "a"), (2, "we know photosynthesis turns sunlight daily, the cat", "a"), (3, "前文" + near + "后文天气", "a"),
        (4, "因为光合作用需要阳光所以", "a"), (5, "因为光合作用需要水所以", "a"), (6, "xx" + items[4][1][:20] + "ก" + items[4][1][20:] + "xx", "a"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["distance"], r["item_words"], r["first_word"], r["end_word"]) for r in decontam.find_leaks(table(spark, docs), bench).collect()}
    assert got == {(1, 1): (0, 3, 2, 5), (3, 3): (2, len(zh), 2, 1 + len(zh)), (4, 4): (0, 8, 2, 10), (6, 5): (1, len(items[4][1]), 1, 2 + len(items[4][1]))}
    assert sorted(r["doc_id"] for r in decontam.drop_leaks(table(spark, docs), bench).collect()) == [2, 5]


# --- token counts ---------------------------------------------------------------

def test_trie_equals_plain(spark):
    rng = random.Random(7)
    pieces = {"▁": -3.0, "a": -2.0, "ab": -2.5, "▁ab": -2.6, "b": -2.2, "ba": -3.5, "é": -4.0, "abab": -4.1}
    counter = tokens.TokenCounter(pieces)
    words = sorted({"▁" + "".join(rng.choice("abécœ") for _ in range(rng.randint(0, 12))) for _ in range(400)})
    assert counter.count_in_trie(words).tolist() == [counter.count_alone(w) for w in words]


def test_tokens_odd(spark):
    rows = [(9, "x" * 5000 + " the the end", "a")]
    got = by_id(tokens.count_tokens(table(spark, ODD + rows)))
    counter = tokens.TokenCounter(tokens.read_pieces(tokens.VOCABULARY))
    assert got[9][0]["n_tokens"] == sum(counter.count_alone("▁" + w) for w in ("x" * 5000, "the", "the end")) and got[9][0]["n_words"] == 3
    assert got[1][0]["n_tokens"] == 0 and len(got[5]) == 2 and None in got and got[3][0]["n_tokens"] == 30_000 * counter.count_alone("▁word")
    assert tokens.count_tokens(table(spark, [])).count() == 0


# --- personal data --------------------------------------------------------------

def test_pii(spark):
    rows = [(i, f"mail {a}@x{i % 3}.example.com, ip 10.0.{i}.7 CALL +1 (20{i % 10}) 555-01{i:02d} card 4111-1111-1111-11{i:02d}", "a") for i, a in enumerate("abcdefghijklmnopqrst")]
    rows += [(50, "Mrs. Anna Smith met Mr. Smith; MRS. SMITH wrote to A@X0.EXAMPLE.COM", "a"), (51, "Frau Schmidt und Herr Schmidt. Госпожа Анна Иванова", "a"), (52, "nothing to see, 12 or 3.5 or 1.2.3", "a")]
    docs = table(spark, rows + [(100 + (i or 0), t, s) for i, t, s in ODD])
    out = pii.replace_pii(docs, key=b"k")
    got = {r["doc_id"]: r for r in out.collect()}
    old = {i: t for i, t, _ in rows}
    cores = lambda text: {(k, c) for _, _, k, c, _ in pii.find_entities(text)}
    before, after = set().union(*(cores(t) for t in old.values())), set().union(*(cores(got[i]["text"]) for i in old))
    apart = lambda some: {x for x in some if not x[0].startswith("given")}
    assert not apart(before) & apart(after) and len(apart(before)) == len(apart(after))
    assert got[52]["text"] == old[52] and got[52]["n_entities"] == 0 and got[101]["text"] is None and got[103]["text"] == LONG
    words = got[50]["text"].replace(";", "").split()
    assert words[2] == words[5] and words[7] == words[2].upper() and words[-1].isupper() and words[-1].lower() in got[0]["text"]
    assert re.search(r"\+1 \(\d{3}\) 555-\d{4} card \d{4}-\d{4}-\d{4}-\d{4}", got[3]["text"])
    assert re.search("[А-Я]", got[51]["text"].split("Госпожа ")[1])
    joined = {r["doc_id"]: r["text"] for r in pii.replace_pii(docs, key=b"k", max_sent=-1).collect()}
    assert joined == {i: r["text"] for i, r in got.items()}
    assert pii.replace_pii(table(spark, []), key=b"k").count() == 0


def test_pii_collisions(spark):
    """As many one-letter addresses as there are letters: all must stay apart."""
    docs = table(spark, [(i, f"{a}@mail.example.com", "a") for i, a in enumerate("abcdefghijklmnopqrstuvwxyz")])
    moved = [r["text"] for r in pii.replace_pii(docs, key=b"other").collect()]
    assert len(set(moved)) == 26


def test_pii_given_names(spark):
    """More given names than the list has, among them names of the list: all stay apart, and none is a real one."""
    given = ["Alan", "Brian", "Colin", "David", "Eric", "Felix", "Frank", "George", "Hugo", "Ian", "Jack", "Kevin", "Luke", "Mark"]
    docs = table(spark, [(i, f"Mr {g} Smith", "a") for i, g in enumerate(given)] + [(50, "Dr Robin Smith and Mrs Julia Adrian", "a")])
    got = {r["doc_id"]: r["text"].split() for r in pii.replace_pii(docs, key=b"k").collect()}
    moved = [got[i][1] for i in range(len(given))] + [got[50][1], got[50][5]]
    assert len(set(moved)) == len(moved)
    assert not {*moved, got[50][6], got[50][2]} & {*given, "Robin", "Julia", "Adrian", "Smith"}
    assert len({got[i][2] for i in range(len(given))} | {got[50][2]}) == 1


def test_pii_whole_entities(spark):
    """Addresses, names and phone numbers in all their forms leave nothing behind, and what is beside them stays."""
    wanted = {
        "_john@x.org_": "john", "-john@x.org": "john", "..john@x.org": "john", "josé.9@x.org": "josé", "jose\u0301.9@x.org": "jose\u0301", "请联系john@x.org请回复": "john", "用户@例子.公司": "用户",
        "ann@secretfirm.com.au": "secretfirm", "ann@münchen.de": "münchen",
        "Mr John Paul Smith said": "John Paul Smith", "Dr. J. Smith": "J Smith", "Mr O'Brien's dog": "Brien", "Mrs Smith-Jones led": "Smith Jones", "Dr. J.R.R. Tolkien": "Tolkien", "Herr Dr. Schmidt": "Schmidt",
        "Frau von der Leyen": "Leyen", "Prof. Jean-Paul d'Arc": "Jean Paul Arc", "Доктор И. И. Иванов": "Иванов", "MR JOHN PAUL SMITH": "JOHN PAUL SMITH", "Mr J Smith": "J Smith",
        "call (202) 555-0101": "0101", "202-555-0147": "0147", "1-800-555-0199": "0199", "030 1234567": "1234567", "0171/1234567": "1234567", "(020) 7946 0958": "7946", "0049 30 1234567": "1234567", "tel: 5551234567": "5551234567",
    }
    got = [r["text"] for r in pii.replace_pii(table(spark, [(i, t, "a") for i, t in enumerate(wanted)]), key=b"k").orderBy("doc_id").collect()]
    for (text, gone), new in zip(wanted.items(), got, strict=True):
        words = re.findall(r"[^\W_]+", new)
        assert not set(re.findall(r"[^\W_]+", gone)) & set(words) and new != text, (text, new)
    assert got[0].startswith("_") and got[0].endswith("_") and got[5].startswith("请联系") and got[5].endswith("请回复")
    at = list(wanted).index
    assert got[at("Mr O'Brien's dog")].endswith("'s dog") and re.fullmatch(r"Mrs \w+-\w+ led", got[at("Mrs Smith-Jones led")])
    assert re.fullmatch(r"Dr\. [A-Z]\w*\. \w+", got[at("Dr. J. Smith")]) and got[at("call (202) 555-0101")].startswith("call (") and got[at("0049 30 1234567")].startswith("0049 3")
    one, other = pii.find_entities("(202) 555-0101 and +1 202 555 0101")
    assert one[2:4] == other[2:4]
    for text in ("01.02.2024 12:30", "2024-01-02 03 04", "order 5551234567", "3.14159 12 10", "a@b", "Mr. and so", "12 or 3.5 or 1.2.3"):
        assert not pii.find_entities(text)


# --- repeated lines -------------------------------------------------------------

def brute_lines(docs, lower=str.lower):
    seen, out = [], set()
    for i, text, _ in sorted((d for d in docs if d[1] is not None), key=lambda d: (d[0] is not None, d[0])):
        for k, line in enumerate(text.split("\n")):
            s = frozenset(re.findall(r"[^\x20\x09-\x0D]+", lower(line)))
            if s:
                hit = next(((j, m) for j, m, t in seen if 5 * len(s & t) >= 4 * len(s | t)), None)
                if hit:
                    out.add((i, k, *hit))
                seen.append((i, k, s))
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(11)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 2) for _ in range(rng.randint(1, 30))] for _ in range(25)]
    docs = []
    for i in range(40):
        some = []
        for words in rng.sample(base, 4):
            words = [w if rng.random() > 0.08 else rng.choice("qrstuv") for w in words]
            some.append(rng.choice([" ", "  ", "\t"]).join(words))
        docs.append((i, "\n".join(some) + rng.choice(["", "\n", "\n\n"]), "a"))
    docs += [(90, None, "a"), (91, "", "a"), (92, " \n \n", "a"), (93, "wİx É é\ne\nw", "a")]
    want = brute_lines(docs)
    got = {tuple(r) for r in lines.repeated_lines(table(spark, docs)).select("doc_id", "line_no", "first_id", "first_line").collect()}
    assert got == want
    gone = {(i, k) for i, k, _, _ in want}
    kept = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(table(spark, docs)).collect()}
    for i, text, _ in docs:
        assert kept[i] == (None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone))
    assert lines.repeated_lines(table(spark, [])).count() == 0


def test_lines_odd(spark):
    """Null ids, repeated rows, empty and very long texts, ties, and groups whose sets are all alike."""
    docs = [*ODD, (6, "same text twice over\nno id here", "b"), (7, "over twice text same\n" + "x " * 9 + "no id here", "b")]
    docs += [(20 + i, " ".join([f"w{k}" for k in range(30)] + [f"own{i}"]) + "\n" + " ".join(f"v{k}" for k in range(i, i + 12)), "c") for i in range(25)]
    docs += [(60, " ".join(f"z{k}" for k in range(5000)), "d"), (61, " ".join(f"z{k}" for k in range(40, 5000)), "d")]
    want = brute_lines(list(dict.fromkeys(docs)))
    got = [tuple(r) for r in lines.repeated_lines(table(spark, docs)).select("doc_id", "line_no", "first_id", "first_line").collect()]
    assert set(got) == want and (6, 1, None, 0) in want and (61, 0, 60, 0) in want
    assert len(lines.drop_repeated_lines(table(spark, docs)).collect()) == len(docs)


def tried(spark, monkeypatch, docs):
    """The result's keys, and how many pairs of sets were counted in full for them."""
    n, whole = [], lines.LineDedup.verified
    monkeypatch.setattr(lines.LineDedup, "verified", lambda self, a, sets, tries: n.append(tries.count()) or whole(self, a, sets, tries))
    return {tuple(r) for r in lines.repeated_lines(table(spark, docs)).select("doc_id", "line_no", "first_id", "first_line").collect()}, sum(n)


def test_lines_pairs_tried(spark, monkeypatch):
    """Long lines that share single words are told apart without counting; a group of near copies is counted about once a line; white space of all kinds parts words."""
    rng = random.Random(17)
    words = [f"{rng.choice('abcdefgh')}{k}" for k in range(1500)]
    apart = [(i, " ".join(rng.sample(words, rng.randint(130, 170))), "a") for i in range(60)]
    got, n = tried(spark, monkeypatch, apart)
    assert got == brute_lines(apart) and n < 20
    base = [f"w{k}" for k in range(40)]
    group = [(i, " ".join([w for w in base if rng.random() > 0.03] + [f"own{i}"] * rng.randint(0, 1)), "a") for i in range(150)]
    got, n = tried(spark, monkeypatch, group)
    assert got == brute_lines(group) and n < 3 * len(group)
    odd = [(i, "\n".join(rng.choice([" ", "\t", "\r", "\x0b", "\f", " \t "]).join(["", *rng.sample("abcdef", rng.randint(0, 6)), ""]) for _ in range(4)), "a") for i in range(30)]
    assert tried(spark, monkeypatch, odd)[0] == brute_lines(odd)


def test_lines_little_is_tried_first(spark, monkeypatch):
    """Sets in no crowd are compared by the join alone, and only sets of crowds are written again with their bound."""
    rng, n, bounds, whole, save = random.Random(23), [], [], lines.LineDedup.verified, lines.Scratch.save
    monkeypatch.setattr(lines.LineDedup, "verified", lambda self, a, sets, tries: n.append(tries.count()) or whole(self, a, sets, tries))

    def saved(self, df, *a):
        out = save(self, df, *a)
        if "bound" in df.columns:
            bounds.append(out.count())
        return out

    monkeypatch.setattr(lines.Scratch, "save", saved)
    pairs = [[f"{k}w{rng.randint(0, 10**6)}" for _ in range(20)] for k in range(30)]
    docs = [(i, " ".join([*words, f"own{i}"]), "a") for i, words in enumerate([*pairs, *pairs])]
    crowd = [(100 + i, " ".join([*[f"c{k}" for k in range(30)], f"own{100 + i}"]), "a") for i in range(40)]
    got = lambda docs: {tuple(r) for r in lines.repeated_lines(table(spark, docs)).select("doc_id", "line_no", "first_id", "first_line").collect()}
    assert got(docs) == brute_lines(docs) and n[0] == 0 and sum(bounds) < 10
    n.clear(), bounds.clear()
    assert got(docs + crowd) == brute_lines(docs + crowd) and 30 < n[0] < 40 and sum(n) < 120 and sum(bounds) < 60


# --- n-gram join ----------------------------------------------------------------

def test_shingles():
    for n in (1, 2, 4):
        sh = Shingler(n)
        rng = random.Random(n)
        texts = ["", " ", "One two", "ONE two", "a" * 300_000 + " b", *[rng.choice([" ", "\n"]).join(rng.choice(["a", "b", "é", "cc"]) for _ in range(rng.randint(1, 9))) for _ in range(200)]]
        seen = {}
        for t in texts:
            w = t.encode().lower().split()
            want = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
            got = sh(t).tolist()
            assert len(got) == len(want)
            assert seen.setdefault(want, got) == got
    assert not set(Shingler(2)("a b c").tolist()) & set(Shingler(2)("ab c d").tolist())


def test_join_equals_brute_force(spark):
    rng = random.Random(13)
    bases = [[str(rng.randint(0, 60)) for _ in range(rng.randint(3, 60))] for _ in range(12)]
    docs = []
    for i in range(240):
        w = list(bases[i % 12 if i % 3 else 0])
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = str(rng.randint(100, 130))
        docs.append((1000 - i, " ".join(w), "a"))
    docs += [(2000, None, "a"), (2001, "", "a"), (2002, "\t", "a"), (None, docs[0][1], "a"), (docs[0][0], docs[0][1], "a"), (3000, LONG, "a"), (3001, LONG, "a")]
    sets = {i: frozenset(tuple(t.split()[k : k + 4]) for k in range(max(1, len(t.split()) - 3))) if t and t.split() else frozenset() for i, t, _ in docs if i is not None}
    part = {i: i for i in sets}

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                part[max(x, y)] = min(x, y)
    few, ngram_join.FEW = ngram_join.FEW, 4  # so that clusters of both kinds meet
    try:
        got = ngram_join.near_components(table(spark, docs), n=4, percent=85).collect()
    finally:
        ngram_join.FEW = few
    assert len(got) == len(docs)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"])), r
        else:
            assert r["component_id"] is None
    assert ngram_join.near_components(table(spark, [])).count() == 0


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {tuple(r) for r in con.execute(lines.SQL).fetchall()}
    assert {tuple(r) for r in lines.repeated_lines(docs).collect()} == want
    want = {r[0]: r[1:] for r in con.execute(mixing.SQL).fetchall()}
    for r in mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken").collect():
        assert want[r[0]] == tuple(r[1:])
    assert docs.where(F.col("text").isNull()).count() == 0
