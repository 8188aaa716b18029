import random
import re
import unicodedata

import pytest

from skyquilt.llm import pii

SCHEMA = "doc_id long, text string, n_entities string, kind string, core string, moved string, _row string"


def table(spark, rows):
    """Rows (doc_id, text), with columns whose names the operator uses too."""
    return spark.createDataFrame([(i, t, "n", "k", "c", "m", "r") for i, t in rows], SCHEMA)


def account(country, rest):
    return f"{country}{pii._check_digits(country, rest):02d}{rest}"


def entities():
    """A few hundred different entities of all kinds, as (kind, text)."""
    rng = random.Random(3)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = {"latin": "abcdefgh", "cyrillic": "абвгдежз", "greek": "αβγδεζηθ", "han": "安文明国家华建志", "arabic": "بتثجحخدذ"}
    word = lambda script, n: "".join(rng.choice(letters[script]) for _ in range(n))
    out = set()
    for script, top in (("latin", "com"), ("latin", "org"), ("cyrillic", "рф"), ("greek", "ελ"), ("han", "公司"), ("arabic", "مصر")):
        domains = [f"{word(script, 3)}.{top}" for _ in range(8)]
        domains += [f"{word(script, 2)}.{d}" for d in domains[:4]]
        out |= {("email", f"{word(script, rng.randint(1, 3))}@{d}") for d in domains for _ in range(4)}
    out |= {("ip", f"10.{rng.randrange(256)}.{rng.randrange(256)}.7") for _ in range(30)}
    out |= {("ipv6", f"2001:db8:{rng.randrange(1, 99):x}::{rng.randrange(1, 65535):x}") for _ in range(30)}
    out |= {("iban", account("DE", number(18))) for _ in range(20)} | {("iban", account("GB", "WEST" + number(14))) for _ in range(20)}
    out |= {("ssn", f"{number(3)}-{number(2)}-{number(4)}") for _ in range(30)} | {("card", number(16)) for _ in range(30)}
    out |= {("phone", f"+44 20 {number(4)} {number(4)}") for _ in range(30)}
    return sorted(out)


def script_of(text):
    return {unicodedata.name(c).split()[0] for c in text if c.isalpha()}


@pytest.mark.parametrize("max_sent", [200_000, -1])
def test_one_to_one(spark, max_sent):
    """All entities in two documents each, against plain dictionaries: one surrogate each, no two alike, none a real one, format kept."""
    some = entities()
    rows = [(i % len(some), f"see {some[i % len(some)][1]} there") for i in range(2 * len(some))]
    got = pii.replace_pii(table(spark, rows), key=b"k", max_sent=max_sent).select("doc_id", "text", "n_entities").collect()
    moved = {}
    for r in got:
        assert r["n_entities"] == 1 and r["text"].startswith("see ") and r["text"].endswith(" there")
        moved.setdefault(some[r["doc_id"]], set()).add(r["text"][4:-6])
    assert len(moved) == len(some) and all(len(v) == 1 for v in moved.values())
    moved = {k: v.pop() for k, v in moved.items()}
    assert len(set(moved.values())) == len(some) and not set(moved.values()) & {t for _, t in some}
    for (kind, old), new in moved.items():
        assert [x[2] for x in pii.find_entities(f"see {new} there")] == [kind], (old, new)
        if kind == "email":
            assert script_of(old.rpartition(".")[0]) == script_of(new.rpartition(".")[0]) and old.count(".") == new.count(".")
        else:
            assert kind in ("ip", "ipv6") or [c.isdigit() for c in old] == [c.isdigit() for c in new]
    hosts = {(old.partition("@")[2], new.partition("@")[2]) for (kind, old), new in moved.items() if kind == "email"}
    assert len({a for a, _ in hosts}) == len({b for _, b in hosts}) == len(hosts)
    above = {(a.partition(".")[2], b.partition(".")[2]) for a, b in hosts if a.count(".") == 2}
    assert len({a for a, _ in above}) == len(above) and above <= {(a, b) for a, b in hosts if a.count(".") == 1}


def test_names_without_titles(spark):
    """Names of many scripts, with and without a title: replaced in their script, by the right gender, and the same everywhere."""
    texts = [
        "John Smith called.", "Mary O’Neil (CEO)", "先生 王小明", "感谢王小明先生的", "김철수 씨는", "Mr. Νίκος Παπαδόπουλος είπε", "Dr Mary Smith and John Q. Public", "Иван Петров сказал",
        "Hans von der Heide", "Mr. محمد علي قال", "JOHN SMITH SAID", "Mr Smith était là",
    ]
    got = {r["doc_id"]: r["text"] for r in pii.replace_pii(table(spark, list(enumerate(texts))), key=b"k").collect()}
    given, family = got[0].split()[:2]
    assert got[0].endswith(" called.") and {given, family} & {"John", "Smith"} == set()
    assert got[10] == f"{given.upper()} {family.upper()} SAID" and got[11] == f"Mr {family} était là"
    assert re.fullmatch(rf"Dr (\w+) {family} and {given} [A-Z]+\. \w+", got[6]) and got[1].split()[0] == got[6].split()[1]
    assert re.fullmatch(r"[A-Z]\w* [A-Z]’\w+ \(CEO\)", got[1])
    assert got[2].startswith("先生 ") and got[3] == f"感谢{got[2][3:]}先生的" and not set("王小明") & set(got[2])
    assert got[4].endswith(" 씨는") and got[4][:3] != "김철수" and script_of(got[4]) == {"HANGUL"}
    assert got[5].startswith("Mr. ") and got[5].endswith(" είπε") and script_of(got[5][4:]) == {"GREEK"} and "Παπαδόπουλος" not in got[5]
    assert got[7].endswith(" сказал") and script_of(got[7]) == {"CYRILLIC"} and "Петров" not in got[7]
    assert re.fullmatch(r"\w+ von der \w+", got[8]) and "Heide" not in got[8]
    assert got[9].endswith(" قال") and script_of(got[9][4:]) == {"ARABIC"} and "محمد" not in got[9]
    for clean in ("Maria The", "12:30:45", "a::b", "std::x", "00:1a:2b:3c:4d:5e", "Madison Avenue", "이야기 씨앗", "高兴的先生", "http://[::1]/"):
        assert not pii.find_entities(clean), clean


def test_null_ids_and_long_texts(spark):
    rows = [(None, "bob@acme.com"), (None, "bob@acme.com"), (None, None), (1, ""), (2, "word " * 200_000 + "bob@acme.com"), (None, "ann@acme.com")]
    out = pii.replace_pii(table(spark, rows), key=b"k")
    assert out.columns == ["doc_id", "text", "n_entities", "kind", "core", "moved", "_row"]
    got = out.collect()
    bob = {r["text"].split()[-1] for r in got if r["text"] and (r["doc_id"] == 2 or r["doc_id"] is None)}
    assert len(got) == 6 and sum(r["doc_id"] is None for r in got) == 4 and len(bob) == 2 and len({b.partition("@")[2] for b in bob}) == 1
    assert sorted(r["n_entities"] for r in got) == [0, 0, 1, 1, 1, 1] and {r["kind"] for r in got} == {"k"}
    assert pii.replace_pii(table(spark, []), key=b"k", max_sent=-1).count() == 0
