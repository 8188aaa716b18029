"""Personal data: keyed surrogates of the same type and format, distinct and the same for the same entity."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt.storage import Scratch

# Titles before names, by gender; given names that stand for others, by script and gender; given names that are
# known without a title; family names of scripts that write them first; titles behind these; words that are no family name.
TITLES = {
    "m": ["mr", "herr", "monsieur", "señor", "sr", "signor", "господин", "κύριος"],
    "f": ["mrs", "ms", "miss", "frau", "madame", "mme", "señora", "sra", "signora", "госпожа", "κυρία"],
    "n": ["dr", "prof", "доктор"],
}
GIVEN = {
    ("latin", "m"): ["Adrian", "Bruno", "Colin", "Dario", "Edgar", "Felix", "Gavin", "Hugo", "Ivo", "Julian", "Kaspar", "Leander", "Magnus", "Norbert", "Oskar", "Quentin", "Rufus", "Silvan", "Tibor", "Valentin"],
    ("latin", "f"): ["Alma", "Bianca", "Clara", "Daria", "Elena", "Flora", "Greta", "Helga", "Irma", "Julia", "Klara", "Leona", "Mathilda", "Nora", "Ottilie", "Paula", "Ramona", "Selma", "Thea", "Viola"],
    ("latin", "n"): ["Ariel", "Robin", "Kim", "Sasha", "Noel", "Jules", "Andrea", "Dominique", "Alexis", "Toni"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Игорь", "Кирилл", "Леонид", "Максим"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Ирина", "Ксения", "Лариса", "Мария"],
    ("cyrillic", "n"): ["Саша", "Женя", "Валя", "Слава", "Шура", "Паша", "Миша", "Лёля", "Витя", "Тоня"],
    ("greek", "m"): ["Άγγελος", "Βασίλης", "Γεράσιμος", "Ευάγγελος", "Θωμάς", "Λουκάς", "Πέτρος", "Σταύρος"],
    ("greek", "f"): ["Αγγελική", "Βασιλική", "Γεωργία", "Δήμητρα", "Ευαγγελία", "Ζωή", "Θεοδώρα", "Σοφία"],
    ("arabic", "m"): ["أحمد", "حسن", "خالد", "سامي", "طارق", "عمر", "كريم", "ياسر"],
    ("arabic", "f"): ["أمينة", "حنان", "زينب", "سعاد", "فاطمة", "ليلى", "مريم", "نادية"],
    ("han", "m"): ["伟", "强", "军", "勇", "杰", "涛", "刚", "志强", "建军", "国栋"],
    ("han", "f"): ["芳", "娜", "敏", "静", "丽", "艳", "娟", "秀英", "桂芳", "玉兰"],
}
KNOWN = {
    "m": (
        "James John Robert Michael David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Steven Paul Andrew Joshua Kenneth Kevin Brian "
        "George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Benjamin Samuel Gregory Patrick Alexander Peter "
        "Hans Klaus Jürgen Wolfgang Stefan Andreas Pierre Michel Philippe François Juan Carlos José Luis Miguel Giovanni Luca "
        "Иван Сергей Алексей Дмитрий Александр Владимир Николай Михаил Андрей Γιώργος Νίκος Κώστας Δημήτρης"
    ).split(),
    "f": (
        "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Sandra Betty Ashley Emily Kimberly Margaret Donna Michelle "
        "Carol Amanda Melissa Deborah Stephanie Rebecca Laura Cynthia Kathleen Angela Anna Emma Nicole Helen Katherine Christine Rachel Maria Marie "
        "Ursula Monika Petra Sabine Claudia Brigitte Isabelle Nathalie Sophie Catherine Carmen Ana Isabel Lucía Giulia Francesca Chiara "
        "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Μαρία Ελένη Κατερίνα"
    ).split(),
}
FAMILY = {"han": "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩冯邓曹彭曾萧田董潘袁蔡蒋余于杜叶程魏苏吕丁沈任姚卢", "hangul": "김이박최정강조윤장임한오서신권황안송전홍"}
HONOURS = {"先生": "m", "女士": "f", "小姐": "f", "太太": "f", "博士": "n", "教授": "n", "老师": "n"}
NO_FAMILY = frozenset("The And Of In On At For With But He She It They We You I A An To From As By Is Was".split())
# Letters of scripts whose letters are no range of code points, and the top-level domains that are set aside for examples and tests.
LETTERS = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "kana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",
    "han": "安文明国家华建志海林春秋山江河云天龙平和光成永新东南西北星月雪玉金石水木青红白正中大方长远清",
    "hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "arabic": "بتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "cyrillic": "".join(map(chr, range(0x430, 0x450))), "thai": "".join(map(chr, range(0xE01, 0xE2F))),
    "devanagari": "".join(map(chr, range(0x915, 0x93A))), "hangul": "".join(map(chr, range(0xAC00, 0xD7A4, 28))),
}
TOP_DOMAIN = {"cyrillic": "испытание", "greek": "δοκιμή", "arabic": "إختبار", "hebrew": "טעסט", "han": "测试", "kana": "テスト", "hangul": "테스트", "devanagari": "परीक्षा"}
# Lengths of account numbers by country.
IBAN_LENGTH = {
    "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26, "UA": 29,
}
# What made-up names are put together from: first letters, vowels, last letters of a syllable.
SYLLABLES = {"latin": ("bcdfghklmnprstvw", "aeiou", "lnrstdkm"), "cyrillic": ("бвгджзклмнпрстфш", "аеиоу", "лнрстдкм"), "greek": ("βγδζθκλμνπρστφχ", "αειου", "λνρ")}
_SCRIPTS = {"CYRILLIC": "cyrillic", "GREEK": "greek", "ARABIC": "arabic", "HEBREW": "hebrew", "CJK": "han", "HIRAGANA": "kana", "KATAKANA": "kana", "HANGUL": "hangul", "THAI": "thai", "DEVANAGARI": "devanagari"}
_KNOWN = {n: g for g, some in KNOWN.items() for n in some}
_TITLE = {t: g for g, some in TITLES.items() for t in some}
_SPOKEN = [f(t) for t in _TITLE for f in (str.capitalize, str.upper)]
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Scripts without spaces: there an address may follow a word directly.
_UNSPACED = "฀-໿က-႟ក-៿々-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_MARKS = "̀-ͯ"
_WORD, _RUN = rf"(?:(?![{_UNSPACED}])[^\W_])", rf"(?:(?![{_UNSPACED}])[\w{_MARKS}])"
_LOCAL = rf"(?:{_RUN}|[.!#$%&'*+/=?^`{{|}}~-])"
_LABEL = rf"(?:{_WORD}(?:(?:{_RUN}|-)*(?:{_WORD}|[{_MARKS}]))?|[{_UNSPACED}]+)"
EMAIL = re.compile(
    rf"(?:(?<![\w.!#$%&'*+/=?^`{{|}}~{_MARKS}-])|(?<=[{_UNSPACED}]))(?:_|[.!#$%&'*+/=?^`{{|}}~-])*+"
    rf"(?P<email>(?:{_WORD}{_LOCAL}*+|(?<![{_UNSPACED}])(?<![{_UNSPACED}][._%+-])[{_UNSPACED}][{_UNSPACED}\d._%+-]*+)@{_LABEL}(?:\.{_LABEL})+)"
)
NUMBER = re.compile(
    rf"(?=[+\d(])(?:(?<![\d.])(?P<ip>{_OCTET}(?:\.{_OCTET}){{3}})(?!\.?\d)"
    r"|(?<![\w+])(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4})(?!\d)"
    r"|(?<![\w.])(?P<card>\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7})(?!\w)"
    r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    # without a country code: three, three and four digits; or a leading 0 (00: a country code after all) and 9 to 15 digits in groups
    r"|(?<![\w+.(/-])(?P<american>(?:1[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}(?P<gap>[ .-]))\d{3}(?(gap)(?P=gap)|[ .-])\d{4})(?![\w-])(?!\.\d)"
    r"|(?<![\w+.(/-])(?P<national>(?=(?:\D{0,3}\d){9,15}(?!\D?\d))(?:\(0\d{1,5}\)[ ]?|0\d{1,5}(?:[ ]?/[ ]?|(?P<between>[ .-])))\d{2,8}(?:(?(between)(?P=between)|[ .-])\d{2,8})*)(?![\w-])(?!\.\d)"
    r"|(?<![\w+.(/-])(?P<spoken>\(?\d(?:[ ./()-]{0,2}\d){6,14})(?![\w-])(?!\.\d))"
)
SPOKEN_PHONE = re.compile(r"(?:\b(?:tel|telephone|phone|mobile|cell|fax|call|telefon|téléphone|teléfono|handy|тел|телефон)|电话|電話|手机|โทร)(?:[ .:#]|no\b|number\b){0,4}$", re.IGNORECASE)
# A piece of a name: letters, with an apostrophe inside but not before an ending such as 's; an initial is one letter.
_LETTER = rf"[^\W\d_][{_MARKS}]*"
_UPPER = r"(?=[^\W\d_a-zа-яёß-öø-ÿα-ωά-ώ])"
_PIECE = rf"(?:(?:[dl]['’])?{_UPPER}{_LETTER}(?:(?:{_LETTER})+(?:['’](?!(?:ll|ve|re)\b)(?:{_LETTER}){{2,}})*|['’](?!(?:ll|ve|re)\b)(?:{_LETTER}){{2,}}))"
_INITIAL = rf"(?:{_UPPER}{_LETTER}\.)"
_HYPHEN = r"[-‐‑](?:[a-zа-я]{1,3}[-‐‑])?"
_TITLES = rf"(?:{'|'.join(sorted(_SPOKEN, key=len, reverse=True))})"
_BARE = rf"(?:{_UPPER}{_LETTER}(?![\w'’]))"
_PART = rf"(?!{_TITLES}\b)(?:{_INITIAL}+(?:{_HYPHEN}{_INITIAL}+)*(?:{_PIECE}(?:{_HYPHEN}{_PIECE})*)?|(?:{_PIECE}|{_BARE}(?={_HYPHEN}))(?:{_HYPHEN}(?:{_PIECE}|{_BARE}))*)"
_GAP = r"[ \t\xa0]+"
_OF = rf"(?:(?:von|van|de|del|della|di|da|du|dos|bin|ibn|фон)(?:{_GAP}(?:la|las|los|le|der|den|dem|het))?{_GAP})?"
_LONE = rf"{_BARE}(?={_GAP}{_OF}(?:{_PART}|{_BARE}))"  # an initial without a full stop, before a further part
NAME = re.compile(rf"\b(?P<title>{_TITLES}\.?(?:{_GAP}{_TITLES}\.?)*){_GAP}(?P<name>{_OF}(?:{_LONE}|{_PART})(?:{_GAP}{_OF}(?:{_LONE}|{_PART}))*)")
NAME_PART = re.compile(rf"(?<!\S)(?:{_PART}|{_BARE})")
NAME_PIECE = re.compile(rf"{_PIECE}|{_INITIAL}|{_BARE}")
# A known given name, and what makes a name of it: more given names or initials, and a family name.
GIVEN_NAME = re.compile(rf"(?<![\w'’@./-]){_PIECE}(?={_GAP})")
FURTHER = re.compile(rf"(?:{_GAP}(?:(?:{'|'.join(_KNOWN)})(?={_GAP}{_UPPER})|{_INITIAL}|{_BARE}(?={_GAP}{_UPPER})))*{_GAP}{_OF}(?!{_TITLES}\b)(?P<family>{_PIECE}(?:{_HYPHEN}{_PIECE})*)")
_HAN = "\u4e00-\u9fff"
_NAMED = rf"(?:(?![的了是和在有不我你他她这那们])[{_HAN}])"
FAMILY_FIRST = re.compile(
    rf"(?:(?P<before>{'|'.join(HONOURS)})[ :：](?=[{FAMILY['han']}]{_NAMED}{{1,2}}(?![{_HAN}])))?(?P<han>[{FAMILY['han']}])(?P<given>{_NAMED}{{1,2}}?)(?:(?=[ ]?(?P<behind>{'|'.join(HONOURS)}))|(?(before)(?![{_HAN}])|(?!)))"
    rf"|(?<![가-힣])(?P<hangul>[{FAMILY['hangul']}])(?P<named>[가-힣]{{2}})(?=[ ]?[씨님](?:은|는|이|가|을|를|의|도|와|과|께|에|만|로)?(?![가-힣]))"
)
IBAN = re.compile(rf"(?<![\w-])(?:{'|'.join(IBAN_LENGTH)})\d\d(?:[ -]?[A-Z0-9]){{11,30}}")
IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?!\w)(?!\.\d)")
MOST_CAPITALS = 4  # parts: words in capitals that go on are a sentence and no name
ENTITY = "kind string, core string"


def find_entities(text: str | None) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, core, surface); the core is what all mentions of an entity share.

    Kinds: email (core: lower case), phone, card and ssn (core: digits, of a phone
    with the country code if it is known), iban (core: letters and digits), ip and
    ipv6, and pieces of names,
    ``given:script:gender``, ``family:script`` or ``initial:script`` (core: lower
    case), so that a full name and a later mention by family name stay one
    person.  The last part of a name of several is the family name.
    """
    text = text or ""
    out = []
    if "@" in text:
        out += [(*m.span("email"), "email", _core(m["email"]), m["email"]) for m in EMAIL.finditer(text)]
    for m in IBAN.finditer(text):
        end = _account_end(text, m.start())
        if end:
            out.append((m.start(), end, "iban", re.sub("[ -]", "", text[m.start() : end]), text[m.start() : end]))
    if text.count(":") > 1:
        for m in IPV6.finditer(text):
            surface = m[0][:-1] if m[0][-1] == ":" and m[0][-2] != ":" else m[0]
            groups = _groups(surface)
            if groups:
                out.append((m.start(), m.start() + len(surface), "ipv6", ":".join(groups), surface))
    for m in NUMBER.finditer(text):
        form, surface, a = m.lastgroup, m[0], m.start()
        digits = re.sub(r"\D", "", surface)
        if form in ("gap", "between"):
            form = "american" if m["american"] else "national"
        if form == "spoken":
            if not SPOKEN_PHONE.search(text[max(0, a - 24) : a]):
                continue
            form = "national"
        if form == "national" and m["national"] and not 9 <= len(digits) <= 15:  # a date, say
            continue
        if form == "american" and len(digits) == 10:
            digits = "1" + digits
        elif form == "national" and digits.startswith("00"):
            digits = digits[2:]
        kind = "phone" if form in ("american", "national") else form
        out.append((*m.span(), kind, surface if kind == "ip" else digits, surface))
    if any(t in text for t in _SPOKEN):
        for m in NAME.finditer(text):
            parts = list(NAME_PART.finditer(m["name"]))
            if m["name"].isupper():
                parts = parts[:MOST_CAPITALS]
            genders = [_TITLE[t.lower().rstrip(".")] for t in m["title"].split()]
            gender = next((g for g in genders if g != "n"), None) or next((_KNOWN[p[0]] for p in parts[:-1] if p[0] in _KNOWN), "n")
            if parts and _script(parts[0][0]) in CASELESS:
                parts = parts[:2]
            out += _pieces(m.start("name"), parts, gender)
    for m in GIVEN_NAME.finditer(text):
        gender = _KNOWN.get(m[0].title() if m[0].isupper() else m[0])
        more = gender and FURTHER.match(text, m.end())
        if more and more["family"].title() not in NO_FAMILY and (more["family"].isupper() or not m[0].isupper()):
            out += _pieces(m.start(), list(NAME_PART.finditer(text[m.start() : more.end()])), gender)
    if any(t in text for t in HONOURS) or "씨" in text or "님" in text:
        for m in FAMILY_FIRST.finditer(text):
            script = "han" if m["han"] else "hangul"
            given = "given" if m["han"] else "named"
            out.append((*m.span(script), f"family:{script}", m[script], m[script]))
            out.append((*m.span(given), f"given:{script}:{HONOURS.get(m['before'] or m['behind'], 'n')}", m[given], m[given]))
    out.sort()
    kept: list = []
    for span in out:  # of two that overlap, the first stays
        if not kept or span[0] >= kept[-1][1]:
            kept.append(span)
    return kept


CASELESS = frozenset(LETTERS) - set(SYLLABLES)


@lru_cache(maxsize=1 << 14)
def _script_of(c: str) -> str:
    return _SCRIPTS.get(unicodedata.name(c, "").split(" ")[0].split("-")[0], "latin")


def _script(word: str) -> str:
    """The script of a word: that of its first letter which is not Latin."""
    return "latin" if word.isascii() else next((s for s in map(_script_of, filter(str.isalpha, word)) if s != "latin"), "latin")


def _pieces(start: int, parts: list[re.Match], gender: str) -> Iterator[tuple[int, int, str, str, str]]:
    """The pieces of a name's parts, which begin at ``start``; of several parts the last is the family name."""
    for i, part in enumerate(parts):
        for x in NAME_PIECE.finditer(part[0]):
            at, piece = start + part.start() + x.start(), x[0].rstrip(".")
            script, core = _script(piece), _core(piece)
            what = f"initial:{script}" if len(core) == 1 else f"given:{script}:{gender}" if i < len(parts) - 1 else f"family:{script}"
            yield at, at + len(piece), what, core, piece


def _check_digits(country: str, account: str) -> int:
    """The two digits behind the country of an account number."""
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def _account_end(text: str, start: int) -> int | None:
    """Where the account number that begins at ``start`` ends, if its length and check digits are those of one."""
    left, at = IBAN_LENGTH[text[start : start + 2]], start
    while left and at < len(text) and (text[at].isascii() and text[at].isalnum() or text[at] in " -"):
        left -= text[at].isalnum()
        at += 1
    core = re.sub("[ -]", "", text[start:at])
    whole = not left and not text[at : at + 1].isalnum() and core == core.upper()
    return at if whole and _check_digits(core[:2], core[4:]) == int(core[2:4]) else None


def _groups(surface: str) -> list[str] | None:
    """The eight groups of an IPv6 address; None where it is none, or as short as ``a::b``, which is code more often."""
    try:
        groups = [f"{int(g, 16):x}" for g in ipaddress.IPv6Address(surface).exploded.split(":")]
    except ValueError:
        return None
    written = [g for g in surface.split(":") if g]
    return groups if any(map(str.isdigit, surface)) and written and (len(written[0]) > 2 or len(written) > 2) else None


def parts_of(spans: list[tuple[int, int, str, str, str]]) -> set[tuple[str, str]]:
    """What gets a surrogate of its own: the entities, and of an address also its host and all domains above that but the top one."""
    found = {(kind, core) for _, _, kind, core, _ in spans}
    for kind, core in list(found):
        if kind == "email":
            found.update(("host", host) for host in _hosts(core))
    return found


def _hosts(address: str) -> list[str]:
    labels = address.partition("@")[2].split(".")
    return [".".join(labels[i:]) for i in range(len(labels) - 1)]


def _core(surface: str) -> str:
    return unicodedata.normalize("NFC", surface).lower().replace("’", "'")


def _number(key: bytes, *parts: str | int) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")


def _permute(key: bytes, label: str, value: int, size: int) -> int:
    """A keyed one-to-one map of 0..size-1: four Feistel rounds, walked until the result is in range."""
    half = 1
    while half * half < size:
        half *= 2
    while True:
        left, right = divmod(value, half)
        for r in range(4):
            left, right = right, (left ^ _number(key, label, r, right)) % half
        value = left * half + right
        if value < size:
            return value


def _luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def _digits(key: bytes, label: str, digits: str) -> str:
    return str(_permute(key, f"{label}:{len(digits)}", int(digits), 10 ** len(digits))).zfill(len(digits)) if digits else ""


def _redrawn(key: bytes, label: str, word: str, grow: int) -> str:
    """Another letter of its script for each letter, another digit for each digit; marks stay, ``grow`` letters come behind."""
    kinds = ["0123456789" if c.isdigit() else LETTERS[_script_of(c)] if c.isalpha() else c for c in word] + [LETTERS[_script(word)]] * grow
    out, draw = "", 0
    for i, some in enumerate(kinds):
        draw = draw if i % 24 else _number(key, label, i)
        draw, r = divmod(draw, len(some))
        out += some[r]
    return out


def surrogate(key: bytes, kind: str, core: str, attempt: int) -> str:
    """The core that stands for ``core``; another one for each attempt."""
    label = f"{kind}:{attempt}"
    if kind == "card" and _luhn(core):
        body = _digits(key, label, core[:-1])
        return next(body + c for c in "0123456789" if _luhn(body + c))
    if kind in ("card", "ssn"):
        return _digits(key, label, core)
    if kind == "phone":  # country code of a +1 number, and the exchange 555 of fiction, stay
        if len(core) == 11 and core[0] == "1":
            if core[4:7] == "555":
                moved = _digits(key, label, core[1:4] + core[7:])
                return f"1{moved[:3]}555{moved[3:]}"
            return "1" + _digits(key, label, core[1:])
        return core[:2] + _digits(key, label, core[2:])
    if kind == "ip":
        a, b, c, d = map(int, core.split("."))
        moved = _permute(key, label, ((a * 256 + b) * 256 + c) * 256 + d, 1 << 32)
        return ".".join(str(moved >> s & 255) for s in (24, 16, 8, 0))
    if kind == "ipv6":  # groups of zero stay, the others move together
        groups = core.split(":")
        moved = _permute(key, label + _shape(groups), _joined([int(g, 16) - 1 for g in groups if g != "0"]), 65535 ** sum(g != "0" for g in groups))
        left = []
        for _ in groups:
            moved, r = divmod(moved, 65535)
            left.append(f"{r + 1:x}")
        return ":".join("0" if g == "0" else left.pop(0) for g in groups)
    if kind == "iban":  # country, length and places of letters stay, check digits are those of the new number
        account = core[4:]
        digits = iter(_digits(key, label + core[:2], re.sub(r"\D", "", account)))
        letters = [ord(c) - 65 for c in account if c.isalpha()]
        shifts = iter([(x + _number(key, label, core[:2], i) % 25 + 1) % 26 for i, x in enumerate(letters)])
        moved = "".join(next(digits) if c.isdigit() else chr(65 + next(shifts)) for c in account)
        return f"{core[:2]}{_check_digits(core[:2], moved):02d}{moved}"
    grow = max(0, attempt - 3)  # later attempts grow, so room never ends
    if kind == "email":
        return _redrawn(key, label + core, core.partition("@")[0], grow)
    if kind == "host":
        return _redrawn(key, label + core, core.partition(".")[0], grow)
    draw = _number(key, label, core)
    what, script, *gender = kind.split(":")
    if gender and attempt == 0 and (script, gender[0]) in GIVEN:
        names = GIVEN[script, gender[0]]
        return names[draw % len(names)].lower()
    if what == "family" and attempt == 0 and script in FAMILY:
        return FAMILY[script][draw % len(FAMILY[script])]
    if what == "initial":  # further letters from the first collision on
        return _letters(draw, LETTERS[script], 1 + attempt)
    if script in CASELESS:
        return _letters(draw, LETTERS[script], (2 if script in FAMILY else 4) + grow)
    onsets, vowels, codas = SYLLABLES[script]
    some = len(onsets) * len(vowels) * len(codas)
    name = ""
    for _ in range(2 + (len(core) > 6) + grow):
        draw, r = divmod(draw, some)
        name += onsets[r % len(onsets)] + vowels[r // len(onsets) % len(vowels)] + codas[r // len(onsets) // len(vowels)]
    if gender and gender[0] == "f":
        name += {"cyrillic": "а", "greek": "α"}.get(script, "a")
    elif script == "greek":
        name += "ης" if what == "family" else "ος"
    return f"{name[0]}'{name[1:]}" if "'" in core else name


def _letters(draw: int, letters: str, n: int) -> str:
    out = ""
    for _ in range(n):
        draw, r = divmod(draw, len(letters))
        out += letters[r]
    return out


def _joined(numbers: list[int]) -> int:
    return sum(n * 65535**i for i, n in enumerate(numbers))


def _shape(groups: list[str]) -> str:
    return "".join("0" if g == "0" else "x" for g in groups)


def address(key: bytes, core: str, attempts: dict[tuple[str, str], int]) -> str:
    """The surrogate of an e-mail address: a label for each label of its host, below a top-level domain set aside for tests."""
    hosts = _hosts(core)
    labels = [surrogate(key, "host", h, attempts.get(("host", h), 0)) for h in hosts]
    top = TOP_DOMAIN.get(_script(core.rpartition(".")[2]), "example")
    return f"{surrogate(key, 'email', core, attempts.get(('email', core), 0))}@{'.'.join(labels)}.{top}"


def render(kind: str, moved: str, surface: str) -> str:
    """A surrogate's core in the format of a mention: its separators, its case."""
    if kind in ("phone", "card", "ssn"):  # from the right: a mention may have an area code alone, or 00 before the country code
        more = sum(c.isdigit() for c in surface) - len(moved)
        left = iter(surface[:more] + moved if more > 0 else moved[-more:])
        return "".join(next(left) if c.isdigit() else c for c in surface)
    if kind == "iban":
        left = iter(moved)
        return "".join(next(left) if c.isalnum() else c for c in surface)
    if kind == "ipv6":
        moved = str(ipaddress.IPv6Address(moved)) if "::" in surface else moved
        return moved.upper() if surface.upper() == surface else moved
    if surface.isupper() and not kind.startswith("initial") and len(surface) > 1:
        return moved.upper()
    if kind.startswith(("given", "family", "initial")):
        moved = re.sub("(^|')(.)", lambda m: m[1] + m[2].upper(), moved)
        return moved.replace("'", "’") if "’" in surface else moved
    return moved


def replace_all(text: str | None, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str | None, int]:
    if not text:
        return text, 0
    out, at, spans = [], 0, find_entities(text)
    for a, b, kind, core, surface in spans:
        moved = address(key, core, attempts) if kind == "email" else surrogate(key, kind, core, attempts.get((kind, core), 0))
        out += [text[at:a], render(kind, moved, surface)]
        at = b
    return "".join([*out, text[at:]]), len(spans)


def assign(scratch: Scratch, entities: DataFrame, key: bytes, max_attempts: int = 64) -> DataFrame:
    """``kind, core, moved, attempt`` of all distinct entities, without collisions.

    No two entities get one surrogate, and no surrogate is an entity of the
    corpus: numbers within their kind, given and family names of every script and
    gender together.  Of e-mail addresses the local parts of one host are kept
    apart, and of hosts the labels below one domain, so addresses, hosts and
    domains are all mapped one to one, and hosts of one domain stay hosts of one.  Those that collide, all but the first,
    draw again until none does.
    """
    name = F.when(F.col("kind").rlike("^(given|family):"), "name")
    pool = name.when(F.col("kind") == "email", F.concat(F.lit("email@"), F.substring_index("core", "@", -1))).when(F.col("kind") == "host", F.concat(F.lit("host."), F.expr("if(size(split(core, '[.]')) > 2, substring(core, instr(core, '.') + 1), '')"))).otherwise(F.col("kind")).alias("pool")
    real = F.when(F.col("kind") == "email", F.substring_index("core", "@", 1)).when(F.col("kind") == "host", F.substring_index("core", ".", 1)).otherwise(F.col("core"))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(moved=[surrogate(key, k, c, a) for k, c, a in zip(f["kind"], f["core"], f["attempt"], strict=True)])

    schema = ENTITY + ", attempt int, moved string"
    now = scratch.save(entities.withColumn("attempt", F.lit(0)).mapInPandas(draw, schema))
    for _ in range(max_attempts):
        drawn = now.select(pool, "*")
        first = drawn.groupBy("pool", "moved").agg(F.min(F.struct("attempt", "kind", "core")).alias("first"), F.count("*").alias("n")).where("n > 1")
        shared = drawn.join(first, ["pool", "moved"]).where("kind <> first.kind or core <> first.core").select("kind", "core")
        taken = entities.select(pool, real.alias("moved")).distinct()
        exists = drawn.join(taken, ["pool", "moved"], "left_semi").select("kind", "core")
        again = scratch.save(shared.union(exists).distinct())
        if again.isEmpty():
            return now
        retry = now.join(again, ["kind", "core"]).select("kind", "core", (F.col("attempt") + 1).alias("attempt")).mapInPandas(draw, schema)
        after = scratch.save(now.join(again, ["kind", "core"], "left_anti").select("kind", "core", "attempt", "moved").unionByName(retry))
        scratch.drop(now)
        now = after
    raise RuntimeError("surrogates still collide; use another key")


def replace_pii(docs: DataFrame, *, key: bytes, id_col: str = "doc_id", text_col: str = "text", max_sent: int = 200_000) -> DataFrame:
    """Every whole text with its personal data replaced by surrogates.

    Found: e-mail addresses, IPv4 and IPv6 addresses, phone numbers (with a country
    code; of three, three and four digits; with a leading 0 and separators; or, in
    any form, after a word for phone), card numbers, social security numbers,
    account numbers (IBAN) whose length and check digits hold, and names: behind a
    title with all their parts, initials and hyphens; a known given name and the
    family name after it; Chinese names beside a title and Korean ones before one.
    In a run of capitals a name cannot be told from the words after it: at most
    four parts are taken there, and two of scripts without capitals.  A surrogate
    is drawn from the key and the entity alone, has its type, script, gender,
    separators and case, and differs from those of all other entities and from
    all entities of the corpus (``assign``), so distinct people stay distinct and
    one entity stays one throughout.  Numbers are moved by keyed one-to-one maps.

    Returns the columns of ``docs`` with ``text_col`` rewritten, and
    ``n_entities`` (mentions replaced).  Null or empty text stays.  Null ids and
    repeated rows: rows of their own.  Empty table: no rows.  A column
    ``n_entities`` is replaced.

    Texts are read twice and never shuffled: only distinct entities are.  The
    entities that had to draw again are sent to all tasks if they are at most
    ``max_sent``; beyond that they are joined to the texts by entity.
    """
    scratch = Scratch(docs.sparkSession)

    def entities_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame(sorted({x for t in f["text"] for x in parts_of(find_entities(t))}), columns=["kind", "core"])

    entities = scratch.save(docs.select(F.col(text_col).alias("text")).mapInPandas(entities_of, ENTITY).distinct())
    moved = assign(scratch, entities, key)
    again = moved.where("attempt > 0").select("kind", "core", "attempt")
    if again.count() <= max_sent:
        attempts = {(r["kind"], r["core"]): r["attempt"] for r in again.collect()}
        shared = docs.sparkSession.sparkContext.broadcast(attempts)

        @F.pandas_udf("text string, n_entities int")
        def rewrite(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([replace_all(t, key, shared.value) for t in texts], columns=["text", "n_entities"])

        new = docs.withColumn("_new", rewrite(F.col(text_col)))
    else:

        @F.pandas_udf("array<struct<kind:string,core:string>>")
        def mentioned(texts: pd.Series) -> pd.Series:
            return pd.Series([[{"kind": k, "core": c} for k, c in sorted(parts_of(find_entities(t)))] for t in texts])

        @F.pandas_udf("text string, n_entities int")
        def rewrite_with(texts: pd.Series, some: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([replace_all(t, key, {(x["kind"], x["core"]): x["attempt"] for x in (s if s is not None else ())}) for t, s in zip(texts, some, strict=True)], columns=["text", "n_entities"])

        keyed = docs.withColumn("_row", F.xxhash64(F.col(text_col)))
        marked = keyed.select("_row", F.explode(mentioned(F.col(text_col))).alias("e")).select("_row", "e.kind", "e.core").distinct()
        drawn = marked.join(again, ["kind", "core"]).groupBy("_row").agg(F.collect_set(F.struct("kind", "core", "attempt")).alias("_some"))
        new = keyed.join(drawn, "_row", "left").withColumn("_new", rewrite_with(F.col(text_col), F.col("_some"))).drop("_row", "_some")
    return new.withColumn(text_col, F.col("_new.text")).withColumn("n_entities", F.col("_new.n_entities")).drop("_new")
