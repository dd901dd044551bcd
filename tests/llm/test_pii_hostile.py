"""PII on long hostile texts, small surrogate spaces, and against an independent replacer."""

import hashlib
import re

from impressa.llm import catalog, pii
from impressa.llm.common import table

MEGABYTE = 1_000_000


def replaced(spark, texts, key="k"):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    return {r["doc_id"]: r for r in pii.replace(d, key).collect()}


def test_texts_of_a_megabyte_of_each_hostile_form(spark):
    units = ["1.", "1234 5678 ", "1234-5678-", "a@", "a.", "a-", "1:", "a:", "::", "AB12 ", "AB12ABCD", "+1 ", "+12 34 ", "(123) ", "Mr ", "Mr John ", "г-н Иванов ", "1", "a", "@", " ", "1-", "123-45-",
             "é", "+1234567 ", "x@y.z ", "1.2.3.", "\n"]
    heads = ["", "a@", "+12 34 ", "+4111 ", "Mr "]
    texts = [u * (MEGABYTE // len(u)) for u in units] + [h + u * 20_000 for h in heads for u in units]
    got = replaced(spark, texts)
    assert len(got) == len(texts) and all(r["text"] is not None for r in got.values())
    for i, t in enumerate(texts):
        if got[i]["n_entities"] == 0:
            assert got[i]["text"] == t


def test_short_numbers_after_a_plus_are_no_phones(spark):
    texts = [f"gain of +1{d:03d} points" for d in range(600)]
    got = replaced(spark, texts)
    assert all(got[i]["text"] == t and got[i]["n_entities"] == 0 for i, t in enumerate(texts))


def test_small_spaces_widen_until_all_are_distinct(spark, monkeypatch):
    monkeypatch.setattr(pii, "WIDEN", 1)
    texts = [f"{a}.{b}.{c}.{d}" for a in range(10) for b in range(10) for c in range(10) for d in (1, 2, 3)]
    phones = [f"+1 {n:06d}" for n in range(100_000, 103_000)]
    got = replaced(spark, texts + phones)
    out = [got[i]["text"] for i in range(len(got))]
    assert len(set(out)) == len(out) and not set(out) & set(texts + phones) and all(r["n_entities"] == 1 for r in got.values())
    assert all(re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", x) for x in out[:len(texts)]) and all(re.fullmatch(r"\+1 \d{6,}", x) for x in out[len(texts):])


def test_names_keep_script_and_gender_and_are_found_without_a_title(spark):
    texts = ["Mr John Smith came. John Smith said so, and John Smithers not.", "Mr Γιώργος Παππάς and Frau Ελένη Παππά", "Herr Արամ Խաչ here", "John Smith alone"]
    got = replaced(spark, texts)
    m = re.fullmatch(r"Mr (\w+ \w+) came\. (\w+ \w+) said so, and John Smithers not\.", got[0]["text"])
    assert m and m[1] == m[2] != "John Smith" and got[0]["n_entities"] == 2
    m = re.fullmatch(r"Mr ([Α-Ωα-ω]+ος) ([Α-Ωα-ω]+) and Frau ([Α-Ωα-ω]+α) ([Α-Ωα-ω]+)", got[1]["text"])
    assert m and "Παππά" not in m.groups() and got[1]["n_entities"] == 2
    assert re.fullmatch(r"Herr [Ա-Ֆա-ֆ]+ [Ա-Ֆա-ֆ]+ here", got[2]["text"])
    assert got[3]["text"] == texts[3] and got[3]["n_entities"] == 0


def test_ibans_with_right_check_digits_and_ipv6(spark):
    good = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"]
    texts = good + ["DE88 3704 0044 0532 0130 00", "AB12 CDEF GHIJ KLMN", "at 2001:db8:0:0:0:0:0:1 and 2001:DB8::a1", "at 12:30:45, std::vector or a::b"]
    got = replaced(spark, texts)
    for i, t in enumerate(good):
        solid = got[i]["text"].replace(" ", "")
        rest = solid[4:] + solid[:4]
        assert got[i]["text"] != t and solid[:2] == t[:2] and int("".join(str(int(c, 36)) for c in rest)) % 97 == 1
        assert [len(w) for w in got[i]["text"].split(" ")] == [len(w) for w in t.split(" ")]
    assert got[0]["text"].replace(" ", "") == got[1]["text"]
    assert all(got[i]["text"] == texts[i] and got[i]["n_entities"] == 0 for i in (3, 4, 6))
    m = re.fullmatch(r"at ((?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}) and ([0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]{2})", got[5]["text"])
    assert m and m[1] != "2001:db8:0:0:0:0:0:1" and got[5]["n_entities"] == 2


# -- an independent replacer of addresses and numbers ------------------------

def stream(key, kind, canon):
    return "".join(hashlib.sha256("\x1f".join([key, kind, canon, "0", str(n)]).encode()).hexdigest() for n in range(8))


def classwise(text, s):
    out = []
    for i, c in enumerate(text):
        r = int(s[(i * 4) % 480:(i * 4) % 480 + 4], 16)
        out.append(chr(97 + r % 26) if "a" <= c <= "z" else chr(65 + r % 26) if "A" <= c <= "Z" else str(r % 10) if c.isascii() and c.isdigit() else c)
    return "".join(out)


def luhn(digits):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(int(c) for c in reversed(digits))) % 10


def by_hand(raw, key):
    digits = re.sub(r"\D", "", raw)
    if "@" in raw:
        canon = raw.lower()
        s = stream(key, "email", canon)
        name, tld = canon.rsplit(".", 1)
        local, domain = name.split("@", 1)
        new = f"{classwise(local, s)}@{classwise(domain, s[::-1])}.{tld}"
        return new.upper() if raw == raw.upper() else new
    if re.fullmatch(r"(\d+\.){3}\d+", raw):
        s = stream(key, "ip", raw)
        r = [int(s[i * 6:i * 6 + 6], 16) for i in range(4)]
        return ".".join(str(x % 10 if len(o) == 1 else x % 90 + 10 if len(o) == 2 else x % 156 + 100) for o, x in zip(raw.split("."), r))
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", raw):
        number = classwise(digits, stream(key, "ssn", digits))
    elif len(digits) == 16 and not re.search(r"[+(]", raw):
        number = classwise(digits, stream(key, "card", digits))
        if luhn(digits) == 0:
            number = number[:-1] + str((10 - luhn(number[:-1] + "0")) % 10)
    else:
        canon = ("+" if raw.startswith("+") else "") + digits
        drawn = classwise(canon, stream(key, "phone", canon))
        number = (canon[:2] + drawn[2:]).lstrip("+") if raw.startswith("+") else drawn
    it = iter(number)
    return "".join(next(it) if c.isdigit() else c for c in raw)


def test_whole_table_against_the_independent_replacer(spark, sf):
    found = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[a-zA-Z]+|\+\d \(\d{3}\) \d{3}-\d{4}|(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w.])"
                       r"|(?<!\w)(?:\d{4}[ -]?){3}\d{4}(?!\w)|(?<!\w)\d{3}-\d\d-\d{4}(?!\w)")
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    n = 0
    for r in catalog.op7_pii(spark, sf).collect():
        text = docs[r["doc_id"]]
        own = found.findall(text)
        if len(own) == r["n_entities"]:
            assert (r["text"] or "") == found.sub(lambda m: by_hand(m[0], "surrogate-key"), text)
            n += len(own)
    assert n > 30
