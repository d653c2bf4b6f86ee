import datetime
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import pii

KEY = b"test"
GOOD = {
    "card": ["4111 1111 1111 1111", "4111111111111111", "378282246310005", "5555-5555-5555-4444"],
    "account": ["9807915762804490", "1219538112535716"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    "ssn": ["123-45-6789"],
    "phone": ["+1 (974) 555-3436", "+44 (020)555-0000"],
    "ip": ["97.51.17.173", "0.0.0.0"],
    "date": ["2024-02-29", "29.02.2024", "02/29/2024", "1900-01-01"],
    "email": ["und.34@mail7.example.com", "A.b+c%9@x.org"],
}
BAD = ["GB83WEST12345698765432", "000-12-3456", "666-12-3456", "300.1.1.1", "01.2.3.4", "2023-02-29", "31.04.2024", "13/13/2020", "1899-12-31",
       "12345", "@x.org", "...", "x4111111111111111", "4111111111111111x", "1" * 20]


def test_small_ranges_are_permuted():
    f = pii.Feistel(KEY)
    for size in (1, 2, 3, 10, 97, 1000):
        values = [f.forth(x, size, "t") for x in range(size)]
        assert sorted(values) == list(range(size)) and [f.back(v, size, "t") for v in values] == list(range(size))
    even = [x for x in range(100) if x % 2 == 0]
    assert sorted(f.forth(x, 100, "e", lambda v: v % 2 == 0) for x in even) == even


@given(st.integers(0, 10**16 - 1))
@settings(max_examples=200, deadline=None)
def test_numbers_keep_kind_and_come_back(x):
    f = pii.Feistel(KEY)
    (_, _, kind, new), = pii.finds(f"{x:016d}", f.forth)
    (_, _, again, old), = pii.finds(new, f.back)
    assert kind == again == ("card" if pii.luhn(f"{x:016d}") else "account") and old == f"{x:016d}"


def test_kinds_formats_and_links(spark):
    text = " ; ".join(v for values in GOOD.values() for v in values)
    rows = [(None, None), (1, ""), (2, text), (2, text), (3, "zz " * 30_000 + "call +1 (974) 555-3436"), (4, " | ".join(BAD)), (5, "4111-1111-1111-1111 é 29.02.2024")]
    df = spark.createDataFrame([(*r, 4, "clash") for r in rows], "doc_id long, text string, n_replaced int, spans string").repartition(3)
    out = {(r.doc_id, i): r for i, r in enumerate(sorted(pii.pseudonymise(df, KEY).collect(), key=lambda r: str(r.doc_id)))}
    by = {}
    for (d, _), r in out.items():
        by.setdefault(d, r)
    assert by[None].text is None and by[None].n_replaced == 0 and by[1].text == "" and by[4].n_replaced == 0 and by[4].text == rows[5][1]
    r = by[2]
    got = [(s.split(":")[0], n.split("=", 1)[1]) for s, n in zip(r.spans.split(","), r.pseudonyms)]
    want = [(k, v) for k, values in GOOD.items() for v in values]
    assert [k for k, _ in got] == [k for k, _ in want]
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s)))
    for (kind, new), (_, old) in zip(got, want):
        assert kind == "ip" or shape(new) == shape(old)
    new = dict(zip([v for _, v in want], [v for _, v in got]))
    digits = lambda s: re.sub(r"\D", "", s)
    assert digits(new["4111 1111 1111 1111"]) == new["4111111111111111"] and pii.luhn(new["4111111111111111"])
    assert pii.iban_rest(new["DE89 3704 0044 0532 0130 00"].replace(" ", "")) == 1 and pii.valid_ssn(digits(new["123-45-6789"]))
    day = datetime.date.fromisoformat(new["2024-02-29"])
    assert new["29.02.2024"] == day.strftime("%d.%m.%Y") and new["02/29/2024"] == day.strftime("%m/%d/%Y")
    assert by[5].text == f"{'-'.join(re.findall('....', new['4111111111111111']))} é {new['29.02.2024']}"
    assert new["+1 (974) 555-3436"] in by[3].text and new["+1 (974) 555-3436"].startswith("+1 (")
    back = pii.pseudonymise(spark.createDataFrame([(2, r.text)], "doc_id long, text string"), KEY, undo=True).first()
    assert back.text == text
    assert pii.pseudonymise(spark.createDataFrame([(2, text)], "doc_id long, text string"), b"other").first().text != r.text


def test_empty_table(spark):
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string")).count() == 0


PHONES = ["+1 555 123 4567", "+15551234567", "+1-202-555-0143", "+1.202.555.0143", "(555) 123-4567", "(555)123-4567", "555-123-4567", "555.123.4567",
          "555 123 4567", "555 123-4567", "1-202-555-0143", "1 (202) 555-0143", "+49 30 12345678", "+44 20 7946 0958", "+44 (0)20 7946 0958", "+(49) 30 1234567",
          "+33 1 23 45 67 89", "+358-9-1234567", "+86 138 0013 8000"]


def test_phones_of_all_shapes():
    f = pii.Feistel(KEY)
    shape = lambda s: re.sub("[0-9]", "0", s)
    for phone in PHONES:
        text = f"call {phone}, or ({phone})."
        found = pii.finds(text, f.forth)
        assert [(text[a:b], k) for a, b, k, _ in found] == [(phone, "phone")] * 2, phone
        new = pii.replaced(text, found)
        assert new != text and shape(new) == shape(text) and pii.replaced(new, pii.finds(new, f.back)) == text
    one = lambda s: pii.finds(s, f.forth)[0][3]
    digits = lambda s: re.sub(r"\D", "", s)[-10:]
    assert len({digits(one(s)) for s in ("+1 (555) 123-4567", "+15551234567", "(555) 123-4567", "555-123-4567", "1 555 123 4567")}) == 1
    assert one("+4915112345678").startswith("+49") and one("+358 9 1234567").startswith("+358 ")


def test_phone_counts_digits():
    f = pii.Feistel(KEY)
    for text in ("+1 555 12", "+12345678901234567", "555-123-45678", "2555-123-4567", "555-123-4567-89", "5551234567", "12 555 123 4567", "555 123 4567 8", "+49 30 (12345678"):
        assert pii.finds(text, f.forth) == [], text
    (a, b, *_), = pii.finds("+1 555 123 4567 2021", f.forth)
    assert (a, b) == (0, 15)
    (a, b, *_), = pii.finds("+44 20 7946 0958 (123456)", f.forth)
    assert (a, b) == (0, 16)


CARD, BE, ES = "4111 1111 1111 1111", "BE68 5390 0754 7034", "ES91 2100 0418 4502 0005 1332"
BESIDE = [(f"{BE} EUR 500", [(BE, "iban")]), (f"{BE.replace(' ', '')} A", [(BE.replace(" ", ""), "iban")]), (f"{ES} 2021 x", [(ES, "iban")]),
          (f"AB12 CDEF {BE}", [(BE, "iban")]), ("AT61 1904 3002 3457 3201 BIC", [("AT61 1904 3002 3457 3201", "iban")]),
          (f"{CARD} 123", [(CARD, "card"), ("123", "rest")]), (f"{CARD}-123.", [(CARD, "card"), ("123", "rest")]), (f"{CARD} 2025", [(CARD, "card")]),
          (f"3782 822463 10005 {CARD}", [("3782 822463 10005", "card"), (CARD, "card")]),
          (f"2021-03-07 {CARD}", [("2021-03-07", "date"), (CARD, "card")]), (f"123-45-6789 {CARD}", [("123-45-6789", "ssn"), (CARD, "card")]),
          (f"+49 3012345678 {CARD}", [("+49 3012345678", "phone"), (CARD, "card")]), (f"555-123-4567 {CARD}", [("555-123-4567", "phone"), (CARD, "card")]),
          ("2021-03-07T12:00:00Z", [("2021-03-07", "date")]), ("2021-03-07Tea", []),
          ("9807 9157 6280 4490 97.51.17.173", [("9807 9157 6280 4490", "account"), ("97.51.17.173", "ip")]),
          ("+49 30 1234567 97.51.17.173", [("+49 30 1234567", "phone"), ("97.51.17.173", "ip")]),
          ("9807915762804490 07.03.2021", [("9807915762804490", "account"), ("07.03.2021", "date")])]


def test_values_beside_others():
    f = pii.Feistel(KEY)
    alone = lambda s: pii.finds(s, f.forth)[0][3]
    for text, want in BESIDE:
        found = pii.finds(text, f.forth)
        assert [(text[a:b], k) for a, b, k, _ in found] == want, text
        assert all(new == alone(text[a:b]) for a, b, k, new in found if k != "rest"), text
        new = pii.replaced(text, found)
        assert pii.replaced(new, pii.finds(new, f.back)) == text


@given(st.lists(st.integers(0, 10**9), min_size=4, max_size=6), st.integers(1, 6))
@settings(max_examples=300, deadline=None)
def test_groups_come_back(numbers, width):
    f = pii.Feistel(KEY)
    text = " ".join(f"{x % 10 ** width:0{width}d}" for x in numbers)
    new = pii.replaced(text, pii.finds(text, f.forth))
    assert pii.replaced(new, pii.finds(new, f.back)) == text


def test_long_numbers_of_zeros_end():
    f = pii.Feistel(KEY)
    (_, _, kind, new), = pii.finds("0" * 19, f.forth)
    assert kind == "card" and pii.finds(new, f.back)[0][3] == "0" * 19


def test_iban_of_another_length_comes_back():
    f = pii.Feistel(KEY)
    for i in range(300):
        text = f"GB00WEST123456{i:08d}99"
        text = text[:2] + f"{98 - pii.iban_rest(text):02d}" + text[4:]
        (_, _, kind, new), = pii.finds(text, f.forth)
        assert kind == "iban" and pii.finds(new, f.back)[0][3] == text
