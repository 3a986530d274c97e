"""Column forms against Python forms, and both against plain facts."""

import random

import pytest
from pyspark.sql import functions as F

from shirabe.detect import context, validators as V
from shirabe.functions import checks as C
from shirabe.functions import text as X


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def numbers(seed, lengths, n=400):
    r = random.Random(seed)
    out = ["".join(r.choices("0123456789", k=r.choice(lengths))) for _ in range(n)]
    return out + ["0" * 12, "123456789012", "000000000012", "0123456789", "9876543210", "1", "11"]


@pytest.mark.parametrize(
    "name,lengths",
    [("all_same", [1, 2, 3]), ("sequential", [2, 3, 4]), ("my_number", [12]), ("corporate_number", [13]), ("modulus10_weight21", [6, 2]), ("credit_card", [13, 15, 16, 19])],
)
def test_checks_agree(spark, name, lengths):
    values = numbers(name, lengths)
    if name == "my_number":
        values += [v[:11] + str(c) for v in values if len(v) == 12 for c in range(10)]
    if name == "corporate_number":
        values += [str(c) + v[1:] for v in values if len(v) == 13 for c in range(10)]
    if name == "credit_card":
        values += [p + "".join(random.Random(i).choices("0123456789", k=n)) for i, (p, n) in enumerate([("4", 15), ("52", 14), ("3528", 12), ("37", 13), ("6011", 12), ("36", 12), ("2221", 12), ("301", 11)] * 40)]
        values += ["41" + "1" * 14, "42" * 8]
    got, want = column(spark, values, getattr(C, name)), [getattr(V, name)(v) for v in values]
    assert got == want and (True in want) and (False in want)


def test_phones_and_dates_agree(spark):
    r = random.Random(3)
    phones = ["090-1234-5678", "+81-90-1234-5678", "+81 3 1234 5678", "03-1234-5678", "0312345678", "0000000000", "0120-123-456", "012-345-6789", "+8112345", "050 1234 5678", "0991234567"]
    phones += [f"0{r.randrange(10**9):09d}" for _ in range(200)]
    assert column(spark, phones, C.phone_valid) == [V.phone_valid(p) for p in phones]
    assert column(spark, phones, C.phone_kind) == [V.phone_kind(p) for p in phones]
    dates = ["1990-02-30", "1990/2/28", "昭和64年1月7日", "昭和65年1月7日", "令和元年5月1日", "R元.5.1", "H31-4-30", "H32-4-30", "19900231", "20000229", "19000229", "平成元年13月1日", "M45/7/30", "x"]
    assert column(spark, dates, C.birthdate_valid) == [V.birthdate_valid(d) for d in dates]
    pairs = [("1" + f"{r.randrange(1000):03d}" + "0", str(r.randrange(10**6, 10**7)) + "1") for _ in range(300)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [x.v for x in df.select("i", C.yucho_account(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()]
    assert got == [V.yucho_account(a, b) for a, b in pairs] and 10 < sum(got) < 60


def test_nulls_are_false(spark):
    for f in (C.all_same, C.sequential, C.my_number, C.corporate_number, C.modulus10_weight21, C.luhn, C.credit_card, C.phone_valid, C.birthdate_valid, C.drivers_license_valid):
        assert column(spark, [None, ""], f) == [False, False], f.__name__


NORM = ["０９０ー１２３４ー５６７８", "データ 3ー4", "ﾃﾞｰﾀ1ｰ2", "a‐b–c—d", "x y​z　", "abc", "1゠2 アンリ゠", "～！Ａ", "ー1", ""]


def test_normalize(spark):
    got = column(spark, NORM, X.normalize)
    assert got == [X.normalize_line(s) for s in NORM] and [len(g) for g in got] == [len(s) for s in NORM]
    assert got[0] == "090-1234-5678" and got[1] == "データ 3-4" and got[6] == "1-2 アンリ゠"


def test_mask_and_tokens(spark):
    values = ["", "a", "abcd", "abcde", "abcdefg", "abcdefgh", "日本語テキスト九文字"]
    assert column(spark, values, X.mask) == [X.mask_value(v) for v in values]
    names = ["bankAccountNo", "HTTPServer2", "order_id-x9Y", "AB12cd", "口座No1", "x", "ABC"]
    assert column(spark, names, X.identifier_tokens) == [list(context.tokens(n)) for n in names]


def test_markers_and_lines(spark):
    text = ["x # shirabe:ignore", "shirabe:ignored", "ashirabe:ignore", "(shirabe:allow)"]
    assert column(spark, text, X.ignored) == [True, False, False, True]
    assert column(spark, ["a\r\nb\n\nc\r"], X.lines) == [["a", "b", "", "c"]]
    assert column(spark, ["a\r\nbc"], lambda c: X.line_offset(c, F.lit(2), F.lit(2))) == [4]


def test_mail_and_addresses_agree(spark):
    mails = ["taro@gmail.com", ".a@gmail.com", "a.@gmail.com", "a..b@gmail.com", "___@gmail.com", "taro@EXAMPLE.com", "taro@a.example", "taro@-a.jp", "taro@a-.jp", "taro@a..jp", "fooled@gmail.com", "taro@BAR.jp", "taro@x.nosuch", "taro@x.local", "@gmail.com", "taro@", "a@b@gmail.com", "x@y.co.jp"]
    assert column(spark, mails, C.email_valid) == [V.email_valid(m) for m in mails]
    tails = ["渋谷区1-2-3", "渋谷区2025-07-02", "渋谷区2025-13-02", "渋谷区1899-1-1", "渋谷区2025-7", "渋谷区", "2024-2-30", "12-2025-07-02"]
    assert column(spark, tails, C.address_tail_is_no_date) == [V.tail_is_no_date(t) for t in tails]
    licences = ["305012345678", "005012345678", "1111-1111-1111", "1234.5678.9012", ""]
    assert column(spark, licences, C.drivers_license_valid) == [V.drivers_license_valid(x) for x in licences]
    from shirabe.detect.dictionaries import compose_kana

    kana = ["ヤマタ゛", "ヤマダ パア゙", "ヴ", ""]
    assert column(spark, kana, X.compose_kana) == [compose_kana(x) for x in kana]


def test_odd_values_are_false(spark):
    odd = ["x", "12a456789012", "日本", "-", " ", "4111x11111111111", "１２３"]
    for f in (C.my_number_valid, C.corporate_number, C.modulus10_weight21, C.credit_card, C.phone_valid, C.birthdate_valid, C.email_valid):
        assert column(spark, odd, f) == [False] * len(odd), f.__name__
    assert column(spark, odd, C.card_brand)[:5] == [None] * 5
