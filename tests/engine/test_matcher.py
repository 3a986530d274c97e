import pytest

from shirabe.detect import context as X
from shirabe.detect import rules as R
from shirabe.detect import structure as S
from shirabe.detect.engine import Config, Detector, Finding, resolve

D = Detector()
ALL = Detector(Config(high_recall=True))


def ids(found):
    return [(f.rule_id, f.match) for f in found]


def my_number(body="12345678901"):
    from shirabe.detect.validators import my_number

    return next(body + c for c in "0123456789" if my_number(body + c))


def test_rules_are_complete():
    assert len(R.builtin()) == 28 and sum(len(r.shapes) for r in R.builtin()) == 84 and len({r.id for r in R.builtin()}) == 25


def test_two_values_with_one_separator_between():
    a, b = my_number("12345678901"), my_number("98765432101")
    assert [m for _, m in ids(D.scan_line(f"個人番号={a},{b}"))] == [a, b]
    found = [f.match for f in D.scan_line("〒150-0043〒530-0001")]
    assert found == ["〒150-0043", "〒530-0001"]


@pytest.mark.parametrize(
    "line,rule,value",
    [
        ("TEL: 090-0000-0000", "jp-phone-number", "090-0000-0000"),
        ("電話番号：０９０ー００００ー００００", "jp-phone-number", "０９０ー００００ー００００"),
        ("免許証番号: 305012345678", "jp-drivers-license", "305012345678"),
        ("パスポート TK1234567", "jp-passport", "TK1234567"),
        ("在留カード AB12345678CD", "jp-residence-card", "AB12345678CD"),
        ("基礎年金番号 1234-567890", "jp-pension-number", "1234-567890"),
        ("普通預金 口座番号 1234567", "jp-bank-account", "1234567"),
        ("みずほ銀行 1234567", "jp-bank-account", "1234567"),
        ("住所: 東京都渋谷区道玄坂2-10-7", "jp-address", "東京都渋谷区道玄坂2-10-7"),
        ("北海道札幌市中央区大通一丁目二番三号", "jp-address", "北海道札幌市中央区大通一丁目二番三号"),
        ("mail taro@gmail.com.", "email-address", "taro@gmail.com"),
        ("生年月日: 1990/02/28", "jp-birthdate", "1990/02/28"),
        ("昭和55年3月3日生まれ", "jp-birthdate", "昭和55年3月3日"),
        ("氏名: 山田太郎", "person-name", "山田太郎"),
        ("姓: 佐藤さんへ", "person-name", "佐藤"),
        ("介護保険 1234567890", "jp-kaigo-insurance", "1234567890"),
        ("住民票コード 12345678901", "jp-juminhyo-code", "12345678901"),
        ("雇用保険 1234-567890-1", "jp-employment-insurance", "1234-567890-1"),
        ("被保険者 12345678", "jp-health-insurance", "12345678"),
    ],
)
def test_values_found(line, rule, value):
    assert (rule, value) in ids(D.scan_line(line))


@pytest.mark.parametrize(
    "line",
    [
        "version 150-0043", "user@example.com", "x@hoge.com", "305012345678", "timestamp: 20260611123456789", "個人番号 1234567890123", "口座番号 ￥1234567", "口座 1234567円", "口座 1234567件", "免許 伝票番号: 305012345678", "生年月日: 1990-02-30",
        "電話 550e8400-e29b-4123-a456-090123456780", "090-1234-5678 # shirabe:ignore", "口座番号 1111111",
    ],
)
def test_values_left_alone(line):
    assert ids(D.scan_line(line)) == []


def test_context_window_is_forty_characters():
    for gap, hit in ((37, True), (38, True), (39, False)):
        line = "免許" + "・" * gap + "305012345678"
        assert bool(D.scan_line(line)) is (gap <= 38 if hit else False)


def test_high_recall_rules():
    assert ("email-address-eai", "太郎@日本語.jp") in ids(ALL.scan_line("太郎@日本語.jp"))
    assert ("email-address-confusable", "pаypal@gmail.com") in ids(ALL.scan_line("pаypal@gmail.com"))
    assert ("person-name-romaji", "Taro Yamada") in ids(ALL.scan_line("full_name: Taro Yamada"))
    assert ("person-name-high-recall", "佐藤") in ids(ALL.scan_line("佐藤様"))
    assert ids(D.scan_line("佐藤様")) == []
    assert ("jp-address-high-recall", "渋谷区神南1丁目2番") in ids(ALL.scan_line("渋谷区神南1丁目2番"))


def test_lines_together():
    assert ids(D.scan("口座番号:\n1234567")) == [("jp-bank-account", "1234567")]
    assert ids(D.scan("口座番号:\n\n\n1234567")) == [("jp-bank-account", "1234567")]
    assert ids(D.scan("口座番号:\n\n\n\n1234567")) == []
    assert ids(D.scan("口座 1234567\n円")) == []
    assert ("person-name-structured", "山田太郎") in ids(ALL.scan("氏名:\n山田太郎"))
    got = ids(ALL.scan("姓: 山田\n名: 太郎"))
    assert {m for _, m in got} == {"山田", "太郎"}
    from shirabe.detect.validators import yucho_account

    s = next(f"1{i:03d}0" for i in range(1000) if yucho_account(f"1{i:03d}0", "12345671"))
    got = D.scan(f"記号 {s}\n番号 12345671")
    assert [(f.match, f.line, f.confidence) for f in got if f.rule_id == "jp-yucho-account"] == [(s, 1, 3), ("12345671", 2, 3)]


def test_columns():
    csv = '氏名,電話番号,注文番号\n山田太郎,"090-1234-5678",1234567\n"佐藤\n花子",x,y\n鈴木一郎,03-1234-5678,7654321'
    got = ALL.scan(csv, "a.csv")
    assert ("person-name-structured", "山田太郎") in ids(got) and ("jp-phone-number", "090-1234-5678") in ids(got) and ("person-name-structured", "鈴木一郎") in ids(got)
    assert not [f for f in got if f.match in ("1234567", "7654321")]
    sql = "INSERT INTO t (full_name, account_no, order_id) VALUES ('山田太郎', '1234567', 7654321), ('it''s', f(1, 2), 3);"
    got = ALL.scan(sql, "a.sql")
    assert ("person-name-structured", "山田太郎") in ids(got) and ("jp-bank-account", "1234567") in ids(got) and "7654321" not in [f.match for f in got]
    assert ids(D.scan('bankAccountNo := "1234567"', "a.go")) == [("jp-bank-account", "1234567")]
    assert ids(D.scan("口座 orderId: 1234567", "a.go")) == []
    assert ids(D.scan('{"bankAccount": {\n"no": "1234567"}}', "a.json")) == [("jp-bank-account", "1234567")]
    assert ids(D.scan("bankAccount:\n  no: 1234567", "a.yaml")) == [("jp-bank-account", "1234567")]


def test_scopes():
    assert S.json_scope(['[{"phone": {', '"a": 1}', "}, {", '"b": "]"}', "]", "x}", "{"]) == [("phone", 1), ("", 1), ("", 2), ("", 0), ("", 0), ("", 0), ("", 0)]
    assert S.yaml_scope(["a:", "  b:", "    c: 1", "  - x", "  d: |", "   text:", "e:", "  f: {", " g: }", "  h: 1"]) == [("", 0), ("a", 1), ("b", 1), ("", 1), ("a", 1), ("", 1), ("", 0), ("e", 2), ("", 2), ("e", 2)]
    assert S.csv_fields('a, "b,""c" ,d', ",") == [(0, 1), (4, 9), (12, 13)] and S.csv_fields('a,"b', ",") is None and S.csv_fields('a,b"c', ",") is None
    assert [(s.positive, s.negative) for s in S.statements('const orderId = "a;b", phone: x; y == z')] == [("order id", "order id"), ("phone", "")]


def test_boost_and_paths():
    text = "名前: 青空\n090-1234-5678"
    low = Detector(Config(boost=False)).scan(text)
    high = D.scan(text)
    name = lambda fs: next((f for f in fs if f.rule_id == "person-name"), None)
    assert name(low).confidence == R.LOW and name(high).confidence == R.MEDIUM
    text = "name: 山田\n090-1234-5678"
    assert name(Detector(Config(boost=False)).scan(text)).confidence == R.LOW and name(D.scan(text)).confidence == R.MEDIUM and name(D.scan(text)).boosted
    assert name(D.scan("name: 山田" + "\n" * 6 + "090-1234-5678")).confidence == R.LOW
    f = D.scan("口座番号 1234567", "src/testdata/x.txt")[0]
    assert f.demoted and f.confidence == R.LOW and not D.scan("口座番号 1234567", "src/x.txt")[0].demoted


def test_thresholds_kinds_and_lists():
    assert not Detector(Config(min_confidence=R.HIGH)).scan("口座番号 1234567")
    both = Detector(Config(min_confidence=R.HIGH, scan_min_confidence=R.LOW)).scan("口座番号 1234567")
    assert [f.fail_only for f in both] == [True]
    assert not Detector(Config(exclude_kinds=("mobile",))).scan("090-1234-5678")
    assert not Detector(Config(stopwords=("０９０-1234-5678",))).scan("090-1234-5678")
    assert not Detector(Config(allow=("^090",))).scan("090-1234-5678")
    d = Detector(Config(log_drops=True, stopwords=("090-1234-5678",)))
    d.scan("090-1234-5678 免許 305012345678\n305012345678\n伝票番号 03-1234-5678")
    assert {x.reason for x in d.drops} >= {"allowlisted", "require-context-missing", "negative-context"}
    own = R.custom_rule("staff-id", "S[0-9]{4}", context=("社員",), require_context=True)
    assert ids(Detector(Config(custom=(own,))).scan("社員 S1234")) == [("staff-id", "S1234")] and not Detector(Config(custom=(own,))).scan("S1234")
    with pytest.raises(ValueError):
        R.selected(custom=(R.custom_rule("credit-card", "x"),))


def test_hunks():
    texts, added = ["電話:", "090-1234-5678", "03-1234-5678", "口座番号:", "1234567"], [False, True, False, False, True]
    assert [(f.line, f.match) for f in D.scan_hunk("a.txt", 10, texts, added)] == [(11, "090-1234-5678"), (14, "1234567")]
    assert ids(D.scan_hunk("a.csv", 5, ["x,1234567"], [True], header="name,口座番号")) == [("jp-bank-account", "1234567")]
    post = '{"bankAccount": {\n"no": "1234567"\n}}'
    assert ids(D.scan_hunk("a.json", 2, ['"no": "1234567"'], [True], post_image=post)) == [("jp-bank-account", "1234567")]
    assert ids(D.scan_hunk("a.json", 2, ['"no":  "1234567"'], [True], post_image=post)) == []


def test_overlaps_fold_in_order():
    f = lambda a, z, c, s=50, r="x": Finding(r, 1, a, z, "", c, c, score=s)
    a, b, c = f(0, 5, 2), f(4, 8, 3), f(7, 9, 2)
    assert resolve([a, b, c]) == [b] and resolve([a, c, b]) == [b] and resolve([a, c]) == [a, c]
    assert resolve([f(0, 5, 2, 50), f(0, 5, 2, 50, "w")])[0].rule_id == "w" and resolve([a, a]) == [a]


def test_words():
    assert X.has_word("my tel: 1", "tel") and not X.has_word("hotel", "tel") and X.has_word("電話帳", "電話")
    assert X.keywords("bankAccountNo", ("account_no", "bank account", "tel")) == ["account_no", "bank account"]
    assert X.numbering_before("会員コード: 1", 7, ("電話",)) and not X.numbering_before("口座番号: 1", 6, ("口座",)) and not X.numbering_before("paid 1", 5, ())


def test_cheap_tests_lose_nothing():
    import random

    r = random.Random(9)
    parts = "個人番号 1234-5678-9018 TEL 090-1234-5678 口座 1234567 免許 305012345678 住所: 東京都渋谷区神南 1-2-3 1丁目2番 生年月日 1990/2/3 dob: みずほ銀行 0001-123- 記号 12340 番号 12345671 passport TK1234567 、 ： - ( ) bankAccount No T1234567890123 登録番号 4000-0012-3456-7899 〒530-0001 氏名: 山田太郎 様 年金 nenkin 被保険者 保険者番号 123456 \n".split(" ")
    slow = Detector(Config(high_recall=True, log_drops=True))
    for _ in range(1500):
        text = "".join(r.choice(parts) + r.choice(["", " ", "\n"]) for _ in range(r.randint(1, 7)))
        assert [(f.rule_id, f.line, f.start, f.end, f.confidence, f.score) for f in ALL.scan(text)] == [(f.rule_id, f.line, f.start, f.end, f.confidence, f.score) for f in slow.scan(text)]


def test_gates_lose_nothing():
    import random
    import re

    r = random.Random(11)
    open_ = Detector(Config(high_recall=True))
    open_.gate_words = None
    parts = "dob: H1/2/3 birthday 1990-1-2 tel (0123) 45-6789 +81 90 1234 5678 card 4000-0012-3456-7899 passport TK 1234567 full_name: Taro Yamada 090.1234.5678 pension 1234.567890 zip code 150-0043 kouza 123/4567 hokensha 1234 5678 x a@b.jp 12 3 45".split(" ")
    for _ in range(3000):
        text = "".join(r.choice(parts) + r.choice(["", " ", " ", "\n"]) for _ in range(r.randint(1, 6)))
        assert [(f.rule_id, f.line, f.start, f.end, f.score) for f in ALL.scan(text)] == [(f.rule_id, f.line, f.start, f.end, f.score) for f in open_.scan(text)]


def test_looking_near_digits_loses_nothing(monkeypatch):
    """The whole line searched, and near its digits only; every line opened, and by the gate; old texts, new results."""
    import random

    import pyarrow.parquet as pq

    from shirabe.detect import engine

    r = random.Random(21)
    parts = "〒150-0043 〒 1500043 TK1234567 AB12345678CD T1234567890123 (0123)45-6789 +81-3-1234-5678 6.5 口座番号 普通預金 1234567 旅券 1234.567890 12/3456 x  、 。 個人番号 123456789018 123456 789018 伝票番号".split(" ")
    texts = ["".join(r.choice(parts) + r.choice(["", " ", "な" * r.choice([1, 30]), "\n"]) for _ in range(r.randint(1, 9))) for _ in range(1500)]
    texts += pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    for config in (Config(high_recall=True), Config(log_drops=True)):
        now = Detector(config)
        got = [[(f.rule_id, f.line, f.start, f.end, f.confidence, f.score, f.whole) for f in now.scan(t)] for t in texts], [(x.rule_id, x.line, x.column, x.reason) for x in now.drops]
        with monkeypatch.context() as m:
            m.setattr(engine, "_NUMERIC", frozenset())
            whole = Detector(config)
            whole.gate_words = None
            want = [[(f.rule_id, f.line, f.start, f.end, f.confidence, f.score, f.whole) for f in whole.scan(t)] for t in texts], [(x.rule_id, x.line, x.column, x.reason) for x in whole.drops]
        assert got[0] == want[0] and sum(map(len, got[0])) > 500
        assert set(got[1]) <= set(want[1])
