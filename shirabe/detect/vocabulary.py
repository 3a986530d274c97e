"""The words that rules, context and structure go by, grouped by what they mean.

Which words count is settled by the detection task (findings have to agree with its documented vocabulary), so the sets
hold these and no others; how they are grouped is ours. Order inside a set has no meaning: :func:`any_of` builds
patterns with the longest word first, and all other uses are membership.
"""

from __future__ import annotations

import re


def any_of(words) -> str:
    """A pattern for any of the words; of two that begin alike the longer one is tried first."""
    return "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))


# --- what names a kind of number: Japanese, English, and Japanese in Latin letters ------------------------------
MY_NUMBER = ("個人番号", "マイナンバー", "my number", "my_number", "mynumber")
PHONE = ("電話", "携帯", "連絡先", "tel", "phone", "mobile", "fax", "denwa")
POSTAL_CODE = ("〒", "郵便", "郵便番号", "住所", "postal", "zip code", "zipcode")
CARD = ("クレジット", "カード番号", "credit", "card")
LICENCE = ("免許", *(f"driver{x} license" for x in ("", "s", "'s")), *(f"driver{x}_license" for x in ("", "s")), "license number", "license no", "licence")
PASSPORT = ("旅券", "パスポート", "passport")
PENSION = ("年金", "pension", "nenkin")
RESIDENCE_CARD = ("在留", *("特別永住" + x for x in ("", "者証明書")), "永住者証明書", "residence card", "special permanent", "zairyu")
BANK_ACCOUNT = ("口座", *(f"{x}預金" for x in ("普通", "当座")), "支店番号", "bank account", "account number", "account_no", "kouza")
POSTAL_SAVINGS = ("ゆうちょ", "郵便局", "日本郵政", "貯金", "郵便貯金", "通帳", "記号", "yucho", *("japan post" + x for x in ("", " bank")))
HEALTH_INSURANCE = ("保険証", "被保険者", "保険者番号", "health insurance", "hokensha")
EMPLOYMENT_INSURANCE = ("雇用保険", "被保険者番号", "employment insurance", "koyou hoken")
CARE_INSURANCE = ("介護保険", "要介護", "被保険者証", "kaigo hoken")
RESIDENT_RECORD = ("住民票", "住民票コード", "juminhyo")
INVOICE = ("適格請求書", "インボイス", "登録番号", "invoice number", "invoice registration")

# --- people and places ---------------------------------------------------------------------------------------------
HOME = ("住所", "自宅", "居住", "所在地", "address")
WORKPLACE = ("勤務先", "勤務地")
#: Before an address that has no prefecture; where anything near will do, ``HOME`` (and the workplaces) count.
HOME_LABEL = HOME
PLACE = tuple(w for w in HOME if w != "居住") + WORKPLACE
PREFECTURE_ENDS, MUNICIPALITY_ENDS = tuple("都道府県"), tuple("市区町村")
BIRTH = ("生年月日", "誕生日")

#: Labels of a name's reading; kana with a voice mark may be one character or two.
READING_LABELS = ("ふりがな", "フリガナ", "フリカ\u3099ナ")
#: Labels of a name: of anyone, of its reading, and of a person in some part.
NAME_LABELS = ("氏名", "ご氏名", "名前", "お名前", "姓名", "フルネーム") + READING_LABELS + tuple(f"{who}名" for who in ("会員", "顧客", "患者", "担当者", "申込者", "契約者", "利用者", "請求先")) + ("受取人",)
NAME_LABELS_LATIN = ("full", "customer", "patient", "applicant")
SURNAME_LABELS, GIVEN_LABELS = ("姓", "苗字", "名字"), ("名",)
#: What a line must have for a labelled name.
NAME_HINTS = ("姓", "名", "苗字", "フルネーム", *READING_LABELS, "受取人", "name")
#: Honorifics that end a name, and the roles that introduce one.
HONORIFICS, ROLE_LABELS = ("様", "殿", "さん", "氏"), ("担当", "宛名", "連絡先")
#: What may follow a name in a sentence: ways to address someone, then particles.
AFTER_NAME = HONORIFICS + ("君", "ちゃん", "先生", "先輩") + tuple("がをはにへとでもの") + ("か", "な", "や", "から", "より", "まで") + tuple(a + "は" for a in ("と", "で", "に", "から", "まで")) + ("でも",)

#: No name: nothing known, nothing given, made up.
NO_NAMES = ("不明", "未定") + ("なし", "無し", "該当なし", "該当無し", "空欄", "未記入", "未設定", "匿名", "名無し", "非公開") + ("ダミー", "サンプル", "テスト", "記入例")
#: Ends of organisations' names: companies and shops, finance, medicine, schools, associations, offices.
ORGANISATION_ENDS = ("会社", "商事", "商店", "産業", "工業", "製作所", "事務所") + ("銀行", "信用金庫") + ("病院", "医院") + tuple("学" + x for x in ("校", "園", "院")) + ("大学",) + ("法人", "財団", "協会", "組合") + tuple(a + b for a in "本支" for b in "社店")
#: Last characters of what someone does, is or belongs to.
ROLE_ENDS = tuple("者員士師手屋") + tuple("長課部室係") + tuple("生先中")

BANK_KINDS = ("銀行",) + ("信用金庫", "信金", "信用組合", "信組") + ("労働金庫", "ろうきん", "農協")

# --- what says that a number is something else ----------------------------------------------------------------------
CURRENCY_BEFORE, CURRENCY_AFTER = tuple("¥￥$"), tuple("円%％") + tuple("万億千")
COUNTERS = tuple("個件名人回点")
#: Labels of other numbers: of orders and parcels, of goods and drawings, of software.
OTHER_NUMBERS = tuple(f"{x}番号" for x in ("伝票", "受付", "予約", "追跡", "シリアル", "ビルド")) + ("品番", "型番", "図面", "sku") + ("トランザクション", "ジョブ", "version", "ver")
#: Words of business papers that speak against a number anywhere near.
PAPERWORK = ("注文", "伝票", "管理番号", "通し番号", "連番")
#: How the name of some number ends.
NUMBER_NAME_ENDS, NUMBER_NAME_ENDS_LATIN = ("番号", "コード", "キー"), ("id", "no", "code", "key", "sku")

# --- identifiers, columns and keys ----------------------------------------------------------------------------------
#: Words of declarations that say nothing about a value: how it is declared, who sees it, its type.
DECLARATIONS = frozenset("let var const def function func class interface type new return default".split()) | frozenset("public private protected static final readonly export declare local".split()) | frozenset("string number bool boolean int int32 int64 float any".split())
#: Words of fields that hold no personal number: amounts, numbers of things, measures, machinery.
IMPERSONAL = frozenset("amount price total yen count".split()) | frozenset("order invoice receipt id uuid guid".split()) | frozenset("size length limit offset port".split()) | frozenset("version revision build hash checksum token".split())
IMPERSONAL_JA = tuple(f"{x}番号" for x in ("注文", "受注", "伝票", "管理", "通し", "行")) + ("連番",) + ("金額", "価格", "単価", "小計", "合計") + ("個数", "数量", "件数")

# --- files and hosts -------------------------------------------------------------------------------------------------
#: Folders of other people's code, of version control, and of what builds make.
SKIPPED_FOLDERS = ("node_modules", "vendor", "venv", ".venv") + (".git",) + ("build", "dist", "target", ".next", "__pycache__")
#: Names that no mail host has (RFC 2606 and 6762).
RESERVED_HOSTS = frozenset(("example", "invalid", "localhost", "test", "local"))
#: Prefixes of numbers that services have: free calls, calls at a share of the cost, information and votes.
SERVICE_PREFIXES = frozenset(("0120", "0800") + ("0570",) + ("0180", "0990"))
TEST_FOLDERS = frozenset(("testdata", "fixtures", "mocks", "seed", "seeds", "spec", "__tests__"))
