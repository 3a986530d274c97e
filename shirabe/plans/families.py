"""Queries of every rule through the matcher, over grids of labels, separators, forms and surroundings.

Each leaves one rule in force, so that what is found is the rule's own; the SQL says from the parts of the text
what the rule has to find.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..detect import dictionaries as D
from ..detect import rules as R
from ..detect import vocabulary as W
from ..detect.engine import Config
from ..operators import scan as S
from .checks import _CO, _MY, sql_brand, sql_luhn, sql_same, sql_sum
from .grids import Grid, listed, quoted

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_ALL = tuple(dict.fromkeys(r.id for r in R.builtin()))


def only(*rule_ids: str, **more) -> Config:
    """A configuration in which these rules alone are in force."""
    return Config(high_recall=True, disabled=tuple(i for i in _ALL if i not in rule_ids), **more)


def scanned(rows, config: Config):
    """Findings of few, costly texts: spread over the cores first."""
    return S.scan_documents(S.spread(rows.select("k", "text")), config=config)


def register(name: str, grid: Grid, config: Config, sql: str, *more: str, about: str = "") -> None:
    def run(spark, sf_dir):
        return scanned(grid.rows(spark, sf_dir), config).select("k", "rule_id", "line", "column", "match", "confidence", *(F.col(f"reason.{m}").alias(m) for m in more))

    run.__doc__, run.grid = about, grid
    QUERIES[name], ORACLE[name] = run, sql


# --- numbers ---------------------------------------------------------------------------------------------------------
_STRANGE = ("値", "備考", "伝票番号", "整理番号", "emp_id")  # of no rule: two words, a known label, two names of numbers
_SEPS, _TAILS = (" ", ": ", "=", "：", "は "), ("", "です", "円", " 件", " 名簿", " 注文書", " (A)")
_HIGH, _MEDIUM, _LOW = R.HIGH, R.MEDIUM, R.LOW


def number_family(rule_id: str, words, forms: dict[str, tuple], valid: str, negative: str, width: int, grid: Grid | None = None, more: tuple = (), reason: str = "") -> None:
    """forms: {template: (confidence, needs context, mode)}. valid: SQL over digits ``d`` and ``value``."""
    g = grid or Grid().digits("d", width)
    g = g.form("value", "d", forms).pick("label", (*words, *_STRANGE)).pick("sep", _SEPS).pick("tail", _TAILS).text("label", "sep", "value", "tail")
    one = lambda j, cast: "CASE " + " ".join(f"WHEN value_form = {quoted(t)} THEN {cast(f[j])}" for t, f in forms.items()) + " END"
    own, must = f"label IN {listed(words)}", one(1, lambda x: str(x).upper())
    price, papers = "tail IN ('円', ' 件')", "tail = ' 注文書'"
    other = "label IN ('伝票番号')"
    named = "label IN ('伝票番号', '整理番号', 'emp_id')"
    against = {"": "FALSE", "unit": f"({price} OR {named})", "full": f"({price} OR {named} OR {papers} OR label = '伝票番号')"}[negative]
    against = f"CASE {one(2, quoted)} WHEN 'none' THEN FALSE WHEN 'label' THEN {other} ELSE {against} END" if negative else "FALSE"
    base = one(0, str)
    sql = (
        f"SELECT k, {quoted(rule_id)} AS rule_id, 1 AS line, CAST(length(label || sep) + 1 AS INTEGER) AS \"column\", value AS match, "
        f"CAST(CASE WHEN NOT ({must}) AND {own} THEN 3 ELSE {base} END AS INTEGER) AS confidence{reason} FROM ({g.sql}) WHERE ({own} OR NOT ({must})) AND NOT ({against}) AND ({valid})"
    )
    register("rule_" + rule_id.removeprefix("jp-").replace("-", "_"), g, only(rule_id), sql, *more, about=f"Labels, separators, forms and surroundings of {rule_id}.")


_must = lambda c: (c, True, "all")
_free = lambda c, mode="all": (c, False, mode)
_SAME = f"NOT {sql_same('d')}"


def _with_check(width: int, sql: str, every: int = 5) -> Grid:
    """Digits ``d``: of ``width`` and a check digit, which is wrong in one of ``every`` rows."""
    g = Grid().digits("b", width)
    return g.add("c", f"CASE WHEN k % {every} = 0 THEN k % 10 ELSE {sql} END")


_REST = f"{sql_sum('b', _MY)} % 11"
_my = _with_check(11, f"(CASE WHEN {_REST} <= 1 THEN 0 ELSE 11 - {_REST} END)").add("d", "b || CAST(c AS STRING)")
number_family(
    "jp-my-number", W.MY_NUMBER, {"dddddddddddd": _free(_MEDIUM), "dddd-dddd-dddd": _free(_MEDIUM), "dddd dddd dddd": _free(_MEDIUM), "dddddd dddddd": _free(_MEDIUM), "dddddd.dddddd": _must(_MEDIUM), "dddddd/dddddd": _must(_MEDIUM), "(dddddd)dddddd": _must(_MEDIUM)},
    f"{_SAME} AND c = (CASE WHEN {_REST} <= 1 THEN 0 ELSE 11 - {_REST} END)", "unit", 12, _my,
)
_CHECK = f"(9 - {sql_sum('b', _CO)} % 9)"
number_family("jp-invoice-number", W.INVOICE, {"Tddddddddddddd": _must(_MEDIUM)}, f"c = {_CHECK}", "", 13, _with_check(12, _CHECK, 7).add("d", "CAST(c AS STRING) || b"), ("kind",), ", 'public-business' AS kind")
number_family("jp-drivers-license", W.LICENCE, {"dddddddddddd": _must(_HIGH), "dddd-dddd-dddd": _must(_HIGH), "dddd.dddd.dddd": _must(_MEDIUM)}, f"{_SAME} AND substr(d, 1, 1) <> '0'", "full", 12)
number_family("jp-pension-number", W.PENSION, {"dddddddddd": _must(_HIGH), "dddd-dddddd": _must(_HIGH), "dddd dddddd": _must(_HIGH), "dddd.dddddd": _must(_MEDIUM)}, _SAME, "full", 10)
number_family("jp-employment-insurance", W.EMPLOYMENT_INSURANCE, {"dddd-dddddd-d": _must(_HIGH), "ddddddddddd": _must(_MEDIUM)}, _SAME, "full", 11)
number_family("jp-kaigo-insurance", W.CARE_INSURANCE, {"dddddddddd": _must(_MEDIUM)}, _SAME, "full", 10)
number_family("jp-juminhyo-code", W.RESIDENT_RECORD, {"ddddddddddd": _must(_HIGH)}, _SAME, "", 11)
number_family("jp-passport", W.PASSPORT, {"TKddddddd": _must(_HIGH), "mz ddddddd": _must(_HIGH)}, _SAME, "unit", 7)
number_family("jp-residence-card", W.RESIDENCE_CARD, {"ABddddddddCD": _must(_HIGH), "xyddddddddZZ": _must(_HIGH)}, _SAME, "unit", 8)
number_family("jp-health-insurance", tuple(w for w in W.HEALTH_INSURANCE if w != "保険者番号"), {"dddddddd": _must(_MEDIUM), "dddd dddd": _must(_MEDIUM)}, _SAME, "full", 8)
number_family("jp-bank-account", W.BANK_ACCOUNT, {"ddddddd": _must(_MEDIUM), "ddd dddd": _must(_MEDIUM), "ddd/dddd": _must(_MEDIUM)}, _SAME, "full", 7)
_REGION = f"(substr(d, 1, 3) <> '000' AND substr(d, 1, 2) IN {listed(D.words('postal_regions'))})"
number_family("jp-postal-code", tuple(w for w in W.POSTAL_CODE if w != "〒"), {"〒ddd-dddd": _free(_HIGH), "〒 ddddddd": _free(_HIGH), "ddd-dddd": _must(_MEDIUM), "ddddddd": _must(_MEDIUM)}, _REGION, "unit", 7)
_g = QUERIES["rule_postal_code"].grid.sql  # behind another label, the sign is no part of the code but speaks for it
ORACLE["rule_postal_code"] += (
    f" UNION ALL SELECT k, 'jp-postal-code', 1, CAST(length(label || sep || value) - length(ltrim(value, '〒 ')) + 1 AS INTEGER), ltrim(value, '〒 '), 2 FROM ({_g}) WHERE value LIKE '〒%' AND label IN ('伝票番号', '整理番号', 'emp_id') AND tail NOT IN ('円', ' 件') AND {_REGION}"
)
number_family(
    "jp-phone-number", W.PHONE,
    {"090-dddd-dddd": _free(_HIGH, "label"), "080 dddd dddd": _free(_MEDIUM), "070/dddd/dddd": _must(_MEDIUM), "060dddddddd": _free(_MEDIUM, "label"), "03-dddd-dddd": _free(_MEDIUM, "label"), "03.dddd.dddd": _free(_MEDIUM), "03.dddd-dddd": _free(_MEDIUM), "03-dddd.dddd": _free(_MEDIUM),
     "03(dddd)dddd": _free(_MEDIUM), "(03)dddd-dddd": _free(_MEDIUM), "03dddddddd": _must(_MEDIUM), "+81-90-dddd-dddd": _free(_HIGH, "label"), "+81 3 dddd dddd": _free(_HIGH, "label")},
    "TRUE", "full", 8, None, ("kind",), ", CASE WHEN value_form LIKE '+81 3%' THEN 'international' WHEN replace(value, ' ', '') LIKE '0800%' THEN 'service' WHEN value_form LIKE '03%' OR value_form LIKE '(03%' THEN 'fixed' ELSE 'mobile' END AS kind",
)
_card = Grid().digits("b", 14).add("c", "k * 7 % 10").add("d", "'4' || b || CAST(c AS STRING)")
number_family("credit-card", W.CARD, {"dddddddddddddddd": _free(_HIGH), "dddd-dddd-dddd-dddd": _free(_HIGH), "dddd dddd dddd dddd": _free(_HIGH)}, f"{_SAME} AND {sql_luhn('d')} AND {sql_brand('d')} IS NOT NULL AND d NOT IN ('4111111111111111', '4242424242424242')", "unit", 16, _card)

# insurers' numbers stand right beside their label
_insurer = Grid().digits("d", 6).pick("label", ("保険者番号", "被保険者番号", "番号")).pick("sep", ("", ":", "： ", "= ", "は")).pick("tail", ("", " です", "-1", "9", "円")).text("label", "sep", "d", "tail")
register(
    "rule_insurer_number", _insurer, only("jp-health-insurance"),
    f"SELECT k, 'jp-health-insurance' AS rule_id, 1 AS line, CAST(length(label || sep) + 1 AS INTEGER) AS \"column\", d AS match, 2 AS confidence FROM ({_insurer.sql}) WHERE label = '保険者番号' AND sep <> 'は' AND tail IN ('', ' です') AND NOT {sql_same('d')} AND {sql_luhn('d')}",
    about="Six digits with a check digit, right behind the insurer's label.",
)

# --- postal savings ---------------------------------------------------------------------------------------------------
_twice = lambda s, i: f"(CASE WHEN {_at(s, i)} > 4 THEN 2 * {_at(s, i)} - 9 ELSE 2 * {_at(s, i)} END)"
_at = lambda s, i: f"CAST(substr({s}, {i + 1}, 1) AS INTEGER)"
_SUM = f"({_at('s', 0)} + 3 * {_at('s', 1)} + {_twice('s', 2)} + 3 * {_at('s', 4)} + {' + '.join(_twice('n8', i) for i in (0, 3, 6))} + {' + '.join(_at('n8', i) for i in (1, 4, 7))} + 3 * ({_at('n8', 2)} + {_at('n8', 5)})) % 10"
_savings = (
    Grid().digits("d", 2, 10**6).digits("e", 6, 10**6).pick("chk", tuple("0123456789")).add("s", "'1' || d || chk || '0'").add("n", "e || '1'").add("n8", "'0' || n")
    .pick("label", (*W.POSTAL_SAVINGS, "値", "備考")).pick("glue", ("-", " ", "-2-", "/")).pick("tail", ("", "円", " です", " 件")).add("lead", "label || ': '").text("lead", "s", "glue", "n", "tail")
)
register(
    "rule_yucho_account", _savings, only("jp-yucho-account"),
    f"SELECT k, 'jp-yucho-account' AS rule_id, 1 AS line, CAST(length(lead) + 1 AS INTEGER) AS \"column\", s || glue || n AS match, 3 AS confidence FROM ({_savings.sql}) WHERE label NOT IN ('値', '備考') AND glue <> '/' AND tail NOT IN ('円', ' 件') AND {_at('s', 3)} = {_SUM} AND NOT {sql_same('n')}",
    about="Symbol and number of a postal savings account, checked against each other.",
)

# --- dates of birth -----------------------------------------------------------------------------------------------------
_eras = {"明治": (1868, 45), "大正": (1912, 15), "昭和": (1926, 64), "平成": (1989, 31), "令和": (2019, 99), "S": (1926, 64), "H": (1989, 31)}
_born = Grid().pick("label", (*W.BIRTH, "DOB", "birthday", "date of birth", "記入日", "日付")).pick("sep", (": ", "：", " ", "（西暦）：")).pick("era", ("", "", *_eras)).pick("m", tuple(str(i) for i in range(1, 14))).pick("day", tuple(str(i) for i in range(1, 33))).pick("marks", ("年月日", "///"[:2], "--", ".."))
_born = _born.add("y", "CASE WHEN era = '' THEN 1930 + k % 90 ELSE k % 70 END")
_born = _born.add("value", "era || CAST(y AS STRING) || substr(marks, 1, 1) || m || substr(marks, 2, 1) || day || substr(marks, 3, 1)").pick("tail", ("", "生まれ", " です")).text("label", "sep", "value", "tail")
_first = "CASE era " + " ".join(f"WHEN {quoted(e)} THEN {f}" for e, (f, _) in _eras.items()) + " ELSE 0 END"
_last = "CASE era " + " ".join(f"WHEN {quoted(e)} THEN {n}" for e, (_, n) in _eras.items()) + " ELSE 9999 END"
register(
    "rule_birthdate", _born, only("jp-birthdate"),
    f"SELECT k, 'jp-birthdate' AS rule_id, 1 AS line, CAST(length(label || sep) + 1 AS INTEGER) AS \"column\", value AS match, 2 AS confidence FROM (SELECT *, {_first} AS f, {_last} AS n FROM ({_born.sql})) WHERE (label NOT IN ('記入日', '日付') OR tail = '生まれ') "
    "AND (era = '' OR y BETWEEN 1 AND n) AND try_cast(lpad(CAST(CASE WHEN era = '' THEN y ELSE f + y - 1 END AS STRING), 4, '0') || '-' || lpad(m, 2, '0') || '-' || lpad(day, 2, '0') AS DATE) IS NOT NULL",
    about="Labelled dates of the calendar and of eras, and dates at which someone was born.",
)

# --- mail ---------------------------------------------------------------------------------------------------------------
_mail = Grid().pick("lead", ("", "mail: ", "<", "宛先は", "a:", "「")).pick("local", ("taro", "t.yamada", ".dot", "a..b", "dummy1", "x_1+y", "end.", "-", "ab%c")).pick("host", ("mail", "ex-ample", "-bad", "sample", "example", "a", "bad-")).pick("tld", ("info", "com", "jp", "photography", "nosuchtld", "local", "test", "example.com")).pick("tail", ("", ">", " まで", "です", ":x", "」"))
_mail = _mail.add("value", "local || '@' || host || '.' || tld").text("lead", "value", "tail")
_LAST = "CASE WHEN contains(tld, '.') THEN split_part(tld, '.', 2) ELSE tld END"
_MAIL_OK = (
    f"local NOT IN ('.dot', 'a..b', 'end.', '-', 'dummy1') AND host NOT IN ('-bad', 'bad-', 'sample', 'example') AND NOT contains(tld, 'example') AND ({_LAST}) IN {listed(D.words('tlds'))} AND ({_LAST}) NOT IN {listed(W.RESERVED_HOSTS)}"
)
register(
    "rule_email_address", _mail, only("email-address"),
    f"SELECT k, 'email-address' AS rule_id, 1 AS line, CAST(length(lead) + 1 AS INTEGER) AS \"column\", value AS match, 3 AS confidence FROM ({_mail.sql}) WHERE {_MAIL_OK} AND lead <> '宛先は' AND tail NOT IN ('です', ':x')",
    about="Mail addresses among signs: dots, dummies, reserved and unknown domains.",
)
_eai = Grid().pick("lead", ("", "mail: ", "<", "宛先は ")).pick("local", ("山田", "taro", "た.ろう", ".山", "メール山", "a1", "山・田")).pick("host", ("例え", "mail", "日本-会社", "-悪い", "example")).pick("tld", ("jp", "com", "nosuchtld", "test", "みんな")).pick("tail", ("", ">", " まで"))
_eai = _eai.add("value", "local || '@' || host || '.' || tld").text("lead", "value", "tail")
_puny = "xn--" + "みんな".encode("punycode").decode()
register(
    "rule_email_eai", _eai, only("email-address-eai"),
    f"SELECT k, 'email-address-eai' AS rule_id, 1 AS line, CAST(length(lead) + 1 AS INTEGER) AS \"column\", value AS match, 3 AS confidence FROM ({_eai.sql}) WHERE regexp_matches(local || host || tld, '[ぁ-ヿ一-鿿]') AND local NOT IN ('.山', 'メール山', '山・田') AND host NOT IN ('-悪い', 'example') "
    f"AND CASE tld WHEN 'みんな' THEN {quoted(_puny)} ELSE tld END IN {listed(D.words('tlds'))} AND tld <> 'test'",
    about="Mail addresses with Japanese in them.",
)
_alike = Grid().pick("local", ("tаro", "taro", "yаmаdа", "satо.k", "αb", "hanakо1")).pick("host", ("mail", "mаil", "gmail", "sаmple")).pick("tld", ("com", "jp", "соm")).add("value", "local || '@' || host || '.' || tld").pick("tail", ("", " x", ">")).text("value", "tail")
register(
    "rule_email_confusable", _alike, only("email-address-confusable"),
    f"SELECT k, 'email-address-confusable' AS rule_id, 1 AS line, 1 AS \"column\", value AS match, 3 AS confidence FROM (SELECT *, length(value) - length(translate(value, 'аоαс', '')) AS n, length(translate(value, 'аоαс.@', '')) AS latin, translate(value, 'аоαс', 'aoac') AS plain FROM ({_alike.sql})) "
    "WHERE n BETWEEN 1 AND 2 AND latin >= 6 AND latin * 100 >= 80 * (latin + n) AND NOT contains(split_part(plain, '@', 2), 'sample')",
    about="Mail addresses with one or two letters that only look Latin.",
)

# --- addresses ------------------------------------------------------------------------------------------------------------
_prefs, _cities, _towns = ("東京都", "大阪府", "北海道", "神奈川県", "京都府"), ("渋谷区", "横浜市", "札幌市", "架空市"), ("神南", "道玄坂", "栄町", "空想台")
_tails = ("1-2-3", "1丁目2番3号", "12番地の4", "2020-1-15", "三丁目五番地六号", "")
_numbered, _dashed = ("1-2-3", "1丁目2番3号", "12番地の4", "2020-1-15", "三丁目五番地六号"), ("1-2-3", "2020-1-15")
_whole = Grid().pick("lead", ("", "住所: ", "値 ", "(")).pick("pref", _prefs).pick("city", _cities).pick("town", _towns).pick("tail", _tails).pick("after", ("", " です", ")")).text("lead", "pref", "city", "town", "tail", "after")
register(
    "rule_address", _whole, only("jp-address"),
    f"SELECT k, 'jp-address' AS rule_id, 1 AS line, CAST(length(lead) + 1 AS INTEGER) AS \"column\", pref || city || town || tail AS match, 3 AS confidence FROM ({_whole.sql}) WHERE tail NOT IN ('', '2020-1-15')",
    about="Addresses with their prefecture: marked, hyphenated and Han numbers, and a date that is none.",
)
_KNOWN = f"city IN {listed(c for c in _cities if D.has_municipality(c))}"
_TOWN = f"(city || '|' || town) IN {listed(c + '|' + t for c in _cities for t in _towns if D.municipality_then_town(c + t))}"
_short = Grid().pick("label", (*W.HOME_LABEL, "勤務先", "値")).pick("sep", (": ", "：", "=", "")).pick("city", _cities).pick("town", _towns).pick("tail", tuple(t for t in _tails if t != "三丁目五番地六号")).pick("after", ("", " です", "\n")).text("label", "sep", "city", "town", "tail", "after")
_GRADE = f"CASE WHEN {_TOWN} THEN 3 WHEN label IN {{}} THEN 3 ELSE 2 END"
register(
    "rule_address_labelled", _short, only("jp-address"),
    f"SELECT k, 'jp-address' AS rule_id, 1 AS line, CAST(length(label || sep) + 1 AS INTEGER) AS \"column\", city || town || tail AS match, CAST({_GRADE.format(listed(W.HOME))} AS INTEGER) AS confidence FROM ({_short.sql}) WHERE label IN {listed(W.HOME_LABEL)} AND {_KNOWN} AND tail NOT IN ('', '2020-1-15')",
    about="Labelled addresses without their prefecture, in known municipalities and towns.",
)
_loose = Grid().pick("lead", ("", "会場：", "住所 ", "勤務地=")).pick("city", _cities).pick("town", _towns).pick("tail", _tails).text("lead", "city", "town", "tail")
register(
    "rule_address_high_recall", _loose, only("jp-address-high-recall"),
    f"SELECT k, 'jp-address-high-recall' AS rule_id, 1 AS line, CAST(length(lead) + 1 AS INTEGER) AS \"column\", city || town || tail AS match, CAST(CASE WHEN {_TOWN} OR lead IN ('住所 ', '勤務地=') THEN 3 ELSE 2 END AS INTEGER) AS confidence FROM ({_loose.sql}) WHERE {_KNOWN} AND tail NOT IN ('', '2020-1-15')",
    about="Addresses without label or prefecture.",
)

# --- names --------------------------------------------------------------------------------------------------------------------
_last, _given = ("山田", "佐藤", "鈴木", "架空"), ("太郎", "花子", "健一", "仮")
_full = lambda gap="": f"(family IN {listed(s for s in _last if D.is_surname(s))} AND given IN {listed(g for g in _given if D.is_given(g))})"
_labelled = Grid().pick("label", (*W.NAME_LABELS, "full_name", "CustomerName", "件名", "品名")).pick("sep", (": ", "：", "=", " ")).pick("family", _last).pick("gap", ("", " ", "　")).pick("given", _given).pick("after", ("", "\n備考", "、")).add("value", "family || gap || given").text("label", "sep", "value", "after")
_labelled_ok = f"label NOT IN ('件名', '品名') AND sep <> ' '"
register(
    "rule_person_name", _labelled, only("person-name"),
    f"SELECT k, 'person-name' AS rule_id, 1 AS line, CAST(length(label || sep) + 1 AS INTEGER) AS \"column\", value AS match, CAST(CASE WHEN {_full()} THEN 2 ELSE 1 END AS INTEGER) AS confidence FROM ({_labelled.sql}) WHERE {_labelled_ok}",
    about="Labelled names: known ones for sure, others in doubt.",
)
_polite = Grid().pick("lead", ("", "本日 ", "(")).pick("family", (*_last, "営業部長", "山田商店")).pick("honorific", (*W.HONORIFICS, "君", "")).pick("tail", ("", "へ", " 御中")).text("lead", "family", "honorific", "tail")
register(
    "rule_name_honorific", _polite, only("person-name-high-recall"),
    f"SELECT k, 'person-name-high-recall' AS rule_id, 1 AS line, CAST(length(lead) + 1 AS INTEGER) AS \"column\", family AS match, 2 AS confidence FROM ({_polite.sql}) WHERE honorific IN {listed(W.HONORIFICS)} AND family NOT IN ('営業部長', '山田商店')",
    about="Names by their honorific; neither roles nor organisations.",
)
_roma = Grid().pick("label", ("Name", "full_name", "customer name", "title")).pick("sep", (": ", "=", " : ")).pick("one", ("Taro", "Hanako", "Zzyx")).pick("two", ("Yamada", "Sato", "Suzuki", "Qwert")).pick("tail", ("", ",", ";")).add("value", "one || ' ' || two").text("label", "sep", "value", "tail")
_ROMA = f"(lower(one) IN {listed(g for g in ('taro', 'hanako', 'zzyx') if g in D.romaji('given_names'))} AND lower(two) IN {listed(s for s in ('yamada', 'sato', 'suzuki', 'qwert') if s in D.romaji('surnames'))})"
register(
    "rule_name_romaji", _roma, only("person-name-romaji"),
    f"SELECT k, 'person-name-romaji' AS rule_id, 1 AS line, CAST(length(label || sep) + 1 AS INTEGER) AS \"column\", value AS match, 2 AS confidence FROM ({_roma.sql}) WHERE {_ROMA} AND label IN ('full_name', 'customer name')",
    about="Labelled names in Latin letters.",
)

# --- rules of the user's own, thresholds, identifiers ------------------------------------------------------------------------------
_staff = Grid().digits("d", 5, 10**6).pick("label", ("社員", "staff id", "注文", "値")).pick("sep", (": ", " ")).pick("tail", ("", "円", " まで", "7")).add("value", "'E' || d").text("label", "sep", "value", "tail")
register(
    "rule_custom", _staff, only(custom=(R.custom_rule("x-staff", "E[0-9]{5}(?![0-9])", "staff number", "medium", ("社員", "staff id"), "unit"), R.custom_rule("x-strict", "(E[0-9]{4})[0-9]", confidence="low", context=("社員",), require_context=True))),
    f"SELECT k, 'x-staff' AS rule_id, 1 AS line, CAST(length(label || sep) + 1 AS INTEGER) AS \"column\", value AS match, CAST(CASE WHEN label IN ('社員', 'staff id') THEN 3 ELSE 2 END AS INTEGER) AS confidence FROM ({_staff.sql}) WHERE tail NOT IN ('円', '7') "
    f"UNION ALL SELECT k, 'x-strict', 1, CAST(length(label || sep) + 1 AS INTEGER), substr(value, 1, 5), 1 FROM ({_staff.sql}) WHERE label = '社員' AND tail IN ('円', '7')",
    about="Rules of the user's own beside each other: promotion, units, a group as the value, required context, overlaps.",
)
_hex = Grid().pick("lead", ("id ", "x", "(")).digits("d", 12, 10**6).pick("version", tuple("1445")).pick("variant", tuple("8aBc")).pick("fin", ("", "f", " "))
_hex = _hex.add("uuid", "'0A1b2C3d-00ff-' || version || 'abc-' || variant || '123-' || d").pick("label", (" 免許", " driver license")).text("lead", "uuid", "fin", "label")
register(
    "uuid_rejection", _hex, only("jp-drivers-license"),
    f"SELECT k, 'jp-drivers-license' AS rule_id, 1 AS line, CAST(length(lead || uuid) - 11 AS INTEGER) AS \"column\", d AS match, 3 AS confidence FROM ({_hex.sql}) WHERE NOT (version = '4' AND variant IN ('8', 'a', 'B') AND fin <> 'f') AND substr(d, 1, 1) <> '0'",
    about="Twelve digits at the end of a UUID of version 4 are no licence number; of other versions they may be.",
)
_two = Grid().digits("d", 11, 10**6).pick("before", ("雇用保険", "被保険者番号 伝票番号:", "値", "")).pick("blank", ("\n", "\n\n", "\n\n\n\n\n")).pick("third", ("", "\n円", "\n備考")).text("before", "blank", "d", "third")
register(
    "cross_line_context", _two, only("jp-employment-insurance"),
    f"SELECT k, 'jp-employment-insurance' AS rule_id, CAST(length(blank) + 1 AS INTEGER) AS line, 1 AS \"column\", d AS match, 2 AS confidence FROM ({_two.sql}) WHERE before = '雇用保険' AND length(blank) <= 3 AND third <> '\n円' AND {_SAME}".replace("\n", "' || chr(10) || '"),
    about="Context from the line before, if it is near enough, and words against a value on the lines around it.",
)
_grade = Grid().pick("label", ("電話", "値")).digits("d", 8, 10**6).add("value", "'080 ' || substr(d, 1, 4) || ' ' || substr(d, 5, 4)").add("sep", "' '").text("label", "sep", "value")


def _thresholds(spark, sf_dir):
    """Medium findings are kept for the exit status alone where only high ones are to be reported."""
    found = scanned(_grade.rows(spark, sf_dir), only("jp-phone-number", min_confidence=R.HIGH, scan_min_confidence=R.MEDIUM))
    return found.groupBy("confidence", "fail_only").agg(F.count("*").alias("n"))


QUERIES["report_thresholds"] = _thresholds
ORACLE["report_thresholds"] = f"SELECT CAST(CASE label WHEN '電話' THEN 3 ELSE 2 END AS INTEGER) AS confidence, label = '値' AS fail_only, count(*) AS n FROM ({_grade.sql}) GROUP BY ALL"
