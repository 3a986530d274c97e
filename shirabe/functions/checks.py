"""Check digits and validity rules as Catalyst expressions: no Python runs.

All take a column of ASCII digits unless said otherwise and give false for null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..detect import vocabulary as W
from .text import strip_separators

_UP, _DOWN = "0123456789", "9876543210"


def _digit(c: Column, i: int) -> Column:
    """The digit at place i from 0."""
    return F.substring(c, i + 1, 1).try_cast("int")


def _weighted(c: Column, weights) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + _digit(c, i) * w
    return total


def _ok(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def all_same(c: Column) -> Column:
    return _ok(c.rlike("\\A(.)\\1*\\z"))


def sequential(c: Column) -> Column:
    """Zeros and then an ascending run (one digit is a run), or one ascending or descending run in all."""
    rest = F.regexp_replace(c, "\\A0+(?=[0-9])", "")
    padded = (F.length(rest) < F.length(c)) & F.contains(F.lit(_UP), rest)
    return _ok((F.length(c) > 1) & (padded | F.contains(F.lit(_UP), c) | F.contains(F.lit(_DOWN), c)))


def my_number(c: Column) -> Column:
    """12 digits whose last is the weighted check digit (weights 2 to 7, then 2 to 6, from the right)."""
    rest = _weighted(c, [6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11
    want = F.when(rest <= 1, F.lit(0)).otherwise(11 - rest)
    return _ok(c.rlike("\\A[0-9]{12}\\z") & ~all_same(c) & (_digit(c, 11) == want))


def my_number_valid(c: Column) -> Column:
    """As it is written, with separators; runs of digits that only count up are left out."""
    d = strip_separators(c)
    return my_number(d) & ~sequential(d)


def corporate_number(c: Column) -> Column:
    """13 digits whose first is 9 less the weighted sum modulo 9 (weights 1 and 2 from the right)."""
    rest = _weighted(F.substring(c, 2, 12), [2, 1] * 6) % 9
    return _ok(c.rlike("\\A[0-9]{13}\\z") & (_digit(c, 0) == 9 - rest))


def modulus10_weight21(c: Column) -> Column:
    """The last digit tops the digit sums of the others, times 2 and 1 from the right, up to a ten."""
    chars = F.reverse(F.split(F.substring(c, F.lit(1), F.length(c) - 1), ""))
    terms = F.transform(F.filter(chars, lambda x: x != ""), lambda x, i: _folded(x.try_cast("int") * F.when(i % 2 == 0, 2).otherwise(1)))
    rest = F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10
    return _ok(c.rlike("\\A[0-9]{2,}\\z") & (F.substring(c, -1, 1).try_cast("int") == (10 - rest) % 10))


def _folded(x: Column) -> Column:
    return (F.when(x > 9, x - 9).otherwise(x)).cast("int")


def luhn(c: Column) -> Column:
    return _ok(c.rlike("\\A[0-9]+\\z") & F.call_function("luhn_check", c))


def card_brand(c: Column) -> Column:
    """The brand that a card number's prefix and length belong to, or null."""
    n = F.length(c)
    p = lambda k: F.substring(c, 1, k).try_cast("int")
    return (
        F.when(c.startswith("4") & n.isin(16, 19), "visa")
        .when((p(2).between(51, 55) | p(4).between(2221, 2720)) & (n == 16), "mastercard")
        .when(p(2).isin(34, 37) & (n == 15), "amex")
        .when(p(4).between(3528, 3589) & n.between(16, 19), "jcb")
        .when((p(2).isin(36, 38, 39) | p(3).between(300, 305)) & n.between(14, 19), "diners")
        .when((c.startswith("6011") | c.startswith("65") | p(3).between(644, 649)) & n.isin(16, 19), "discover")
    )


def known_test_card(c: Column) -> Column:
    from ..detect.validators import TEST_CARDS

    return _ok(F.sha2(c, 256).isin(sorted(TEST_CARDS)))


def credit_card(c: Column) -> Column:
    """13 to 19 digits of a brand, not all the same, no published test number, with a Luhn check digit."""
    return _ok(c.rlike("\\A[0-9]{13,19}\\z") & ~all_same(c) & card_brand(c).isNotNull() & luhn(c) & ~known_test_card(c))


def yucho_check(symbol: Column, number: Column) -> Column:
    """The check digit of a postal account: of its symbol without the fourth digit, and its number in 8 digits."""
    double = lambda c, i: _folded(2 * _digit(c, i))
    n = F.lpad(number, 8, "0")
    total = _digit(symbol, 0) + 3 * _digit(symbol, 1) + double(symbol, 2) + 3 * _digit(symbol, 4)
    for i in (1, 4, 7):
        total = total + _digit(n, i)
    for i in (2, 5):
        total = total + 3 * _digit(n, i)
    for i in (0, 3, 6):
        total = total + double(n, i)
    return total % 10


def yucho_account(symbol: Column, number: Column) -> Column:
    """A postal account: the fourth digit of its symbol checks the others and the number."""
    shape = symbol.rlike("\\A[0-9]{5}\\z") & number.rlike("\\A[0-9]{1,8}\\z")
    return _ok(shape & (_digit(symbol, 3) == yucho_check(symbol, number)))


def phone_kind(c: Column) -> Column:
    """service, ip, mobile, international or fixed, of a number as it is written."""
    d = strip_separators(c)
    home = F.when(d.startswith("+81"), F.concat(F.lit("0"), F.substring(d, 4, 99))).when(d.startswith("81"), F.concat(F.lit("0"), F.substring(d, 3, 99))).otherwise(d)
    return F.when(home.rlike("\\A(?:" + W.any_of(W.SERVICE_PREFIXES) + ")"), "service").when(home.startswith("050"), "ip").when(home.rlike("\\A0[6-9]0"), "mobile").when(c.startswith("+81"), "international").otherwise("fixed")


def phone_valid(c: Column, area_codes: list[str] | None = None) -> Column:
    """A number as it is written: mobile, fixed (with a separator any area, else a known one), or +81."""
    from ..detect.dictionaries import area_codes as known

    d = strip_separators(F.regexp_replace(c, "\\A\\+", ""))
    rest = F.substring(d, 3, 99)
    abroad = ((F.length(rest) == 9) & ~rest.startswith("0")) | ((F.length(rest) == 10) & rest.rlike("\\A[5-9]0"))
    codes = "|".join(sorted(known() if area_codes is None else area_codes))
    fixed = (F.length(d) == 10) & F.when(c.rlike("[- ]"), F.substring(d, 2, 1) != "0").otherwise(d.rlike(f"\\A(?:{codes})"))
    mobile = (F.length(d) == 11) & d.rlike("\\A0[5-9]0")
    return _ok(~all_same(d) & ~sequential(d) & F.when(d.startswith("81"), abroad).otherwise(d.startswith("0") & (fixed | mobile)))


def calendar_date(y: Column, m: Column, d: Column) -> Column:
    text = F.format_string("%04d-%02d-%02d", y, m, d)
    return _ok(F.try_to_date(text, "yyyy-MM-dd").isNotNull())


def birthdate_valid(c: Column) -> Column:
    """A date in Western years, Japanese eras (by name or letter, the first year by its own character) or
    eight digits, if the calendar has it."""
    plain = "\\A((?:19|20)[0-9]{2})([0-9]{2})([0-9]{2})\\z"
    shape = "\\A(?:((?:19|20)[0-9]{2})|(令和|平成|昭和|大正|明治|[HMRST])(元|[0-9]{1,2}))[年/.-]([0-9]{1,2})[月/.-]([0-9]{1,2})日?\\z"
    get = lambda p, k: F.regexp_extract(c, p, k)
    num = lambda p, k: get(p, k).try_cast("int")
    era = F.substring(get(shape, 2), 1, 1)
    year = F.when(get(shape, 3) == "元", 1).otherwise(num(shape, 3))
    first, last = F.lit(None).cast("int"), F.lit(None).cast("int")
    for names, a, z in (("明M", 1868, 45), ("大T", 1912, 15), ("昭S", 1926, 64), ("平H", 1989, 31), ("令R", 2019, 99)):
        hit = era.isin(*names)
        first, last = F.when(hit, a).otherwise(first), F.when(hit, z).otherwise(last)
    western = F.coalesce(num(shape, 1), F.when(year.between(1, last), first + year - 1))
    return _ok(F.when(c.rlike(plain), calendar_date(num(plain, 1), num(plain, 2), num(plain, 3))).when(c.rlike(shape) & western.isNotNull(), calendar_date(western, num(shape, 4), num(shape, 5))).otherwise(False))


def drivers_license_valid(c: Column) -> Column:
    d = strip_separators(c)
    return _ok((F.length(d) > 0) & ~d.startswith("0") & ~all_same(d) & ~sequential(d))


def address_tail_is_no_date(c: Column) -> Column:
    """Whether the numbers that end an address, joined by hyphens, aren't a date of 1900 to 2100."""
    tail = F.regexp_extract(c, "([0-9]{1,4}(?:-[0-9]{1,4})+)\\z", 1)
    parts = F.split(tail, "-")
    n = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    date = (F.size(parts) == 3) & n(0).between(1900, 2100) & calendar_date(n(0), n(1), n(2))
    return F.coalesce(~date, F.lit(True))


def email_valid(c: Column, tlds=None) -> Column:
    """An ASCII mail address that isn't a placeholder, under a known top-level domain."""
    from ..detect.dictionaries import words

    local, domain = F.regexp_extract(c, "\\A(.+)@([^@]+)\\z", 1), F.lower(F.regexp_extract(c, "\\A(.+)@([^@]+)\\z", 2))
    labels = F.split(domain, "\\.")
    tld, dummy = F.element_at(labels, -1), "(?i)hoge|fuga|dummy|sample|foo|bar"
    plain = (local != "") & ~local.rlike("\\A\\.|\\.\\z|\\.\\.") & local.rlike("[0-9A-Za-z]")
    named = ~F.exists(labels, lambda x: (x == "") | x.startswith("-") | x.endswith("-") | (x == "example"))
    known = tld.isin(*sorted(words("tlds") if tlds is None else tlds)) & ~tld.isin(*sorted(W.RESERVED_HOSTS))
    return _ok(plain & named & ~local.rlike(dummy) & ~F.get(labels, F.lit(0)).rlike(dummy) & known)


def no_digit_group(line: Column, value: str, separators: str, *widths: int) -> Column:
    """Whether no occurrence of the value's pattern has, after a separator, a run of digits of such a width
    beside it."""
    sep = "[" + "".join("\\" + x for x in separators) + "]"
    runs = "|".join(f"[0-9]{{{w}}}" for w in widths)
    return _ok(~line.rlike(f"(?<![0-9])(?:{runs}){sep}(?:{value})|(?:{value}){sep}(?:{runs})(?![0-9])"))
