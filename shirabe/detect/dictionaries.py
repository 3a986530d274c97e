"""Dictionaries behind the rules: small lists of our own from common knowledge, replaceable by files.

A file has a word on each line; what follows ``#`` is a comment. ``use(folder)`` loads any of the files
surnames.txt, given_names.txt, municipalities.txt, towns.txt, postal_codes.txt, tlds.txt, area_codes.txt,
bank_names.txt, bank_codes.txt, romaji_surnames.txt, romaji_given_names.txt and name_homographs.txt over the
lists that come with the package.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache
from pathlib import Path

HERE = Path(__file__).resolve().parent.parent / "dictionaries"
_folder: list[Path] = []


def use(folder: str | None) -> None:
    """Look for dictionary files in ``folder`` first (None: only in the package)."""
    _folder[:] = [Path(folder)] if folder else []
    for f in list(globals().values()):
        if hasattr(f, "cache_clear"):
            f.cache_clear()


@lru_cache(maxsize=None)
def words(name: str) -> frozenset[str]:
    for place in (*_folder, HERE):
        path = place / f"{name}.txt"
        if os.path.exists(path):
            text = path.read_text(encoding="utf-8")
            return frozenset(w for line in text.splitlines() for w in line.partition("#")[0].split())
    return frozenset()


def area_codes() -> frozenset[str]:
    return words("area_codes")


def area_code(digits: str) -> str | None:
    """The longest known area code with which the digits begin."""
    codes = area_codes()
    return next((digits[:n] for n in range(5, 1, -1) if digits[:n] in codes), None)


def postal_code(value: str) -> bool:
    """Whether 7 digits are a postal code; without a list of codes, whether they begin with a region in use."""
    d = "".join(c for c in value if "0" <= c <= "9")
    if len(d) != 7:
        return False
    known = words("postal_codes")
    return d in known if known else d[:3] != "000" and int(d[:3]) >= 1 and d[:2] in words("postal_regions")


def known_tld(label: str) -> bool:
    return label.lower() in words("tlds")


_PAIRS = {}
for _base in "かきくけこさしすせそたちつてとはひふへほうカキクケコサシスセソタチツテトハヒフヘホウワヰヱヲヽゝ":
    for _mark in "゙゚":
        _one = unicodedata.normalize("NFC", _base + _mark)
        if len(_one) == 1:
            _PAIRS[_base + _mark] = _one


def compose_kana(s: str) -> str:
    """Kana and a combining voice mark in one character."""
    if "゙" not in s and "゚" not in s:
        return s
    for a, b in _PAIRS.items():
        s = s.replace(a, b)
    return s


# --- names ---------------------------------------------------------------------------------------------------
def is_surname(v: str) -> bool:
    return v in words("surnames")


def is_given(v: str) -> bool:
    return v in words("given_names")


def split_full_name(v: str, homographs: bool = True) -> tuple[str, str] | None:
    """Surname and given name: parted by a space, or up to 4 characters each but never one and one."""
    parts = v.split()
    if len(parts) > 1:
        return (parts[0], parts[1]) if len(parts) == 2 and is_surname(parts[0]) and is_given(parts[1]) else None
    if homographs and v in words("name_homographs"):
        return None
    for n in range(1, min(4, len(v) - 1) + 1):
        if 1 <= len(v) - n <= 4 and not (n == 1 and len(v) == 2) and is_surname(v[:n]) and is_given(v[n:]):
            return v[:n], v[n:]
    return None


def match_name(v: str) -> str:
    """full, surname, given or none."""
    v = compose_kana(v.strip())
    if split_full_name(v):
        return "full"
    if len(v) >= 2 and is_surname(v):
        return "surname"
    return "given" if len(v) >= 2 and is_given(v) else "none"


def romaji_forms(word: str) -> set[str]:
    """A Latin name with its long vowels shortened, and ``oh`` for a long o."""
    out = {word}
    for a, b in (("ou", "o"), ("oo", "o"), ("uu", "u"), ("ou", "oh"), ("oo", "oh")):
        out |= {w.replace(a, b) for w in set(out)}
    return out


@lru_cache(maxsize=None)
def romaji(kind: str) -> frozenset[str]:
    return frozenset(f for w in words(f"romaji_{kind}") for f in romaji_forms(w))


# --- places --------------------------------------------------------------------------------------------------
_OLD = str.maketrans("ヶヵ龍澤邊櫻廣國", "ケカ竜沢辺桜広国")


@lru_cache(maxsize=1 << 16)
def plain_place(v: str) -> str:
    return unicodedata.normalize("NFKC", v).translate(_OLD)


@lru_cache(maxsize=None)
def _places(kind: str) -> frozenset[str]:
    return frozenset(map(plain_place, words(kind)))


def municipality_end(v: str) -> int | None:
    """Where the first known municipality in ``v`` ends: any part that ends in 市, 区, 町 or 村."""
    s, known = plain_place(v), _places("municipalities")
    for end in range(1, len(s) + 1):
        if s[end - 1] in "市区町村" and any(s[a:end] in known for a in range(end)):
            return end
    return None


def has_municipality(v: str) -> bool:
    return municipality_end(v) is not None


def municipality_then_town(v: str) -> bool:
    """Whether a known town follows a known municipality."""
    s, known, towns = plain_place(v), _places("municipalities"), _places("towns")
    for end in range(1, len(s) + 1):
        if s[end - 1] in "市区町村" and any(s[a:end] in known for a in range(end)):
            if any(s[end : end + n] in towns for n in range(1, 9)):
                return True
    return False
