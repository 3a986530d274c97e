"""Bytes to text: UTF-16, ISO-2022-JP, Shift_JIS and EUC-JP by their signs, and escapes inside texts.

The functions work on one value; :mod:`shirabe.sources.files` runs them over Arrow batches.
"""

from __future__ import annotations

import re

SNIFF = 8192
#: Characters of the scripts Hiragana, Katakana and Han.
_JA = re.compile("[ぁ-ゖゝ-ゟァ-ヺヽ-ヿㇰ-ㇿ㐀-䶿一-鿿豈-\ufaff々〇〻ｦ-ｯｱ-ﾝ]")
#: What the codec makes of single bytes that Shift_JIS doesn't have.
_STRAY = re.compile("[\x80\uf8f0-\uf8f3\ufffd]")


def utf16_by_mark(raw: bytes) -> str | None:
    """Text after a byte order mark; None without one, or if what follows is no UTF-16."""
    name = {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}.get(raw[:2])
    try:
        return raw[2:].decode(name) if name else None
    except UnicodeDecodeError:
        return None


def iso_2022_jp(raw: bytes) -> str | None:
    if not raw.isascii() or (b"\x1b$" not in raw and b"\x1b(" not in raw):
        return None
    try:
        return raw.decode("iso2022_jp")
    except UnicodeDecodeError:
        return None


def utf16_by_zeros(raw: bytes) -> str | None:
    """Text without a mark, if over 30 % of the bytes on one side of the pairs at its head are zero."""
    head = raw[:SNIFF]
    if len(raw) < 8 or len(raw) % 2 or b"\0" not in head:
        return None
    half = len(head) // 2
    for zeros, name in ((head[1::2].count(0), "utf-16-le"), (head[0::2].count(0), "utf-16-be")):
        if zeros > 0.3 * half:
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                continue
    return None


def legacy_japanese(raw: bytes) -> str | None:
    """Shift_JIS or EUC-JP, whichever gives more Japanese characters (Shift_JIS if as many)."""
    best, most = None, 0
    for name in ("cp932", "euc_jp"):
        try:
            text = raw.decode(name)
        except UnicodeDecodeError:
            continue
        n = len(_JA.findall(text))
        if n > most and not _STRAY.search(text):
            best, most = text, n
    return best


def decode(raw: bytes | None) -> str | None:
    """The text of a file's bytes, or None for what isn't text."""
    if raw is None:
        return None
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return utf16_by_mark(raw)
    text = iso_2022_jp(raw)
    if text is not None:
        return text
    if b"\0" in raw[:SNIFF]:
        return utf16_by_zeros(raw)
    try:
        return raw.decode("utf-8").removeprefix("﻿")
    except UnicodeDecodeError:
        return legacy_japanese(raw)


# --- escapes -------------------------------------------------------------------------------------------------
_JSON = re.compile(r"(\\+)u([0-9a-fA-F]{4})(?:\\u([0-9a-fA-F]{4}))?")


def json_escapes(s: str) -> str:
    """``\\uXXXX`` after an odd run of backslashes; pairs of surrogates are joined, lone ones and control
    characters stay."""
    if "\\u" not in s:
        return s
    out, at = [], 0
    for m in re.finditer(r"(\\+)u([0-9a-fA-F]{4})", s):
        if m.start() < at or len(m[1]) % 2 == 0:
            continue
        c, end = int(m[2], 16), m.end()
        if 0xD800 <= c < 0xDC00:
            low = re.match(r"\\u([dD][c-fC-F][0-9a-fA-F]{2})", s[end:])
            if not low:
                continue
            c, end = 0x10000 + ((c - 0xD800) << 10) + int(low[1], 16) - 0xDC00, end + 6
        elif 0xDC00 <= c < 0xE000:
            continue
        if c < 0x20 or 0x7F <= c < 0xA0:
            continue
        out += [s[at : m.end() - 6], chr(c)]
        at = end
    return "".join(out) + s[at:]


def html_numbers(s: str) -> str:
    """``&#d;`` and ``&#xh;``; surrogates, control characters and what is too large stay."""

    def one(m):
        c = int(m[1], 16) if m[1] else int(m[2])
        return chr(c) if 0x20 <= c < 0x110000 and not 0x7F <= c < 0xA0 and not 0xD800 <= c < 0xE000 else m[0]

    return re.sub("&#(?:[xX]([0-9a-fA-F]{1,6})|([0-9]{1,7}));", one, s) if "&#" in s else s


def percent_runs(s: str) -> str:
    """Runs of two or more ``%XX`` that are UTF-8 with a character beyond ASCII and no control character."""

    def one(m):
        try:
            t = bytes.fromhex(m[0].replace("%", "")).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]
        return m[0] if t.isascii() or any(ord(c) < 0x20 or 0x7F <= ord(c) < 0xA0 for c in t) else t

    return re.sub("(?:%[0-9a-fA-F]{2}){2,}", one, s) if "%" in s else s


def unescape(s: str | None) -> str | None:
    """The view of a text in which its escapes are read, each kind once; line numbers stay."""
    return None if s is None else percent_runs(html_numbers(json_escapes(s)))
