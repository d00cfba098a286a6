"""Texts reduced to plain letters: repair of damaged encodings, markup, look-alikes and invisible characters."""

from __future__ import annotations

import html
import re
import unicodedata

# The printable characters of Windows-1252 at 0x80..0x9f, by byte.
_CP1252 = {0x80 + k: c for k, c in enumerate("€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ")}
_BYTE_OF = {c: b for b, c in _CP1252.items()} | {chr(b): b for b in range(0x80, 0x100)}
_RUN = re.compile("[" + "".join(map(re.escape, _BYTE_OF)) + "]{2,}")
#: Longer tags and scripts count as text, so that a stray "<" doesn't swallow a page.
_TAG = re.compile(r"<[^<>]{0,300}>")
_SCRIPT = re.compile(r"<(script|style)\b[^>]{0,300}>.{0,20000}?</\1>", re.I | re.S)

# Cyrillic and Greek letters drawn like Latin ones.
LOOK_ALIKES = dict(zip("абвгеёзикмнорстухѕіјԁһԛԝӏьαβγεηικνορτυχω", "abbreeзukmhopctyxsijdhqwlbabyenikvoptuxw")) | {"з": "z", "п": "n", "л": "n"}

#: Pieces that count as a word in scripts without spaces: two ideographs or kana, four letters of Thai, Lao, Burmese or Khmer.
UNSPACED = re.compile("[\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]{2}|[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]{4}")
#: Letters from here on have no Latin form.
_FOREIGN, _IDEOGRAPHS = 0x370, (range(0x2E80, 0xA000), range(0xF900, 0xFB00), range(0x20000, 0x40000))


def _foreign(code: int) -> str:
    """A letter without Latin form or look-alike: an ideograph as four letters or digits, which tell all apart, another as one."""
    if any(code in r for r in _IDEOGRAPHS):
        return "".join("abcdefghijklmnopqrstuvwxyz0123456789"[code // 36**k % 36] for k in range(4))
    return chr(97 + code % 26)


def repair(text: str) -> str:
    """UTF-8 that was read as Windows-1252 or Latin-1, where a run of characters allows it; all else is kept."""

    def decode(m: re.Match) -> str:
        try:
            return bytes(_BYTE_OF[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    return text if text.isascii() else _RUN.sub(decode, text)


class _Plain(dict):
    """Translation of a character to lower-case a-z and 0-9 (accents off, widths and look-alikes resolved), or to nothing.

    Letters of other scripts become letters by a fixed rule, so that no text vanishes.
    """

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code)).lower():
            c = LOOK_ALIKES.get(c, c)
            if c.isascii() and c.isalnum():
                out += c
            elif ord(c) >= _FOREIGN and c.isalpha():
                out += _foreign(ord(c))
        self[code] = out
        return out


PLAIN = _Plain({ord("ß"): "ss", ord("ẞ"): "ss", ord("æ"): "ae", ord("œ"): "oe", ord("ø"): "o", ord("ł"): "l", ord("đ"): "d"})


def unmark(text: str) -> str:
    """Entities and tags resolved, encoding repaired."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", _SCRIPT.sub(" ", text))
    return repair(text)


def letters(text: str) -> str:
    """Letters and digits alone, lower case: spacing, punctuation, layout, markup and accents are gone."""
    return unmark(text).translate(PLAIN)
