"""Making texts alike before they are compared: mark-up, decoding, written form, line breaks."""

from __future__ import annotations

import html
import re
import unicodedata

TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]{0,15})(?:\s[^<>]*)?/?>")
COMMENT = re.compile(r"<!--.*?-->", re.S)
# Tags that end a line or a cell; all others stand inside a line.
BLOCK = frozenset("br p div li ul ol td th tr table h1 h2 h3 h4 h5 h6 hr section article pre blockquote".split())
NOTE = re.compile(r"\[\d{1,4}\]")
BROKEN_WORD = re.compile(r"(?<=[^\W\d_])[-‐­][ \t]*\r?\n[ \t>]*(?=[^\W\d_])")
UNSEEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿￹-￻\x00-\x08\x0e-\x1b\x7f]")
# The unseen characters that count as printable, and letters of scripts that hold look-alikes.
FILLER = re.compile("[͏ᅟᅠ឴឵᠋-᠏︀-️]")
FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ]")
# UTF-8 read as Latin-1 or Windows-1252: a lead byte's letter and the letters of its trail bytes.
TRAIL = "\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
MISREAD = re.compile(f"[Â-ß][{TRAIL}]|[à-ï][{TRAIL}]{{2}}|[ð-ô][{TRAIL}]{{3}}")
WORD = re.compile(r"[^\W_]+")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "т": "t", "к": "k", "м": "m", "н": "h", "в": "b", "п": "n", "г": "r",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
_LOOK = str.maketrans(LOOKALIKES)
MIXED = re.compile(r"[^\W\d_]*(?:[A-Za-zÀ-ɏ][Ͱ-ϿЀ-ԯ]|[Ͱ-ϿЀ-ԯ][A-Za-zÀ-ɏ])[^\W\d_]*|(?<![^\W\d_])[аеорсухіАЕО](?![^\W\d_])")


def _read_again(m: re.Match[str]) -> str:
    s = m.group(0)
    try:
        raw = b"".join(bytes([ord(c)]) if ord(c) < 256 else c.encode("cp1252") for c in s)
        return raw.decode("utf-8")
    except (UnicodeDecodeError, UnicodeEncodeError):
        return s


def _tag(m: re.Match[str]) -> str:
    return "\n" if m.group(2).lower() in BLOCK else ""


def clean(text: str) -> str:
    """The text without mark-up and notes, rightly decoded, in compatibility form, its words whole."""
    if "<" in text:
        text = TAG.sub(_tag, COMMENT.sub("", text))
    if "&" in text:
        text = html.unescape(text)
        if "<" in text:
            text = TAG.sub(_tag, text)
    plain = text.isascii()
    if not plain:
        text = unicodedata.normalize("NFKC", MISREAD.sub(_read_again, text))
    if "\n" in text and ("-" in text or not plain):
        text = BROKEN_WORD.sub("", text)
    # Most texts hold no unseen character; a printable text surely has none.
    if not text.replace("\n", " ").replace("\t", " ").isprintable():
        text = UNSEEN.sub("", text)
    elif not plain and FILLER.search(text):
        text = UNSEEN.sub("", text)
    if not plain:
        text = MIXED.sub(lambda m: m.group(0).translate(_LOOK), text) if FOREIGN.search(text) else text
    return NOTE.sub("", text) if "[" in text else text


def plain_words(text: str) -> list[str]:
    """Words for comparison: clean, case-folded, without accents and punctuation."""
    text = clean(text).casefold()
    if not text.isascii():
        text = unicodedata.normalize("NFD", text)
        text = "".join(c for c in text if not unicodedata.combining(c))
    return WORD.findall(text)
