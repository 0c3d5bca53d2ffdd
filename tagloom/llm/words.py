"""Texts as comparable words."""

from __future__ import annotations

import re
import unicodedata

#: Characters that show nothing: soft hyphen, zero-width ones, byte order mark (fixed values).
_INVISIBLE = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]+")
_DASHES = re.compile("[\u2010-\u2014\u2212]")
#: Numbers in brackets: reference signs and paragraph numbers.
_BRACKETED = re.compile(r"[(\[]\s*[0-9]+\s*[)\]]")
_BROKEN = re.compile(r"(?<=[^\W\d_])-\s*[\r\n\f]+\s*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_ACCENTS = re.compile("[̀-ͯ]+")


def plain(text: str | None) -> str:
    """Compatibility forms, accents, case and invisible characters made one; words broken
    at the end of a line joined; bracketed numbers left out."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text))
        text = _DASHES.sub("-", _ACCENTS.sub("", text))
    text = text.casefold()
    if "-" in text:
        text = _BROKEN.sub("", text)
    return _BRACKETED.sub(" ", text)


def words(text: str | None) -> list[str]:
    return _WORD.findall(plain(text))
