"""Lexical rules shared by written tags and query atoms.

One token is either *bare* (ASCII letters, digits, ``_ + -``, and ``.`` from the
second character on) or *quoted* (``"…"`` where ``""`` stands for one quote).
Quoting is spelling only: the decoded text is the token's value.

The patterns are written so that Python's ``re`` and Java's regex engine read them
alike; all repetitions are possessive, because the plain form recurses once per
character in the JVM and overflows its stack on long quoted values.
"""

from __future__ import annotations

import re

from tagloom.model import TagSyntaxError

#: Unicode White_Space as the body of a character class (fixed values).
WHITE_SPACE = "\\t-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

QUOTED = '"[^"]*+(?:""[^"]*+)*+"'
BARE = "[A-Za-z0-9_+-][A-Za-z0-9_.+-]*+"
TOKEN = f"(?:{QUOTED}|{BARE})"

#: ``ns:key=value`` with groups ns, key, value. A lone ``+`` is refused by the caller
#: in Python and by the lookahead in :data:`TAG_PATTERN_JVM`.
TAG_PATTERN = f"(?:({TOKEN}):)?({TOKEN})(?:=({TOKEN}))?"
_STRICT = f"(?:{QUOTED}|(?!\\+(?:[:=]|\\z)){BARE})"
TAG_PATTERN_JVM = f"\\A(?:({_STRICT}):)?({_STRICT})(?:=({_STRICT}))?\\z"

#: One field of a line: a run of quoted spans and characters that aren't white space.
FIELD_PATTERN = f'(?:{QUOTED}|[^"{WHITE_SPACE}]++)++'

_FIELD = re.compile(FIELD_PATTERN)
_SEGMENT = re.compile(f'(?:{QUOTED}|[^"/]++)*+')
_INFIX = re.compile(f'[()]|(?:{QUOTED}|[^"(){WHITE_SPACE}]++)++')


_BARE = re.compile(BARE)


def is_token(text: str) -> bool:
    """Whether a text is a bare token as it stands, so that it needs no quotes."""
    return text != "+" and _BARE.fullmatch(text) is not None


def decode(token: str) -> str:
    """The value a token stands for: quotes stripped and undoubled."""
    return token[1:-1].replace('""', '"') if token.startswith('"') else token


def _need_closed_quotes(text: str) -> None:
    # Quotes only ever pair up, so an odd number is exactly the unterminated case.
    if text.count('"') % 2:
        raise TagSyntaxError(f"unterminated quote in {text!r}")


def split_fields(line: str) -> list[str]:
    """Split at unquoted Unicode white space."""
    _need_closed_quotes(line)
    return _FIELD.findall(line)


def split_infix(text: str) -> list[str]:
    """Parentheses and atoms of an infix query, quoted spans kept whole."""
    _need_closed_quotes(text)
    return _INFIX.findall(text)


def split_postfix(text: str) -> list[str]:
    """Segments between unquoted slashes; nothing is trimmed."""
    _need_closed_quotes(text)
    out, at = [], 0
    while True:
        end = _SEGMENT.match(text, at).end()
        out.append(text[at:end])
        if end >= len(text):
            return out
        at = end + 1
