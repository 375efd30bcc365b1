"""Words of a text as the leak search counts them."""

from __future__ import annotations

import re
import unicodedata

#: Characters without width that texts may hide in words.
INVISIBLE = "\u00ad\u200b\u200c\u200d\ufeff"

_WORD = re.compile(r"[a-z0-9]+")
_DROP = {ord(c): None for c in INVISIBLE}


def words(text: str | None) -> list[str]:
    """Runs of a-z and 0-9 after NFKC, removal of invisible characters and lower-casing; none for a null."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_DROP)
    return _WORD.findall(text.lower())
