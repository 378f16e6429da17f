"""Words of texts as bytes: runs of letters, digits and what is no ASCII, A-Z like a-z."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Word bytes as they are, A-Z as a-z, all other ASCII a space.
_AS_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def words(text: bytes) -> list[bytes]:
    return text.translate(_AS_WORDS).split()


def pieces(text: bytes, size: int) -> Iterator[bytes]:
    """The text cut between words into pieces of about size bytes; a longer word stays whole."""
    at = 0
    while len(text) - at > size:
        gap = _GAP.search(text, at + size)
        if not gap:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]
