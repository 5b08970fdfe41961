"""Terms of a text: maximal runs of A-Z, a-z, 0-9 and all characters beyond ASCII; A-Z as a-z."""

from __future__ import annotations

from collections.abc import Iterator

PIECE_BYTES = 1 << 20
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_FOLDED = bytes(
    b if b >= 0x80 or b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def term_pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, in lists from about `size` bytes each. No term is cut."""
    folded = text.translate(_FOLDED)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + size) if len(folded) - at > size else -1
        end = len(folded) if end < 0 else end
        terms = folded[at:end].split()
        if terms:
            yield terms
        at = end
