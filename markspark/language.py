"""Fixed values of the text-mark rules: letters, marks, labels and word lists.

A `MarkProfile` holds everything that is specific to one language, so column functions and
operators take a profile instead of naming letters themselves.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values (they must equal the published rules) ---------------------------------------

PAD_ID = 0
UNK_ID = 1
FIRST_CHAR_ID = 2

LABEL_NONE = 0
LABEL_BREVE_COMMA = 1
LABEL_CIRCUMFLEX = 2
LABEL_NAMES = ("none", "breve_comma", "circumflex")

LINES_PER_DOCUMENT = 50
EVAL_DOCUMENTS = 500
MAX_CHARS = 20_000
QUANT_GROUP = 32

REPORT_PUNCTUATION = ".,;:!?\"'()„”«»"

# Unicode white space as `str.split()` sees it, and line breaks as `str.splitlines()` does.
WHITESPACE = r"[\s\x1c-\x1f]"  # with (?U), which makes \s mean Unicode white space
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# Letters without digits and underscore; letters, digits and underscore.
LETTER_RUN = r"[\p{L}\p{Nl}\p{No}]+"
WORD_RUN = r"[\p{L}\p{N}_]+"

ALWAYS_MARKED_RO = (
    "și", "dacă", "fără", "după", "așa", "când", "într", "dintr", "niște", "către",
    "decât", "același", "aceeași", "încât", "fiindcă",
)


@dataclass(frozen=True)
class MarkProfile:
    """Letters of one language. The default is Romanian."""

    legacy: str = "şţŞŢ"
    """Old code points ..."""
    legacy_fixed: str = "șțȘȚ"
    """... and, position by position, the letters that replace them."""
    breve_comma: str = "ășțĂȘȚ"
    breve_comma_base: str = "astAST"
    circumflex: str = "âîÂÎ"
    circumflex_base: str = "aiAI"
    candidates: str = "aistAIST"
    min_marked: tuple[tuple[str, str, float], ...] = (
        ("a", "ă", 0.03),
        ("s", "ș", 0.03),
        ("t", "ț", 0.02),
    )
    """(plain letter, marked form, least share of that letter that carries the mark)."""
    always_marked: tuple[str, ...] = ALWAYS_MARKED_RO
    max_bare_share: float = 0.05
    base_of: dict[str, str] = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        pairs = zip(self.marked, self.marked_base, strict=True)
        object.__setattr__(self, "base_of", dict(pairs))

    @property
    def marked(self) -> str:
        return self.breve_comma + self.circumflex

    @property
    def marked_base(self) -> str:
        return self.breve_comma_base + self.circumflex_base

    @property
    def bare_words(self) -> tuple[str, ...]:
        """The always-marked words without marks. A listed word that has no mark at all
        is in both lists and counts on both sides."""
        return tuple("".join(self.base_of.get(c, c) for c in w) for w in self.always_marked)


ROMANIAN = MarkProfile()
