"""Regular expressions of the text rules.

The module's own constants are for Spark (Java regular expressions). ``SQL`` holds the same
patterns in the plainer syntax that other engines read.
"""

from types import SimpleNamespace

# Characters that Unicode text processing treats as white space.
_SPACES = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE_CHARS = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)
# Printable ASCII is decided by the first test of the class.
WS = f"[[^!-~]&&[{_SPACES}]]"
NOT_WS = f"[!-~[^{_SPACES}]]"

CJK = r"[\x{4e00}-\x{9fff}]"
HAN = r"[\x{4e00}-\x{9fa5}]"

# One run of Han characters may be interrupted by anything but a Latin word.
TOKEN_RUN = rf"[a-z0-9_]+|{CJK}(?:[^a-z0-9_\x{{4e00}}-\x{{9fff}}]*{CJK})*"
LATIN_WORD = r"[A-Za-z0-9_]+"


def _spaced_word(ws: str, not_ws: str) -> str:
    """A window token: one word together with the white space before it."""
    return f"{ws}*{not_ws}+"


def _piece(not_ws: str) -> str:
    """A Latin word or any other single visible character."""
    return f"{LATIN_WORD}|{not_ws}"


SPACED_WORD = _spaced_word(WS, NOT_WS)
PIECE = _piece(NOT_WS)

# --- fixed values: patterns that decide results -------------------------------------------
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}"
PHONE = r"1[3-9]\p{Nd}{9}"
ID_NUMBER = r"\p{Nd}{17}[\p{Nd}Xx]"
ARTICLE = "第[0-9０-９一二三四五六七八九十百千零〇两]+条"
STRUCTURE = r"第[0-9０-９一二三四五六七八九十百千零〇两]+([编篇章节])[^\n]*"
HEADING = r"(?m)^(#{1,6})[ \t]+(.+?)[ \t]*$"
NUMERAL = r"[0-9]+(?:\.[0-9]+)?"
_EXACT_QUERY = (
    r"(?i)(\.pdf|\.docx|\.pptx|\.xlsx|\.txt|\.md|HT-\p{Nd}|ZD-\p{Nd}|INV-|JW-|AP-|POL-|"
    r"\p{Nd}{4}%s*年|\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}|[A-Za-z]{1,8}-?\p{Nd}{2,}[A-Za-z0-9-]*)"
)
EXACT_QUERY = _EXACT_QUERY % WS
# Delimiter damage, in the order in which it has to be undone (core "#").
DELIMITER = "<|#|>"
DELIMITER_DAMAGE = (
    r"<\|#\|*?#\|>",
    r"<\|\\#\|>",
    r"<\|+>",
    r"<.?\|#\|*?>",
    r"<\|?#\|?>",
    r"<[^|]#\|>|<\|#[^|]>",
    r"<\|#\|+(?!>)",
    r"<\|#:(?!>)",
    r"<\|\|(?!>)",
    r"(?<!<)\|#\|>",
    r"<\|#\|>\|",
    r"\|\|#\|\|",
)
# --- end of fixed values ------------------------------------------------------------------

_ws, _not_ws = f"[{_SPACES}]", f"[^{_SPACES}]"
SQL = SimpleNamespace(
    WS=_ws, NOT_WS=_not_ws, EDGE_WS=f"^{_ws}+|{_ws}+$", CJK=CJK, HAN=HAN, TOKEN_RUN=TOKEN_RUN,
    LATIN_WORD=LATIN_WORD, SPACED_WORD=_spaced_word(_ws, _not_ws), PIECE=_piece(_not_ws), EMAIL=EMAIL,
    PHONE=PHONE, ID_NUMBER=ID_NUMBER, ARTICLE=ARTICLE, HEADING=HEADING, EXACT_QUERY=_EXACT_QUERY % _ws,
)
