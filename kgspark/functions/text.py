"""Text rules as Catalyst expressions. Only HTML unescaping needs a Python batch."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P

SEP = "<SEP>"

# --- fixed values: marker words of the query router ---------------------------------------
COMPARE_WORDS = (
    "比较", "区别", "相比", "对比", "为什么", "如何影响",
    "导致", "因果", "关系", "跨文档", "以及",
)
VAGUE_WORDS = ("这个", "那个", "怎么办", "怎样", "相关内容", "大概", "有没有什么")
CONCEPT_WORDS = ("原理", "概念", "机制", "是什么意思", "如何理解")
ANAPHORA_WORDS = ("它", "他", "她", "这个", "那个", "上述", "刚才", "上面", "前面")
NAME_WORDS = ("是谁", "叫什么", "姓名", "工号")
GRAPH_WORDS = (
    "为什么", "如何影响", "导致", "因果", "关系", "比较", "区别", "相比", "跨文档",
)
SUBQUESTION_SPLIT = "[和与及、]|以及|相比|比较"
DIRECT_FACTS = " 的直接事实"
RELATED_EFFECTS = " 的关系或影响"
MAX_SUBQUESTIONS = 4
REDACTED_EMAIL, REDACTED_PHONE, REDACTED_ID = "[邮箱]", "[手机号]", "[证件号]"
# --- end of fixed values ------------------------------------------------------------------


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column) -> Column:
    """Drop Unicode white space at both ends."""
    return F.btrim(col, F.lit(P.SPACE_CHARS))


def squash(col: Column) -> Column:
    """Trim and reduce every run of white space to one blank."""
    return strip(F.regexp_replace(col, f"{P.WS}+", " "))


def clip(col: Column, limit: int = 500) -> Column:
    text = squash(F.coalesce(col, F.lit("")))
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit), F.lit("…"))
    )


def summary(col: Column, limit: int = 250) -> Column:
    text = strip(col)
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit), F.lit("..."))
    )


def contains_any(col: Column, words) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | col.contains(word)
    return found


def _bigrams(run: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))),
        lambda i: run.substr(i, F.lit(2)),
    )


def tokens(col: Column) -> Column:
    """Search tokens: lower-cased Latin words and bigrams of Han runs."""
    lowered = F.lower(F.coalesce(col, F.lit("")))
    runs = F.regexp_extract_all(lowered, F.lit(P.TOKEN_RUN), F.lit(0))
    mixed = F.flatten(
        F.transform(
            runs,
            lambda r: F.when(r.rlike("^[a-z0-9_]"), F.array(r)).otherwise(
                _bigrams(F.regexp_replace(r, r"[^\x{4e00}-\x{9fff}]", ""))
            ),
        )
    )
    return F.when(lowered.rlike(P.CJK), mixed).otherwise(runs)


def token_count(col: Column) -> Column:
    """Han characters plus Latin words; 1 when only other visible text is there."""
    text = F.coalesce(col, F.lit(""))
    units = F.regexp_count(text, F.lit(f"{P.CJK}|{P.LATIN_WORD}"))
    return F.when(units > 0, units).when(text.rlike(P.NOT_WS), 1).otherwise(0)


def spaced_words(col: Column) -> Column:
    """Window tokens: each word keeps the white space before it, so joining restores the text."""
    return F.regexp_extract_all(col, F.lit(P.SPACED_WORD), F.lit(0))


def split_markers(col: Column, pattern: str) -> Column:
    """Split at any marker, trim the parts and drop the empty ones."""
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), pattern, -1), strip)
    return F.filter(parts, lambda p: p != "")


def split_values(col: Column) -> Column:
    """Distinct values of a separator-joined string, first occurrence first."""
    return F.array_distinct(split_markers(col, SEP))


def relation_labels(col: Column) -> Column:
    text = F.replace(F.coalesce(col, F.lit("")), F.lit(SEP), F.lit("；"))
    parts = F.transform(F.split(text, "[；;，,]", -1), squash)
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


@F.pandas_udf(T.StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else html.unescape(v))


def unescape_html(col: Column) -> Column:
    """HTML entities to characters; rows without '&' send no text to Python."""
    return F.coalesce(_unescape(F.when(col.contains("&"), col)), col)


def sanitize(col: Column, escapes: bool = True) -> Column:
    """Trim, drop control and non-characters, unescape HTML.

    ``escapes=False`` leaves out the Python step for text known to hold no entities.
    """
    text = F.regexp_replace(strip(col), r"[\x{fffe}\x{ffff}]", "")
    text = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    if escapes:
        text = unescape_html(text)
    return strip(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", ""))


_FULL_WIDTH = "".join(chr(c) for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), *range(0xFF10, 0xFF1A)))
_HALF_WIDTH = "".join(chr(ord(c) - 0xFEE0) for c in _FULL_WIDTH)
# Symbols replaced one by one, and what may touch Han text without a blank.
_SYMBOLS = ("－＋／＊（）—　", "-+/*()- ")
_ATTACHED = r"[a-zA-Z0-9()\[\]@#$%!&*\-=+_]"


def normalize_name(col: Column, inner_quotes: bool = False) -> Column:
    """Canonical spelling of an extracted name; '' marks a name to drop."""
    t = F.regexp_replace(col, rf"(?i)</p{P.WS}*>|<p{P.WS}*>|<p/>", "")
    t = F.regexp_replace(t, rf"(?i)</br{P.WS}*>|<br{P.WS}*>|<br/>", "")
    t = F.translate(t, _FULL_WIDTH + _SYMBOLS[0], _HALF_WIDTH + _SYMBOLS[1])
    gap = f"{P.WS}+"
    here = f"(?={P.WS})"  # cheap first test
    t = F.regexp_replace(t, f"{here}(?<={P.HAN}){gap}(?={P.HAN})", "")
    t = F.regexp_replace(t, f"{here}(?<={P.HAN}){gap}(?={_ATTACHED})", "")
    t = F.regexp_replace(t, f"{here}(?<={_ATTACHED}){gap}(?={P.HAN})", "")
    # A lone quote inside double quotes goes with them.
    t = F.regexp_replace(t, "^\"'\"$", "")
    for quoted in ('^"([^"]*)"$', "^'([^']*)'$", "^“([^“”]*)”$", "^‘([^‘’]*)’$", "^《([^《》]*)》$"):
        t = F.regexp_replace(t, quoted, "$1")
    if inner_quotes:
        t = F.translate(t, "“”‘’", "")
        t = F.regexp_replace(t, rf"['\"]+(?={P.HAN})|(?<={P.HAN})['\"]+", "")
        t = F.regexp_replace(t, r"\x{a0}", " ")
        t = F.regexp_replace(t, r"(?<=[^\p{Nd}])\x{202f}", " ")
    return _drop_numbers(strip(t))


def _drop_numbers(name: Column) -> Column:
    """One or two digits, or up to five digits and dots, are no name."""
    return F.regexp_replace(name, r"^[0-9]{1,2}$|^(?=[\p{Nd}.]{1,5}$)\p{Nd}*\.[\p{Nd}.]*$", "")


def clean_name(col: Column, inner_quotes: bool = True) -> Column:
    """Name or description from sanitised text; HTML entities are already characters."""

    def cleaned(c):
        # Printable ASCII without tags and quotes has nothing to normalise, and numbers to drop are short.
        plain = bind(strip(c), lambda t: F.when(F.length(t) <= 5, _drop_numbers(t)).otherwise(t))
        return F.when(c.rlike("[^ -~]|[<\"']"), normalize_name(sanitize(c, escapes=False), inner_quotes)).otherwise(plain)

    # Inside a lambda: written out for every row, the rules make a method that the JVM does not compile.
    return bind(col, cleaned)


def fields_of_lines(text: Column) -> Column:
    """The fields of every line of a text with whole delimiters, without HTML entities."""
    return F.transform(F.filter(F.split(text, "\n", -1), lambda r: r != ""), lambda r: split_markers(r, re.escape(P.DELIMITER)))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def unescaped_fields_of_lines(texts: pd.Series) -> pd.Series:
    """``fields_of_lines`` with HTML entities as characters; NULL for NULL."""

    def read(line):
        return [html.unescape(f) for f in map(str.strip, line.split(P.DELIMITER)) if f]

    return texts.map(lambda t: None if t is None else [read(line) for line in t.split("\n") if line])


def computed_once(df, keep: list[str], **columns: Column):
    """Project ``columns`` behind a generator, so that later filters do not evaluate them again."""
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))


def repair_delimiters(col: Column) -> Column:
    """Undo delimiter damage. Records whose pipes and cores all sit in whole delimiters are skipped."""
    rest = F.replace(col, F.lit(P.DELIMITER), F.lit(""))
    fixed = col
    for damage in P.DELIMITER_DAMAGE:
        fixed = F.regexp_replace(fixed, damage, P.DELIMITER)
    return F.when(rest.rlike("[|#]"), fixed).otherwise(col)


def repair_lines(col: Column) -> Column:
    """``repair_delimiters`` for every line of a text, in one pass over all lines.

    In a line that is whole the patterns find nothing but whole delimiters; only one behind another ``<``
    could be taken for damage of a line next to it, so such a text is repaired line by line.
    """
    fixed = col
    for damage in P.DELIMITER_DAMAGE:
        fixed = F.regexp_replace(fixed, damage.replace("[^|]", r"[^|\n]"), P.DELIMITER)
    each = F.array_join(F.transform(F.split(col, "\n", -1), repair_delimiters), "\n")
    whole = ~F.replace(col, F.lit(P.DELIMITER), F.lit("")).rlike("[|#]")
    return F.when(whole, col).when(F.contains(col, F.lit("<" + P.DELIMITER)), each).otherwise(fixed)


def redact(col: Column) -> Column:
    """Mask e-mail, phone and id numbers, in this order: each step sees the result before it."""
    text = F.regexp_replace(F.coalesce(col, F.lit("")), P.EMAIL, REDACTED_EMAIL)
    text = F.regexp_replace(text, P.PHONE, REDACTED_PHONE)
    return F.regexp_replace(text, P.ID_NUMBER, REDACTED_ID)


def drop_think(col: Column) -> Column:
    """Drop a leading think block, else everything up to the last stray closing tag."""
    return strip(F.regexp_replace(col, r"(?s)^(?:<think>.*?</think>|.*</think>)", ""))


def html_to_text(col: Column) -> Column:
    text = F.regexp_replace(col, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.regexp_replace(text, r"(?s)<[^>]+>", "\n")


def embedded_json(col: Column, schema: str) -> Column:
    """Parse the outermost {...} of a model reply; NULL when there is none or it is broken."""
    text = strip(F.regexp_replace(F.coalesce(col, F.lit("")), r"(?s)<think>.*?</think>", ""))
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.from_json(F.when(body != "", body), schema)


def numerals_changed(left: Column, right: Column) -> Column:
    def seen(c):
        found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(P.NUMERAL), F.lit(0))
        return F.array_sort(F.array_distinct(found))

    return seen(left) != seen(right)


def query_route(col: Column) -> Column:
    text = squash(F.coalesce(col, F.lit("")))
    named = contains_any(text, NAME_WORDS) & text.rlike(f"{P.CJK}{{2,4}}")
    return (
        F.when(text.rlike(P.EXACT_QUERY) | named, "exact")
        .when(contains_any(text, COMPARE_WORDS), "subquestions")
        .when(contains_any(text, VAGUE_WORDS) & ~contains_any(text, CONCEPT_WORDS), "rewrite")
        .otherwise("factual")
    )


def needs_graph(col: Column) -> Column:
    return (query_route(col) == "subquestions") | contains_any(col, GRAPH_WORDS)


def first_unique(items: Column, limit: int) -> Column:
    """Clean, drop empties and repeats, keep the order and at most ``limit`` items."""
    cleaned = F.filter(F.transform(items, squash), lambda x: x != "")
    return F.slice(F.array_distinct(cleaned), 1, limit)


def subquestions(col: Column) -> Column:
    parts = split_markers(col, SUBQUESTION_SPLIT)
    pair = F.array(F.concat(col, F.lit(DIRECT_FACTS)), F.concat(col, F.lit(RELATED_EFFECTS)))
    return first_unique(F.when(F.size(parts) >= 2, parts).otherwise(pair), MAX_SUBQUESTIONS)


def standalone_query(query: Column, topic: Column) -> Column:
    """Prefix the last topic of the conversation when the query points back at it."""
    text, about = squash(query), squash(F.coalesce(topic, F.lit("")))
    points_back = contains_any(text, ANAPHORA_WORDS) & (about != "") & ~F.contains(text, about)
    return F.when(points_back, squash(F.concat(about, F.lit("。"), text))).otherwise(text)
