"""Text normalisation as column functions."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import fixed
from ..operators.ranking import top_k_per_group
from .once import computed_once


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def squeeze(c: str | Column) -> Column:
    """Runs of white space become one space; ends trimmed."""
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def _foldings() -> tuple[str, str, dict[str, str]]:
    """Where full case folding is not lower case: single letters, their foldings, and letters that become several."""
    differ = {c: c.casefold() for c in map(chr, range(0x80, 0x110000)) if c.casefold() != c.lower() == c}
    single = {c: f for c, f in differ.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in differ.items() if len(f) > 1}


_FOLD_FROM, _FOLD_TO, _FOLD_MANY = _foldings()
_FOLDED = _FOLD_FROM + "".join(_FOLD_MANY)
#: a class of few parts that holds every letter to fold but the sharp s, which is common and replaced by itself
_MAY_FOLD = "[" + "".join(c for c in _FOLDED if "ß" != c < "\u0250") + "\u0250-\U0010ffff]"


def casefold(c: str | Column) -> Column:
    """Full Unicode case folding in the JVM, so that it can stand inside lambdas as well.

    Lower case is the folding of nearly all rows; only those that hold a letter that folds otherwise go further.
    """
    c = _col(c)
    low = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    single = F.when(F.rlike(low, F.lit(f"[{_FOLD_FROM}]")), F.translate(low, _FOLD_FROM, _FOLD_TO)).otherwise(low)
    several = "".join(_FOLD_MANY)
    tokens = F.regexp_extract_all(single, F.lit(f"[{several}]|[^{several}]+"), 0)
    names = F.from_json(F.lit(json.dumps(_FOLD_MANY)), "map<string,string>")
    many = F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(names, t), t)), "")
    return F.when(is_ascii(c), F.lower(c)).when(~F.rlike(low, F.lit(_MAY_FOLD)), low).when(
        ~F.rlike(low, F.lit(f"[{_FOLDED}]")), low).when(F.rlike(low, F.lit(f"[{several}]")), many).otherwise(single)


def is_ascii(c: str | Column) -> Column:
    return F.octet_length(_col(c)) == F.char_length(_col(c))


def _unsettled() -> str:
    """A class of all letters that NFKC changes, reorders or may join to the one before, and of those without a meaning yet.

    Ranges with few letters between them are one range, but in the blocks that most texts are written in. The class is
    nested, as a letter is held against one range after the other.
    """
    letters = [chr(n) for n in range(0x110000) if not 0xD800 <= n < 0xE000]
    halves = (unicodedata.decomposition(c).split() for c in letters)
    joined = {chr(int(d[1], 16)) for d in halves if len(d) == 2 and d[0][0] != "<"}
    joined |= {chr(n) for n in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}   # vowels and finals of Hangul
    ranges: list[list[int]] = []
    for c in letters:
        if unicodedata.category(c) == "Cn" or unicodedata.combining(c) or c in joined or not unicodedata.is_normalized("NFKC", c):
            n = ord(c)
            gap = 1 if n < 0x600 or 0x2000 <= n < 0x2100 or 0x3000 <= n < 0x3100 else 64
            if ranges and n - ranges[-1][1] <= gap:
                ranges[-1][1] = n
            else:
                ranges.append([n, n])

    def between(a: int, b: int) -> str:
        return f"\\x{{{a:x}}}-\\x{{{b:x}}}"

    parts = [ranges[i:i + 12] for i in range(0, len(ranges), 12)]
    nested = "".join(f"[{between(p[0][0], p[-1][1])}&&[{''.join(between(*r) for r in p)}]]" for p in parts)
    return f"[{between(ranges[0][0], ranges[-1][1])}&&[{nested}]]"


_UNSETTLED = _unsettled()


# one text after the other, sent by the hundred: a task's memory does not grow with its rows
@F.udf(StringType(), useArrow=False)
def _nfkc_casefold(v: str | None) -> str | None:
    return None if v is None else unicodedata.normalize("NFKC", v).casefold()


def folded(c: str | Column) -> Column:
    """NFKC + full case folding.

    Rows without a letter that NFKC changes are folded in the JVM and travel to Python as NULL, so only rows with such
    letters pay for the Unicode tables.
    """
    c = text_or_empty(c)
    plain = is_ascii(c) | ~F.rlike(c, F.lit(_UNSETTLED))
    return F.when(plain, casefold(c)).otherwise(_nfkc_casefold(F.when(~plain, c)))


def normalize_text(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(folded(c), r"(?U)[\s\x1c-\x1f]+", " "))


def normalize_message_id(c: str | Column) -> Column:
    """Case-folded id without white space and without one pair of angle brackets."""
    bare = F.regexp_replace(folded(c), r"(?U)[\s\x1c-\x1f]+", "")
    return F.regexp_replace(bare, "^<|>$", "")


def _words_only(c: Column, keep: str = "") -> Column:
    return F.trim(F.regexp_replace(c, f"[^a-z0-9{keep}]+", " "))


def normalize_company_match(c: str | Column) -> Column:
    """Key used when matching postings."""
    return _words_only(F.lower(F.regexp_replace(text_or_empty(c), fixed.MATCH_COMPANY_WORDS, "")))


def normalize_company_contact(c: str | Column) -> Column:
    """Key used for contacts; an ampersand is part of the name."""
    return _words_only(
        F.regexp_replace(casefold(text_or_empty(c)), fixed.CONTACT_COMPANY_SUFFIX, " "), "&"
    )


def normalize_company_entity(c: str | Column) -> Column:
    """Key of the company table: legal forms are dropped as whole words only."""
    parts = F.split(F.regexp_replace(casefold(text_or_empty(c)), "[^a-z0-9 ]", " "), " +")
    drop = ("",) + fixed.ENTITY_SUFFIXES
    return F.array_join(F.filter(parts, lambda w: ~w.isin(*drop)), " ")


def normalize_alias(c: str | Column) -> Column:
    return _words_only(casefold(text_or_empty(c)))


def normalize_title(c: str | Column) -> Column:
    return _words_only(F.lower(F.regexp_replace(text_or_empty(c), fixed.SENIORITY_WORDS, "")))


# Names that are read without a semicolon as well.
_OPEN_NAMES = tuple(n for n in html5 if not n.endswith(";"))
# Numbers of the C1 range stand for Windows-1252 where that has a character.
_C1 = {str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"


def html_unescape(c: str | Column, open_names: Sequence[str] = _OPEN_NAMES) -> Column:
    """Character references to characters, each read once from left to right, without leaving the JVM.

    ``open_names`` are read without a semicolon as well, by default those of HTML 5; all others need theirs.
    """
    c = _col(c)
    known = {n: v for n, v in html5.items() if n.endswith(";") or n in open_names}
    names = F.from_json(F.lit(json.dumps(known)), "map<string,string>")
    longest_first = "|".join(sorted(open_names, key=len, reverse=True))
    c1 = F.from_json(F.lit(json.dumps(_C1)), "map<string,string>")

    def numbered(token: Column) -> Column:
        digits = F.regexp_replace(F.lower(token), "^&#x?0*|;$", "")
        hexadecimal = F.contains(F.lower(token), F.lit("x"))
        code = F.when(F.length(digits) > 7, F.lit("1114112")).when(digits == "", F.lit("0")).when(
            hexadecimal, F.conv(digits, 16, 10)).otherwise(digits)
        n = code.cast("bigint")
        character = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        dropped = n.between(1, 8) | n.between(14, 31) | (n == 11) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (
            (n % 0x10000) >= 0xFFFE)
        return F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("\ufffd")).when(
            n.between(0x80, 0x9F), F.try_element_at(c1, code)).when(dropped, F.lit("")).otherwise(character)

    def named(token: Column) -> Column:
        name = F.substring(token, 2, 64)
        start = F.regexp_extract(name, f"^(?:{longest_first})", 0)
        return F.coalesce(F.try_element_at(names, name), F.when(start != "", F.concat(
            F.try_element_at(names, start), F.substring(token, F.length(start) + 2, 2 ** 30))), token)

    tokens = F.regexp_extract_all(c, F.lit(f"{_REFERENCE}|[^&]+|&"), 0)
    value = F.array_join(F.transform(tokens, lambda t: F.when(F.rlike(t, F.lit("^&#.")), numbered(t)).when(
        F.rlike(t, F.lit("^&.")), named(t)).otherwise(t)), "")
    return F.when(F.contains(c, F.lit("&")), value).otherwise(c)


def html_unescape_strip(c: str | Column, open_names: Sequence[str] = _OPEN_NAMES) -> Column:
    """References decoded, tags to spaces, white space squeezed."""
    bare = F.regexp_replace(html_unescape(text_or_empty(c), open_names), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"[\s\u00a0]+", " "))


def clean_title(c: str | Column) -> Column:
    """A short role phrase, or '' where the text is prose."""
    v = F.btrim(F.regexp_replace(html_unescape(text_or_empty(c)), r"[\s\u00a0]+", " "),
                F.lit(" .:-"))
    v = F.regexp_replace(v, fixed.TITLE_PREFIX, "")
    v = F.regexp_replace(v, fixed.TITLE_BOUNDARY + r"(?s:.*)$", "")
    v = F.btrim(v, F.lit(" ,.:;|–—-()"))
    prose = (
        (F.length(v) > 100)
        | (F.size(F.split(v, r"\s+")) > 12)
        | F.lower(v).isin(*fixed.TITLE_STOP)
    )
    return F.when(prose, F.lit("")).otherwise(v)


def terms(c: str | Column) -> Column:
    """Distinct words of three or more letters or digits, common words removed."""
    found = F.regexp_extract_all(casefold(text_or_empty(c)), F.lit("([a-z0-9]{3,})"), 1)
    return F.array_except(found, F.array(*[F.lit(t) for t in fixed.STOP_TERMS]))


def all_words(c: str | Column) -> Column:
    return F.regexp_extract_all(casefold(text_or_empty(c)), F.lit("([a-z0-9+#.]{3,})"), 1)


def words(c: str | Column) -> Column:
    """Distinct words; plus, hash and dot belong to a word (c++, c#, node.js)."""
    return F.array_distinct(all_words(c))


def keywords(df: DataFrame, id_col: str, text_col: str, limit: int = 30) -> DataFrame:
    """The ``limit`` most frequent words per document, most frequent first.

    Words are counted with partial aggregation before the shuffle, so a text's size shows up
    as distinct words only.
    """
    counted = (
        df.select(F.col(id_col), F.explode(all_words(text_col)).alias("word"))
        .groupBy(id_col, "word")
        .agg(F.count("*").alias("n"))
    )
    best = top_k_per_group(counted, [id_col], [F.desc("n"), F.asc("word")], limit)
    return best.groupBy(id_col).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]
        ).alias("keywords")
    )


def with_keywords(df: DataFrame, text_col: str, limit: int = 30) -> DataFrame:
    """Adds ``keywords``, the ``limit`` most frequent words of a row's text.

    Words are sorted within the row and counted as runs of equal ones, so no word leaves its row and a task holds one
    text at a time.
    """
    df = computed_once(df, _sorted=F.sort_array(all_words(text_col)))
    df = computed_once(df, _starts=F.filter(F.transform("_sorted", lambda w, i: i), lambda i: (i == 0) | (
        F.get("_sorted", i) != F.get("_sorted", i - 1))))
    runs = F.transform("_starts", lambda at, k: F.struct(
        (at - F.coalesce(F.get("_starts", k + 1), F.size("_sorted"))).alias("n"), F.get("_sorted", at).alias("word")))
    best = F.transform(F.slice(F.sort_array(runs), 1, limit), lambda r: r["word"])
    return computed_once(df, keywords=best).drop("_sorted", "_starts")


def requirement_lines(c: str | Column, limit: int = 20) -> Column:
    lines = F.split(text_or_empty(c), r"\r\n|\n|\r")
    kept = F.filter(lines, lambda line: F.contains(casefold(line), F.lit("require")))
    return F.slice(F.transform(kept, lambda line: F.btrim(line, F.lit(" \t\u000b\u000c"))), 1, limit)


def signature(c: str | Column, lines_kept: int = 6, longest: int = 2000) -> Column:
    """Last six non-blank lines, at most 2000 characters (part of the rule)."""
    lines = F.filter(
        F.transform(F.split(text_or_empty(c), r"\r\n|\n|\r"),
                    lambda line: F.btrim(line, F.lit(" \t\u000b\u000c"))),
        lambda line: line != "",
    )
    tail = F.slice(lines, F.greatest(F.size(lines) - (lines_kept - 1), F.lit(1)), F.lit(lines_kept))
    return F.substring(F.array_join(tail, "\n"), 1, longest)


def parse_address(c: str | Column) -> Column:
    """``Name <address>``, ``address (Name)`` or a bare address as struct(name, address)."""
    c = text_or_empty(c)
    noted = r"^\s*([^\s()<>]+@[^\s()<>]+)\s*\(([^()]*)\)\s*$"
    bracketed = F.contains(c, F.lit("<"))
    name = F.regexp_extract(c, r'^\s*"?([^"<]*?)"?\s*<', 1)
    inner = F.regexp_extract(c, r"<\s*([^<>]*?)\s*>", 1)
    return F.struct(
        F.when(bracketed, F.trim(name)).otherwise(F.trim(F.regexp_extract(c, noted, 2))).alias("name"),
        F.when(bracketed, inner).when(F.rlike(c, F.lit(noted)), F.regexp_extract(c, noted, 1)).otherwise(
            F.trim(c)).alias("address"),
    )


def recipients(to: str | Column, cc: str | Column) -> Column:
    """Lower-case addresses of two headers; what stands in quotes is a name, not an address."""
    joined = F.lower(F.concat_ws(", ", text_or_empty(to), text_or_empty(cc)))
    joined = F.regexp_replace(joined, r'"(?:[^"\\]|\\.)*+"\s*(?=<)', "")
    return F.regexp_extract_all(joined, F.lit(r'([^\s<>,;"]+@[^\s<>,;"]+)'), 1)


def account_reference(c: str | Column) -> Column:
    """A short stable reference that does not disclose the account."""
    return F.substring(F.sha2(F.trim(casefold(text_or_empty(c))), 256), 1, 12)


def redact(c: str | Column, secrets: list[str]) -> Column:
    value = _col(c)
    for secret in secrets:
        if secret:
            value = F.replace(value, F.lit(secret), F.lit("[REDACTED]"))
    return value


def content_hash(c: str | Column) -> Column:
    return F.sha2(_col(c), 256)
