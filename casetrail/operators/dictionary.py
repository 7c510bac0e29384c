"""Finding known companies in running text by the phrases that may be names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import extract as X
from ..functions.once import computed_once
from ..functions.text import casefold, text_or_empty
from ..session import write_through

_WORD = r"([\p{L}\p{N}]+)"
_PLACES = 1 << 18   # places of the two fixed-size tables that say which words and phrases may belong to a name


def company_vocabulary(jobs: DataFrame, only_valid: bool = True) -> DataFrame:
    """Distinct company names fit for recognition in text."""
    name = F.trim(text_or_empty("company"))
    fit = X.valid_company(name) if only_valid else (
        (F.length(name) >= 3) & ~name.rlike(fixed.GENERIC_COMPANY_PATTERN)
        & ~casefold(name).isin(*fixed.MEETING_PLATFORMS))
    return jobs.where(fit).select(name.alias("company")).distinct()


def _context(patterns: tuple[str, ...], name: Column) -> Column:
    """Regular expression with the quoted name in each pattern's place."""
    parts: list[Column] = [F.lit("(?U)")]
    for i, pattern in enumerate(patterns):
        before, after = pattern.split("NAME")
        parts += [F.lit(("|" if i else "") + before + r"\Q"), name, F.lit(r"\E" + after)]
    return F.concat(*parts)


_TEXT_CONTEXT = (fixed.TEXT_CONTEXT_BEFORE, fixed.TEXT_CONTEXT_AFTER)
_SUMMARY_CONTEXT = (fixed.SUMMARY_CONTEXT_AFTER, fixed.SUMMARY_CONTEXT_BEFORE)
_BOUNDED = (r"(?<![\p{L}\p{N}])NAME(?![\p{L}\p{N}])",)


def _place(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(_PLACES)).cast("int")


def _places(names: DataFrame, column: str) -> Column:
    """A byte for each place of the hash: 1 where some value of the column falls. At most ``_PLACES`` numbers are read."""
    held = bytearray(_PLACES)
    for row in names.select(_place(F.col(column))).distinct().collect():
        held[row[0]] = 1
    return F.lit(bytes(held))


def _may_be(c: Column, places: Column) -> Column:
    return F.substring(places, _place(c) + 1, F.lit(1)) == F.lit(b"\x01")


def company_in_text(
    messages: DataFrame, companies: DataFrame, text: Column, key: str = "message_identity",
    context: tuple[str, ...] = _TEXT_CONTEXT,
) -> DataFrame:
    """(key, company): the longest known name that stands in the text as a bounded phrase and in
    context ("at X", "X ... role").

    A text is cut into words once. Two tables of ``_PLACES`` bytes, whatever the dictionary, hold the hashes of first words
    and of whole names: only where a word may start a name are phrases of the lengths of names cut, and only phrases that
    may be names leave the row. What leaves is joined on the phrase (one row per name), so that no hash decides. Texts with
    a hit are read again to check the context.
    """
    folded = computed_once(messages.select(key, text_or_empty(text).alias("_t")),
                           _folded=casefold("_t")).drop("_t")
    names = companies.select("company", casefold("company").alias("_name")).withColumn(
        "_words", F.regexp_extract_all("_name", F.lit(_WORD), 1)).where(F.size("_words") > 0).select(
        "company", "_name", F.array_join("_words", " ").alias("_phrase"), F.get("_words", F.lit(0)).alias("_first"),
        F.size("_words").alias("_n"))
    # a written table has a known size: Spark broadcasts it while it is small and shuffles the phrases otherwise
    names = write_through(names, "dictionary")
    lengths = sorted(r[0] for r in names.select("_n").distinct().collect())   # a few: the words of a name
    starts, wholes = _places(names, "_first"), _places(names, "_phrase")
    words = computed_once(folded, _w=F.regexp_extract_all("_folded", F.lit(_WORD), 1)).select(key, "_w")

    def phrases_at(i: Column) -> Column:
        cut = F.transform(F.array(*map(F.lit, lengths)), lambda n: F.when(
            i + n - 1 <= F.size("_w"), F.array_join(F.slice("_w", i, n), " ")))
        return F.filter(cut, lambda p: p.isNotNull() & _may_be(p, wholes))

    places = F.filter(F.sequence(F.lit(1), F.size("_w")), lambda i: _may_be(F.get("_w", i - 1), starts))
    found = F.array_distinct(F.flatten(F.transform(places, phrases_at)))
    phrases = words.where(F.size("_w") > 0).select(key, F.explode(found).alias("_phrase"))
    hits = phrases.join(names.select("_phrase", "company", "_name"), "_phrase")
    # the names in one text are bounded by its words
    per_text = hits.groupBy(key).agg(
        F.collect_set(F.struct("company", "_name")).alias("_names"))

    def fits(n: Column) -> Column:
        return F.rlike(F.col("_folded"), _context(_BOUNDED, n["_name"])) & F.rlike(
            F.col("_folded"), _context(context, n["_name"]))

    kept = F.filter("_names", fits)
    ranked = F.array_sort(F.transform(kept, lambda n: F.struct(
        (-F.length(n["company"])).alias("l"), n["company"].alias("c"))))
    return per_text.join(folded, key).select(
        key, F.get(ranked, F.lit(0))["c"].alias("company")).where("company IS NOT NULL")


def _candidate(c: Column) -> Column:
    v = F.regexp_replace(c, r"(?i)\b(?:inc\.?|interview)\b.*$", "")
    v = F.regexp_replace(v, r"(?i)\s+(?:teams|gms)$", "")
    return F.btrim(v, F.lit(" ,.-|–—:"))


def company_in_summary(
    events: DataFrame, companies: DataFrame, text: Column, key: str,
    exclude_names: tuple[str, ...] = (),
) -> DataFrame:
    """(key, company) of calendar texts: "interview with X" and its kin first, then the words
    before "interview", then the dictionary."""
    text = text_or_empty(text)

    def accepted(c: Column) -> Column:
        ok = (c != "") & ~c.rlike(fixed.GENERIC_COMPANY_PATTERN) & ~casefold(c).isin(
            *fixed.MEETING_PLATFORMS)
        for name in exclude_names:
            ok = ok & ~F.contains(casefold(c), F.lit(name.casefold()))
        return F.when(ok, c)

    patterns = (*fixed.SUMMARY_COMPANY_PATTERNS, fixed.SUMMARY_PREFIX_PATTERN)
    made = {f"_c{i}": _candidate(F.regexp_extract("_text", p, 1)) for i, p in enumerate(patterns)}
    staged = computed_once(events.select(key, text.alias("_text")), **made)
    staged = computed_once(staged.select(key, "_text", *made), _said=F.coalesce(
        *[accepted(F.col(c)) for c in made])).select(key, "_text", "_said")
    # as a table: what the texts come from is computed once, not in each of the joins that meet in one task below
    staged = write_through(staged, "summaries")
    known = company_in_text(
        staged.where("_said IS NULL"), companies, F.col("_text"), key, _SUMMARY_CONTEXT)
    return staged.join(known, key, "left").select(
        key, F.coalesce("_said", "company").alias("company"))
