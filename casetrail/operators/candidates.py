"""Suggesting jobs for unlinked messages: exact top three without comparing every pair.

A job scores 70 when all words of its company are in the subject, else 50 when one of them is in
the sender, plus 12 per shared title word (two at least, 30 at most); 70 are needed.  What a
message can score with a job is therefore decided by few facts, and each fact is a *block*:

* the company's words (70);
* the company's words, or one word of it, with two shared title words (94 or 74);
* the same with three shared title words (100 or 80).

Inside a block every job scores at least the block's value and only the order (company, title,
id) tells them apart, so three jobs per block are enough: whatever ranks behind them in the block
also ranks behind them overall.  A message looks up the blocks it touches.  The work per message
is bounded by its own words, however many jobs a company has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import computed_once
from ..functions.text import terms, text_or_empty
from .ranking import top_k_per_group

MINIMUM = 70


def _pairs(words: Column) -> Column:
    """All unordered pairs of a sorted array as 'a b'."""
    n = F.size(words)
    made = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.transform(
        F.slice(words, i + 1, n), lambda b: F.concat_ws(" ", F.get(words, i - 1), b))))
    return F.when(n >= 2, made).otherwise(F.array().cast("array<string>"))


def _triples(words: Column) -> Column:
    n = F.size(words)
    made = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.transform(
        _pairs(F.slice(words, i + 1, n)), lambda p: F.concat_ws(" ", F.get(words, i - 1), p))))
    return F.when(n >= 3, made).otherwise(F.array().cast("array<string>"))


def _groups(words: Column) -> Column:
    return F.concat(_pairs(words), _triples(words))


def _score(subject: Column, sender: Column, company: Column, title: Column):
    named = (F.size(company) > 0) & (F.size(F.array_except(company, subject)) == 0)
    like = F.arrays_overlap(company, sender)
    shared = F.size(F.array_intersect(title, subject))
    points = (
        F.when(named, 70).when(like, 50).otherwise(0)
        + F.when(shared >= 2, F.least(F.lit(30), shared * 12)).otherwise(0)
    )
    reasons = F.filter(F.array(
        F.when(named, F.lit("company name in subject")).when(like, F.lit("company-like sender domain")),
        F.when(shared >= 2, F.lit("role terms in subject")),
    ), lambda r: r.isNotNull())
    return points.cast("bigint"), reasons


def _catalog(jobs: DataFrame, k: int) -> DataFrame:
    shown = jobs.select("id", text_or_empty("company").alias("_c"), text_or_empty("title").alias("_t"))
    # postings that read the same differ by id only: k of them are enough, and only their words are cut
    kept = computed_once(
        top_k_per_group(shown, ["_c", "_t"], [F.asc("id")], k),
        company_terms=F.array_sort(terms("_c")), title_terms=F.array_sort(terms("_t")))
    return kept.select(
        "id", F.coalesce(F.nullif("_c", F.lit("")), F.lit("Unknown company")).alias("company"),
        F.coalesce(F.nullif("_t", F.lit("")), F.lit("Unknown role")).alias("title"), "company_terms", "title_terms")


def candidate_jobs(queue: DataFrame, jobs: DataFrame, k: int = 3) -> DataFrame:
    """(message_identity, rank, id, company, title, score, reasons): up to ``k`` jobs each."""
    catalog = _catalog(jobs, k)
    named = catalog.where(F.size("company_terms") > 0).withColumn(
        "company_key", F.array_join("company_terms", " "))

    # --- blocks: key -> the first k jobs ---------------------------------------------------
    # the groups of a title are made once, for all keys of the posting
    grouped = computed_once(named.select("id", "company", "title", "company_key", "company_terms", "title_terms"),
                            _g=_groups(F.col("title_terms")))

    def with_groups(owner: Column) -> Column:
        return F.transform("_g", lambda g: F.concat(owner, F.lit("|"), g))

    own = F.concat(F.lit("a|"), "company_key")
    keys_of = F.concat(F.array(own), with_groups(own), F.flatten(F.transform(
        "company_terms", lambda w: with_groups(F.concat(F.lit("b|"), w)))))
    blocks = top_k_per_group(
        grouped.select(F.explode(keys_of).alias("block"), "id", "company", "title").withColumn("key", F.xxhash64("block")),
        ["key", "block"], [F.asc("company"), F.asc("title"), F.asc("id")], k).select("key", "id")

    # --- messages: distinct texts, whose words are cut once they are single ---------------------
    asked = queue.select(
        "message_identity", text_or_empty("subject").alias("subject"), text_or_empty("sender").alias("sender"),
    ).withColumn("profile", F.xxhash64("subject", "sender"))
    profiles = computed_once(
        asked.select("profile", "subject", "sender").distinct(),
        subject_terms=F.array_sort(terms("subject")), sender_terms=F.array_sort(terms("sender")))

    # companies whose words are all in the subject, found by their rarest word
    keys = named.select("company_key", "company_terms").dropDuplicates(["company_key"])
    words = keys.select("company_key", "company_terms", F.explode("company_terms").alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    filed = words.join(counts, "word").groupBy("company_key").agg(
        F.min_by("word", F.struct("n", "word")).alias("word"),
        F.first("company_terms").alias("company_terms"))
    subject_words = profiles.select("profile", "subject_terms", F.explode("subject_terms").alias("word"))
    whole = subject_words.join(filed, "word").where(
        F.size(F.array_except("company_terms", "subject_terms")) == 0
    ).select("profile", "company_key", "subject_terms")

    # what is looked up meets by a number: two texts of one number only add jobs to score
    def lookups(hits: DataFrame, owner: str, vocabulary: DataFrame, tag: str) -> DataFrame:
        """Blocks of (owner, title words): only words the owner's titles use are combined."""
        used = hits.select("profile", owner, F.explode("subject_terms").alias("word")).select(
            "profile", F.xxhash64(owner, "word").alias("pair")).join(
            vocabulary.withColumn("pair", F.xxhash64(owner, "word")), "pair").groupBy("profile", owner).agg(
            F.array_sort(F.collect_set("word")).alias("w"))
        return used.select("profile", owner, F.explode(_groups(F.col("w"))).alias("_g")).select(
            "profile", F.xxhash64(F.concat(F.lit(tag), owner, F.lit("|"), "_g")).alias("key"))

    by_word = named.select("title_terms", F.explode("company_terms").alias("_w"))
    title_words = named.select("company_key", F.explode("title_terms").alias("word")).distinct()
    word_words = by_word.select(
        F.col("_w").alias("company_word"), F.explode("title_terms").alias("word")).distinct()
    senders = profiles.select("profile", "subject_terms", F.explode("sender_terms").alias("company_word"))
    probes = reduce(DataFrame.unionByName, [
        whole.select("profile", F.xxhash64(F.concat(F.lit("a|"), "company_key")).alias("key")),
        lookups(whole, "company_key", title_words, "a|"),
        lookups(senders, "company_word", word_words, "b|"),
    ])
    found = probes.join(blocks, "key").select("profile", "id").distinct()

    points, reasons = _score(*[F.col(c) for c in (
        "subject_terms", "sender_terms", "company_terms", "title_terms")])
    scored = found.join(profiles, "profile").join(catalog, "id").select(
        "profile", "id", "company", "title", points.alias("score"), reasons.alias("reasons")
    ).where(F.col("score") >= MINIMUM)
    best = top_k_per_group(
        scored, ["profile"], [F.desc("score"), F.asc("company"), F.asc("title"), F.asc("id")], k)
    return asked.select("message_identity", "profile").join(best, "profile").drop("profile")


def brute_force(queue: DataFrame, jobs: DataFrame, k: int = 3) -> DataFrame:
    """The same by comparing every pair; for tests on small data only."""
    m = queue.select("message_identity", terms("subject").alias("s"), terms("sender").alias("e"))
    j = jobs.select(
        "id", F.coalesce(F.nullif("company", F.lit("")), F.lit("Unknown company")).alias("company"),
        F.coalesce(F.nullif("title", F.lit("")), F.lit("Unknown role")).alias("title"),
        terms(text_or_empty("company")).alias("c"), terms(text_or_empty("title")).alias("t"))
    points, reasons = _score(*[F.col(c) for c in "sect"])
    scored = m.join(j, F.lit(True)).select(
        "message_identity", "id", "company", "title", points.alias("score"), reasons.alias("reasons")
    ).where(F.col("score") >= MINIMUM)
    return top_k_per_group(scored, ["message_identity"], [
        F.desc("score"), F.asc("company"), F.asc("title"), F.asc("id")], k)
