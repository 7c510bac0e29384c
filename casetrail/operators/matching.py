"""Matching confirmations to jobs by a score, without comparing every message to every job.

The score of a pair adds identifiers (100 external, 70 requisition), company (35 equal, 22
contained), title (35 equal, else up to 30 for shared words) and date (20, 10 or 4 by distance).
A match needs 45.

What a message has in common with a job is one of a few *units*: the requisition; the company; the
title; requisition and title; company and title; all of them.  All jobs of a unit score at least the unit's points with
the message, and a job that scores more does so through a richer unit that is in the race as well.
So the best over units is the best over jobs, and no unit pairs every message with every job:

* messages and jobs are reduced to distinct keys first; copies cost one key;
* company-and-title units are found by one equi-join on (account, related company, title word),
  full ones on (account, requisition, related company), titles by their rarest words; titles within
  a requisition by any word, whatever the company: a hot requisition pairs its titles, not its jobs;
* dates add at most 20, so units with fewer than 25 points, or more than 20 behind the message's
  best, are dropped before dates are looked at;
* dates are an equi-join on 92-day buckets of (unit, first seen) with the lowest job id; a job too
  far away counts with its undated score;
* normalised rows and surviving units are written to the shared folder, so each is computed once
  and a lost executor costs no more than its own tasks.

The tests compare the result with the brute-force search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import elapsed_days
from ..functions.text import normalize_company_match, normalize_title, text_or_empty
from ..session import write_through

THRESHOLD = 45.0
_MAX_DATE = 20.0
_BUCKET_DAYS = 92
_PROFILE = ["account", "req", "company_key", "title_key"]


def date_points(a: Column | str, b: Column | str) -> Column:
    days = elapsed_days(a, b)
    return F.coalesce(
        F.when(days <= 3, 20.0).when(days <= 14, 10.0).when(days <= 45, 4.0), F.lit(0.0))


def title_points(a: Column, b: Column) -> Column:
    left, right = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    shared = F.size(F.array_intersect(left, right))
    overlap = shared / F.greatest(F.size(left), F.size(right)) * F.lit(30.0)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 35.0).otherwise(overlap)


def company_points(a: Column, b: Column) -> Column:
    return (
        F.when((a == "") | (b == ""), 0.0).when(a == b, 35.0)
        .when(F.contains(a, b) | F.contains(b, a), 22.0).otherwise(0.0)
    )


def text_points(m: str = "m_", j: str = "j_") -> Column:
    """Requisition, company and title points of a profile pair."""
    c = F.col
    same_req = (c(m + "req") != "") & (c(m + "req") == c(j + "req"))
    return (
        F.when(same_req, 70.0).otherwise(0.0)
        + company_points(c(m + "company_key"), c(j + "company_key"))
        + title_points(c(m + "title_key"), c(j + "title_key"))
    )


def _profiles(df: DataFrame, account: str, company: str, title: str, req: str) -> DataFrame:
    return df.withColumns({
        "account": text_or_empty(account), "req": F.lower(text_or_empty(req)),
        "company_key": normalize_company_match(company), "title_key": normalize_title(title),
    }).withColumn("profile", F.xxhash64(*_PROFILE))


def _tokens(title: Column | str) -> Column:
    t = F.col(title) if isinstance(title, str) else title
    return F.filter(F.array_distinct(F.split(t, " ")), lambda w: w != "")


def _rare_first(title: str) -> Column:
    """The words that two titles sharing five sixths of their words must share one of."""
    ordered = F.array_sort(F.transform(
        _tokens(title), lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w"))))
    return F.transform(
        F.slice(ordered, F.lit(1), F.floor(F.size(ordered) / 6).cast("int") + 1), lambda s: s["w"])


def contained_names(names: DataFrame) -> DataFrame:
    """(inner, outer) of distinct names where ``inner`` is a proper part of ``outer``.

    A name is filed under its rarest three-letter piece and looked up by every piece of the other
    names.  The table of pieces is bounded by the alphabet of normalised names (37 letters).
    """
    name = F.col("name")

    def pieces(width: int) -> Column:
        count = F.greatest(F.length(name) - (width - 1), F.lit(1))
        cut = F.transform(F.sequence(F.lit(1), count), lambda i: F.substr(name, i, F.lit(width)))
        return F.when(F.length(name) >= width, cut).otherwise(F.array().cast("array<string>"))

    shelves = names.select(name.alias("outer"), F.explode(F.array_distinct(
        F.concat(pieces(1), pieces(2), pieces(3)))).alias("piece"))
    counts = shelves.groupBy("piece").agg(F.count("*").alias("n"))
    longest = F.least(F.lit(3), F.length("outer"))
    filed = shelves.where(F.length("piece") == longest).join(counts, "piece").groupBy(
        F.col("outer").alias("inner")).agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    return filed.join(shelves, "piece").where(
        F.contains(F.col("outer"), F.col("inner")) & (F.col("inner") != F.col("outer"))
    ).select("inner", "outer")


def _best(rows: DataFrame, keys: list[str], job: str) -> DataFrame:
    """The highest score of each key and the lowest job that has it.

    Numbers are combined by hashing before the shuffle; a struct as the aggregate would have every pair sorted first.
    """
    equal = rows.groupBy(*keys, "score").agg(F.min(job).alias(job))
    return equal.groupBy(*keys).agg(F.max_by(job, "score").alias(job), F.max("score").alias("score"))


def _stored(df: DataFrame, label: str) -> DataFrame:
    """Written through; the shuffles it took leave the disk when it is written, as nothing else reads them."""
    return write_through(df, label, keep_shuffles=False)


def _unit(kind: str, *columns: str) -> Column:
    return F.xxhash64(F.lit(kind), *columns)


def _accounts(df: DataFrame) -> DataFrame:
    """A message may match jobs of its own account or of none."""
    return df.withColumn("account", F.explode(F.array_distinct(F.array(F.lit(""), F.col("account")))))


def _text(prefix: str = "") -> Column:
    return F.xxhash64(prefix + "company_key", prefix + "title_key")


def _first_shared(block: Column, m_words: Column, j_words: Column) -> Column:
    """Whether ``block`` is the first word of two titles, so that a pair that shares several is made once."""
    return block == F.array_min(F.array_intersect(m_words, j_words))


def _related(m: DataFrame, near: DataFrame) -> DataFrame:
    """Messages' keys once for every job company (``_near``) that may be theirs."""
    named = m.where("company_key <> ''")
    return _accounts(named.join(near, "company_key").unionByName(
        named.withColumn("_near", F.col("company_key")))).distinct()


def _renamed(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keep else prefix + c) for c in df.columns])


def _candidate_units(mp: DataFrame, jp: DataFrame) -> DataFrame:
    """(profile, unit, points): every unit a message profile can match, with its points."""
    names = mp.select("company_key").union(jp.select("company_key")).where(
        "company_key <> ''").distinct().withColumnRenamed("company_key", "name")
    inside = _stored(contained_names(names), "match-names")
    near = inside.select(F.col("inner").alias("company_key"), F.col("outer").alias("_near")).union(
        inside.select("outer", "inner"))

    own = _accounts(mp)
    by_company = own.where("company_key <> ''").select(
        "profile", _unit("c", "account", "company_key").alias("unit"), F.lit(35.0).alias("points"))
    by_req = own.where("req <> ''").select(
        "profile", _unit("r", "account", "req").alias("unit"), F.lit(70.0).alias("points"))

    titles = [df.select("title_key").distinct().withColumn(
        "word", F.explode(_rare_first("title_key"))) for df in (mp, jp)]
    alike = titles[0].withColumnRenamed("title_key", "m_title").join(
        titles[1].withColumnRenamed("title_key", "j_title"), "word").select(
        "m_title", "j_title", title_points(F.col("m_title"), F.col("j_title")).alias("points")
    ).where(F.col("points") >= THRESHOLD - _MAX_DATE).distinct()
    by_title = own.join(alike, own["title_key"] == alike["m_title"]).select(
        "profile", _unit("t", "account", "j_title").alias("unit"), "points")

    # company and title, whatever the requisition
    m_words, j_words = _tokens("m_title_key"), _tokens("j_title_key")
    keys = ["company_key", "title_key"]
    m2, j2 = (df.where("company_key <> '' AND title_key <> ''").select("account", *keys).distinct()
              for df in (mp, jp))
    word = F.explode(_tokens("title_key"))
    points = company_points(F.col("m_company_key"), F.col("j_company_key")) + title_points(
        F.col("m_title_key"), F.col("j_title_key"))
    texts = _stored(_renamed(_related(m2, near).withColumn("_word", word), "m_", "account", "_near", "_word").join(
        _renamed(j2.withColumns({"_near": F.col("company_key"), "_word": word}), "j_", "account", "_near", "_word"),
        ["account", "_near", "_word"]).where(_first_shared(F.col("_word"), m_words, j_words)).select(
        "account", _text("m_").alias("text"), _unit("ct", "account", "j_company_key", "j_title_key").alias("unit"),
        points.alias("points")).where(F.col("points") >= THRESHOLD - _MAX_DATE), "match-texts")
    by_text = own.withColumn("text", _text()).join(texts, ["account", "text"]).select("profile", "unit", "points")

    # the same requisition and something of the title, whatever the company
    m3, j3 = (df.where("req <> '' AND title_key <> ''").select("account", "req", "title_key").distinct() for df in (mp, jp))
    titled = _renamed(_accounts(m3).distinct().withColumn("_word", word), "m_", "account", "req", "_word").join(
        _renamed(j3.withColumn("_word", word), "j_", "account", "req", "_word"), ["account", "req", "_word"]).where(
        _first_shared(F.col("_word"), m_words, j_words)).select(
        "account", "req", F.col("m_title_key").alias("title_key"), _unit("rt", "account", "req", "j_title_key").alias("unit"),
        (title_points(F.col("m_title_key"), F.col("j_title_key")) + 70.0).alias("points"))
    by_req_title = own.join(titled, ["account", "req", "title_key"]).select("profile", "unit", "points")

    # the same requisition and a related company, whatever the title
    m4, j4 = (df.where("req <> '' AND company_key <> ''").select("account", "req", *keys).distinct() for df in (mp, jp))
    full = _renamed(_related(m4, near), "m_", "account", "req", "_near").join(
        _renamed(j4.withColumn("_near", F.col("company_key")), "j_", "account", "req", "_near"),
        ["account", "req", "_near"]).select(
        "account", "req", _text("m_").alias("text"), _unit("f", "account", "req", "j_company_key", "j_title_key").alias("unit"),
        (points + 70.0).alias("points"))
    by_full = own.withColumn("text", _text()).join(full, ["account", "req", "text"]).select("profile", "unit", "points")
    return by_company.unionByName(by_req).unionByName(by_title).unionByName(by_text).unionByName(
        by_req_title).unionByName(by_full)


def match_applications(messages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Best job per message: message_identity, job_id, score, matched.

    ``messages``: message_identity, account, company, title, applied_at, job_ref, requisition_id,
    inferred_role.  ``jobs``: id, email_account, external_id, requisition_id, company, title,
    first_seen_at, role_family.  Ties go to the lower job id; messages no candidate reaches are
    left out.
    """
    m = _stored(_profiles(messages, "account", "company", "title", "requisition_id").select(
        "message_identity", "applied_at", "job_ref", "requisition_id", "inferred_role", "profile",
        *_PROFILE), "match-messages")
    j = _stored(_profiles(jobs, "email_account", "company", "title", "requisition_id").select(
        "id", "first_seen_at", "external_id", "role_family", "profile", *_PROFILE), "match-jobs")
    mp = m.select(*_PROFILE, "profile").distinct()
    jp = j.select(*_PROFILE, "profile").distinct()

    def when(filled: str, unit: Column) -> Column:
        return F.when(F.expr(filled), unit)

    units = F.filter(F.array(
        when("company_key <> ''", _unit("c", "account", "company_key")),
        when("req <> ''", _unit("r", "account", "req")),
        when("title_key <> ''", _unit("t", "account", "title_key")),
        when("company_key <> '' AND title_key <> ''", _unit("ct", "account", "company_key", "title_key")),
        when("req <> '' AND title_key <> ''", _unit("rt", "account", "req", "title_key")),
        when("req <> '' AND company_key <> ''", _unit("f", "account", "req", "company_key", "title_key")),
    ), lambda u: u.isNotNull())
    dates = _stored(j.select("id", "first_seen_at", F.explode(units).alias("unit")).groupBy(
        "unit", "first_seen_at").agg(F.min("id").alias("id")), "match-units")
    undated = dates.groupBy("unit").agg(F.min("id").alias("id"))

    every = _stored(_candidate_units(mp, jp).join(undated, "unit"), "match-candidates")
    bar = every.groupBy("profile").agg(F.max("points").alias("_bar"))
    kept = every.join(bar, "profile").where(F.col("points") >= F.col("_bar") - _MAX_DATE).drop("_bar")

    asked = m.select("profile", "applied_at").distinct()
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01"))
    bucket = lambda d: F.floor(d / _BUCKET_DAYS).cast("int")
    wanted = asked.where("applied_at IS NOT NULL").withColumn("bucket", F.explode(F.array(
        *[bucket(day("applied_at") + d) for d in (-_BUCKET_DAYS // 2, _BUCKET_DAYS // 2)])))
    stocked = dates.where("first_seen_at IS NOT NULL").withColumn("bucket", bucket(day("first_seen_at")))
    dated = wanted.join(kept.drop("id"), "profile").join(stocked, ["unit", "bucket"]).select(
        "profile", "applied_at", "id",
        (F.col("points") + date_points("applied_at", "first_seen_at")).alias("score"))
    plain = asked.join(_best(kept.withColumnRenamed("points", "score"), ["profile"], "id"), "profile")
    top = _stored(_best(dated.unionByName(plain), ["profile", "applied_at"], "id"), "match-best")
    by_text = m.select("message_identity", "profile", "applied_at").join(
        top.withColumnRenamed("applied_at", "_at").withColumnRenamed("profile", "_p"),
        (F.col("profile") == F.col("_p")) & F.col("applied_at").eqNullSafe(F.col("_at"))
    ).select("message_identity", F.col("id").alias("job_id"), "score")

    # a named external id belongs to one job at most
    mm = m.where("job_ref <> ''").select(
        "message_identity", "job_ref", "applied_at",
        *[F.col(c).alias("m_" + c) for c in _PROFILE])
    jj = j.where("external_id <> ''").select(
        "id", "external_id", "first_seen_at", *[F.col(c).alias("j_" + c) for c in _PROFILE])
    by_id = _stored(mm.join(jj, mm["job_ref"] == jj["external_id"]).where(
        (F.col("j_account") == "") | (F.col("j_account") == F.col("m_account"))
    ).select("message_identity", F.col("id").alias("job_id"), (
        F.lit(100.0) + text_points() + date_points("applied_at", "first_seen_at")).alias("score")), "match-named")

    winner = _stored(_best(by_text.unionByName(by_id), ["message_identity"], "job_id"), "match-winners")
    facts = m.select("message_identity", "job_ref", "requisition_id", "inferred_role")
    roles = j.select(F.col("id").alias("job_id"), F.col("role_family").alias("_role"))
    joined = winner.join(facts, "message_identity").join(
        roles, "job_id")
    conflict = (
        (text_or_empty("inferred_role") != "") & (text_or_empty("_role") != "")
        & (F.col("_role") != F.col("inferred_role"))
        & (text_or_empty("job_ref") == "") & (text_or_empty("requisition_id") == "")
    )
    return joined.select(
        "message_identity", "job_id", "score",
        ((F.col("score") >= THRESHOLD) & ~conflict).alias("matched"))


def brute_force(messages: DataFrame, jobs: DataFrame) -> DataFrame:
    """The same by comparing every pair; for tests on small data only."""
    m = _profiles(messages, "account", "company", "title", "requisition_id").select(
        "message_identity", "job_ref", "applied_at", *[F.col(c).alias("m_" + c) for c in _PROFILE])
    j = _profiles(jobs, "email_account", "company", "title", "requisition_id").select(
        "id", "external_id", "first_seen_at", *[F.col(c).alias("j_" + c) for c in _PROFILE])
    allowed = (F.col("j_account") == "") | (F.col("j_account") == F.col("m_account"))
    named = (F.col("job_ref") != "") & (F.col("job_ref") == F.col("external_id"))
    score = (F.when(named, 100.0).otherwise(0.0) + text_points()
             + date_points("applied_at", "first_seen_at"))
    return m.join(j, allowed).withColumn("score", score).groupBy("message_identity").agg(
        F.min_by(F.struct(F.col("id").alias("job_id"), "score"),
                 F.struct(-F.col("score"), F.col("id"))).alias("_w")).select(
        "message_identity", "_w.*")


def _first_filled(value: str, order: Column) -> Column:
    """First non-empty value in order; a mergeable aggregate."""
    return F.min_by(value, F.when(text_or_empty(value) != "", order))


def apply_match(
    jobs: DataFrame, messages: DataFrame, matches: DataFrame, profiles: DataFrame | None = None,
    now: str | None = None,
) -> DataFrame:
    """Jobs after matching, whole rows: empty fields of matched jobs filled, unmatched messages as new jobs.

    Of several messages the first (by date, then identity) fills a field.  Unmatched messages of
    one account and external id become one job.  Role and resume family that no message infers come
    from ``profiles`` (account, role_family, resume_family) of the message's account.
    """
    order = F.struct("applied_at", "message_identity")
    none = F.lit(None).cast("string")
    if profiles is None:
        messages = messages.withColumns({"_default_role": none, "resume_family": none})
    else:
        messages = messages.join(profiles.groupBy("account").agg(
            F.min("role_family").alias("_default_role"), F.min("resume_family").alias("resume_family")), "account", "left")
    messages = messages.withColumn("inferred_role", F.coalesce(
        F.nullif(text_or_empty("inferred_role"), F.lit("")), F.col("_default_role"), F.lit(""))).drop("_default_role")
    moment = (F.lit(now) if now else F.current_timestamp()).cast("timestamp_ntz")
    # read for the jobs they fill and for those they make; each step's shuffles are gone before the next one's
    joined = _stored(messages.join(_stored(matches, "matches"), "message_identity", "left"), "matched-messages")
    hit = joined.where(F.coalesce("matched", F.lit(False)))
    fill = ("account", "inferred_role", "resume_family", "message_id", "ats_platform", "requisition_id", "job_url",
            "company", "title")
    gained = _stored(hit.groupBy("job_id").agg(
        *[_first_filled(c, order).alias(f"_{c}") for c in fill],
        F.min("applied_at").alias("_applied_at"),
        F.max(F.least(F.lit(100.0), F.round("score", 1))).alias("_score")), "gained")

    def filled(old: str, new: str) -> Column:
        return F.coalesce(F.nullif(text_or_empty(old), F.lit("")), F.col(new), F.lit(""))

    touched = F.col("_score").isNotNull()
    title = F.when(F.col("title") == "Application confirmation", F.lit("")).otherwise(F.col("title"))
    updated = _updated(jobs, gained, filled, touched, title)

    miss = joined.where(~F.coalesce("matched", F.lit(False)))
    owners = jobs.where("external_id <> ''").select(
        F.col("external_id").alias("job_ref"), F.col("email_account").alias("_owner"),
        F.lit(True).alias("_known"))
    owned = miss.join(owners, "job_ref", "left")
    reusable = (F.col("job_ref") != "") & (
        F.col("_known").isNull() | (text_or_empty("_owner") == "") | (F.col("_owner") == F.col("account")))
    made = owned.withColumn("external_id", F.when(reusable, F.col("job_ref")).otherwise(F.concat(
        F.lit("email-"), "account", F.lit("-"),
        F.substring(F.regexp_replace("message_identity", "^v1:", ""), 1, 32))))
    new = made.groupBy("account", "external_id").agg(
        *[_first_filled(c, order).alias(c) for c in fill if c != "account"],
        F.min("applied_at").alias("applied_at"), F.count_if(F.col("applied_at").isNull()).alias("_undated"))

    def text(c: str, default: str = "") -> Column:
        return F.coalesce(F.col(c), F.lit(default))

    created = new.select(
        F.lit(None).cast("bigint").alias("id"), "external_id",
        text("title", "Application confirmation").alias("title"), text("company").alias("company"),
        text("job_url").alias("url"), F.col("account").alias("email_account"),
        text("inferred_role").alias("role_family"), "applied_at",
        text("message_id").alias("confirmation_id"), text("ats_platform").alias("ats_platform"),
        text("requisition_id").alias("requisition_id"),
        F.lit("email_confirmation").alias("application_source"),
        F.lit(0.0).alias("import_confidence"), F.lit("applied").alias("status"),
        text("resume_family").alias("resume_family"), F.lit("email").alias("source"), F.lit(50.0).alias("score"),
        F.when(F.col("_undated") > 0, moment).otherwise(F.col("applied_at")).alias("first_seen_at"),
        moment.alias("last_seen_at"))
    return updated.unionByName(created)


def _updated(jobs, gained, filled, touched, title) -> DataFrame:
    joined = jobs.join(gained, jobs["id"] == gained["job_id"], "left").withColumn("_t", title)
    source = F.when(touched & (text_or_empty("application_source") == ""),
                    F.lit("email_confirmation")).otherwise(F.col("application_source"))
    shown = F.coalesce(F.nullif(text_or_empty("_t"), F.lit("")), F.col("_title"), F.col("title"))
    return joined.select(
        "id", "external_id", shown.alias("title"),
        filled("company", "_company").alias("company"), filled("url", "_job_url").alias("url"),
        filled("email_account", "_account").alias("email_account"),
        filled("role_family", "_inferred_role").alias("role_family"),
        F.coalesce("applied_at", "_applied_at").alias("applied_at"),
        filled("confirmation_id", "_message_id").alias("confirmation_id"),
        filled("ats_platform", "_ats_platform").alias("ats_platform"),
        filled("requisition_id", "_requisition_id").alias("requisition_id"),
        source.alias("application_source"),
        F.greatest(F.coalesce("import_confidence", F.lit(0.0)), F.coalesce("_score", F.lit(0.0)))
        .alias("import_confidence"), "status", filled("resume_family", "_resume_family").alias("resume_family"),
        "source", "score", "first_seen_at", "last_seen_at")
