"""Keyed merges of a batch into a table.  Each returns the new table; nothing is updated in place.

Incoming rows are reduced to one per key by mergeable aggregates before the join, so a key that
arrives a million times reaches the join once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.once import computed_once
from ..functions.text import (
    content_hash, normalize_alias, normalize_company_entity, requirement_lines, text_or_empty,
    with_keywords,
)
from .ranking import first_per_group

LEGACY_SOURCE = "linkedin_extension_legacy"


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of every key."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)]))
        .alias("_r"))
    return picked.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def upsert_jobs(
    current: DataFrame, incoming: DataFrame, fields: Sequence[str], score: Column,
    seen: str = "seen_at",
) -> DataFrame:
    """By external id: payload fields replaced, score recomputed, first seen kept, last seen set."""
    batch = latest(incoming, ["external_id"], [seen]).withColumn("score", score)
    new = batch.select("external_id", F.col(seen).alias("_seen"),
                       *[F.col(f).alias(f"_{f}") for f in (*fields, "score")])
    joined = current.join(new, "external_id", "full_outer")
    hit = F.col("_seen").isNotNull()
    return joined.select(
        "external_id", *[F.when(hit, F.col(f"_{f}")).otherwise(F.col(f)).alias(f)
                         for f in (*fields, "score")],
        F.coalesce("first_seen_at", "_seen").alias("first_seen_at"),
        F.coalesce("_seen", "last_seen_at").alias("last_seen_at"))


def _first_filled(column: str, order: Column) -> Column:
    return F.min_by(column, F.when(text_or_empty(column) != "", order))


CONTACT_FIELDS = ("name", "title", "signature", "linkedin_url", "phone")


def upsert_contacts(current: DataFrame, evidence: DataFrame) -> DataFrame:
    """Contacts after evidence: seen range widened, empty fields filled by the earliest value.

    ``current``: contact_key, the five fields, first_seen_at, last_seen_at.  ``evidence``:
    contact_key, the five fields, message_identity, observed_at.
    """
    order = F.struct("observed_at", "message_identity")
    batch = evidence.groupBy("contact_key").agg(
        *[_first_filled(f, order).alias(f"_{f}") for f in CONTACT_FIELDS],
        F.min("observed_at").alias("_lo"), F.max("observed_at").alias("_hi"))
    joined = current.join(batch, "contact_key", "full_outer")
    return joined.select(
        "contact_key",
        *[F.coalesce(F.nullif(text_or_empty(f), F.lit("")), F.col(f"_{f}"), F.lit("")).alias(f)
          for f in CONTACT_FIELDS],
        F.coalesce("first_seen_at", "_lo").alias("first_seen_at"),
        F.greatest("last_seen_at", "_hi").alias("last_seen_at"))


def contact_key(company: str = "normalized_company", name: str = "name",
                email: str = "normalized_email") -> Column:
    """Key of a contact not known yet: company and name, or company and address."""
    who = F.when(text_or_empty(name) != "", F.col(name)).otherwise(F.col(email))
    return F.concat_ws("|", F.col(company), who)


def touch_links(
    current: DataFrame, evidence: DataFrame, keys: Sequence[str], first: str = "message_identity",
) -> DataFrame:
    """Link rows by key: first source kept, seen range widened; a repeat only moves the end."""
    batch = evidence.groupBy(*keys).agg(
        F.min_by(first, F.struct("observed_at", first)).alias("_first"),
        F.min("observed_at").alias("_lo"), F.max("observed_at").alias("_hi"))
    joined = current.join(batch, list(keys), "full_outer")
    return joined.select(
        *keys, F.coalesce(first, "_first").alias(first),
        F.coalesce("first_seen_at", "_lo").alias("first_seen_at"),
        F.greatest("last_seen_at", "_hi").alias("last_seen_at"))


def reconcile_ledger(source: DataFrame, target: DataFrame, source_name: str = "linkedin"):
    """(jobs, report): applied rows of a ledger brought into the jobs without losing newer data.

    Missing jobs are added as applied; new and saved ones are promoted; an empty date or source
    is filled; nothing else changes.
    """
    applied = F.coalesce("applied_at", "first_seen_at")
    rows = source.where((F.col("source") == source_name) & (F.col("status") == "applied"))
    src = first_per_group(
        rows.select("external_id", applied.alias("_at"), F.col("id").alias("_sid"), "title", "company"),
        ["external_id"], ["_at", "_sid"])
    src = src.select("external_id", F.col("_at").alias("_s_at"), F.col("title").alias("_s_title"),
                     F.col("company").alias("_s_company"), F.lit(True).alias("_in_source"))
    joined = target.join(src, "external_id", "full_outer")
    in_source, exists = F.coalesce("_in_source", F.lit(False)), F.col("id").isNotNull()
    status = F.lower(text_or_empty("status"))
    created = in_source & ~exists
    promote = in_source & exists & status.isin("new", "saved")
    skip = in_source & exists & ~status.isin("new", "saved", *fixed.LEDGER_KNOWN_STATUSES)
    date = in_source & exists & F.col("applied_at").isNull() & F.col("_s_at").isNotNull()
    blank = in_source & exists & (F.trim(text_or_empty("application_source")) == "")
    already = (in_source & exists & ~blank & ~promote & ~date
               & (F.col("application_source") == LEGACY_SOURCE))
    jobs = joined.select(
        "id", "external_id",
        F.when(created, F.col("_s_title")).otherwise(F.col("title")).alias("title"),
        F.when(created, F.col("_s_company")).otherwise(F.col("company")).alias("company"),
        F.when(created | promote, F.lit("applied")).otherwise(F.col("status")).alias("status"),
        F.when(created, F.lit(source_name)).otherwise(F.col("source")).alias("source"),
        F.when(created | date, F.col("_s_at")).otherwise(F.col("applied_at")).alias("applied_at"),
        F.when(created | blank, F.lit(LEGACY_SOURCE)).otherwise(F.col("application_source"))
        .alias("application_source"))
    report = joined.agg(
        F.count_if(in_source).alias("source_records"), F.count_if(created).alias("created"),
        F.count_if(promote).alias("marked_applied"),
        F.count_if(date | (created & F.col("_s_at").isNotNull())).alias("dated"),
        F.count_if(already).alias("already_reconciled"),
        F.count_if(skip).alias("skipped_existing_outcome"))
    return jobs, report


def record_application(jobs: DataFrame, applications: DataFrame, events: DataFrame) -> DataFrame:
    """One application per job: (job_id, status, applied_at, source, created).

    ``events``: job_id, occurred_at.  Jobs that have an application keep it; unknown jobs are
    ignored; repeats of one job count once, at their first time.
    """
    known = jobs.select(F.col("id").alias("job_id"))
    first = events.join(known, "job_id", "left_semi").groupBy("job_id").agg(
        F.min("occurred_at").alias("applied_at"))
    new = first.join(applications.select("job_id"), "job_id", "left_anti").select(
        "job_id", F.lit("applied").alias("status"), "applied_at",
        F.lit("linkedin_extension").alias("source"), F.lit(True).alias("created"))
    old = applications.join(first.select("job_id"), "job_id", "left_semi").select(
        "job_id", "status", "applied_at", "source", F.lit(False).alias("created"))
    return old.unionByName(new)


def upsert_companies(current: DataFrame, incoming: DataFrame, at: str = "updated_at") -> DataFrame:
    """By normalised name: website, industry and notes replaced, name and creation kept."""
    keyed = incoming.withColumn("normalized_name", normalize_company_entity("name")).where(
        "normalized_name <> ''")
    fields = ("website", "industry", "notes")
    last = F.struct(at, "name")
    batch = keyed.groupBy("normalized_name").agg(
        *[F.max_by(f, last).alias(f"_{f}") for f in fields], F.min_by("name", last).alias("_name"),
        F.min(at).alias("_created"), F.max(at).alias("_updated"))
    joined = current.join(batch, "normalized_name", "full_outer")
    hit = F.col("_updated").isNotNull()
    return joined.select(
        "normalized_name", F.coalesce("name", "_name").alias("name"),
        *[F.when(hit, F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields],
        F.coalesce("created_at", "_created").alias("created_at"),
        F.coalesce("_updated", "updated_at").alias("updated_at"))


def upsert_links(
    current: DataFrame, incoming: DataFrame, key: str, fields: Sequence[str],
    known: dict[str, DataFrame] | None = None, at: str = "updated_at",
) -> DataFrame:
    """Reviewed links, aliases, relationships: the last write per key wins, creation is kept.

    Rows without a reason, or naming a key or reference that ``known`` (column -> frame with that
    column) lacks, are rejected.
    """
    batch = incoming
    if "reason" in incoming.columns:
        batch = batch.withColumn("reason", F.trim(text_or_empty("reason"))).where("reason <> ''")
    for column, frame in (known or {}).items():
        batch = batch.join(frame.select(column).distinct(), column, "left_semi")
    newest = batch.groupBy(key).agg(
        F.max_by(F.struct(*fields), F.struct(at, *fields)).alias("_n"), F.min(at).alias("_lo"),
        F.max(at).alias("_hi"))
    joined = current.join(newest, key, "full_outer")
    hit = F.col("_hi").isNotNull()
    return joined.select(
        key, *[F.when(hit, F.col("_n")[f]).otherwise(F.col(f)).alias(f) for f in fields],
        F.coalesce("created_at", "_lo").alias("created_at"),
        F.coalesce("_hi", at).alias(at))


def company_aliases(rows: DataFrame) -> DataFrame:
    """Alias rows with their key; incomplete ones are dropped."""
    kept = rows.withColumns({c: F.trim(text_or_empty(c)) for c in (
        "alias_name", "canonical_name", "reason")}).withColumn(
        "normalized_alias", normalize_alias("alias_name"))
    return kept.where("canonical_name <> '' AND reason <> '' AND normalized_alias <> ''")


def apply_changes(
    current: DataFrame, changes: DataFrame, allowed: Sequence[str], key: str = "id",
    at: str = "changed_at", score: tuple[str, Column] | None = None,
) -> DataFrame:
    """Allowed non-NULL columns of the change replace the old; ``updated_at`` is set.

    ``score`` = (column that triggers it, expression): recomputed where that column changes.
    """
    last = latest(changes, [key], [at])
    new = last.select(key, F.col(at).alias("_at"), *[F.col(c).alias(f"_{c}") for c in allowed])
    joined = current.join(new, key, "left")
    any_change = F.greatest(*[F.col(f"_{c}").isNotNull() for c in allowed]) if len(
        allowed) > 1 else F.col(f"_{allowed[0]}").isNotNull()
    replaced = joined.withColumns({
        **{c: F.coalesce(f"_{c}", c) for c in allowed},
        "updated_at": F.when(any_change, F.col("_at")).otherwise(F.col("updated_at"))})
    if score:
        trigger, value = score
        replaced = replaced.withColumn("match_score", F.when(
            F.col(f"_{trigger}").isNotNull(), value).otherwise(F.col("match_score")))
    return replaced.drop("_at", *[f"_{c}" for c in allowed])


def describe_jobs(texts: DataFrame, limit: int = 30) -> DataFrame:
    """job_id, source_hash, skills and requirements; one row per (job, hash)."""
    # both depend on the text alone and are read in its row: hashes, a few words and lines leave it, never the text
    read = with_keywords(computed_once(texts, source_hash=content_hash("raw_text")), "raw_text", limit)
    return read.select("job_id", "source_hash", F.col("keywords").alias("skills"),
                       requirement_lines("raw_text").alias("requirements")).dropDuplicates(["job_id", "source_hash"])


def apply_aliases(df: DataFrame, aliases: DataFrame, column: str = "company") -> DataFrame:
    """Adds ``display_<column>``: the canonical name of an alias; the raw value stays."""
    side = aliases.groupBy(F.col("normalized_alias").alias("_key")).agg(F.min("canonical_name").alias("canonical_name"))
    return df.withColumn("_key", normalize_alias(column)).join(side, "_key", "left").withColumn(
        f"display_{column}", F.coalesce("canonical_name", column)).drop("_key", "canonical_name")


def rollback_scope(
    imports: DataFrame, imported: DataFrame, jobs: DataFrame, dependents: dict[str, DataFrame],
    max_import: int, max_job: int, provider: str | None = None,
) -> dict[str, DataFrame]:
    """What remains of every table once rows above the baseline ids, and what hangs on them, go.

    ``dependents`` carry ``message_identity``.  Rows of the baseline are never touched.
    """
    gone_imports = imports.where(F.col("id") > max_import)
    if provider:
        gone_imports = gone_imports.where(F.col("mailbox_name") == provider)
    gone = imported.join(
        gone_imports.select(F.col("id").alias("source_import_id")), "source_import_id", "left_semi"
    ).select("message_identity")
    kept = {name: df.join(gone, "message_identity", "left_anti") for name, df in dependents.items()}
    kept["imported"] = imported.join(gone, "message_identity", "left_anti")
    kept["imports"] = imports.join(gone_imports.select("id"), "id", "left_anti")
    kept["jobs"] = jobs.where(F.col("id") <= max_job)
    return kept
