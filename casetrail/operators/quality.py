"""Checks over tables: keys, constraints, references, digests and differences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _all(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, list(frames))


def duplicate_key_groups(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """(table, duplicate_groups): number of keys that occur more than once.

    Keys are first counted by a hash, which takes little room; whole keys are compared only where a hash occurs again.
    """
    def groups(name: str, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        hashed = df.select(*keys, F.xxhash64(*keys).alias("_hash"))
        again = hashed.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1").select("_hash")
        counted = hashed.join(again, "_hash", "left_semi").groupBy("_hash", *keys).agg(F.count("*").alias("_n"))
        return counted.agg(F.count_if(F.col("_n") > 1).alias("duplicate_groups")).select(
            F.lit(name).alias("table"), "duplicate_groups")

    return _all(groups(name, df, keys) for name, (df, keys) in tables.items())


def row_digest(df: DataFrame) -> Column:
    """60-bit content hash of a row as a decimal number."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 15), 16, 10).cast("bigint")


def table_digest(df: DataFrame) -> DataFrame:
    """One row: count, sum and xor of the row hashes; equal for equal content in any order."""
    hashed = df.select(row_digest(df).alias("h"))
    return hashed.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("total"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("mixed"))


def digests_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two tables hold the same rows."""
    sides = table_digest(a).unionByName(table_digest(b))
    return sides.agg(((F.min("rows") == F.max("rows")) & (F.min("total") == F.max("total"))
                      & (F.min("mixed") == F.max("mixed"))).alias("equal"))


def preserved(before: DataFrame, after: DataFrame, max_id: int, key: str = "id") -> DataFrame:
    """One row: whether the rows up to the baseline id are unchanged."""
    old = F.col(key) <= max_id
    return digests_equal(before.where(old), after.where(old)).withColumnRenamed("equal", "preserved")


def state_delta(before: Mapping[str, DataFrame], after: Mapping[str, DataFrame]) -> DataFrame:
    """(table, delta): difference of the row counts."""
    counts = [
        df.agg(F.count("*").alias("n")).select(
            F.lit(name).alias("table"), (F.col("n") * sign).alias("n"))
        for tables, sign in ((before, -1), (after, 1)) for name, df in tables.items()]
    return _all(counts).groupBy("table").agg(F.sum("n").alias("delta"))


def batch_verification(
    messages: DataFrame, imported: DataFrame, metadata: DataFrame, classified: DataFrame,
    jobs: DataFrame, contact_jobs: DataFrame, contacts: DataFrame, interview_events: DataFrame,
    interviews: DataFrame, version: str,
) -> DataFrame:
    """Six flags per message and whether it is fully represented.

    Everything that is known of an identity is one tagged row; one aggregation, combined before its shuffle, turns the
    rows of an identity into flags, however many there are.
    """
    key = "message_identity"

    tags = ("asked", "imported", "metadata", "classified", "contact", "interview")

    def said(rows: DataFrame, tag: str) -> DataFrame:
        """A bit for the tag, and the job that an imported or a classified row names."""
        return rows.select(key, F.lit(1 << tags.index(tag)).alias("_bits"), *[
            (F.col("job_id") if tag == of else F.lit(None)).cast("bigint").alias(name)
            for name, of in (("_ij", "imported"), ("_cj", "classified"))])

    contact = contacts.select(F.col("id").alias("recruiter_id")).distinct()
    job = jobs.select(F.col("id").alias("job_id")).distinct()
    lost = contact_jobs.join(contact, "recruiter_id", "left_anti").select(key).unionByName(
        contact_jobs.join(job, "job_id", "left_anti").select(key))
    seen = interviews.select(F.col("id").alias("interview_id"))
    unseen = interview_events.where("interview_id IS NOT NULL").join(seen, "interview_id", "left_anti")
    rows = _all([
        said(messages, "asked"), said(imported, "imported"), said(metadata, "metadata"),
        said(classified.where(F.col("classifier_version") == version), "classified"),
        said(lost, "contact"), said(unseen, "interview")])

    # three numbers an identity: what is shuffled is little more than the identities
    merged = rows.groupBy(key).agg(F.bit_or("_bits").alias("_bits"), F.min("_ij").alias("_ij"), F.min("_cj").alias("_cj"))
    named = dict(zip(tags, ("_asked", "imported_message", "transport_metadata", "classification", "_bad_contact", "_bad_interview")))
    joined = merged.select(key, "_ij", "_cj", *[
        (F.col("_bits").bitwiseAND(1 << tags.index(tag)) != 0).alias(name) for tag, name in named.items()]).where("_asked")
    # messages without a job meet none and are spread by their identity instead of meeting in one task
    joined = joined.withColumn("_spread", F.when(F.col("_ij").isNull(), F.xxhash64(key)).otherwise(0))
    joined = joined.join(job.select(F.col("job_id").alias("_ij"), F.lit(0).cast("long").alias("_spread"),
                                    F.lit(True).alias("_job")), ["_ij", "_spread"], "left")

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    stable = flag("imported_message") & flag("classification") & F.col("_ij").eqNullSafe(
        F.col("_cj")) & (F.col("_ij").isNull() | flag("_job"))
    flags = {
        "imported_message": flag("imported_message"), "transport_metadata": flag("transport_metadata"),
        "classification": flag("classification"), "job_link_stable": stable,
        "recruiter_links_stable": ~flag("_bad_contact"),
        "interview_links_stable": ~flag("_bad_interview"),
    }
    shown = joined.select(key, *[v.alias(n) for n, v in flags.items()])
    return shown.withColumn("represented", reduce(lambda a, b: a & b, [F.col(n) for n in flags]))


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """Child rows whose reference leads nowhere."""
    return child.where(F.col(fk).isNotNull()).join(
        parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def check_constraints(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, violations); as in SQL, a rule that is NULL is not violated."""
    wide = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules
    ])).alias("r")).select("r.*")


def failure_ledger(df: DataFrame, value: str, error: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows): bad rows are kept with their error, good ones go on."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull()).drop(value)


def replay_conflicts(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Stored rows whose type or provider differs from the replay of the same message and
    version."""
    new = recomputed.select("message_identity", "classifier_version",
                            F.col("classification").alias("_c"), F.col("provider").alias("_p"))
    joined = stored.join(new, ["message_identity", "classifier_version"])
    return joined.where((F.col("classification") != F.col("_c")) | (F.col("provider") != F.col("_p"))
                        ).withColumnsRenamed({"_c": "replayed_classification", "_p": "replayed_provider"})


# --- sets -------------------------------------------------------------------------------------


def missing_ids(present: DataFrame, id_col: str, scope: Sequence[str] = ()) -> DataFrame:
    """Ids missing between the first and the last of every scope.

    Gaps are found between neighbours and only gaps are expanded, so a dense range costs nothing
    and no scope is unrolled whole.
    """
    from pyspark.sql import Window

    # neighbours are looked up by range bucket, so that a hot scope is sorted by many tasks
    width = 1 << 16
    ids = present.select(*scope, F.col(id_col).alias("_id")).distinct().withColumn(
        "_bucket", F.floor(F.col("_id") / width))
    inside = ids.withColumn("_prev", F.lag("_id").over(
        Window.partitionBy(*scope, "_bucket").orderBy("_id")))
    edges = ids.groupBy(*scope, "_bucket").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi"))
    across = edges.withColumn("_prev", F.lag("_hi").over(
        Window.partitionBy(*scope).orderBy("_bucket")))
    gaps = inside.select(*scope, "_prev", "_id").unionByName(
        across.select(*scope, "_prev", F.col("_lo").alias("_id"))
    ).where(F.col("_id") - F.col("_prev") > 1)
    # a long gap is cut into rows of bounded length before its ids are listed
    cuts = gaps.select(*scope, "_id", F.explode(F.sequence(
        F.col("_prev") + 1, F.col("_id") - 1, F.lit(width))).alias("_from"))
    return cuts.select(*scope, F.explode(F.sequence(
        F.col("_from"), F.least(F.col("_from") + width - 1, F.col("_id") - 1))).alias(id_col))


def class_shortfall(expected: DataFrame, actual: DataFrame, key: str = "classification") -> DataFrame:
    have = actual.groupBy(key).agg(F.sum("n").alias("_have"))
    return expected.join(have, key, "left").select(
        key, (F.col("n") - F.coalesce("_have", F.lit(0))).alias("shortfall")).where("shortfall > 0")


def schema_diff(df: DataFrame, expected: Mapping[str, str], table: str) -> DataFrame:
    """(table, severity, column, rows, nulls, failing): every column of the table or of ``expected`` (column to type), with
    its rows, those without a value and those whose value does not read as the type, counted in one pass.

    ``error``: a column is missing (all its rows are nulls) or holds values of another type; ``warning``: it is not
    expected; ``ok`` otherwise.
    """
    have = set(df.columns)
    counted = [F.count("*").alias("rows")]
    for c in df.columns:
        counted.append(F.count_if(F.col(c).isNull()).alias(f"{c}:nulls"))
        if c in expected:
            read = F.col(c).cast("string").try_cast(expected[c])
            counted.append(F.count_if(F.col(c).isNotNull() & read.isNull()).alias(f"{c}:failing"))
    zero = F.lit(0).cast("bigint")
    found = []
    for c in sorted(have | set(expected)):
        nulls = F.col(f"`{c}:nulls`") if c in have else F.col("rows")
        failing = F.col(f"`{c}:failing`") if c in have and c in expected else zero
        severity = F.lit("error") if c not in have else F.lit("warning") if c not in expected else F.when(
            failing > 0, "error").otherwise("ok")
        found.append(F.struct(F.lit(table).alias("table"), severity.alias("severity"), F.lit(c).alias("column"),
                              F.col("rows"), nulls.alias("nulls"), failing.alias("failing")))
    return df.agg(*counted).select(F.inline(F.array(*found)))


def is_subset(part: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """One row: how many distinct keys, how many of them are in ``whole``, and whether all are."""
    keys = part.select(key).distinct()
    known = whole.select(key).distinct().withColumn("_in", F.lit(True))
    return keys.join(known, key, "left").agg(
        F.count("*").alias("keys"), F.count("_in").alias("shared")
    ).withColumn("subset", F.col("keys") == F.col("shared"))
