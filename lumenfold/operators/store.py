"""The store of page versions: what a fetch does to it, which version answers, what it says, and what that makes doubtful."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import word_count
from lumenfold.operators import claims as C
from lumenfold.operators import pages as P
from lumenfold.sources.atomic import AtomicStore


def version_id(at: Column, digest: Column) -> Column:
    return F.concat(F.date_format(at, "yyyyMMdd'T'HHmmss'Z-'"), F.substring(digest, 1, 8))


def sync(fetches: DataFrame, active: DataFrame, least_words: int = 40) -> DataFrame:
    """One row a fetch: what it changes, and what is done with it.

    ``fetches`` has (source_id, url, retrieved_at, content_hash, title, text, error, status), one a page; text is null where it
    failed. ``active`` has (source_id, url, version_id, content_hash, title, text). A failed fetch and a page with nothing to read
    keep the version that answers; the same content changes nothing; any other page becomes the active version, and a substantive change
    drops what was derived from the one before.
    """
    old = active.select("source_id", "url", F.col("version_id").alias("previous_version"), F.col("content_hash").alias("_hash"), F.col("title").alias("_title"), F.col("text").alias("_text"))
    rows = P.compare(fetches.join(old, ["source_id", "url"], "left"), "_text", "text", "_title", "title")
    failed = F.col("text").isNull()
    unusable = ~failed & ((F.coalesce("title", F.lit("")) == "") | (word_count(F.col("text")) < least_words))
    same = ~failed & ~unusable & F.coalesce(F.col("_hash") == F.col("content_hash"), F.lit(False))
    quiet = failed | unusable | same
    none = F.array().cast("array<string>")
    real = P.is_substantive(F.col("change_type"))
    action = F.when(failed, "kept previous version").when(unusable, "refused: no usable content, previous version kept").when(same, "unchanged").when(real, "activated · derived caches invalidated").when(F.col("change_type") == "none", "unchanged").otherwise("activated")
    out = P.staged(
        rows, action=action, kind=F.when(quiet, "none").otherwise(F.col("change_type")), level=F.when(quiet, "low").otherwise(F.col("severity")), names=F.when(quiet, none).otherwise(F.slice("categories", 1, 4)),
        doubtful=F.when(quiet, none).otherwise(F.col("affected_topics")), said=F.when(failed, "").when(unusable, "refused: no usable content").when(same, "identical content").otherwise(F.col("summary")),
        incident=F.when(failed, P.incident_kind(F.col("error"), F.col("status"))), recovered=~failed & ~unusable,
        new_version=F.when(~failed & ~unusable, F.when(same, F.col("previous_version")).otherwise(version_id(F.col("retrieved_at"), F.col("content_hash")))),
    )
    keep = ["source_id", "url", "retrieved_at", "content_hash", "title", "text", "previous_version"]
    return out.select(*keep, "action", F.col("kind").alias("change_type"), F.col("level").alias("severity"), F.col("names").alias("categories"), F.col("doubtful").alias("affected_topics"), F.col("said").alias("summary"), "incident", "recovered", F.col("new_version").alias("version_id"))


def activated(synced: DataFrame, active: DataFrame) -> DataFrame:
    """The pointers to active versions after a sync: one row a page."""
    cols = ["source_id", "url", "version_id", "content_hash", "title", "text"]
    new = synced.where(F.startswith("action", F.lit("activated"))).select(*cols)
    return active.select(*cols).join(new.select("source_id", "url"), ["source_id", "url"], "left_anti").select(*cols).unionByName(new)


def versions(synced: DataFrame) -> DataFrame:
    """Rows for the history: what a sync stored anew."""
    new = synced.where(F.startswith("action", F.lit("activated")))
    return new.withColumn("word_count", word_count(F.col("text"))).select("source_id", "url", "version_id", "retrieved_at", "content_hash", "title", "text", "previous_version", "change_type", "summary", "word_count")


def claims_moved(synced: DataFrame, active: DataFrame) -> DataFrame:
    """(source_id, url, claim_id, status, claim_text): claims that a substantive change adds, removes or keeps."""
    real = synced.where(F.startswith("action", F.lit("activated")) & P.is_substantive(F.col("change_type"))).select("source_id", "url", "text", F.lit("b").alias("side"))
    was = active.join(real.select("source_id", "url"), ["source_id", "url"], "left_semi").select("source_id", "url", "text", F.lit("a").alias("side"))
    held = C.extract(real.unionByName(was), ["source_id", "url", "side"], "source_id", "text")
    both = held.groupBy("source_id", "url", "claim_id").agg(F.bool_or(F.col("side") == "a").alias("a"), F.bool_or(F.col("side") == "b").alias("b"), F.min("claim_text").alias("claim_text"))
    return both.select("source_id", "url", "claim_id", F.when(F.col("a") & F.col("b"), "kept").when(F.col("a"), "removed").otherwise("added").alias("status"), "claim_text")


def audit(synced: DataFrame) -> DataFrame:
    """(at, event, source, detail, fields): what a sync writes to the audit log, several events for a change that someone has to look at."""
    on, real = F.startswith("action", F.lit("activated")), P.is_substantive(F.col("change_type"))
    tests = [
        ("sync.fetch_failed", F.col("action") == "kept previous version"), ("version.refused", F.startswith("action", F.lit("refused"))), ("version.unchanged", F.col("action") == "unchanged"), ("version.activated", on),
        ("cache.invalidated", on & real), ("source.change_needs_review", on & real & P.needs_attention(F.col("severity"))),
    ]
    names = F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in tests]))
    fields = F.create_map(F.lit("url"), F.col("url"), F.lit("version"), F.coalesce("version_id", F.lit("")), F.lit("change"), F.col("change_type"), F.lit("severity"), F.col("severity"))
    return synced.select(F.col("retrieved_at").alias("at"), F.explode(names).alias("event"), F.col("source_id").alias("source"), F.col("summary").alias("detail"), fields.alias("fields"))


def review_changes(synced: DataFrame, moved: DataFrame) -> DataFrame:
    """Changes filed for review: (change_id, source, url, old_version, new_version, detected_at, severity, summary, before_after, affected_topics, affected_claims, review_status)."""
    said = lambda status: F.slice(F.array_sort(F.collect_list(F.when(F.col("status") == status, F.col("claim_text")))), 1, 10)
    told = moved.groupBy("source_id", "url").agg(said("removed").alias("gone"), said("added").alias("come"))
    rows = synced.where(F.startswith("action", F.lit("activated")) & P.is_substantive(F.col("change_type")) & P.needs_attention(F.col("severity"))).join(told, ["source_id", "url"], "left")
    none = F.array().cast("array<string>")
    gone, come = F.coalesce("gone", none), F.coalesce("come", none)
    return rows.select(
        F.concat(F.lit("CHANGE-"), "version_id").alias("change_id"), F.col("source_id").alias("source"), "url", F.col("previous_version").alias("old_version"), F.col("version_id").alias("new_version"), F.col("retrieved_at").alias("detected_at"),
        "severity", "summary", P.before_after(gone, come).alias("before_after"), "affected_topics", gone.alias("affected_claims"), F.lit("open").alias("review_status"),
    )


def review_conflicts(conflicts: DataFrame) -> DataFrame:
    """Contradictions filed for review, with the resolution that the rules prefer."""
    return conflicts.withColumns({"review_status": F.lit("open"), "recommended_resolution": F.col("prefer"), "recommended_reason": F.col("prefer_reason")})


def listing(records: DataFrame, id_col: str, status_col: str, status: str | None = None, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Records of a queue, the newest id first, of one status if given; a status that isn't allowed is an error."""
    if status and allowed and status not in allowed:
        raise ValueError(f"{status!r} is none of {', '.join(allowed)}")
    return (records.where(F.col(status_col) == status) if status else records).orderBy(F.desc(id_col))


def archive_resolved(records: DataFrame, status_col: str = "status") -> DataFrame:
    """``records`` with resolved ones archived."""
    return records.withColumn(status_col, F.when(F.col(status_col) == "resolved", "archived").otherwise(F.col(status_col)))


def free_id(records: DataFrame, day: Column, prefix: str = "BUG") -> DataFrame:
    """(day, next_id): the smallest number over the count of a day's ids that none of them has; ``records`` has (id), ids like BUG-20240501-003."""
    rows = records.where(F.col("id").rlike(rf"^{prefix}-\d{{8}}-\d{{3,}}$")).select(F.regexp_extract("id", r"-(\d{8})-", 1).alias("day"), F.regexp_extract("id", r"-(\d{3,})$", 1).cast("int").alias("n")).distinct()
    taken = rows.where(F.col("day") == F.date_format(day, "yyyyMMdd")).groupBy("day").agg(F.array_sort(F.collect_set("n")).alias("taken"))
    free = F.array_min(F.array_except(F.sequence(F.size("taken") + 1, F.size("taken") * 2 + 1), F.col("taken")))
    return taken.select("day", F.concat(F.lit(f"{prefix}-"), "day", F.lit("-"), F.format_string("%03d", free)).alias("next_id"))


def save_partitioned(df: DataFrame, path: str, by: list[str]) -> int:
    """Saves the partitions that ``df`` has anew and leaves others, in one commit: claims by source and version, reports by status. Returns the store's version."""
    store = AtomicStore(df.sparkSession, path)
    return store.commit(store.upsert("rows", df, by))


def saved(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All partitions, as of a version of the store."""
    return AtomicStore(spark, path).read("rows", version)


def load_claims(spark: SparkSession, path: str, source: str, version: str) -> DataFrame:
    """The claims of one version: only the bucket that can hold them is read."""
    return AtomicStore(spark, path).read("rows", source_id=source, version_id=version)


def append_conflicts(conflicts: DataFrame, path: str) -> int:
    """Adds to the conflict log; those who add at once don't disturb each other."""
    store = AtomicStore(conflicts.sparkSession, path)
    return store.commit(store.append("conflicts", conflicts))


def read_conflicts(spark: SparkSession, path: str) -> DataFrame:
    return AtomicStore(spark, path).read("conflicts")


def write_snapshot(df: DataFrame, root: str, stamp: str) -> int:
    """The latest snapshot and its row in the history, in one commit: no reader sees one without the other."""
    store = AtomicStore(df.sparkSession, root)
    return store.commit(store.overwrite("latest", df), store.append("history", df.withColumn("at", F.lit(stamp))))


def read_latest(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The last snapshot written; empty where there is none yet."""
    return AtomicStore(spark, root).read("latest", schema=schema)


def read_history(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Every snapshot with its stamp, ``at``."""
    return AtomicStore(spark, root).read("history", schema=f"{schema}, at string")


def set_fields(spark: SparkSession, root: str, changes: DataFrame, key: str = "id") -> int:
    """Writes fields of a register in place: where ``changes`` (the key and some of the register's columns) has a value, it replaces the old one. One commit."""
    store = AtomicStore(spark, root)
    rows = store.read("rows").alias("r").join(changes.alias("c"), key)
    now = [F.coalesce(F.col(f"c.{c}"), F.col(f"r.{c}")).alias(c) if c in changes.columns else F.col(f"r.{c}") for c in store.read("rows").columns if c != key]
    return store.commit(store.upsert("rows", rows.select(key, *now), [key]))


def within_days(snapshots: DataFrame, at: str, now: Column, days: int = 30) -> DataFrame:
    """Snapshots that are kept: those of the last ``days``."""
    return snapshots.where(F.col(at) >= now - F.make_dt_interval(days=F.lit(days)))


def claim_metrics(claims: DataFrame, active: DataFrame) -> DataFrame:
    """(active, stale, with_effective_date): one row over the claims of active versions."""
    held = claims.join(active.select("source_id", "version_id"), ["source_id", "version_id"], "left_semi")
    current = F.col("status") == "current"
    return held.agg(F.count_if(current).alias("active"), F.count_if(~current).alias("stale"), F.count_if(F.col("effective_from").isNotNull()).alias("with_effective_date"))


def open_incidents(incidents: DataFrame) -> DataFrame:
    """(source, open, kinds): what is wrong with each source now."""
    rows = incidents.where("current_status = 'open'")
    return rows.groupBy("source").agg(F.count("*").alias("open"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


# Capability, the count that proves it, and its status where that is 0 and above.
CAPABILITIES = [
    ("national_routing", "live_national", "not_observed", "production_verified"), ("local_jurisdiction", "live_local", "not_observed", "production_verified"), ("institution_routing", "live_institution", "not_observed", "production_verified"),
    ("live_retrieval", "live", "not_observed", "production_verified"), ("rendered_retrieval", "live_rendered", "not_observed", "production_verified"), ("freshness", "fresh", "not_observed", "production_verified"),
    ("claim_provenance", "claims_active", "not_observed", "production_verified"), ("effective_dates", "claims_dated", "mechanism_verified", "production_verified"), ("historical_retrieval", "deep_sources", "insufficient_history", "production_verified"),
    ("conflict_detection", "conflicts", "mechanism_verified", "production_verified"), ("change_detection", "real_changes", "mechanism_verified", "production_verified"), ("smtp", "email_configured", "not_configured", "mechanism_verified"),
    ("watched_authority", "watched_usable", "authority_unavailable", "production_verified"), ("blocked_sources", "blocked", "not_observed", "blocked"), ("failed_sources", "unavailable", "not_observed", "failed"),
]


def scorecard(counts: DataFrame) -> DataFrame:
    """(capability, status, evidence) of the fifteen capabilities from one row of counts; a watched authority that is blocked is blocked, not unavailable."""
    rows = []
    for name, column, without, with_ in CAPABILITIES:
        status = F.when(F.col(column) > 0, with_).otherwise(without)
        if name == "watched_authority":
            status = F.when(F.col("watched_blocked") > 0, "blocked").otherwise(status)
        rows.append(F.struct(F.lit(name).alias("capability"), status.alias("status"), F.concat(F.col(column).cast("string"), F.lit(f" {column}")).alias("evidence")))
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def source_counts(sources: DataFrame, watched: str) -> DataFrame:
    """One row of what the scorecard counts of sources: (id, mode, health, jurisdiction, verified, due)."""
    live = F.col("mode") == "live_query"
    at = lambda level: live & (F.col("jurisdiction") == level)
    usable = F.col("verified") & F.col("health").isin("healthy", "healthy_rendered", "stale", "changed")
    return sources.agg(
        F.count_if(at("national")).alias("live_national"), F.count_if(at("department")).alias("live_local"), F.count_if(at("institution")).alias("live_institution"), F.count_if(live).alias("live"),
        F.count_if(live & (F.col("health") == "healthy_rendered")).alias("live_rendered"), F.count_if(usable & ~F.col("due")).alias("fresh"), F.count_if(F.col("health") == "blocked").alias("blocked"),
        F.count_if(F.col("health") == "unavailable").alias("unavailable"), F.count_if((F.col("id") == watched) & usable).alias("watched_usable"), F.count_if((F.col("id") == watched) & (F.col("health") == "blocked")).alias("watched_blocked"),
        F.count("*").alias("registered"), F.count_if(usable).alias("citable"), F.count_if(usable & F.col("due")).alias("due"),
    )


def snapshot(sources: DataFrame, changes: DataFrame, conflicts: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row on the state of everything: sources (registered, citable, live, blocked, unavailable, current, due), open changes by severity, open conflicts and incidents, and whether someone has to look."""
    s = sources.select("registered", "citable", "live", "blocked", "unavailable", (F.col("citable") - F.col("due")).alias("current"), "due")
    level = lambda name: F.count_if(F.col("severity") == name).alias(f"changes_{name}")
    c = changes.where("review_status = 'open'").agg(level("critical"), level("high"), F.count("*").alias("changes_open"))
    k = conflicts.where("review_status = 'open'").agg(F.count("*").alias("conflicts_open"))
    i = incidents.where("current_status = 'open'").agg(F.count("*").alias("incidents_open"))
    attention = (F.col("changes_critical") > 0) | (F.col("conflicts_open") > 0) | (F.col("incidents_open") > 0)
    return s.crossJoin(c).crossJoin(k).crossJoin(i).withColumn("needs_attention", attention)  # one row each


def latest_versions(versions_: DataFrame) -> DataFrame:
    """The newest stored version of each page."""
    newest = F.row_number().over(Window.partitionBy("source_id", "url").orderBy(F.desc("retrieved_at"), F.desc("version_id")))
    return versions_.withColumn("_n", newest).where("_n = 1").drop("_n")
