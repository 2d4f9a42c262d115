"""What the registry of sources decides: which may be cited or fetched, whom to ask about a question, and reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hours until a source of each priority is due, media types that can be read, and bounds of a fetch.
REFRESH_HOURS = {"critical": 8, "high": 24, "medium": 72, "low": 336}
READABLE = ("text/html", "application/xhtml+xml", "text/plain", "application/xml", "text/xml")
MAX_BYTES, MAX_REDIRECTS = 3_000_000, 5
ACCESS = {"blocked": "bot protection; not bypassed", "parser_failure": "fetched, but nothing readable came out", "unavailable": "could not be reached", "unverified": "never checked against the live site"}
CITABLE = ("healthy", "healthy_rendered", "stale", "changed")


def usable(verified: Column, health: Column) -> Column:
    """Whether a source may be cited."""
    return verified & health.isin(*CITABLE)


def refresh_hours(priority: Column) -> Column:
    table = F.create_map(*[x for k, v in REFRESH_HOURS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, priority), F.lit(REFRESH_HOURS["medium"]))


def domains(domain: Column, aliases: Column, legacy: Column) -> Column:
    """Every host that may serve a source, the one of today first."""
    clean = F.transform(F.concat(F.array(domain), aliases, legacy), lambda d: F.regexp_replace(F.lower(F.trim(F.coalesce(d, F.lit("")))), r"^\.+", ""))
    return F.array_distinct(F.filter(clean, lambda d: d != ""))


def for_key(wanted: DataFrame, key: str, sources: DataFrame, held: str) -> DataFrame:
    """``wanted`` with ``rank`` and ``source_id`` of the sources that list its key in their array ``held``, the most authoritative first."""
    listed = sources.select(F.col("id").alias("source_id"), "authority_level", "file_order", F.explode(F.array_distinct(F.transform(held, F.lower))).alias("_k"))
    hit = wanted.withColumn("_k", F.lower(F.trim(F.col(key)))).join(listed, "_k").drop("_k")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("authority_level", "file_order", "source_id"))
    return hit.withColumn("rank", rank).drop("authority_level", "file_order")


def by_jurisdiction(sources: DataFrame, level: str, area: str = "") -> DataFrame:
    """Sources of a level, and of an area where one is given."""
    rows = sources.where(F.col("jurisdiction") == level)
    return rows.where(F.lower("jurisdiction_area") == area.strip().lower()) if area.strip() else rows


def authoritative(urls: DataFrame, host: str, sources: DataFrame) -> DataFrame:
    """``urls`` with ``source_id`` and ``authoritative``: a registered source that may be cited serves the host, or a parent of it."""
    from lumenfold.operators.lookup import for_host

    served = sources.select(F.explode(domains(F.col("domain"), F.col("aliases"), F.col("legacy_domains"))).alias("domain"), F.col("id").alias("source_id"), "file_order")
    found = for_host(urls.where(~F.coalesce(F.col(host).rlike(r"^[\d.]+$|^\["), F.lit(False))), host, served)
    ok = found.join(sources.select(F.col("id").alias("source_id"), usable(F.col("verified"), F.col("health")).alias("authoritative")), "source_id", "left")
    return urls.join(ok.select(*urls.columns, "source_id", "authoritative"), urls.columns, "left").withColumn("authoritative", F.coalesce("authoritative", F.lit(False)))


def fetch_refusal(url: Column, redirects: Column, media: Column, allowed: Column) -> Column:
    """Why a fetch is refused; null where it isn't. ``allowed``: hosts of the source that is expected; every hop has to stay on them, over https."""
    host = lambda u: F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    serves = lambda u: F.exists(allowed, lambda d: (host(u) == d) | F.endswith(host(u), F.concat(F.lit("."), d))) & ~host(u).rlike(r"^[\d.]+$|^\[")
    kind = F.trim(F.split(F.coalesce(media, F.lit("")), ";")[0])
    readable = F.exists(F.array(*[F.lit(t) for t in READABLE]), lambda t: F.startswith(kind, t))
    hops = F.coalesce(redirects, F.array().cast("array<string>"))
    plain, strange = F.get(F.filter(hops, lambda r: ~F.startswith(r, F.lit("https://"))), 0), F.get(F.filter(hops, lambda r: ~serves(r)), 0)
    return (
        F.when(~F.coalesce(url, F.lit("")).startswith("https://"), "refused: only https is fetched")
        .when(~serves(url), F.concat(F.lit("refused: '"), host(url), F.lit("' is not a registered source")))
        .when(plain.isNotNull(), "refused: redirect left https")
        .when(strange.isNotNull(), F.concat(F.lit("refused: redirect to '"), host(strange), F.lit("'")))
        .when(F.size(hops) > MAX_REDIRECTS, "refused: too many redirects")
        .when((kind != "") & ~readable, F.concat(F.lit("refused: content type '"), kind, F.lit("' is not readable")))
    )


def host_of(final_url: Column, url: Column) -> Column:
    """The host that a fetch ended on, or was asked for where it ended nowhere; null for neither."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(F.nullif(final_url, F.lit("")), url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def cached(fetches: DataFrame, now: Column, most_seconds: int) -> DataFrame:
    """(url_key, ...): the last good fetch of each address, if it isn't older than ``most_seconds``."""
    age = F.unix_timestamp(now) - F.unix_timestamp("retrieved_at")
    last = F.row_number().over(Window.partitionBy("url").orderBy(F.desc("retrieved_at")))
    rows = fetches.where("ok").withColumn("_n", last).where("_n = 1").drop("_n")
    return rows.where(age <= most_seconds).withColumn("url_key", F.substring(F.sha2(F.col("url").cast("binary"), 256), 1, 24))


def check(fetched: Column, refused: Column, readable: Column, rendered: Column) -> Column:
    """The health that one look at a source's page finds. ``refused`` is the health that a refused fetch tells (see ``decisions.refusal``)."""
    return F.when(~fetched & ~readable, refused).when(~readable, "parser_failure").when(rendered, "healthy_rendered").otherwise("healthy")


def topics_for(questions: DataFrame, topics: DataFrame) -> DataFrame:
    """(question, topic, score, rank): topics that the purposes of a question belong to; the strongest purposes, which come first, count most, ties keep the file's order."""
    asked = questions.select("question", F.size("purposes").alias("_n"), F.posexplode("purposes").alias("_at", "purpose"))
    held = topics.select(F.col("id").alias("topic"), "file_order", F.explode(F.array_distinct("purposes")).alias("purpose"))
    got = asked.join(held, "purpose").groupBy("question", "topic", "file_order").agg(F.sum(F.col("_n") - F.col("_at")).alias("score"))
    return got.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "file_order"))).drop("file_order")


def speaks_to(sources: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, source_id): sources that name a purpose of the topic, hyphened or within a longer id, and sources that name nothing."""
    wanted = topics.select(F.col("id").alias("topic"), F.explode(F.array_distinct("purposes")).alias("p")).select("topic", "p", F.translate("p", "_", "-").alias("w"))
    some = sources.select(F.col("id").alias("source_id"), F.explode("supported_topics").alias("t"))
    general = sources.where(F.size("supported_topics") == 0).select(F.col("id").alias("source_id")).crossJoin(topics.select(F.col("id").alias("topic")))  # two maintainers' tables
    named = some.join(F.broadcast(wanted), (F.col("t") == F.col("p")) | F.contains("t", "w")).select("topic", "source_id")  # as many rows as registry topics
    return named.unionByName(general.select("topic", "source_id")).distinct()


def plan(questions: DataFrame, topics: DataFrame, sources: DataFrame) -> DataFrame:
    """One row a question: topic, steps (in order: source_id, reason, mode), live_steps, unreachable, unreachable_deciders, needs_place, fall_back, has_authority.

    ``questions`` has (question, purposes, entity, authority_source: the authority of the reader's place, null where the place isn't
    known), ``sources`` the registry's columns and ``mode``. An institution speaks for itself; then the local authority, if the topic
    is administered locally and it speaks to the topic; then the classes of bodies that the topic prefers.

    Topic, institution and authority decide all of it: each combination that is asked for is planned once, and questions take the plan of theirs.
    """
    first = topics_for(questions, topics).where("rank = 1").select("question", "topic")
    t = topics.select(F.col("id").alias("topic"), "preferred", "fallback")
    every = questions.join(first.hint("shuffle_merge"), "question", "left").withColumn("_ask", F.struct("topic", "entity", "authority_source"))
    asked = every.select(F.col("_ask").alias("question"), "_ask.*").distinct().join(t, "topic", "left")
    local = F.coalesce(F.array_contains("preferred", "local_authority"), F.lit(False))
    s = sources.select(F.col("id").alias("source_id"), "name", "source_type", "authority_level", "mode", "file_order", "supported_entities")
    fits = speaks_to(sources, topics)
    own = asked.where(F.coalesce("entity", F.lit("")) != "").join(s.select("source_id", F.explode("supported_entities").alias("entity")), "entity").select("question", "source_id", F.lit(0).alias("class"), F.lit("institution").alias("reason"))
    near = asked.where(local).join(fits, "topic").where(F.col("authority_source") == F.col("source_id")).select("question", "source_id", F.lit(1).alias("class"), F.lit("local authority").alias("reason"))
    wants = asked.where("topic is not null").select("question", "topic", F.posexplode("preferred").alias("at", "wanted")).where("wanted <> 'local_authority'")
    kind = s.select("source_id", F.when(F.col("source_id") == "service-public", F.array(F.lit("corpus"), F.col("source_type"))).otherwise(F.array("source_type")).alias("kinds")).select("source_id", F.explode("kinds").alias("wanted"))
    wide = wants.join(kind, "wanted").join(fits, ["topic", "source_id"]).select("question", "source_id", (F.col("at") + 2).alias("class"), F.col("wanted").alias("reason"))
    once = own.unionByName(near).unionByName(wide).groupBy("question", "source_id").agg(F.min(F.struct("class", "reason")).alias("c")).join(s, "source_id")
    down = F.col("mode") == "unavailable"
    order = lambda test, *more: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("c.class", "authority_level", "file_order", *more)))), lambda x: x)
    step = F.struct("source_id", F.col("c.reason").alias("reason"), "mode").alias("step")
    steps = once.groupBy("question").agg(order(~down, step).alias("s"), order(down, "name").alias("u"), order(down & (F.col("authority_level") == 1), "name").alias("d"))
    out = asked.join(steps, "question", "left")
    names = lambda c: F.coalesce(F.transform(c, lambda x: x["name"]), F.array().cast("array<string>"))
    rows = F.coalesce(F.transform("s", lambda x: x["step"]), F.array().cast("array<struct<source_id:string,reason:string,mode:string>>"))
    plans = out.select(
        F.col("question").alias("_ask"), rows.alias("steps"), F.filter(rows, lambda x: x["mode"] == "live_query").alias("live_steps"), names("u").alias("unreachable"), names("d").alias("unreachable_deciders"),
        (local & F.col("authority_source").isNull()).alias("needs_place"), (F.col("topic").isNull() | F.coalesce(F.array_contains("fallback", "corpus"), F.lit(False))).alias("fall_back"), (F.size(rows) > 0).alias("has_authority"),
    )
    return every.select("question", "topic", "_ask").join(plans.hint("shuffle_merge"), "_ask", "left").drop("_ask")


def coverage(topics: DataFrame, sources: DataFrame) -> DataFrame:
    """(topic, sources, live, cached, unavailable, deciders_down, status): how well each topic can be answered now.

    A topic is complete if something can be read live, its local authority too where it needs one, and no body that decides it is down.
    """
    named = sources.where(F.size("supported_topics") > 0)
    rows = speaks_to(named, topics).join(named.select(F.col("id").alias("source_id"), "mode", "authority_level", "jurisdiction"), "source_id")
    is_ = lambda mode: F.col("mode") == mode
    got = rows.groupBy("topic").agg(
        F.count("*").alias("sources"), F.count_if(is_("live_query")).alias("live"), F.count_if(is_("cached_only")).alias("cached"), F.count_if(is_("unavailable")).alias("unavailable"),
        F.count_if((F.col("authority_level") == 1) & is_("unavailable")).alias("deciders_down"), F.bool_or(is_("live_query") & (F.col("jurisdiction") == "department")).alias("_local"),
    )
    all_ = topics.select(F.col("id").alias("topic"), F.array_contains("preferred", "local_authority").alias("_needs")).join(got, "topic", "left").fillna(0)
    complete = (F.col("live") > 0) & (~F.col("_needs") | F.coalesce("_local", F.lit(False))) & (F.col("deciders_down") == 0)
    status = F.when(complete, "complete").when((F.col("live") > 0) | (F.col("cached") > 0), "partial").otherwise("missing")
    return all_.withColumn("status", status).drop("_local", "_needs")


def describe(sources: DataFrame, versions: DataFrame, claims: DataFrame, conflicts: DataFrame, now: Column) -> DataFrame:
    """One row a source: its versions, claims, conflicts, when it is due, why it can't be read, and how current it is.

    ``versions`` has (source_id, version_id, retrieved_at, change_type), ``claims`` (source_id, version_id, status, effective_from),
    ``conflicts`` (source_a, source_b).
    """
    seen = versions.groupBy("source_id").agg(
        F.count("*").alias("versions"), F.max("retrieved_at").alias("last_checked"), F.max_by("version_id", F.struct("retrieved_at", "version_id")).alias("current_version"),
        F.max(F.when(F.col("change_type").isin("substantive", "critical"), F.col("retrieved_at"))).alias("last_change"),
    )
    held = claims.join(seen.select("source_id", F.col("current_version").alias("version_id")), ["source_id", "version_id"]).groupBy("source_id").agg(
        F.count("*").alias("claims"), F.count_if(F.col("status") != "current").alias("claims_stale"), F.count_if(F.col("effective_from").isNotNull()).alias("claims_dated")
    )
    argued = conflicts.select(F.explode(F.array_distinct(F.array("source_a", "source_b"))).alias("source_id")).groupBy("source_id").agg(F.count("*").alias("conflicts"))
    hours = refresh_hours(F.col("refresh_priority"))
    rows = sources.withColumnRenamed("id", "source_id")
    for part in (seen, held, argued):
        rows = rows.join(part, "source_id", "left")
    due = F.col("last_checked") + F.make_dt_interval(hours=hours)
    why = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in ACCESS.items() for x in (F.lit(k), F.lit(v))]), F.col("health")), F.lit(""))
    state = F.when(F.coalesce("claims_stale", F.lit(0)) > 0, "pending review").when(F.col("current_version").isNotNull(), "current").otherwise("unknown")
    return rows.fillna(0, ["versions", "claims", "claims_stale", "claims_dated", "conflicts"]).withColumns(
        {"next_refresh": due, "due_now": due.isNull() | (due < now), "access_reason": why, "currentness": state, "parser_mode": F.when(F.col("render_enabled"), "rendered").otherwise("static"), "authority": F.concat(F.lit("L"), "authority_level")}
    )


def counts(sources: DataFrame, by: list[str]) -> DataFrame:
    return sources.groupBy(*by).agg(F.count("*").alias("n"))


def worst_freshness(evidence: DataFrame, by: str) -> DataFrame:
    """(by, freshness): the least fresh of an answer's evidence (answer, freshness); null counts as unknown, and answers without evidence have no row."""
    levels = F.create_map(*[x for i, k in enumerate(("live_verified", "fresh", "stale", "unknown", "unavailable")) for x in (F.lit(k), F.lit(i))])
    state = F.coalesce("freshness", F.lit("unknown"))
    return evidence.groupBy(by).agg(F.max_by(state, F.coalesce(F.try_element_at(levels, state), F.lit(3))).alias("freshness"))


def freshness_key(state: Column) -> Column:
    """The message that tells a reader how current an answer is."""
    return F.when(state == "live_verified", "fresh_live").when(state == "stale", "fresh_stale").when(state.isin("unavailable", "unknown"), "fresh_unavailable").otherwise("fresh_cached")


def versions_used(evidence: DataFrame, by: str) -> DataFrame:
    """(by, versions, local_source): which version of each page an answer rests on, and the first source that isn't a national one. ``evidence`` has (by, position, source_id, url, version_id, jurisdiction)."""
    held = F.when(F.coalesce("version_id", F.lit("")) != "", F.struct(F.concat_ws("|", "source_id", "url").alias("k"), F.col("version_id").alias("v")))
    rows = evidence.groupBy(by).agg(F.array_distinct(F.collect_list(held)).alias("_p"), F.min_by("source_id", F.when(F.col("jurisdiction") != "national", F.col("position"))).alias("local_source"))
    # Of a page that comes twice, the later version counts.
    keys = F.array_sort(F.array_distinct(F.transform("_p", lambda x: x["k"])))
    values = F.transform(keys, lambda k: F.array_max(F.transform(F.filter("_p", lambda x: x["k"] == k), lambda x: x["v"])))
    return rows.select(by, F.map_from_arrays(keys, values).alias("versions"), "local_source")
