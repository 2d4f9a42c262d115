"""Displays and reports: passages, citations, service links, official definitions, review queue, health, scorecard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import fold_plain

BARE_URL = r"^[-*•\s]*(https?://\S+)$"


def passages(hits: DataFrame, by: str) -> DataFrame:
    """(by, passages): numbered passages with their titles, parted by rules, in order of ``position``."""
    label = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(" ("), F.coalesce("page", F.lit("")), F.lit(")"))
    label = F.concat(label, F.coalesce(F.concat(F.lit(" — situation: "), F.nullif("situation", F.lit(""))), F.lit("")))
    block = F.struct("position", F.concat(label, F.lit("\n"), F.col("text")).alias("b"))
    return hits.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]), "\n\n---\n\n").alias("passages"))


def updated_label(day: Column, plausible: Column) -> Column:
    known = F.nullif(F.coalesce(day, F.lit("")), F.lit(""))
    said = F.concat(F.lit("last updated "), known)
    return F.when(known.isNull(), "update date unavailable").when(plausible, said).otherwise(F.concat(said, F.lit(" (date as published; appears mistyped)")))


def service_links(hits: DataFrame, by: str, official: list[str], limit: int = 3) -> DataFrame:
    """(by, rank, title, url): bare addresses of official hosts, each once, named by the nearest other line of the three above."""
    lines = hits.select(by, "position", F.posexplode(F.transform(F.split("text", "\n"), lambda x: F.trim(x))).alias("line_no", "line"))
    w = Window.partitionBy(by, "position").orderBy("line_no").rowsBetween(-3, -1)
    name = F.last(F.when((F.col("line") != "") & ~F.col("line").rlike(BARE_URL), F.col("line")), ignorenulls=True).over(w)
    url = F.regexp_replace(F.regexp_extract("line", BARE_URL, 1), "[.,;)]+$", "")
    rows = lines.withColumns({"title": name, "url": url}).where("url <> '' and title is not null")
    host = F.lower(F.regexp_extract("url", "^https?://([^/:]+)", 1))
    ok = F.lit(False)
    for d in official:
        ok = ok | (host == d) | F.endswith(host, F.lit(f".{d}"))
    first = rows.where(ok).groupBy(by, "url").agg(F.min(F.struct("position", "line_no", "title")).alias("s"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("s.position", "s.line_no"))
    return first.select(by, rank.alias("rank"), F.col("s.title").alias("title"), "url").where(F.col("rank") <= limit)


def match_official(terms: DataFrame, official: DataFrame) -> DataFrame:
    """(term, ref, how): the official definition of each term: same title, title without its bracket, or the only title it begins.

    ``official`` has (ord, ref, title). Prefix matches come from an equi-join on the words that a title begins with.
    """
    o = official.withColumns({"key": fold_plain(F.col("title")), "bare": fold_plain(F.regexp_replace("title", r"\s*\([^)]*\)\s*$", ""))})
    t = terms.select("term", fold_plain(F.col("term")).alias("key"))
    exact = t.join(o.select("key", "ref", "ord"), "key").groupBy("term").agg(F.min_by("ref", "ord").alias("ref"), F.lit(0).alias("tier"))
    bare = t.join(o.select(F.col("bare").alias("key"), "ref", "ord"), "key").groupBy("term").agg(F.min_by("ref", "ord").alias("ref"), F.lit(1).alias("tier"))
    words = F.split("key", " ")
    starts = o.select("ref", "ord", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))).alias("begin"), "key")
    prefix = t.join(starts.where("begin <> key").select(F.col("begin").alias("key"), "ref"), "key").groupBy("term").agg(F.min("ref").alias("ref"), F.count("*").alias("n")).where("n = 1").select("term", "ref", F.lit(2).alias("tier"))
    best = exact.unionByName(bare).unionByName(prefix).groupBy("term").agg(F.min_by(F.struct("ref", "tier"), "tier").alias("b"))
    return best.select("term", F.col("b.ref").alias("ref"), F.element_at(F.array(F.lit("exact"), F.lit("unqualified"), F.lit("prefix")), F.col("b.tier") + 1).alias("how"))


def review_queue(changes: DataFrame, conflicts: DataFrame, claims: DataFrame, incidents: DataFrame) -> DataFrame:
    """(kind, id, source): everything that waits for a person. Each input has (id, source, status)."""
    parts = [(changes, "change", "open"), (conflicts, "conflict", "open"), (claims, "stale_claim", "stale_pending_review"), (incidents, "incident", "open")]
    rows = [df.where(F.col("status") == status).select(F.lit(kind).alias("kind"), "id", "source") for df, kind, status in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def set_status(rows: DataFrame, moves: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """``rows`` with new statuses from ``moves`` (key, status); running it fails on a status that isn't allowed."""
    new = moves.select(key, F.when(F.col("status").isin(allowed), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("no such status: "), "status"))).alias("_new"))
    return rows.join(new, key, "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def scorecard(counts: DataFrame, rules: dict[str, tuple[str, int]]) -> DataFrame:
    """(capability, status, evidence) from one row of counts: verified at its least count, observed above zero, else not observed. ``rules``: capability to (column, least)."""
    rows = [
        F.struct(
            F.lit(name).alias("capability"),
            F.when(F.col(c) >= least, "production_verified").when(F.col(c) > 0, "mechanism_verified").otherwise("not_observed").alias("status"),
            F.concat(F.col(c).cast("string"), F.lit(f" {c}")).alias("evidence"),
        )
        for name, (c, least) in rules.items()
    ]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def corpus_stats(docs: DataFrame, day: str, plausible: str) -> DataFrame:
    ok = F.when(F.col(plausible), F.col(day))
    return docs.agg(F.count("*").alias("documents"), F.min(ok).alias("oldest"), F.max(ok).alias("newest"))


def procedure_label(ids: Column) -> Column:
    """Names of procedures, by id."""
    from lumenfold.functions.facts import LABELS

    table = F.create_map(*[x for k, v in LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.array_join(F.transform(F.array_sort(ids), lambda i: F.coalesce(F.try_element_at(table, i), i)), ", ")


def build_glossary(authored: DataFrame, official: DataFrame) -> DataFrame:
    """(term, explanation, source, definition_id): the official definition of each term where one matches, else the authored one. ``official`` has (ord, ref, title, body)."""
    hit = match_official(authored.select("term"), official.select("ord", "ref", "title")).select("term", "ref")
    both = authored.join(hit, "term", "left").join(official.select("ref", "body"), "ref", "left")
    return both.select("term", F.coalesce("body", "explanation").alias("explanation"), F.when(F.col("body").isNotNull(), "official").otherwise("authored").alias("source"), F.when(F.col("body").isNotNull(), F.col("ref")).alias("definition_id"))
