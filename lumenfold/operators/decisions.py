"""Decisions by ordered rules: answerability, source promotion, verdict replies, follow-ups, purposes and page types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.text import contains_any, fold_hyphen_underscore, fold_key, tokens

# Openers that continue a question, words without a subject of their own, walls against bots.
ELLIPTICAL = ("and ", "and,", "what about", "how about", "ok and", "also", "then ", "so ", "but ", "what if", "and what", "in that case", "et ", "et pour", "et si", "et quoi", "aussi", "alors", "donc ", "puis ", "mais ", "et dans ce cas", "dans ce cas")
GENERIC = tuple("""
document documents paper papers papier papiers piece pieces justificatif justificatifs form forms formulaire formulaires
cost costs price prices fee fees cout couts coute coutent combien ca cela prix tarif tarifs montant
time deadline delay delays delai delais duree long much many far often souvent longtemps
where who when how what which why quel quels quelle quelles quoi qui ou comment pourquoi quand
need needs needed require required faut besoin fournir apporter do does did is are was were can could should must go
dois doit devons devez doivent aller suis est sont etre avoir ai i me my mine we our us you your it its they them the a an
je me mon ma mes nous notre nos votre vous il elle ce cette les des du de la le next apres ensuite suite step steps etape etapes procedure demarche demarches
then also too encore aussi
""".split())  # fmt: skip
BOT_WALLS = ("perfdrive", "captcha", "botmanager", "challenge")


def answerability(c: dict[str, Column]) -> Column:
    """The state of a question, the worst first. ``c`` has the boolean columns needs_clarification, refused, authority_known, authority_reachable, stale, missing_required, has_institution, retrieved_anything and the counts conflicts and citations."""
    kept = F.when(c["stale"], "stale").when(c["missing_required"], "partial").when(c["citations"] > 0, "supported").otherwise("partial")
    return (
        F.when(c["needs_clarification"], "needs_clarification")
        .when(c["conflicts"] > 0, "conflicting_sources")
        .when(c["authority_known"] & ~c["authority_reachable"], "authority_unavailable")
        .when(c["stale"] & c["refused"], "stale")
        .when(~c["refused"], kept)
        .when(c["authority_known"], "source_gap")
        .when(c["has_institution"], "wrong_source_type")
        .when(~c["retrieved_anything"], "retrieval_failure")
        .otherwise("not_found")
    )


def may_answer(state: Column) -> Column:
    return state == "supported"


def promotion(health: Column, verified: Column, secure: Column, authority_level: Column, named: Column, relevant: Column, stored: Column) -> Column:
    """struct(mode, failed): the mode a source may work in, and the names of the checks it fails."""
    readable = health.isin("healthy", "healthy_rendered", "changed", "stale")
    checks = [("domain_verified", verified), ("extractable", readable), ("security", secure), ("authority", (authority_level <= 2) & named), ("relevance", relevant), ("freshness_metadata", stored)]
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(n)) for n, ok in checks]))
    cached = F.when(stored, "cached_only").otherwise("unavailable")
    mode = F.when(health.isin("blocked", "unavailable", "parser_failure"), cached).when(~verified, "unavailable").when(F.size(failed) == 0, "live_query").otherwise("sync_only")
    return F.struct(mode.alias("mode"), failed.alias("failed"))


def gate_reasons(failed: Column) -> Column:
    """The checks that a source fails, in words."""
    return F.array_join(F.transform(failed, lambda x: F.concat(x, F.lit(": failed"))), "; ")


def read_verdict(reply: Column) -> Column:
    """True for yes, false for no, null where the reply can't be read."""
    text = F.trim(F.coalesce(reply, F.lit("")))
    first, upper = F.regexp_replace(F.upper(F.trim(F.split(text, "\r\n|\n|\r")[0])), "[^A-Z]", ""), F.upper(text)
    yes, no = F.contains(upper, F.lit("YES")), F.contains(upper, F.lit("NO"))
    return F.when(first.startswith("YES"), True).when(first.startswith("NO"), False).when(yes & ~no, True).when(no & ~yes, False)


def retry_after(detail: Column) -> Column:
    """Seconds to wait that a refusal names; 10 where it names none."""
    minutes, rest = F.regexp_extract(detail, r"(?i)try again in (\d+)m([\d.]+)s", 1), F.regexp_extract(detail, r"(?i)try again in (\d+)m([\d.]+)s", 2)
    seconds = F.regexp_extract(detail, r"(?i)try again in ([\d.]+)s", 1)
    return F.when(minutes != "", minutes.try_cast("int") * 60 + rest.try_cast("double")).when(seconds != "", seconds.try_cast("double")).otherwise(10.0)


def refusal(error: Column) -> Column:
    """struct(health, target, note) of a refused fetch."""
    target = F.regexp_extract(F.coalesce(error, F.lit("")), r"(?i)redirect to (\S+)", 1)
    wall = contains_any(F.lower(target), BOT_WALLS)
    health = F.when((target != "") & wall, "blocked").otherwise("unavailable")
    note = F.when(target == "", "").when(wall, "bot protection").otherwise("rebrand candidate")
    return F.struct(health.alias("health"), target.alias("target"), note.alias("note"))


def is_followup(asked: Column, previous: Column) -> Column:
    """The question leans on the one before: it opens like a continuation, or names no subject of its own."""
    text = F.trim(F.coalesce(asked, F.lit("")))
    low = F.lower(text)
    opens = reduce(lambda a, b: a | b, [low.startswith(w) for w in ELLIPTICAL])
    bare = F.size(F.array_except(tokens(text), F.array(*[F.lit(w) for w in GENERIC]))) == 0
    return (text != "") & (F.coalesce(previous, F.lit("")) != "") & (opens | bare)


def followup(asked: Column, previous: Column) -> Column:
    return F.when(is_followup(asked, previous), F.concat(F.trim(previous), F.lit(" — "), F.trim(asked))).otherwise(F.trim(asked))


def purposes(text: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """Ids of the purposes a text serves, most hits first, then by id. A phrase counts three, a word one."""
    folded = fold_hyphen_underscore(text)
    words = F.array_distinct(F.regexp_extract_all(folded, F.lit("([a-z0-9]{3,})"), 1))
    rows = []
    for name, keywords in table.items():
        hits = sum((F.when(F.contains(folded, F.lit(k)), 3).otherwise(0) if " " in k else F.array_contains(words, k).cast("int") for k in keywords), F.lit(0))
        rows.append(F.struct((-hits).alias("minus"), F.lit(name).alias("id")))
    return F.transform(F.array_sort(F.filter(F.array(*rows), lambda x: x["minus"] < 0)), lambda x: x["id"])


def page_type(path: Column, label: Column, rules: list[tuple[str, tuple[str, ...], tuple[str, ...]]]) -> Column:
    """The first rule that fits the path, else the first that fits the label, else unknown. Rules are (id, path parts, label parts)."""
    p, t = fold_hyphen_underscore(path), fold_hyphen_underscore(label)
    tests = [(contains_any(p, paths), name) for name, paths, _ in rules if paths] + [(contains_any(t, titles), name) for name, _, titles in rules if titles]
    return reduce(lambda c, x: c.when(x[0], x[1]), tests[1:], F.when(tests[0][0], tests[0][1])).otherwise("unknown")


def compatible(a: Column, b: Column) -> Column:
    """Unknown on either side is no mismatch."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def verdict_key(question: Column, chunks: Column) -> Column:
    """The same for any order of the chunks and any accents, case or punctuation of the question."""
    return F.substring(F.sha2(F.to_json(F.struct(fold_key(question).alias("q"), F.array_sort(chunks).alias("c"))).cast("binary"), 256), 1, 32)


def may_ask_for(filled: Column, field: Column) -> Column:
    return ~F.array_contains(filled, field)


def keyword_hits(text: Column, keywords: tuple[str, ...]) -> Column:
    """How many keywords a text holds: a phrase counts two, a word one."""
    folded = fold_hyphen_underscore(F.translate(text, "/", " "))
    words = F.array_distinct(F.regexp_extract_all(folded, F.lit("([a-z0-9]{3,})"), 1))
    return sum((F.when(F.contains(folded, F.lit(k)), 2).otherwise(0) if " " in k else F.array_contains(words, k).cast("int") for k in keywords), F.lit(0))


def candidate_score(path: Column, anchor: Column, title: Column, kind: Column, depth: Column, keywords: tuple[str, ...], serving: tuple[str, ...], editorial: tuple[str, ...], language: str, wants_news: bool = False) -> Column:
    """How well a linked page is likely to answer: its label counts most, then its path and title; then its kind, depth and language."""
    hits = keyword_hits(anchor, keywords) * 4.0 + keyword_hits(path, keywords) * 3.0 + keyword_hits(title, keywords) * 2.0
    of_kind = F.when(kind.isin(*serving), 6.0).when(kind.isin("official_procedure", "requirements"), 2.0).otherwise(0.0)
    news = F.when(kind.isin(*editorial), 5.0 if wants_news else -8.0).otherwise(0.0)
    portal = F.when(kind == "application_portal", -1.0).otherwise(0.0)
    parts = F.size(F.filter(F.split(path, "/"), lambda p: p != ""))
    length = F.when(parts.between(1, 4), 1.0).when(parts > 6, -1.0).otherwise(0.0)
    home = F.when(F.contains(path, F.lit(f"/{language}/")), 0.5).otherwise(0.0)
    far = F.when(depth <= 1, 0.0).when(depth == 2, -0.5).otherwise(-2.0)
    return hits + of_kind + news + portal + length + home + far


TRIAGE = "title string, translation string, category string, severity string, expected string, actual string, likely_cause string, suggested_fix string, affected_feature string, confidence string, notes string, reproduction_steps array<string>, needs_more_info boolean"


def read_triage(reply: Column) -> Column:
    """struct of the known keys of a JSON reply, inside a fence or bare; null where it can't be read. Unknown keys fall away, texts are trimmed."""
    text = F.regexp_replace(F.trim(F.coalesce(reply, F.lit(""))), r"(?s)^```(?:json)?\s*(.*?)```.*$", "$1")
    return F.from_json(F.when(text.rlike(r"(?s)^\s*\{.*\}\s*$"), text), TRIAGE, {"mode": "PERMISSIVE"})


def triage_error(reply: Column) -> Column:
    """Why a reply gives no triage; null where it does."""
    parsed = read_triage(reply)
    empty = parsed.isNull() | F.forall(F.array(*[parsed[c].isNull() for c in ("title", "category", "severity", "notes")]), lambda x: x)
    return F.when(empty, "the model did not return readable JSON")


def subject(severity: Column, report_id: Column, title: Column, prefix: str) -> Column:
    """The subject line of a report."""
    level = F.lower(F.coalesce(severity, F.lit("")))
    shout = F.when(level.isin("critical", "high", "medium", "low"), F.upper(level)).otherwise("UNTRIAGED")
    short = F.substring(F.trim(F.regexp_replace(F.coalesce(title, F.lit("New report")), r"(?U)\s+", " ")), 1, 80)
    return F.concat(F.lit(f"[{prefix}]["), shout, F.lit("] "), F.coalesce(report_id, F.lit("BUG-?")), F.lit(" — "), short)


def translate(strings, rows, language: str, key: str):
    """``rows`` with ``text``: the string of its language, else the English one, else the key. ``strings`` is a small table (language, key, text)."""
    own = strings.select(F.col("language").alias(language), F.col("key").alias(key), F.col("text").alias("_own"))
    english = strings.where("language = 'en'").select(F.col("key").alias(key), F.col("text").alias("_en"))
    both = rows.join(own, [language, key], "left").join(english, key, "left")
    return both.withColumn("text", F.coalesce(F.nullif("_own", F.lit("")), "_en", key)).drop("_own", "_en")


# How an answer says that the pages don't answer, and what of a provider's error is no reader's business.
REFUSALS = ("do not cover", "don't cover", "does not cover", "doesn't cover", "ne couvrent pas", "ne couvre pas", "n'indiquent pas", "ne précisent pas")
ACCOUNT = r"(?is)(org_[A-Za-z0-9]+|req_[A-Za-z0-9]+|in organization\s+`?[^`\s]+`?|Need more tokens\?.*$|https?://\S+)"


def says_refusal(text: Column) -> Column:
    """An answer that says the pages don't cover the question is a refusal."""
    return contains_any(F.lower(F.coalesce(text, F.lit(""))), REFUSALS)


def reader_safe(message: Column) -> Column:
    """An error without account details and addresses, 200 characters at most."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(message, F.lit("")), ACCOUNT, ""), r"\s+", " ")), 1, 200)


def change_subject(source: Column, severity: Column, summary: Column, prefix: str) -> Column:
    """The subject line of a notice that a source changed."""
    told = F.substring(F.trim(F.regexp_replace(F.coalesce(summary, F.lit("changed")), r"\s+", " ")), 1, 70)
    return F.concat(F.lit(f"[{prefix} SOURCE CHANGE]["), F.upper(severity), F.lit("] "), source, F.lit(" — "), told)


def report_body(parts: list[tuple[str, Column]]) -> Column:
    """Labelled blocks of a report, indented; lists are numbered, and what is empty is left out. A part is a text column, or an array built by ``F.array``."""
    blocks = []
    for label, value in parts:
        items = "array(" in str(value._jc) if hasattr(value, "_jc") else False
        lines = F.transform(value, lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x)) if items else F.transform(F.split(value, "\n"), lambda x: F.concat(F.lit("  "), x))
        empty = (F.size(value) == 0) if items else (F.coalesce(value, F.lit("")) == "")
        blocks.append(F.when(~empty, F.concat(F.lit(label + "\n"), F.array_join(lines, "\n"))))
    return F.concat_ws("\n\n", *blocks)


def is_triaged(title: Column, error: Column) -> Column:
    return (F.coalesce(title, F.lit("")) != "") & (F.coalesce(error, F.lit("")) == "")
