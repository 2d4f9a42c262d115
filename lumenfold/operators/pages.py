"""Pages over time: signal lines, changes, versions, freshness, retention, incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import contains_any, fold_ws, plain

# Words that mark a line as something a reader acts on.
SIGNAL_WORDS = (
    "document", "documents", "justificatif", "justificatifs", "pièce", "pièces", "condition", "conditions", "éligib", "eligib", "requis", "required",
    "obligatoire", "mandatory", "délai", "deadline", "date limite", "tarif", "tarifs", "frais", "fee", "fees", "coût", "cost", "montant",
    "procédure", "procedure", "démarche", "demarche", "étape", "step", "candidature", "admission", "inscription", "apply", "application",
    "dossier", "formulaire", "form", "rendez-vous", "appointment", "contact", "téléphone", "adresse", "address",
)
# Words of each category of change, how severe it is, and the topics it makes doubtful.
CATEGORIES = {
    "eligibility": (("eligib", "éligib", "condition", "qui peut", "who can", "reserve", "réservé", "ouvert aux", "open to", "critere", "critère"), "critical", ("admission", "residence_permit", "housing", "health", "work")),
    "required_document": (("document", "justificatif", "piece", "pièce", "attestation", "formulaire", "cerfa", "certificat", "copie", "originaux"), "high", ("documents", "admission", "residence_permit", "housing")),
    "deadline": (("delai", "délai", "deadline", "date limite", "avant le", "jusqu'au", "cloture", "clôture", "echeance", "échéance"), "critical", ("deadline", "admission", "taxes")),
    "fee": (("tarif", "frais", "fee", "cost", "cout", "coût", "montant", "gratuit", "payant", "prix"), "critical", ("tuition", "taxes")),
    "procedure": (("procedure", "procédure", "demarche", "démarche", "etape", "étape", "step", "comment faire", "how to"), "critical", ("admission", "residence_permit", "documents")),
    "application_portal": (("teleservice", "téléservice", "portail", "portal", "en ligne", "online", "compte", "connexion", "login"), "high", ("admission", "residence_permit")),
    "contact": (("contact", "telephone", "téléphone", "courriel", "email", "guichet"), "medium", ("contact",)),
    "address": (("adresse", "address", "situe", "situé", "rue", "avenue"), "medium", ("contact",)),
    "jurisdiction": (("prefecture", "préfecture", "departement", "département", "commune", "mairie", "consulat", "competent", "compétent"), "high", ("residence_permit", "documents")),
    "student_rule": (("etudiant", "étudiant", "crous", "universite", "université", "campus", "scolarite", "scolarité", "admission"), "high", ("admission", "programmes", "housing")),
    "immigration_rule": (("sejour", "séjour", "visa", "etranger", "étranger", "titre de sejour", "titre de séjour", "naturalisation", "anef", "recepisse", "récépissé"), "critical", ("residence_permit", "documents")),
    "housing_rule": (("logement", "bail", "loyer", "caution", "apl", "allocation logement", "residence", "résidence"), "high", ("housing",)),
    "tax_rule": (("impot", "impôt", "fiscal", "declaration", "déclaration", "revenus"), "high", ("taxes",)),
    "health_rule": (("sante", "santé", "assurance maladie", "securite sociale", "sécurité sociale", "carte vitale", "mutuelle"), "high", ("health",)),
    "employment_rule": (("emploi", "travail", "contrat", "cdi", "cdd", "alternance", "salaire", "chomage", "chômage"), "high", ("work",)),
}
# A change of any of these is worth waking someone for.
CRITICAL_WORDS = ("document", "justificatif", "pièce", "condition", "éligib", "eligib", "délai", "deadline", "date limite", "obligatoire", "required", "admission", "candidature")


def distinct_folds(words: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(plain(w) for w in words))


SIGNALS, CRITICAL = distinct_folds(SIGNAL_WORDS), distinct_folds(CRITICAL_WORDS)


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns made on a generated row: a filter on them, or a later use, can't copy their expressions into the rows below."""
    row = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_row")
    return df.select(*df.columns, row).select(*df.columns, "_row.*")


def folded_lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r"), fold_ws)


def signals_of(lines: Column) -> Column:
    """Of folded lines, those of at least three words that hold a signal word, each once, in order of text."""
    return F.array_distinct(F.filter(lines, lambda x: (F.size(F.split(x, " ")) >= 3) & contains_any(x, SIGNALS)))


def signal_lines(text: Column) -> Column:
    """Folded lines of at least three words that hold a signal word, each once, in order of text."""
    return signals_of(folded_lines(text))


def numbers_in(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(\d[\d\s.,/-]*)\b"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))))


def links_in(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"""(https?://[^\s"'<>]+)"""), 1)))


def categories(folded: Column) -> Column:
    """Names of the categories with a hit, most hits first, then by name backwards. One function of the text, which is made once and whose many tests aren't generated code too long to compile."""

    def of(text: Column) -> Column:
        rows = []
        for name, (words, _, _) in CATEGORIES.items():
            # Each listed form counts, so a word listed with and without its accent counts twice.
            hits = sum((F.contains(text, F.lit(plain(w))).cast("int") for w in words[1:]), F.contains(text, F.lit(plain(words[0]))).cast("int"))
            rows.append(F.struct(hits.alias("hits"), F.lit(name).alias("name")))
        return F.array(*rows)

    some = F.filter(F.transform(F.array(folded), of)[0], lambda x: x["hits"] > 0)
    return F.transform(F.reverse(F.array_sort(some)), lambda x: x["name"])


def severity(names: Column) -> Column:
    of = lambda level: F.array(*[F.lit(n) for n, (_, s, _) in CATEGORIES.items() if s == level])
    out = F.lit("low")
    for level in ("medium", "high", "critical"):
        out = F.when(F.arrays_overlap(names, of(level)), level).otherwise(out)
    return out


def topics(names: Column) -> Column:
    """Topics of the categories, each once, in the categories' order."""
    table = F.create_map(*[x for n, (_, _, t) in CATEGORIES.items() for x in (F.lit(n), F.array(*[F.lit(y) for y in t]))])
    return F.array_distinct(F.flatten(F.transform(names, lambda n: F.element_at(table, n))))


#: What a comparison finds.
FOUND = ("title_changed", "numbers_changed", "links_changed", "change_type", "categories", "severity", "affected_topics", "added", "removed", "summary")


def compare(pairs: DataFrame, old: str, new: str, old_title: str, new_title: str, only: tuple[str, ...] = FOUND) -> DataFrame:
    """Adds change_type, severity, categories, affected_topics, added, removed (20 at most), the three flags and a summary, or what of these ``only`` names.

    Steps are staged, so that each signal line is found once and a filter on the kind of change doesn't copy the work. Nothing is made that
    isn't asked for, and categories are looked for where something changed.
    """
    was, now = F.coalesce(F.col(old), F.lit("")), F.coalesce(F.col(new), F.lit(""))
    t0, t1 = F.coalesce(F.col(old_title), F.lit("")), F.coalesce(F.col(new_title), F.lit(""))
    figures = {"numbers_changed": lambda: numbers_in(was) != numbers_in(now), "links_changed": lambda: links_in(was) != links_in(now)}
    df = staged(
        pairs, _a=signal_lines(was), _b=signal_lines(now), _first=was == "", _same=(fold_ws(was) == fold_ws(now)) & (t0 == t1), title_changed=(t0 != "") & (t0 != t1),
        **{n: of() for n, of in figures.items() if n in _needed(only)},
    )
    return _told(df, pairs.columns, only)


def compare_along(versions: DataFrame, page: str, order: list[str], text: str, title: str, only: tuple[str, ...] = FOUND, after: DataFrame | None = None, at: str = "retrieved_at") -> DataFrame:
    """As :func:`compare`, each version of a page against the one before it; those later than ``after``, a row of one time, where that is given.

    What a comparison reads of a text is found once a version, before versions meet, and goes along in place of the text.
    """
    said, none = F.coalesce(text, F.lit("")), F.array().cast("array<string>")
    parts = {"numbers_changed": ("_numbers", lambda: numbers_in(said)), "links_changed": ("_links", lambda: links_in(said))}
    parts = {n: x for n, x in parts.items() if n in _needed(only)}
    df = staged(versions, _lines=folded_lines(said))
    df = df.withColumns({"_b": signals_of(F.col("_lines")), "_now": F.array_join(F.filter("_lines", lambda x: x != ""), " "), "_none": said == "", "_title": F.coalesce(title, F.lit("")), **{c: of() for c, of in parts.values()}})
    w = Window.partitionBy(page).orderBy(*order)
    before = lambda c, default: F.coalesce(F.lag(c).over(w), default)
    df = df.withColumns({"_a": before("_b", none), "_was": before("_now", F.lit("")), "_first": before("_none", F.lit(True)), "_t0": before("_title", F.lit("")), **{f"{c}0": before(c, none) for c, _ in parts.values()}})
    if after is not None:
        df = df.join(F.broadcast(after.toDF("_after")), F.col(at) > F.col("_after"))  # one row
    t0, t1 = F.col("_t0"), F.col("_title")
    df = df.withColumns({"_same": (F.col("_was") == F.col("_now")) & (t0 == t1), "title_changed": (t0 != "") & (t0 != t1), **{n: F.col(f"{c}0") != F.col(c) for n, (c, _) in parts.items()}})
    return _told(df, versions.columns, only)


def _needed(only: tuple[str, ...]) -> set[str]:
    return {*only, *(["numbers_changed"] if "summary" in only else [])}


def _told(df: DataFrame, columns: list[str], only: tuple[str, ...]) -> DataFrame:
    """``columns`` and what of FOUND ``only`` names, from the signal lines of both texts (_a, _b), _first, _same and the flags."""
    none, many = F.array().cast("array<string>"), lambda c: F.size(c).cast("string")
    settled = F.col("_first") | F.col("_same")
    df = staged(df, _add=F.array_sort(F.array_except("_b", "_a")), _rem=F.array_sort(F.array_except("_a", "_b")))
    df = staged(df, _quiet=(F.size("_add") == 0) & (F.size("_rem") == 0) & ~F.col("title_changed"))
    df = staged(df, _touched=F.when(settled | F.col("_quiet"), "").otherwise(fold_ws(F.array_join(F.concat("_add", "_rem"), " "))))
    if set(only) & {"categories", "severity", "affected_topics", "summary"}:
        df = staged(df, _names=F.when(F.col("_touched") == "", none).otherwise(categories(F.col("_touched"))))
    loud = contains_any(F.col("_touched"), CRITICAL)
    parts = lambda: F.array_compact(F.array(
        F.when(F.size("_add") > 0, F.concat(many("_add"), F.lit(" line(s) added"))), F.when(F.size("_rem") > 0, F.concat(many("_rem"), F.lit(" line(s) removed"))),
        F.when(F.col("title_changed"), F.lit("title changed")), F.when(F.col("numbers_changed"), F.lit("numbers changed")),
        F.when(F.size("_names") > 0, F.concat(F.lit("touches "), F.array_join(F.slice("_names", 1, 3), ", "))),
    ))
    made = {
        "change_type": lambda: F.when(F.col("_first"), "new").when(F.col("_same"), "none").when(F.col("_quiet"), "cosmetic").when(loud, "critical").otherwise("substantive"),
        "categories": lambda: F.when(settled, none).when(F.col("_quiet"), F.array(F.lit("cosmetic"))).otherwise(F.col("_names")),
        "severity": lambda: F.when(settled | F.col("_quiet"), "low").otherwise(severity(F.col("_names"))),
        "affected_topics": lambda: F.when(settled | F.col("_quiet"), none).otherwise(topics(F.col("_names"))),
        "added": lambda: F.when(settled, none).otherwise(F.slice("_add", 1, 20)),
        "removed": lambda: F.when(settled, none).otherwise(F.slice("_rem", 1, 20)),
        "summary": lambda: F.when(F.col("_first"), "first version").when(F.col("_same"), "identical").when(F.col("_quiet"), "wording or layout only; nothing a reader acts on changed").otherwise(F.array_join(parts(), ", ")),
    }
    df = staged(df, **{n: of() for n, of in made.items() if n in only})
    return df.select(*columns, *[n for n in FOUND if n in only])


def is_substantive(change_type: Column) -> Column:
    return change_type.isin("substantive", "critical")


def needs_attention(level: Column) -> Column:
    """Whether a person should be told, rather than the log alone."""
    return level.isin("critical", "high")


def before_after(removed: Column, added: Column) -> Column:
    """What a page said and says now, three statements of each at most, in its own words; empty where neither moved."""
    lines = F.concat(
        F.when(F.size(removed) > 0, F.transform(F.slice(removed, 1, 3), lambda x: F.concat(F.lit("BEFORE: "), x))).otherwise(F.array(F.lit("BEFORE: (no matching requirement was stated)"))),
        F.when(F.size(added) > 0, F.transform(F.slice(added, 1, 3), lambda x: F.concat(F.lit("AFTER:  "), x))).otherwise(F.array(F.lit("AFTER:  (the requirement is no longer stated)"))),
    )
    return F.when((F.size(removed) == 0) & (F.size(added) == 0), "").otherwise(F.array_join(lines, "\n"))


def invalidations(changes: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(topic, at, source_id, version_id): the latest substantive change that makes a topic doubtful; ``stored`` holds earlier stamps, and the later one stays.

    ``changes`` has (source_id, version_id, retrieved_at, change_type, affected_topics).
    """
    rows = changes.where(is_substantive(F.col("change_type"))).select(F.explode("affected_topics").alias("topic"), F.col("retrieved_at").alias("at"), "source_id", "version_id")
    rows = rows if stored is None else stored.select("topic", "at", "source_id", "version_id").unionByName(rows)
    last = F.max(F.struct("at", "source_id", "version_id")).alias("s")
    return rows.groupBy("topic").agg(last).select("topic", "s.*")


def still_valid(answers: DataFrame, stamps: DataFrame) -> DataFrame:
    """``answers`` (answer, topics, made_at) with ``valid``: no topic of theirs was stamped after they were made."""
    hit = answers.select("answer", "made_at", F.explode("topics").alias("topic")).join(stamps.select("topic", "at"), "topic").where("at > made_at").select("answer").distinct()
    return answers.join(hit.withColumn("_hit", F.lit(True)), "answer", "left").withColumn("valid", F.col("_hit").isNull()).drop("_hit")


def asof(wanted: DataFrame, versions: DataFrame, key: str, day: str, at: str, value: str) -> DataFrame:
    """``wanted`` (key, day) with the last version at or before the end of that day; null where none is that old.

    Both sides are put in one time line of each key and the last value carried on: no join, and rows of a key are read once.
    """
    left = wanted.withColumns({"_t": F.date_add(F.col(day).cast("date"), 1).cast("timestamp"), "_v": F.lit(None).cast(versions.schema[value].dataType), "_q": F.lit(1)})
    right = versions.select(key, F.col(at).alias("_t"), F.col(value).alias("_v")).withColumn("_q", F.lit(2))
    line = left.unionByName(right, allowMissingColumns=True)
    # A version of midnight after the day comes behind the question.
    w = Window.partitionBy(key).orderBy("_t", "_q", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return line.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_q = 1").drop("_t", "_v", "_q")


def chain(versions: DataFrame, page: str, at: str, version: str, digest: str) -> DataFrame:
    """Adds previous_version, number, newest_first and is_change (the content differs from the version before)."""
    w, back = Window.partitionBy(page).orderBy(at, version), Window.partitionBy(page).orderBy(F.desc(at), F.desc(version))
    before = F.lag(digest).over(w)
    return versions.withColumns(
        {
            "previous_version": F.lag(version).over(w),
            "number": F.row_number().over(w),
            "newest_first": F.row_number().over(back),
            "is_change": before.isNull() | (before != F.col(digest)),
        }
    )


def retention(versions: DataFrame, page: str, at: str, version: str, active: str, pending: str, now: Column, keep: int, days: int) -> DataFrame:
    """(page, version, action) of versions outside retention: the newest ``keep``, the last two and the active one stay, and pages with two versions at most are left alone."""
    back = Window.partitionBy(page).orderBy(F.desc(at), F.desc(version))
    rows = versions.withColumns({"_n": F.row_number().over(back), "_all": F.count("*").over(Window.partitionBy(page))})
    old = (F.col("_all") > 2) & (F.col("_n") > max(keep, 2)) & ~F.coalesce(F.col(active), F.lit(False)) & (F.col(at) < now - F.make_dt_interval(days=F.lit(days)))
    return rows.where(old).select(page, version, F.when(F.col(pending) > 0, "kept").otherwise("prune").alias("action"))


def pruned(versions: DataFrame, plan: DataFrame, page: str, version: str) -> DataFrame:
    """``versions`` without those that the plan of :func:`retention` marks to prune."""
    return versions.join(plan.where("action = 'prune'").select(page, version), [page, version], "left_anti")


def freshness(at: Column, now: Column, hours: Column) -> Column:
    return F.when(at.isNull(), "unknown").when(now <= at + F.make_dt_interval(hours=hours), "fresh").otherwise("stale")


def history_depth(versions: Column, days: Column, least_versions: int = 3, least_days: int = 30) -> Column:
    return F.when(versions < least_versions, "insufficient_history").when(days >= 3 * least_days, "historical_mature").when(days >= least_days, "historical_ready").otherwise("limited_history")


def incident_kind(error: Column, status: Column) -> Column:
    """First rule that fits."""
    t = F.lower(F.coalesce(error, F.lit("")))
    return (
        F.when(contains_any(t, ("bot protection", "perfdrive", "captcha")), "bot_wall")
        .when(contains_any(t, ("timeout", "timed out")), "timeout")
        .when(contains_any(t, ("nodename", "dns", "name or service")), "dns")
        .when(F.contains(t, F.lit("redirect to")), "redirect_change")
        .when(contains_any(t, ("no usable content", "parsed to nothing")), "parser_failure")
        .when(F.contains(t, F.lit("render")), "render_failure")
        .when((status == 403) | F.contains(t, F.lit("403")), "forbidden")
        .when(status >= 400, "http_error")
        .otherwise("unknown")
    )


def incidents(events: DataFrame, source: str, kind: str, at: str, failed: str, tie: str) -> DataFrame:
    """One row an incident: failures of a (source, kind) until the source recovers; a failure after that opens a new one.

    ``failed`` is true for a failure and false for a recovery, which closes every open incident of its source.
    """
    whole = Window.partitionBy(source).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("island", F.coalesce(F.sum((~F.col(failed)).cast("int")).over(whole), F.lit(0)))
    ends = rows.where(~F.col(failed)).groupBy(source, "island").agg(F.min(at).alias("resolved_at"))
    got = rows.where(failed).groupBy(source, kind, "island").agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("occurrence_count"))
    return got.join(ends, [source, "island"], "left").withColumn("current_status", F.when(F.col("resolved_at").isNull(), "open").otherwise("resolved"))
