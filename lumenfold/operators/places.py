"""Places in questions and replies: which town, département and authority a text is about. Every test is an equi-join on exploded keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import fold_hyphen
from lumenfold.operators.lookup import ngrams, resolve_places

# Words before a place, and the form of a place's name behind them.
HINT = r"((?:\b(?i:in|at|near|from|live in|living in|based in|à|au|aux|dans|habite à|habite a|j'habite à|j'habite a|près de|pres de))\s+([A-ZÀ-ÖØ-Þ][\w'’\-]*(?:[ -][A-ZÀ-ÖØ-Þ][\w'’\-]*){0,3}))"
ABOUT_PLACE = r"(?i)\b(d[ée]partement|pr[ée]fecture)\b"
CODE_IN_TEXT, CODE_IN_REPLY = r"(?i)\b(?:d[ée]partement\s+)?(\d{2})\b", r"(?i)\b(\d{2,3}|2[AB])\b"


def gazetteer(departments: DataFrame) -> DataFrame:
    """(name, key, department, file_order): every département and town by its folded name; a town's name may come in several."""
    names = F.explode(F.concat(F.array("name"), "cities"))
    return departments.select("code", "file_order", names.alias("name")).select("name", fold_hyphen(F.col("name")).alias("key"), F.col("code").alias("department"), "file_order").dropDuplicates(["key", "department"])


def hints(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, nth, span): the names behind words that introduce a place."""
    found = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(HINT), 2), lambda x: F.regexp_replace(F.trim(x), r"[.,;:!?]+$", ""))
    return df.select(id_col, F.posexplode(found).alias("nth", "span"))


def city_named(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, city): the first place that a text names, known or not."""
    return hints(df, id_col, text).where("nth = 0").select(id_col, F.col("span").alias("city"))


def _hit(df: DataFrame, id_col: str, priority: int, how: str, city: Column, departments: Column) -> DataFrame:
    return df.select(id_col, F.lit(priority).alias("priority"), F.lit(how).alias("how"), city.alias("city"), departments.alias("departments"))


def _by_code(codes: DataFrame, id_col: str, departments: DataFrame, priority: int) -> DataFrame:
    hit = codes.where("code <> ''").join(departments.select(F.upper("code").alias("code"), F.col("code").alias("department")), "code")
    return _hit(hit, id_col, priority, "code", F.lit(""), F.array("department"))


def resolve(df: DataFrame, id_col: str, text: str, departments: DataFrame, hint: str | None = None, reply: bool = False) -> DataFrame:
    """(id, how, city, department, candidates, ambiguous): the place of each text that has one, by the first way that finds any.

    A hint that is a département's name or code; a département named in the text (the first of the file); a town behind
    a word that introduces places, the longest reading first; any known name that looks like one; a code, where the text is about
    places. A reply to the question where one is (``reply``) is first read for any known name or code, however it is written.
    A town of several départements is ambiguous: they are its candidates.
    """
    rows = df.select(id_col, F.coalesce(F.col(text), F.lit("")).alias("_t"), *([F.col(hint).alias("_hint")] if hint else []))
    known = gazetteer(departments)
    own = departments.select(fold_hyphen(F.col("name")).alias("key"), F.col("code").alias("department"), "file_order")
    ways = []
    if hint:
        keyed = rows.where(F.coalesce("_hint", F.lit("")) != "").select(id_col, fold_hyphen(F.col("_hint")).alias("key"))
        both = own.select("key", "department").unionByName(departments.select(F.lower("code").alias("key"), F.col("code").alias("department")))
        ways.append(_hit(keyed.join(both, "key"), id_col, 1, "hint", F.lit(""), F.array("department")))
    if reply:
        any_ = resolve_places(rows, id_col, "_t", known.select("name", "key", "department"), guarded=False)
        ways += [_hit(any_, id_col, 2, "reply", F.col("place"), F.col("candidates")), _by_code(rows.select(id_col, F.upper(F.regexp_extract("_t", CODE_IN_REPLY, 1)).alias("code")), id_col, departments, 3)]
    words = F.filter(F.split(fold_hyphen(F.regexp_replace("_t", r"[^\w'’\s-]", " ")), " "), lambda w: w != "")
    named = ngrams(rows, id_col, words, 5).select(id_col, F.col("gram").alias("key")).join(own, "key")
    named = named.groupBy(id_col).agg(F.min_by("department", "file_order").alias("department"))
    ways.append(_hit(named, id_col, 4, "department", F.lit(""), F.array("department")))
    spans = hints(rows, id_col, "_t").withColumn("_w", F.split("span", " "))
    spans = spans.select(id_col, "nth", F.explode(F.sequence(F.size("_w"), F.lit(1), F.lit(-1))).alias("width"), "_w").withColumn("city", F.array_join(F.slice("_w", F.lit(1), F.col("width")), " "))
    towns = departments.select(F.col("code").alias("department"), F.explode("cities").alias("town")).select("department", fold_hyphen(F.col("town")).alias("key")).groupBy("key").agg(F.array_sort(F.collect_set("department")).alias("departments"))
    hinted = spans.withColumn("key", fold_hyphen(F.col("city"))).join(towns, "key").groupBy(id_col).agg(F.min_by(F.struct("city", "departments"), F.struct("nth", -F.col("width"))).alias("s"))
    ways.append(_hit(hinted, id_col, 5, "introduced", F.col("s.city"), F.col("s.departments")))
    looks = resolve_places(rows, id_col, "_t", known.select("name", "key", "department"))
    ways.append(_hit(looks, id_col, 6, "name", F.col("place"), F.col("candidates")))
    ways.append(_by_code(rows.where(F.col("_t").rlike(ABOUT_PLACE)).select(id_col, F.regexp_extract("_t", CODE_IN_TEXT, 1).alias("code")), id_col, departments, 7))
    all_ = ways[0]
    for w in ways[1:]:
        all_ = all_.unionByName(w)
    best = all_.groupBy(id_col).agg(F.min_by(F.struct("how", "city", "departments"), F.struct("priority", F.array_join("departments", ","))).alias("b"))
    sole = F.size("b.departments") == 1
    return best.select(id_col, "b.how", "b.city", F.when(sole, F.col("b.departments")[0]).alias("department"), F.when(sole, F.array().cast("array<string>")).otherwise(F.col("b.departments")).alias("candidates"), (~sole).alias("ambiguous"))


def department_of(df: DataFrame, key: str, departments: DataFrame) -> DataFrame:
    """``df`` with code, department, region, authority_source and authority of the département that ``key`` names by code or by name; null where there is none."""
    d = departments.select("code", F.col("name").alias("department"), "region", F.col("prefecture_source").alias("authority_source"), F.col("prefecture_name").alias("authority"))
    keys = d.select("*", F.explode(F.array_distinct(F.array(fold_hyphen(F.col("code")), fold_hyphen(F.col("department"))))).alias("_key"))
    return df.withColumn("_key", fold_hyphen(F.col(key))).join(keys, "_key", "left").drop("_key")


def place_label(city: Column, department: Column) -> Column:
    """How to say where this is, to a reader."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(has(city) & has(department), F.concat_ws(" · ", city, department)).when(has(department), department).otherwise(F.coalesce(city, F.lit("")))


def relevance(hits: DataFrame, pages: DataFrame, purposes_of: DataFrame) -> DataFrame:
    """``hits`` (query, doc, department, purposes) with ``ok`` and ``reason``: a page scoped to another département, or to none of the purposes asked for, is about somebody else.

    ``pages`` has (doc, department) of pages that name one place; ``purposes_of`` (doc, page_purposes). Unknown on a side is no mismatch.
    """
    rows = hits.join(pages.select("doc", F.col("department").alias("_scope")), "doc", "left").join(purposes_of.select("doc", "page_purposes"), "doc", "left")
    elsewhere = F.coalesce(F.col("_scope") != F.col("department"), F.lit(False))
    off = (F.size(F.coalesce("purposes", F.array())) > 0) & (F.size(F.coalesce("page_purposes", F.array())) > 0) & ~F.arrays_overlap("purposes", "page_purposes")
    reason = F.when(elsewhere, "wrong_jurisdiction").when(F.coalesce(off, F.lit(False)), "wrong_purpose")
    return rows.withColumns({"reason": reason, "ok": reason.isNull()}).drop("_scope", "page_purposes")
