"""Institutions that a question names, or leans on without naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import fold_plain, fold_ws
from lumenfold.operators.lookup import slug

# References that need an earlier turn, the forms of names, and capitalised words that name nothing.
REFERENCE = (
    r"(?i)\b(?:this|that|the|my|our|its|their)\s+(?:school|university|college|institution|campus|faculty|business\s+school|grande\s+ecole|grande\s+école)\b"
    r"|(?i)\b(?:cette|cet|ce|ma|mon|notre|leur|la|le|l'|l’)\s?(?:ecole|école|universite|université|etablissement|établissement|fac|faculte|faculté|campus)\b"
)
PROPER = r"(?U)(\b[A-ZÀ-ÖØ-Þ][\w’'\-]*(?:\s+[A-ZÀ-ÖØ-Þ&][\w’'\-]*)+)"
ACRONYM = r"(\b[A-Z]{2,6}\b)"
NO_NAME = tuple("how what where when which who why do does did can could should is are was i my the a an france french paris comment que quoi ou où quand quel quelle est sont je mon ma le la les un une des et pour dans avec".split())
PER_SPAN = 6


def mentions_reference(text: Column) -> Column:
    """Whether a text leans on an institution that it doesn't name."""
    return F.coalesce(text, F.lit("")).rlike(REFERENCE)


def surface(text: Column) -> Column:
    """The words that point at an institution."""
    return F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), REFERENCE, 0), r"\s+", " "))


def spans(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, nth, span): runs of capitalised words and acronyms, the longest first, then in order of text."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = F.filter(F.concat(F.regexp_extract_all(t, F.lit(PROPER), 1), F.regexp_extract_all(t, F.lit(ACRONYM), 1)), lambda x: ~fold_ws(x).isin(*[w for w in NO_NAME]))
    order = F.array_sort(F.transform(found, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("span"))))
    return df.select(id_col, F.posexplode(F.transform(order, lambda x: x["span"])).alias("nth", "span"))


def named(df: DataFrame, id_col: str, text: str, register: DataFrame) -> DataFrame:
    """(id, rank, name, acronym): institutions that a text names outright, best first, a name once.

    A span has to be an institution's name or acronym, or, in two words or more, the beginning of its name; six at most a span.
    Only the first span that any institution fits counts. Two equi-joins: on whole names, and on the first word.
    """
    r = register.select("name", F.coalesce("acronym", F.lit("")).alias("acronym")).distinct().withColumns({"n": fold_ws(F.col("name")), "a": fold_ws(F.col("acronym"))})
    s = spans(df, id_col, text).withColumn("key", fold_ws(F.col("span"))).where("key <> ''")
    exact = s.join(r.select("name", "acronym", "n", F.explode(F.array_distinct(F.filter(F.array("n", "a"), lambda x: x != ""))).alias("key")), "key").withColumn("tier", F.lit(0))
    first = lambda c: F.split(c, " ")[0]
    begun = s.where(F.size(F.split("key", " ")) >= 2).withColumn("w", first(F.col("key"))).join(r.withColumn("w", first(F.col("n"))), "w").where(F.col("n").startswith(F.col("key")) & (F.col("n") != F.col("key"))).withColumn("tier", F.lit(1))
    cols = [id_col, "nth", "name", "acronym", "n", "tier"]
    hits = exact.select(*cols).unionByName(begun.select(*cols))
    within = Window.partitionBy(id_col, "nth").orderBy("tier", F.length("name"), "n", "name")
    hits = hits.withColumns({"_k": F.row_number().over(within), "_first": F.min("nth").over(Window.partitionBy(id_col))}).where(f"nth = _first and _k <= {PER_SPAN}")
    once = hits.groupBy(id_col, "n").agg(F.min(F.struct("_k", "name", "acronym")).alias("h"))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy("h._k"))
    return once.select(id_col, rank.alias("rank"), F.col("h.name").alias("name"), F.col("h.acronym").alias("acronym"))


def canonical_ids(name: Column, acronym: Column) -> Column:
    """The ids under which the registry of sources may hold an institution."""
    return F.array_distinct(F.filter(F.array(slug(name), slug(F.coalesce(acronym, F.lit("")))), lambda x: x != ""))


def resolve(turns: DataFrame, conversation: str, turn: str, text: str, register: DataFrame) -> DataFrame:
    """``turns`` with institution, from_context, needs_clarification and about_institution.

    What a turn names counts; a turn that only refers takes the last that its conversation named before; if there is none, someone has to be asked.
    """
    keyed = turns.withColumn("_id", F.struct(conversation, turn))
    first = named(keyed, "_id", text, register).where("rank = 1").select("_id", F.col("name").alias("_named"))
    rows = keyed.join(first, "_id", "left").drop("_id")
    before = F.last("_named", ignorenulls=True).over(Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_before", before)
    refers = F.col("_named").isNull() & mentions_reference(F.col(text))
    got = F.when(refers, F.col("_before")).otherwise(F.col("_named"))
    return rows.withColumns({"institution": got, "from_context": refers & F.col("_before").isNotNull(), "needs_clarification": refers & F.col("_before").isNull(), "about_institution": got.isNotNull() | refers}).drop("_named", "_before")


# Words of people who ask as students.
STUDY = tuple("""
student students study studies studying university college campus school enrol enroll enrolment enrollment tuition scholarship grant diploma degree
master bachelor phd doctorate internship erasmus etudiant etudiante etudiants etude etudes universite fac faculte ecole
scolarite inscription bourse diplome licence doctorat stage crous cvec parcoursup
""".split())  # fmt: skip
NOW = ("latest", "current", "currently", "now", "recent", "recently", "changed", "change", "changes", "update", "updated", "this year", "still", "new rule", "actuel", "actuelle", "actuellement", "récent", "recent", "récemment", "changé", "change", "changement", "mise à jour", "maintenant", "cette année", "toujours", "nouveau")


def looks_like_study(tokens: Column) -> Column:
    """Whether someone asks as a student, by the tokens of the question."""
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in STUDY]))


def wants_current(text: Column) -> Column:
    """Whether a question is about what holds now, so that a stored page isn't enough."""
    f = fold_plain(F.coalesce(text, F.lit("")))
    words = sorted({w.translate(str.maketrans("éèàâêçîôû", "eeaaecioû")).replace("û", "u") for w in NOW})
    out = F.lit(False)
    for w in words:
        out = out | F.contains(f, F.lit(w))
    return out
