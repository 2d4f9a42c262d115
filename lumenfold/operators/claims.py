"""Claims: sentences that assert something actionable, what changed among them, and contradictions between sources."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.facts import WORD_NUMBERS
from lumenfold.functions.dates import in_force, parse_date
from lumenfold.functions.text import contains_any, fold_ws, plain, squeeze
from lumenfold.operators.pages import staged

# Words of claims, of replacement and of scope; numbers in words; units; stop words.
CLAIM_WORDS = (
    "document", "documents", "justificatif", "justificatifs", "piece", "pièce", "pieces", "pièces", "attestation", "formulaire", "cerfa", "certificat",
    "condition", "conditions", "eligib", "éligib", "requis", "required", "obligatoire", "mandatory", "must", "devez", "doit", "faut",
    "delai", "délai", "deadline", "date limite", "avant le", "jusqu'au", "tarif", "frais", "fee", "cost", "cout", "coût", "montant", "gratuit",
    "procedure", "procédure", "demarche", "démarche", "etape", "étape", "candidature", "admission", "inscription", "apply", "application",
    "rendez-vous", "appointment", "en ligne", "online", "teleservice", "téléservice", "portail",
)
REPLACES = ("instead of", "rather than", "no longer", "not accepted", "is not required", "au lieu de", "en remplacement", "ne sont plus", "n'est plus", "n est plus", "ne sont pas accept", "non accept", "n'est pas requis", "supprim", "remplace par")
CONDITIONS = ("si vous", "si le", "si la", "dans le cas", "pour les", "lorsque", "sauf", "except", "if you", "if the", "unless", "in the case", "for students", "pour les etudiants", "ressortissant", "selon")
NUMBERS = WORD_NUMBERS
UNITS = ("mois", "months", "month", "jours", "jour", "days", "day", "semaines", "semaine", "weeks", "week", "ans", "an", "annees", "annee", "years", "year", "euros", "euro", "€", "heures", "heure", "hours", "hour", "%", "pages", "page", "exemplaires", "exemplaire", "copies", "copie")
STOP = ("les", "des", "une", "der", "the", "and", "for", "you", "your", "with", "that", "this", "sont", "est", "vous", "pour", "dans", "avec", "doit", "must", "should", "will", "etre", "avoir", "plus", "tout", "tous")
DATE = r"(\d{1,2}(?:er)?\s+\p{L}+\s+\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})"
SINCE = r"(?i)(?:à\s+compter\s+du|a\s+compter\s+du|applicable\s+(?:au|à\s+partir\s+du)|en\s+vigueur\s+(?:au|à\s+compter\s+du)|depuis\s+le|effective\s+(?:from|on)|as\s+of|with\s+effect\s+from|starting)\s+" + DATE
UNTIL = r"(?i)(?:jusqu'au|jusqu’au|until|up\s+to|valable\s+jusqu'au)\s+" + DATE
#: Lower wins: a more specific authority.
JURISDICTIONS = {"institution": 0, "city": 1, "department": 2, "regional": 3, "national": 4}
WORDS = tuple(dict.fromkeys(plain(w) for w in CLAIM_WORDS))
LEAST_OVERLAP = 0.28


def claim_id(source: Column, text: Column) -> Column:
    """Stays the same across versions of a page."""
    return F.substring(F.sha2(F.concat(source, F.lit("|"), fold_ws(text)).cast("binary"), 256), 1, 16)


def extract(pages: DataFrame, keys: list[str], source: str, text: str, limit: int = 40) -> DataFrame:
    """One row per claim of a page: the keys, position, claim_id, claim_text, effective_from and effective_until (null: not said).

    A claim is a line of five words or more and 400 characters at most with a claim word; a repeated one counts once, and a page has ``limit`` at most.
    """
    lines = pages.select(*dict.fromkeys([*keys, source]), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r\n|\n|\r")).alias("position", "_line"))
    # Staged: each line is squeezed once, and folded once if it is a sentence.
    rows = staged(lines, claim_text=squeeze(F.col("_line"))).where((F.length("claim_text") <= 400) & (F.length("claim_text") - F.length(F.replace("claim_text", F.lit(" "), F.lit(""))) >= 4))
    rows = staged(rows, _folded=fold_ws(F.col("claim_text"))).where(contains_any(F.col("_folded"), WORDS)).withColumn("claim_id", F.substring(F.sha2(F.concat(source, F.lit("|"), "_folded").cast("binary"), 256), 1, 16))
    first = rows.groupBy(*keys, "claim_id").agg(F.min("position").alias("position"), F.min_by("claim_text", "position").alias("claim_text"))
    ranked = first.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("position"))).where(F.col("_n") <= limit).drop("_n")
    # Most claims name no day: only what was found is read as one.
    rows = staged(ranked, _since=F.regexp_extract("claim_text", SINCE, 1), _until=F.regexp_extract("claim_text", UNTIL, 1))
    day = lambda found: F.when(F.col(found) != "", F.try_to_date(parse_date(F.col(found)), "yyyy-MM-dd"))
    return rows.withColumns({"effective_from": day("_since"), "effective_until": day("_until")}).drop("_since", "_until")


def diff(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Keys with ``status``: added, removed or kept."""
    a, b = old.select(*on).distinct().withColumn("_a", F.lit(True)), new.select(*on).distinct().withColumn("_b", F.lit(True))
    return a.join(b, on, "full_outer").select(*on, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("kept").alias("status"))


def content_words(text: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(fold_ws(text), F.lit("([a-z0-9]{4,})"), 1)), F.array(*[F.lit(w) for w in STOP]))


def longest_of(words: Iterable[str]) -> str:
    """A pattern of the longest of the words that fits, by first letters: a place where none begins is left after one look at each letter."""
    tails: dict[str, list[str]] = {}
    for w in sorted(words, key=len, reverse=True):
        tails.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in tails.items())


def quantities(text: Column) -> Column:
    """``value unit`` of each stated quantity, sorted: digits or words, decimal point, unit without its plural s."""
    pattern = rf"(\d+(?:[.,]\d+)?|{longest_of(NUMBERS)})\s*({longest_of(UNITS)})"
    found = F.regexp_extract_all(fold_ws(text), F.lit(f"({pattern})"), 1)
    table = F.create_map(*[x for k, v in NUMBERS.items() for x in (F.lit(k), F.lit(v))])

    def value(x: Column) -> Column:
        number = F.regexp_extract(x, pattern, 1)
        return F.concat(F.coalesce(F.try_element_at(table, number), F.translate(number, ",", ".")), F.lit(" "), F.regexp_replace(F.regexp_extract(x, pattern, 2), "s+$", ""))

    return F.array_sort(F.array_distinct(F.transform(found, value)))


def differing_measure(a: Column, b: Column) -> Column:
    """Some unit is stated by both, and no value of it is shared."""
    unit = lambda x: F.element_at(F.split(x, " "), 2)
    common = F.array_intersect(F.transform(a, unit), F.transform(b, unit))
    of = lambda q, u: F.filter(q, lambda x: unit(x) == u)
    return F.exists(common, lambda u: ~F.arrays_overlap(of(a, u), of(b, u)))


def classify(pairs: DataFrame) -> DataFrame:
    """Adds ``relation`` to pairs with words_a/b, quantities_a/b, folded_a/b, by the first rule that fits."""
    size_a, size_b = F.size("words_a"), F.size("words_b")
    shared = F.size(F.array_intersect("words_a", "words_b"))
    same = (size_a > 0) & (size_b > 0) & (shared / F.least(size_a, size_b) >= LEAST_OVERLAP)
    replaces = contains_any(F.col("folded_a"), REPLACES) | contains_any(F.col("folded_b"), REPLACES)
    scoped = contains_any(F.col("folded_a"), CONDITIONS) != contains_any(F.col("folded_b"), CONDITIONS)
    within = (shared == F.least(size_a, size_b)) & (size_a != size_b)
    rule = F.when(~same, "compatible").when(replaces | differing_measure(F.col("quantities_a"), F.col("quantities_b")), "contradictory").when(scoped, "conditional").when(within, "additive").otherwise("compatible")
    return pairs.withColumn("relation", rule)


def pairs(claims: DataFrame, block: str) -> DataFrame:
    """Pairs of claims of different sources in a block that may be about one subject, each once (a before b by id).

    One subject needs ``LEAST_OVERLAP`` of the shorter claim's words. Of its words, in order of how rare they are in the block, so
    many from the rarest on have to hold a shared one; only those meet all words of claims that are as long or longer, in one
    equi-join. Words that nearly all claims share so pair none by themselves.
    """
    rows = claims.withColumns({"words": content_words(F.col("claim_text")), "quantities": quantities(F.col("claim_text")), "folded": fold_ws(F.col("claim_text"))})
    keyed = rows.select(block, "source_id", "claim_id", F.size("words").alias("size"), F.explode("words").alias("word"))
    often = keyed.groupBy(block, "word").agg(F.count("*").alias("often"))
    nth = F.row_number().over(Window.partitionBy(block, "source_id", "claim_id").orderBy("often", "word"))
    few = keyed.join(often, [block, "word"]).withColumn("nth", nth).where(F.col("nth") <= F.col("size") - F.ceil(F.col("size") * LEAST_OVERLAP) + 1)
    short, long = (df.select(block, "word", F.col("source_id").alias(f"s{x}"), F.col("claim_id").alias(f"c{x}"), F.col("size").alias(f"n{x}")) for df, x in ((few, 1), (keyed, 2)))
    met = short.join(long, [block, "word"]).where("s1 <> s2 and c1 <> c2 and n1 <= n2")
    first = F.col("c1") < F.col("c2")
    side = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    near = met.select(block, side("s1", "s2").alias("source_a"), side("c1", "c2").alias("id_a"), side("s2", "s1").alias("source_b"), side("c2", "c1").alias("id_b")).distinct()
    cols = [c for c in rows.columns if c not in (block, "source_id", "claim_id")]
    for x in "ab":
        of = rows.select(block, F.col("source_id").alias(f"source_{x}"), F.col("claim_id").alias(f"id_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in cols])
        near = near.join(of, [block, f"source_{x}", f"id_{x}"])
    return near


def resolve(df: DataFrame, on: Column) -> DataFrame:
    """Adds prefer (a or b) and prefer_reason by six keys: in force, jurisdiction, specificity, later start, authority, recency."""
    rank = lambda c: F.coalesce(F.try_element_at(F.create_map(*[x for k, v in JURISDICTIONS.items() for x in (F.lit(k), F.lit(v))]), c), F.lit(9))
    holds_a, holds_b = (in_force(F.col(f"effective_from_{x}"), F.col(f"effective_until_{x}"), on) for x in "ab")
    steps = [
        (holds_a != holds_b, holds_a, F.lit("the other is not in force on this date")),
        (rank(F.col("jurisdiction_a")) != rank(F.col("jurisdiction_b")), rank(F.col("jurisdiction_a")) < rank(F.col("jurisdiction_b")), F.lit("a more specific authority")),
        (F.size("words_a") != F.size("words_b"), F.size("words_a") > F.size("words_b"), F.lit("states the requirement more specifically")),
        (F.coalesce(F.col("effective_from_a") != F.col("effective_from_b"), F.lit(False)), F.col("effective_from_a") > F.col("effective_from_b"), F.lit("takes effect later")),
        (F.col("authority_level_a") != F.col("authority_level_b"), F.col("authority_level_a") < F.col("authority_level_b"), F.lit("higher authority for this topic")),
        (F.lit(True), F.col("retrieved_at_a") >= F.col("retrieved_at_b"), F.lit("read more recently")),
    ]
    side, reason = F.when(steps[0][0], F.when(steps[0][1], "a").otherwise("b")), F.when(steps[0][0], steps[0][2])
    for test, first, why in steps[1:]:
        side, reason = side.when(test, F.when(first, "a").otherwise("b")), reason.when(test, why)
    return df.withColumns({"prefer": side, "prefer_reason": reason})


def conflict_id(a: Column, b: Column) -> Column:
    return F.concat(F.lit("CONF-"), F.substring(F.sha2(F.array_join(F.array_sort(F.array(a, b)), "|").cast("binary"), 256), 1, 12))


def mark_stale(claims: DataFrame, moved: DataFrame) -> DataFrame:
    """``claims`` with those that are current and in ``moved`` (source_id, claim_id) put up for review."""
    hit = moved.select("source_id", "claim_id", F.lit(True).alias("_moved")).distinct()
    both = claims.join(hit, ["source_id", "claim_id"], "left")
    return both.withColumn("status", F.when(F.col("_moved") & (F.col("status") == "current"), "stale_pending_review").otherwise(F.col("status"))).drop("_moved")
