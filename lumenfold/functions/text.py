"""Column functions on text: folds, tokens, counts, language and question classes. All stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _letters() -> tuple[str, str]:
    """Precomposed letters of the Latin, Greek and Cyrillic blocks and what is left of each without its marks."""
    pairs = []
    for code in (*range(0x00C0, 0x0250), *range(0x0370, 0x0530), *range(0x1E00, 0x2000)):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != c:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _letters()


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends. Single spaces, nearly all of a text's white space, are left as they are."""
    return F.trim(F.regexp_replace(c, r"(?U) \s+|[\s&&[^ ]]\s*", " "))


def fold_plain(c: Column) -> Column:
    """Lower case without marks; white space as it is. Null stays null. Only a text with more bytes than characters has marks to take off."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.regexp_replace(F.translate(F.lower(c), _FROM, _TO), r"\p{Mn}+", ""))


def fold_ws(c: Column) -> Column:
    return squeeze(fold_plain(c))


def fold_hyphen(c: Column) -> Column:
    return squeeze(F.translate(fold_plain(c), "-", " "))


def fold_hyphen_underscore(c: Column) -> Column:
    return squeeze(F.translate(fold_plain(c), "-_", "  "))


def fold_proc(c: Column) -> Column:
    return squeeze(F.translate(fold_plain(c), "-’", " '"))


def fold_claim(c: Column) -> Column:
    """Typographic apostrophes, spaces and dashes become plain ones; hyphens stay."""
    dashes = "‐‑‒–—―−"
    return squeeze(F.translate(fold_plain(c), "’  " + dashes, "'  " + "-" * len(dashes)))


def fold_date(c: Column) -> Column:
    return squeeze(F.translate(fold_plain(c), "'", " "))


def fold_key(c: Column) -> Column:
    """Runs of a-z and 0-9 joined by one space."""
    return F.array_join(F.regexp_extract_all(fold_plain(c), F.lit("([a-z0-9]+)"), 1), " ")


FOLDS = {f.__name__: f for f in (fold_plain, fold_ws, fold_hyphen, fold_hyphen_underscore, fold_proc, fold_claim, fold_date, fold_key)}


def tokens(c: Column) -> Column:
    """Folded runs of letters and digits of at least two characters; apostrophes part words."""
    return F.regexp_extract_all(fold_plain(c), F.lit(r"([\p{L}\p{N}&&[^ʼ]]{2,})"), 1)  # of the apostrophes only ʼ counts as a letter


def words_of(c: Column) -> Column:
    """Words between white space; none for blank text."""
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"(?U)(\S+)"), 1))


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, at least 1; 0 for empty text."""
    return F.when(F.length(c) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(c) / 4))).cast("int")


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(c), lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in words]))  # the text is made once


def count_of(c: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur in the text."""
    return F.transform(F.array(c), lambda x: reduce(lambda a, b: a + b, [F.contains(x, F.lit(w)).cast("int") for w in words]))[0]


def plain(word: str) -> str:
    """The fold of a literal, on the driver."""
    folded = "".join(x for x in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(x) != "Mn")
    return " ".join(folded.split())


# Stop words for comparing the subjects of statements, and function words of two languages.
FRENCH_MARKERS = tuple("""
je j me moi mon ma mes mien nous notre nos vous votre vos il elle ils elles
le la les un une des du de au aux ce cet cette ces
est sont suis etes ai as avons avez ont etait
et ou mais donc car ne pas plus jamais rien
pour dans avec sans sur sous chez vers apres avant depuis pendant
que qui quoi dont ou quel quelle quels quelles comment pourquoi combien quand
puis dois doit peut peux faut faire demander obtenir
mois annee jour delai droit titre sejour etranger demarche
""".split())  # fmt: skip
ENGLISH_MARKERS = tuple("""
i me my mine we our us you your he she it they them their
the a an this that these those
is are am was were be been do does did have has had
and or but so because not never nothing
for in with without on under at to from after before since during
what which who whom whose how why when where much many long
can could should would will need must get apply
month year day deadline right permit stay foreigner process
""".split())  # fmt: skip
FRENCH_LETTERS = "àâäçéèêëîïôöùûüÿœ"


def language(c: Column) -> Column:
    """struct(language, confidence, french, english, accented) by function words; accents count 0.75 each, three at most; ties are English."""
    low = F.lower(c)
    words = F.regexp_extract_all(low, F.lit(r"(\p{L}+)"), 1)
    french = F.size(F.filter(words, lambda w: fold_plain(w).isin(*FRENCH_MARKERS)))
    english = F.size(F.filter(words, lambda w: w.isin(*ENGLISH_MARKERS)))
    accented = F.length(F.regexp_replace(low, f"[^{FRENCH_LETTERS}]", ""))
    fr = french + F.least(accented, F.lit(3)) * F.lit(0.75)
    total = fr + english
    name = F.when(total == 0, F.when(accented > 0, "fr").otherwise("en")).otherwise(F.when(fr > english, "fr").otherwise("en"))
    sure = F.when(total == 0, 0.0).otherwise(F.greatest(fr, english.cast("double")) / total)
    return F.struct(name.alias("language"), sure.alias("confidence"), french.alias("french"), english.alias("english"), accented.alias("accented"))


# Phrases that tell what kind of answer a question wants.
PROCEDURAL = ("how do i", "how can i", "how to", "what do i need", "steps", "procedure", "apply", "renew", "register", "comment", "quelles", "demarche", "renouveler", "postuler", "candidater")
COMPLEX = (" and ", " or ", "deadline", "timeline", "calendar", "both", "difference between", "as well as", "et aussi", "ainsi que", "international student", "plus", "also")
MICRO = ("what is", "what's", "is it", "are there", "can i", "do i need", "when is", "where is", "how much", "qu'est-ce", "est-ce que", "combien", "quand", "ou est")


def answer_class(c: Column) -> Column:
    f = fold_plain(c)
    procedural, several = contains_any(f, PROCEDURAL), count_of(f, COMPLEX) >= 2
    micro = reduce(lambda a, b: a | b, [f.startswith(w) | F.contains(f, F.lit(f" {w}")) for w in MICRO])
    return F.when(procedural & several, "complex").when(procedural, "procedural").when(micro, "micro").otherwise("standard")


# Words that each kind of answer should have at least and at most.
BANDS = {"micro": (20, 60), "standard": (50, 120), "procedural": (80, 180), "complex": (150, 300)}


def length_check(question: Column, answer: Column) -> Column:
    """struct(answer_class, words, floor, ceiling, over, told): an answer against the length that its question deserves."""
    kind = answer_class(question)
    bound = lambda i: F.element_at(F.create_map(*[x for k, v in BANDS.items() for x in (F.lit(k), F.lit(v[i]))]), kind)
    n, most = word_count(F.coalesce(answer, F.lit(""))), bound(1)
    told = F.concat(n.cast("string"), F.lit(" words, "), F.when(n > most, "over").otherwise("within"), F.lit(" the "), kind, F.lit(" ceiling of "), most.cast("string"))
    return F.struct(kind.alias("answer_class"), n.alias("words"), bound(0).alias("floor"), most.alias("ceiling"), (n > most).alias("over"), told.alias("told"))


def is_confident(confidence: Column) -> Column:
    return confidence >= 0.6


def excerpt(c: Column, limit: int = 420) -> Column:
    """The text after its header, cut at ``limit`` characters at the last sentence or line if that lies past half."""
    at = F.instr(c, "\n\n")
    body = F.regexp_replace(F.when(at > 0, F.substr(c, at + 2)).otherwise(c), r"(?U)^\s+|\s+$", "")
    cut = F.substring(body, 1, limit)
    last = lambda mark: F.when(F.instr(cut, mark) > 0, limit - F.instr(F.reverse(cut), mark[::-1]) - len(mark) + 1).otherwise(-1)
    stop = F.greatest(last(". "), last("\n"))
    short = F.when(stop > limit * 0.5, F.substr(cut, F.lit(1), stop + 1)).otherwise(cut)
    return F.when(F.length(body) <= limit, body).otherwise(F.concat(F.regexp_replace(short, r"(?U)\s+$", ""), F.lit("…")))


def known(c: Column) -> Column:
    """The text, empty where it isn't known."""
    return F.coalesce(c, F.lit(""))
