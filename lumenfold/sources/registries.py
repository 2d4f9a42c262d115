"""Registries as tables: sources, jurisdictions, topics, purposes, procedures, glossary, institutions, gold questions.

YAML registries are a maintainer's files of a few hundred rows: they are read on the driver, checked, and become tables
that keep the order of the file. JSON registers are read by Spark.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.text import fold_plain

# What a registry's fields may say.
TYPES = ("government", "public_body", "local_authority", "university", "school", "institution", "third_party")
HEALTH = ("healthy", "healthy_rendered", "stale", "changed", "unavailable", "parser_failure", "blocked", "unverified")
LEVELS = ("national", "regional", "department", "city", "institution")
SOURCE = (
    "id string, name string, domain string, base_url string, source_type string, authority_level int, aliases array<string>, legacy_domains array<string>, supported_topics array<string>, supported_entities array<string>, "
    "language string, verified boolean, verified_at string, crawl_enabled boolean, live_query_enabled boolean, render_enabled boolean, refresh_priority string, health string, jurisdiction string, jurisdiction_area string, "
    "official_site_url string, admission_url string, application_url string, portal_url string, freshness_hours int, entry_points array<string>, notes string, file_order int"
)
DEFAULTS = {"authority_level": 2, "language": "fr", "refresh_priority": "medium", "health": "unverified", "jurisdiction": "national", "freshness_hours": 720}
LOWER = ("domain", "source_type", "refresh_priority", "health", "jurisdiction", "aliases", "legacy_domains")


class RegistryError(ValueError):
    """A registry that can't be read or says something impossible."""


def read_yaml(path: str) -> dict:
    import yaml

    try:
        return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    except (OSError, yaml.YAMLError) as e:
        raise RegistryError(f"no readable registry at {path}: {e}") from e


def _typed(row: dict, schema: str) -> tuple:
    out = []
    for field in schema.split(", "):
        name, kind = field.split()
        value = row.get(name, DEFAULTS.get(name))
        if kind == "array<string>":
            value = [str(x).lower() if name in LOWER else str(x) for x in value or ()]
        elif kind == "string":
            value = str(value or "").lower() if name in LOWER else str(value or "")
        out.append({"int": lambda v: int(v or 0), "boolean": bool}.get(kind, lambda v: v)(value))
    return tuple(out)


def sources(spark: SparkSession, path: str) -> DataFrame:
    """Every registered source in file order. An unknown type, health or jurisdiction, a repeated id or an address that isn't https is an error that names its row."""
    rows, seen = [], set()
    for n, row in enumerate(read_yaml(path).get("sources", [])):
        at = row.get("id", f"row {n + 1}")
        for name, allowed in (("source_type", TYPES), ("health", HEALTH), ("jurisdiction", LEVELS)):
            if str(row.get(name, DEFAULTS.get(name, ""))).lower() not in allowed:
                raise RegistryError(f"{at}: {name} is none of {', '.join(allowed)}")
        if at in seen:
            raise RegistryError(f"{at}: the id comes twice")
        if not str(row.get("base_url", "")).startswith("https://"):
            raise RegistryError(f"{at}: base_url must be https")
        seen.add(at)
        rows.append(_typed(row | {"file_order": n}, SOURCE))
    return spark.createDataFrame(rows, SOURCE)


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.createDataFrame([_typed(r | {"file_order": n}, schema + ", file_order int") for n, r in enumerate(rows)], schema + ", file_order int")


def _named(raw: dict, key: str) -> list[dict]:
    return [{"id": k, **(v or {})} for k, v in (raw.get(key) or {}).items()]


def regions(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, read_yaml(path).get("regions", []), "id string, name string")


def departments(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, read_yaml(path).get("departments", []), "code string, id string, name string, region string, prefecture_source string, prefecture_name string, cities array<string>, notes string")


def topics(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, _named(read_yaml(path), "topics"), "id string, purposes array<string>, preferred array<string>, required array<string>, fallback array<string>, note string")


def purposes(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, _named(read_yaml(path), "purposes"), "id string, keywords array<string>, page_types array<string>")


def page_types(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, _named(read_yaml(path), "page_types"), "id string, paths array<string>, titles array<string>")


def procedures(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, group_no, pattern): a text names a procedure if every group of it has a pattern that fits."""
    rows = [(k, str(v.get("label", k)), g, str(p)) for k, v in (read_yaml(path).get("procedures") or {}).items() for g, group in enumerate(v.get("all_of", [])) for p in group]
    return spark.createDataFrame(rows, "id string, label string, group_no int, pattern string")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """The gold questions; those without an expectation hold nulls."""
    rows = [(r["id"], r["segment"], r.get("topic"), r.get("en"), r.get("fr"), r.get("expected_fiche_id"), bool(r.get("expect_refusal")), r.get("note")) for r in read_yaml(path).get("questions", [])]
    return spark.createDataFrame(rows, "id string, segment string, topic string, en string, fr string, expected_page string, expect_refusal boolean, note string")


TERMS = "map<string,struct<en:string,explanation_en:string,explanation_fr:string,aliases_en:array<string>,source:string,definition_id:string>>"


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """(fr, en, explanations, aliases_en, source, definition_id, is_official) by French term, from one JSON object keyed by term."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", TERMS)).alias("fr", "t"))
    rows = raw.select("fr", "t.*").withColumns({"aliases_en": F.coalesce("aliases_en", F.array().cast("array<string>")), "source": F.coalesce("source", F.lit("authored"))})
    return rows.withColumn("is_official", F.col("source") != "authored").orderBy("fr")


def aliases(terms: DataFrame) -> DataFrame:
    """(term, alias): every folded name of a term, each once."""
    return terms.select(F.col("fr").alias("term"), F.explode(F.array_distinct(F.transform(F.concat("aliases_en", F.array("fr", "en")), fold_plain))).alias("alias"))


def search_glossary(terms: DataFrame, needle: str) -> DataFrame:
    """Terms whose French or English name or an alias holds the needle, folded; all for an empty one."""
    n = fold_plain(F.trim(F.lit(needle)))
    names = F.concat(F.array("fr", "en"), "aliases_en")
    return terms.where((n == "") | F.exists(names, lambda x: F.contains(fold_plain(x), n)))


def institutions(rows: DataFrame) -> DataFrame:
    """A register of institutions: (uai, name, acronym, kind, sector, url, commune, postcode, departement, departement_id, academie, region, parent, aliases, label, is_private, place), by name, then town.

    ``rows`` has the register's own columns, as text. Rows without a name are left out; ``38 - Isère`` is a number and a name.
    """
    of = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in rows.columns else F.lit("")
    dept, parent = of("departement"), F.regexp_replace(of("universite_de_rattachement_libelle_et_uai"), r" \(.*$", "")
    named = F.split_part(dept, F.lit(" - "), F.lit(2))
    other = F.filter(F.transform(F.concat(F.split(of("sigle"), ","), F.array(parent)), lambda x: F.trim(x)), lambda x: x != "")
    out = rows.select(
        of("code_uai").alias("uai"), of("nom").alias("name"), of("sigle").alias("acronym"), of("type_detablissement").alias("kind"), of("statut").alias("sector"), of("url_et_id_onisep").alias("url"), of("commune").alias("commune"),
        of("cp").alias("postcode"), F.when(F.trim(named) != "", F.trim(named)).otherwise(dept).alias("departement"), F.trim(F.split_part(dept, F.lit(" - "), F.lit(1))).alias("departement_id"),
        of("academie").alias("academie"), of("region").alias("region"), parent.alias("parent"), F.array_sort(F.array_distinct(other)).alias("aliases"),
    ).where("name <> ''")
    label = F.when(F.col("acronym") != "", F.concat("name", F.lit(" ("), "acronym", F.lit(")"))).otherwise(F.col("name"))
    where = F.concat_ws(" · ", F.nullif("commune", F.lit("")), F.nullif("departement", F.lit("")))
    out = out.withColumns({"label": label, "is_private": F.contains(F.lower("sector"), F.lit("priv")), "sector_label": F.coalesce(F.nullif("sector", F.lit("")), F.lit("—")), "place": where})
    return out.orderBy(fold_plain(F.col("name")), fold_plain(F.col("commune")))


def universities(register: DataFrame) -> DataFrame:
    return register.where(F.contains(fold_plain(F.col("kind")), F.lit("universit")) | F.contains(fold_plain(F.col("name")), F.lit("universit")))


def with_checks(registry: DataFrame, checks: DataFrame, day: str) -> DataFrame:
    """``registry`` with the health that ``checks`` (id, health) found; a source that could be read is verified on that day. Others stay as they are."""
    good = F.col("_health").isin("healthy", "healthy_rendered")
    rows = registry.join(checks.select("id", F.col("health").alias("_health")), "id", "left")
    return rows.withColumns({"health": F.coalesce("_health", "health"), "verified": F.when(good, True).otherwise(F.col("verified")), "verified_at": F.when(good, F.lit(day)).otherwise(F.col("verified_at"))}).drop("_health")


def with_live(registry: DataFrame, promoted: DataFrame) -> DataFrame:
    """``registry`` with live queries on for the ids in ``promoted``, and off for all others."""
    return registry.join(promoted.select("id", F.lit(True).alias("_on")).distinct(), "id", "left").withColumn("live_query_enabled", F.coalesce("_on", F.lit(False))).drop("_on")
