"""Latency, provider and claim health, event counts, coverage, capability transitions, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Target seconds of each answer class, and ranks of capability states.
TARGETS = {"MICRO": 5.0, "STANDARD": 10.0, "PROCEDURAL": 15.0, "COMPLEX": 30.0}
RANKS = {
    "failed": 0, "blocked": 0, "authority_unavailable": 0, "not_configured": 1, "not_observed": 1,
    "insufficient_history": 2, "fixture_verified": 2, "mechanism_verified": 3, "production_verified": 4,
}


def lookup(table: dict, key: Column) -> Column:
    """The value of a key in a small fixed table; null where it has none."""
    return F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), key)


ACCURACY, SLACK, WHOLE, MAX_GROUPS = 50_000, 5e-5, 20_000, 100_000


def percentiles(rows: DataFrame, by: list[str], value: str, fractions: list[float]) -> DataFrame:
    """(by, n, avg, max, p0, p1, ...): exact percentiles of each group, linear between neighbours; null values don't count.

    A sketch brackets each percentile within a few ten-thousandths of a group's values; then what lies below the bracket is counted, and only
    what lies in it is sorted. No task holds a group's values, unless it has at most ``WHOLE`` of them.
    """
    v = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    ends = [min(1.0, max(0.0, f + d)) for f in fractions for d in (-SLACK, SLACK)]
    stats = v.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_v").alias("avg"), F.min("_v").alias("_min"), F.max("_v").alias("max"), F.percentile_approx("_v", ends, ACCURACY).alias("_q"))
    few = stats.select(*by).limit(MAX_GROUPS + 1).count() <= MAX_GROUPS
    both = v.join(F.broadcast(stats) if few else stats, by)
    whole, aggs = F.col("n") <= WHOLE, []
    for k in range(len(fractions)):
        low, high = F.when(whole, F.col("_min")).otherwise(F.col("_q")[2 * k]), F.when(whole, F.col("max")).otherwise(F.col("_q")[2 * k + 1])
        aggs += [F.count_if(F.col("_v") < low).alias(f"_b{k}"), F.sort_array(F.collect_list(F.when(F.col("_v").between(low, high), F.col("_v")))).alias(f"_s{k}")]
    got = both.groupBy(*by, "n", "avg", "max").agg(*aggs)
    for k, f in enumerate(fractions):
        at = f * (F.col("n") - 1) - F.col(f"_b{k}")
        value_at = lambda i, k=k: F.element_at(F.col(f"_s{k}"), (F.least(i, F.size(f"_s{k}") - 1) + 1).cast("int"))
        below = value_at(F.floor(at))
        got = got.withColumn(f"p{k}", below + (value_at(F.floor(at) + 1) - below) * (at - F.floor(at)))
    return got.select(*by, "n", "avg", "max", *[f"p{k}" for k in range(len(fractions))])


def latency(rows: DataFrame, by: str, total: str) -> DataFrame:
    """n, avg, p50, p95 (linear between neighbours) and max of each group; an empty or null group is ``unknown``, null totals don't count."""
    key = F.coalesce(F.nullif(F.col(by).cast("string"), F.lit("")), F.lit("unknown"))
    return percentiles(rows.select(key.alias(by), total), [by], total, [0.5, 0.95]).select(by, "n", "avg", F.col("p0").alias("p50"), F.col("p1").alias("p95"), "max")


def provider_health(rows: DataFrame, *by: str) -> DataFrame:
    limited, empty = F.col("rate_limited"), F.col("empty_answer") & ~F.col("rate_limited")
    return rows.groupBy(*by).agg(
        F.count("*").alias("answers"),
        F.count_if(limited).alias("rate_limit_count"),
        (F.count_if(limited) / F.count("*")).alias("rate_limit_share"),
        F.coalesce(F.sum(F.when(limited, F.col("retry_after"))), F.lit(0.0)).alias("rate_limit_wait_total"),
        F.coalesce(F.max(F.when(limited, F.col("retry_after"))), F.lit(0.0)).alias("rate_limit_wait_max"),
        F.count_if(F.col("provider") == "ollama").alias("fallback_count"),
        F.count_if(empty).alias("empty_answers"),
    )


def claim_health(rows: DataFrame, *by: str) -> DataFrame:
    checked = rows.where("claims_generated > 0 or claim_validation_time > 0")
    half = percentiles(checked, list(by), "claim_validation_time", [0.5]).select(*by, F.col("p0").alias("validation_p50"))
    return checked.groupBy(*by).agg(
        F.count("*").alias("answers_checked"),
        F.sum("claims_generated").alias("claims_generated"),
        F.sum("claims_supported").alias("claims_supported"),
        F.coalesce(F.try_divide(F.sum("claims_supported"), F.sum("claims_generated")), F.lit(1.0)).alias("supported_claim_ratio"),
    ).join(half, list(by), "left")


def event_counts(events: DataFrame, kinds: list[str], event: str) -> DataFrame:
    """A row for each kind, zero where it never came."""
    spark = events.sparkSession
    wanted = spark.createDataFrame([(k,) for k in kinds], f"{event} string")
    return wanted.join(events.groupBy(event).agg(F.count("*").alias("n")), event, "left").select(event, F.coalesce("n", F.lit(0)).alias("n"))


def within_target(answer_class: Column, seconds: Column) -> Column:
    """Null where the class has no target."""
    return seconds <= lookup(TARGETS, F.upper(answer_class))


def transitions(before: DataFrame, after: DataFrame, key: str = "capability", status: str = "status") -> DataFrame:
    """Capabilities known before whose status moved: both statuses, direction, and whether that is a regression."""
    was = before.select(key, F.col(status).alias("previous_status"))
    moved = was.join(after.select(key, F.col(status).alias("new_status")), key).where("previous_status <> new_status")
    a, b = lookup(RANKS, F.col("previous_status")), lookup(RANKS, F.col("new_status"))
    a_, b_ = a, F.coalesce(b, F.lit(2))
    direction = F.when(a.isNull(), "changed").when(b_ > a_, F.when(a_ == 0, "recovered").otherwise("improved")).when(b_ < a_, "degraded").otherwise("changed")
    earned = lambda c: F.coalesce(F.col(c).isin("production_verified", "mechanism_verified"), F.lit(False))
    back = earned("previous_status") & (~earned("new_status") | ((F.col("previous_status") == "production_verified") & (F.col("new_status") == "mechanism_verified")))
    return moved.withColumns({"direction": direction, "regression": back})


def coverage(topics: DataFrame, sources: DataFrame) -> DataFrame:
    """(topic, status, sources): complete where every deciding source is live, missing where none is, else partial."""
    got = topics.join(sources, "topic", "left").groupBy("topic").agg(F.count("source_id").alias("sources"), F.count_if(F.col("live")).alias("live"))
    return got.withColumn("status", F.when((F.col("sources") == 0) | (F.col("live") == 0), "missing").when(F.col("live") == F.col("sources"), "complete").otherwise("partial"))


def agreement(rows: DataFrame, question: str, variant: str, first: str, second: str, rank: str, item: str, k: int = 3) -> DataFrame:
    """Per question: how the top k of two variants agree (set, order, top 1, items shared and in either, Jaccard)."""
    top = rows.where(F.col(rank) <= k).groupBy(question, variant).agg(F.transform(F.array_sort(F.collect_list(F.struct(rank, item))), lambda x: x[item]).alias("items"))
    a, b = (top.where(F.col(variant) == v).select(question, F.col("items").alias(n)) for v, n in ((first, "a"), (second, "b")))
    both = a.join(b, question)
    return both.select(
        question,
        (F.array_sort("a") == F.array_sort("b")).alias("same_set"),
        (F.col("a") == F.col("b")).alias("same_order"),
        (F.col("a")[0] == F.col("b")[0]).alias("same_top"),
        F.size(F.array_intersect("a", "b")).alias("shared"),
        F.size(F.array_union("a", "b")).alias("either"),
        (F.size(F.array_intersect("a", "b")) / F.greatest(F.lit(1), F.size(F.array_union("a", "b")))).alias("jaccard"),
    )


def retrieval_records(hits: DataFrame, question: str, rank: str, page: str, score: str) -> DataFrame:
    """(question, pages, top_pages, best_score): the pages a question retrieved, each once, in order, the first three, and the best score to four digits."""
    first = hits.groupBy(question, page).agg(F.min(rank).alias("_r"), F.max(score).alias("_s"))
    pages = F.transform(F.array_sort(F.collect_list(F.struct("_r", page))), lambda x: x[page])
    return first.groupBy(question).agg(pages.alias("pages"), F.round(F.max("_s"), 4).alias("best_score")).withColumn("top_pages", F.slice("pages", 1, 3))


def by_segment(questions: DataFrame, k: int = 3) -> DataFrame:
    """(segment, n, agree, refusals, rightly, wrongly, mean_best): how two phrasings of each question (en, fr: items in order) agree on their first k, and what is refused."""
    same = F.array_sort(F.slice("en", 1, k)) == F.array_sort(F.slice("fr", 1, k))
    return questions.groupBy("segment").agg(
        F.count("*").alias("n"), F.count_if(same).alias("agree"), F.count_if("refused").alias("refusals"), F.count_if(F.col("expects_refusal") & F.col("refused")).alias("rightly"),
        F.count_if(~F.col("expects_refusal") & F.col("refused")).alias("wrongly"), F.avg("best").alias("mean_best"),
    )


RANGES = 512  # that distinct values are cut into


def at_places(counted: DataFrame, places: list[int]) -> list[float]:
    """The values at places (from 0) of the order of all values; ``counted`` has (v, n), each value once with its number.

    Values are cut into ranges at approximate quantiles; the driver adds up one total a range, and only the ranges that hold
    a place are ordered. No task sees all values.
    """
    counted = counted.select(F.col("v").cast("double").alias("v"), "n")
    cuts = sorted(set(counted.agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 20 * RANGES)).first()[0] or []))
    ranged = counted.withColumn("range", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("v"))) if cuts else F.lit(0))
    totals = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # RANGES rows at most
    start, wanted = 0, {}
    for r in sorted(totals):
        wanted |= {p: (r, p - start) for p in places if start <= p < start + totals[r]}
        start += totals[r]
    if not wanted:
        return []
    held = ranged.where(F.col("range").isin(sorted({r for r, _ in wanted.values()})))
    held = held.withColumn("end", F.sum("n").over(Window.partitionBy("range").orderBy("v")))
    of = [F.min(F.when((F.col("range") == r) & (F.col("end") > at), F.col("v"))) for r, at in (wanted[p] for p in places)]
    return list(held.agg(*[c.alias(f"p{i}") for i, c in enumerate(of)]).first())


def calibration(questions: DataFrame, score: str, refuse: str) -> DataFrame:
    """(least, p10, median, most, separable): one row on the best scores of questions that can be answered; separable if those that can't all score below them.

    The tenth is the lower order statistic at a tenth of the count. Questions without a score don't count.
    """
    counted = questions.where(~F.col(refuse) & F.col(score).isNotNull()).groupBy(F.col(score).alias("v")).agg(F.count("*").alias("n"))
    n = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least, p10, low, high, most = at_places(counted, [0, n // 10, (n - 1) // 2, n // 2, n - 1]) if n else [None] * 5
    below = questions.where(F.col(refuse)).agg(F.max(score)).first()[0]
    row = (least, p10, (low + high) / 2 if n else None, most, bool(n and below is not None and below < least))
    return questions.sparkSession.createDataFrame([row], "least double, p10 double, median double, most double, separable boolean")


def numbered(rows: DataFrame, day: str, at: str, prefix: str = "BUG") -> DataFrame:
    """Adds ``report_id``: a prefix, the day and the row's number in that day."""
    n = F.row_number().over(Window.partitionBy(F.to_date(day)).orderBy(at))
    return rows.withColumn("report_id", F.concat(F.lit(f"{prefix}-"), F.date_format(day, "yyyyMMdd"), F.lit("-"), F.lpad(n.cast("string"), 3, "0")))


def bounded(rows: DataFrame, order: list[Column], most: int, keep: int, by: str) -> DataFrame:
    """A cache of over ``most`` entries keeps its last ``keep``, in each ``by``."""
    w = Window.partitionBy(by)
    ranked = rows.withColumns({"_n": F.row_number().over(w.orderBy(*order)), "_all": F.count("*").over(w)})
    return ranked.where((F.col("_all") <= most) | (F.col("_n") <= keep)).drop("_n", "_all")
