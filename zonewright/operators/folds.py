"""The index as of cutoffs: each fold's components from what was known at its cutoff, its outcome from what came after.

Rows are dealt to the folds whose span holds them in one scan; every count of a fold is a conditional sum of the same aggregation,
so many cutoffs cost one pass and one row per zone, fold and task in the shuffle. All that follows is a table of places and folds.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import half_up, micro
from . import rates, risk, scan


@dataclass(frozen=True)
class Fold:
    """Incidents from start to cutoff are known, those after it up to end are the outcome; all dates are inside their span but the cutoff of the outcome."""

    fold: int
    start: datetime.date
    cutoff: datetime.date
    end: datetime.date


def fold_table(folds: list[Fold]) -> Column:
    return F.array(*(F.struct(F.lit(f.fold).alias("fold"), *(F.lit(getattr(f, n)).alias(n) for n in ("start", "cutoff", "end"))) for f in folds))


def dealt(rows: DataFrame, folds: list[Fold], span) -> DataFrame:  # noqa: ANN001
    """rows, each once for every fold for which span(fold) holds, with the fold's columns."""
    return rows.select("*", F.explode(F.filter(fold_table(folds), span)).alias("_f")).select(*rows.columns, "_f.*")


def known_counts(incidents: DataFrame, folds: list[Fold], history_from: datetime.date, days: int = 90, baselines: int = 5) -> DataFrame:
    """fold, zone_id (null for incidents without one), documented, outcome, deaths (from history_from to the cutoff, a year floor), n_a, n_b, n_ab, n_any, and b0 to b5:
    incidents of the last `days` before the cutoff and of the spans before. incidents: incident_date, zone_id, in_mv, in_ob, in_mort."""
    day = F.col("incident_date")
    i = dealt(incidents, folds, lambda f: (day >= F.least(f["start"], F.lit(history_from))) & (day <= f["end"]))
    known = (day <= F.col("cutoff")) & (day >= F.col("start"))
    age = F.datediff("cutoff", day)
    bucket = F.ceil(age / F.lit(float(days))) - 1
    a, b = F.col("in_mv"), F.col("in_ob")
    return i.groupBy("fold", "zone_id").agg(
        F.count_if(known).alias("documented"),
        F.count_if(day > F.col("cutoff")).alias("outcome"),
        F.count_if((day >= F.lit(history_from)) & (day <= F.col("cutoff")) & F.col("in_mort")).alias("deaths"),
        *(F.count_if(known & c).alias(n) for n, c in (("n_a", a), ("n_b", b), ("n_ab", a & b), ("n_any", a | b))),
        *(F.count_if(known & (age > 0) & (bucket == k)).alias(f"b{k}") for k in range(baselines + 1)),
    )


def known_burden(weekly: DataFrame, folds: list[Fold], days: int = 365) -> DataFrame:
    """fold, zone_id, burden (3 * abductions + violence against civilians) of the weeks from `days` before the cutoff to the cutoff."""
    w = dealt(weekly, folds, lambda f: F.col("week").between(F.date_sub(f["cutoff"], days), f["cutoff"]))
    when = lambda c: F.sum(F.when(c, F.col("events")).otherwise(0))
    return w.groupBy("fold", "zone_id").agg((3 * when(F.col("sub_type") == "F") + when(F.col("event_type") == "R")).alias("burden"))


def best_circles(zones: DataFrame, cases: DataFrame) -> DataFrame:
    """fold, zone_id, rr of the zones in each fold's circle of highest ratio. cases: fold, zone_id, cases."""
    order = Window.partitionBy("fold").orderBy(F.desc(micro("llr")), "center", "radius_km")
    best = scan.scanned(zones, cases, by=["fold"]).withColumn("_k", F.row_number().over(order)).where("_k = 1 AND llr > 0")
    return best.select("fold", F.explode("members").alias("zone_id"), "rr")


def found_circles(zones: DataFrame, cases: DataFrame, folds: list[Fold], replications: int = 999) -> DataFrame:
    """The same of each fold's primary cluster and its significant secondary ones, with the highest rr where a zone is in several."""
    out = None
    for f in folds:
        found = scan.clusters(zones, cases.where(F.col("fold") == f.fold).drop("fold"), replications)
        own = found.select(F.explode("members").alias("zone_id"), "rr").groupBy("zone_id").agg(F.max("rr").alias("rr")).select(F.lit(f.fold).alias("fold"), "zone_id", "rr")
        out = own if out is None else out.unionByName(own)
    return out


def components(zones: DataFrame, incidents: DataFrame, weekly: DataFrame, seen: DataFrame, folds: list[Fold], history_from: datetime.date, simulated: bool = False) -> DataFrame:
    """fold, zone_id, the columns of risk.WEIGHTS as of the fold's cutoff, and outcome: a row per zone and fold, zones without incidents too.

    seen: zone_id of documented sighting patterns, which have no cutoff. simulated: clusters by simulation (the primary one and
    significant others), as the index has them; else the best circle, which SQL can state. Nothing after a cutoff reaches a component of its fold.
    """
    counts = rates.checkpointed(known_counts(incidents, folds, history_from))
    places = zones.select("zone_id", "population", "lat", "lng")
    each = dealt(places, folds, lambda f: f["fold"].isNotNull()).select("fold", "zone_id", "population")
    own = [c for c in counts.columns if c not in ("fold", "zone_id")]
    base = each.join(counts, ["fold", "zone_id"], "left").fillna(0, own)
    a, b, both = F.sum("n_a"), F.sum("n_b"), F.sum("n_ab")
    chapman = F.when(both >= 3, ((a + 1) * (b + 1) / (both + 1) - 1) / F.greatest(F.sum("n_any"), F.lit(1))).otherwise(1.0)
    factor = counts.groupBy("fold").agg(chapman.alias("factor"))
    base = rates.empirical_bayes(base, by=["fold"]).join(factor, "fold", "left")
    base = base.join(known_burden(weekly, folds), ["fold", "zone_id"], "left")
    people = F.col("population")
    rate = lambda x: micro(rates.per_100k(F.coalesce(x, F.lit(0)), people))
    base = base.withColumns({"eb_rate": micro("eb_rate"), "mse_rate": rate(F.col("documented") * F.coalesce("factor", F.lit(1.0))), "burden_rate": rate(F.col("burden")), "death_rate": rate(F.col("deaths"))})
    base = rates.checkpointed(base)
    for value, out in (("eb_rate", "eb_pct"), ("mse_rate", "mse_pct"), ("burden_rate", "acled_recent"), ("death_rate", "ucdp_baseline")):
        base = base.join(rates.midranks(base, value, out, "fold"), ["fold", value], "left")
    older = [F.col(f"b{k}").cast("double") for k in range(1, 6)]
    mean = sum(older[1:], older[0]) / 5
    squares = [(x - mean) * (x - mean) for x in older]
    sd = F.sqrt(sum(squares[1:], squares[0]) / 4)
    z = half_up((F.col("b0") - mean) / F.greatest(sd, F.lit(0.6)), 2)
    cases = base.select("fold", "zone_id", F.col("documented").alias("cases"))
    inside = found_circles(places, cases, folds) if simulated else best_circles(places, cases)
    got = base.join(inside, ["fold", "zone_id"], "left").join(seen.select("zone_id").distinct().withColumn("_seen", F.lit(1.0)), "zone_id", "left")
    return got.select(
        "fold",
        "zone_id",
        *(micro(c).alias(c) for c in ("eb_pct", "mse_pct")),
        micro(risk.cluster_score(F.col("rr"))).alias("cluster_score"),
        *(micro(c).alias(c) for c in ("acled_recent", "ucdp_baseline")),
        micro(risk.temporal_score(z)).alias("temporal_score"),
        F.coalesce("_seen", F.lit(0.0)).alias("vehicle_score"),
        "outcome",
    )


def ranking_report(rows: DataFrame, sets: dict[str, dict[str, float]]) -> DataFrame:
    """weights, fold, n, n_positive, auc (for outcomes of 1 and more; 0.5 with one class only) and rho (of ranks; 0 without spread) of each set of weights in each fold."""
    score = lambda w: micro(sum((F.lit(float(w.get(k, 0.0))) * F.col(k) for k in risk.WEIGHTS), F.lit(0.0)))
    scored = rows.select("fold", "outcome", F.explode(F.array(*(F.struct(F.lit(n).alias("weights"), score(w).alias("score")) for n, w in sets.items()))).alias("s")).select("fold", "outcome", "s.*")
    by = ["weights", "fold"]
    rank = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / F.lit(2.0)
    ranked = scored.select(*by, "outcome", rank("score").alias("r"), rank("outcome").alias("o"))
    n, p = F.count("*"), F.count_if(F.col("outcome") >= 1)
    area = (F.sum(F.when(F.col("outcome") >= 1, F.col("r")).otherwise(0.0)) - p * (p + 1) / F.lit(2.0)) / (p * (n - p))
    spread = (F.stddev_pop("r") > 0) & (F.stddev_pop("o") > 0)
    return ranked.groupBy(*by).agg(n.alias("n"), p.alias("n_positive"), F.when((p == 0) | (p == n), F.lit(0.5)).otherwise(area).alias("auc"), F.when(spread, F.covar_pop("r", "o") / (F.stddev_pop("r") * F.stddev_pop("o"))).otherwise(0.0).alias("rho"))
