"""Agreement of independent observers on a value, or nothing: native aggregation only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import anchor
from ..schemas import QuorumParams


@dataclass(frozen=True)
class Observation:
    """How to read votes from a table: what is claimed, when, how many, and which rows count at all."""

    claim: Column
    observed_at: Column
    quantity: Column | None = None
    admissible: Column | None = None


def latest_votes(votes: DataFrame, subject: list[str], observer: str = "observer", at: str = "observed_at", seq: str = "seq") -> DataFrame:
    """One row for each subject and observer: the latest, and of equally late ones the first by ``seq``.

    The minimum of a struct is a partial aggregate: an observer who votes a million times sends one row
    from each task.
    """
    rest = [c for c in votes.columns if c not in (*subject, observer, at, seq)]
    best = F.min(F.struct((-F.col(at)).alias("__late"), F.col(seq).alias("__seq"), *rest)).alias("__best")
    picked = votes.groupBy(*subject, observer).agg(best)
    return picked.select(*subject, observer, (-F.col("__best.__late")).alias(at), F.col("__best.__seq").alias(seq), *(F.col(f"__best.{c}").alias(c) for c in rest))


def reconcile(votes: DataFrame, subject: list[str], spec: Observation, now: int | Column, params: QuorumParams = QuorumParams(), observer: str = "observer", seq: str = "seq") -> DataFrame:
    """The claim of each subject that most observers support, with at least ``k`` of them and no tie for first.

    Inadmissible votes count neither for nor against. A vote older than the window is ignored (one from
    the future isn't). Each observer has one vote, the latest. The quantity is the upper median of the
    winners' counts, if at least ``k`` gave one and ``k`` are within the tolerance of it, else null. A
    subject without an answer has no row.

    Votes shuffle once, by subject and observer; what is left for a subject is one row per observer.
    """
    now = F.lit(now) if isinstance(now, int) else now
    quantity = spec.quantity if spec.quantity is not None else F.lit(None).cast("long")
    rows = votes if spec.admissible is None else votes.where(spec.admissible)
    rows = rows.where(now - spec.observed_at <= params.window_secs)
    rows = rows.select(*subject, observer, spec.observed_at.cast("long").alias("observed_at"), F.col(seq).alias("seq"), spec.claim.alias("claim"), quantity.cast("long").alias("quantity"))
    last = latest_votes(rows.withColumnRenamed(observer, "observer"), subject)
    tally = last.groupBy(*subject, "claim").agg(F.count("*").alias("support"), F.sort_array(F.collect_list("quantity")).alias("counts"))
    whole = Window.partitionBy(*subject)
    ranked = tally.withColumns({"top": F.max("support").over(whole), "voters": F.sum("support").over(whole)})
    winners = ranked.where(F.col("support") == F.col("top")).withColumn("ties", F.count("*").over(whole)).where(f"ties = 1 and support >= {params.k}")
    return winners.select(*subject, "claim", upper_median("counts", params.k, params.qty_tolerance).alias("quantity"), "support", (F.col("voters") - F.col("support")).alias("dissent"))


def upper_median(counts: str | Column, k: int, tolerance: int) -> Column:
    """The element at half the length of a sorted array, if k counts are there and k lie within the tolerance."""
    c = F.col(counts) if isinstance(counts, str) else counts
    middle = F.get(c, F.floor(F.size(c) / 2).cast("int"))
    close = F.size(F.filter(c, lambda x: F.abs(x - middle) <= tolerance))
    return F.when((F.size(c) >= k) & (close >= k), middle)


def reconcile_retail(observations: DataFrame, now: int | Column, params: QuorumParams = QuorumParams()) -> DataFrame:
    """Agreed availability and quantity of every store and sku."""
    spec = Observation(F.col("availability"), F.col("observed_at"), F.col("quantity"))
    return reconcile(observations, ["store", "sku"], spec, now, params).withColumnRenamed("claim", "availability")


def reconcile_web(observations: DataFrame, now: int | Column, params: QuorumParams = QuorumParams(), per_url: bool = True, subject: list[str] | None = None) -> DataFrame:
    """Agreed content of every URL; without ``per_url``, of all rows as one subject, where other URLs split the vote.

    Where an observer saw a URL several times and each of them is to be answered, ``subject`` names the columns
    that tell them apart; otherwise only the latest vote counts. A vote whose hash is all zero is void.
    """
    hash_ = anchor(F.col("source_hash"))
    spec = Observation(F.struct("url", "source_hash"), F.col("observed_at"), admissible=hash_.isNotNull())
    rows = observations if subject else observations.withColumn("subject", F.col("url") if per_url else F.lit("all"))
    out = reconcile(rows, subject or ["subject"], spec, now, params)
    return out.select("claim.url", "claim.source_hash", "support", "dissent")
