"""What may be taken from others: tiers of trust, anchors, and admission."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import anchor


@dataclass(frozen=True)
class Tier:
    name: str
    accepts_peer_contribution: bool
    requires_peers: bool
    check: str


RECOMPUTABLE = Tier("recomputable", True, False, "derive it again from bytes at hand; any difference rejects it")
CORROBORABLE = Tier("corroborable", True, True, "enough distinct observers agree, or there is no answer")
LOCAL_ONLY = Tier("local_only", False, False, "build it here; a copy from others isn't taken")
TIERS = {t.name: t for t in (RECOMPUTABLE, CORROBORABLE, LOCAL_ONLY)}

#: For each kind of artifact its tier and the column that anchors it to content, if any.
ARTIFACTS: dict[str, tuple[Tier, str | None]] = {
    "web_doc": (CORROBORABLE, "source_hash"),
    "indexed_doc": (CORROBORABLE, "source_hash"),
    "retail_observation": (CORROBORABLE, None),
    "vector": (LOCAL_ONLY, None),
}


def tier_of(kind: Column) -> Column:
    """The name of the tier of an artifact kind; null if unknown."""
    pairs = [x for k, (t, _) in ARTIFACTS.items() for x in (F.lit(k), F.lit(t.name))]
    return F.try_element_at(F.create_map(*pairs), kind)


def accepts_peer(kind: Column) -> Column:
    return F.coalesce(tier_of(kind).isin([t.name for t in TIERS.values() if t.accepts_peer_contribution]), F.lit(False))


def requires_peers(kind: Column) -> Column:
    return F.coalesce(tier_of(kind).isin([t.name for t in TIERS.values() if t.requires_peers]), F.lit(False))


def is_anchored(content_id: Column) -> Column:
    """Whether there is a content id; one of all zero bytes is none."""
    return anchor(content_id).isNotNull()


def admit(rows: DataFrame, kind: str) -> DataFrame:
    """Rows from others that may be taken: none of a local kind, and anchored ones where the kind has an anchor."""
    tier, column = ARTIFACTS[kind]
    if not tier.accepts_peer_contribution:
        return rows.limit(0)
    return rows if column is None else rows.where(is_anchored(F.col(column)))
