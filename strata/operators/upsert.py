"""Keyed upsert (K7, J6, U3): delete target rows whose key is staged, then
insert every staged row.

Semantics kept on purpose: duplicate keys inside the staged batch are all
inserted; a null key never matches, so null-key rows of both sides survive.
(``MERGE INTO`` differs: it rejects several source rows matching one target
row.)

Skew: the anti join needs only key existence, so the staged keys are reduced
to distinct keys first. That aggregate merges map-side, so a batch in which
one trip is copied a million times (a re-delivered file) contributes one key,
and the build side of the join is unique per key. A hot key on the target
side is then a plain skewed partition of a left-anti join, which AQE's
skew-join handling splits (``spark.sql.adaptive.skewJoin.enabled``) -- but
only when both join inputs are plain shuffles. Large publishes therefore
stage the distinct keys as Parquet first (``stage_keys``) and pass them in as
``staged_keys``; an aggregate feeding the join directly would hide the skew
from AQE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def upsert(
    target: DataFrame,
    staged: DataFrame,
    key: str | Sequence[str],
    staged_keys: DataFrame | None = None,
) -> DataFrame:
    """``staged_keys``: the batch's distinct keys, already materialised (see
    ``stage_keys``); computed lazily from ``staged`` when omitted."""
    keys = _keys(key)
    delete = staged_keys if staged_keys is not None else staged.select(*keys).distinct()
    kept = target.join(delete.select(*keys), keys, "left_anti")
    return kept.unionByName(staged.select(*target.columns))


def stage_keys(staged: DataFrame, key: str | Sequence[str], path: str) -> DataFrame:
    """Write the batch's distinct keys (the delete list) and read them back.

    One map-side-merged aggregate; the read-back is a plain scan, so the anti
    join sees two shuffles and AQE can split a hot target key, and the key
    list is computed once however often it is used."""
    keys = _keys(key)
    delete = staged.select(*keys).distinct()
    delete.write.mode("overwrite").parquet(path)
    # read back with the known schema: no footer-inference job
    return staged.sparkSession.read.schema(delete.schema).parquet(path)


def replaced_rows(target: DataFrame, staged: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Target rows an upsert would delete (a change count / audit trail)."""
    keys = _keys(key)
    return target.join(staged.select(*keys).distinct(), keys, "left_semi")


def partition_values(staged_keys: DataFrame, partition: str) -> list:
    """The distinct partition values of a batch, null included. For partitions of
    days only: their number is bounded by the calendar, not by the rows."""
    return [r[0] for r in staged_keys.select(partition).distinct().collect()]


def in_partitions(partition: str, values: Sequence) -> Column:
    """Whether a row lies in one of the partitions (never null)."""
    inside = F.col(partition).isin([v for v in values if v is not None])
    return F.coalesce(inside, F.lit(None in values))


def upsert_partitions(
    target: DataFrame, staged: DataFrame, key: str, partition: str,
    staged_keys: DataFrame | None = None, touched_values: Sequence | None = None,
) -> DataFrame:
    """Upsert restricted to the partitions the batch touches.

    Valid when equal keys always fall in the same partition value (for the
    fact: ``trip_id`` hashes the pickup time and ``pickup_date_key`` derives
    from it). Given ``touched_values`` (the batch's partition values; for days a
    list that the calendar bounds, see ``partition_values``) the target is read
    through a static partition filter, so untouched partitions are not even
    listed by a task; without it a semi join picks the touched rows. The anti
    join runs on ``(partition, key)`` so it spreads even when one partition is
    hot. Write the result with dynamic partition overwrite; untouched partitions
    stay.
    """
    delete = staged_keys if staged_keys is not None else staged.select(partition, key).distinct()
    if touched_values is not None:
        current = target.filter(in_partitions(partition, touched_values))
    else:
        touched = delete.select(partition).distinct()
        same = target[partition].eqNullSafe(touched[partition])  # the null partition is rewritten too
        current = target.join(touched, same, "left_semi")
    kept = current.join(delete.select(partition, key), [partition, key], "left_anti")
    return kept.unionByName(staged.select(*target.columns))
