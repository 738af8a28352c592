"""Reaction state from a log of reactions and removals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["target_guid", "part", "from_me", "handle_id"]


def latest(log: DataFrame) -> DataFrame:
    """The latest entry per target, part and sender, removals included.

    ``max_by`` combines on the map side, so a message with a flood of reactions is no hot task.
    """
    state = F.struct("emoji", "removed", "ts", "reaction_id")
    rows = log.groupBy(*KEYS).agg(F.max_by(state, F.struct("ts", "reaction_id")).alias("r"))
    return rows.select(*KEYS, "r.emoji", "r.ts", "r.reaction_id", "r.removed")


def live(log: DataFrame) -> DataFrame:
    """The one live reaction per target, part and sender: a reaction replaces earlier ones, a removal clears them."""
    return latest(log).filter("NOT removed").drop("removed")


def merge(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Latest entries after a batch of new log entries. Removals stay, so how the log is cut makes no difference."""
    return latest(current.unionByName(batch.select(current.columns)))
