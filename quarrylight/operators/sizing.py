"""Measured sizes behind every broadcast hint in this library."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
#: Plan nodes of a relation that is read and cut down only, so that measuring it is one cheap pass.
PLAIN_NODES = ("Relation", "LogicalRelation", "LocalRelation", "LogicalRDD", "Project", "Filter", "Range", "RepartitionByExpression")
_measured: WeakKeyDictionary = WeakKeyDictionary()


def is_plain(df: DataFrame) -> bool:
    node, plain = df._jdf.queryExecution().optimizedPlan(), True
    while plain:
        plain = node.nodeName() in PLAIN_NODES or node.nodeName().startswith("Relation")
        children = node.children()
        if children.isEmpty():
            return plain
        plain = plain and children.size() == 1
        node = children.head()
    return False


def measured_bytes(df: DataFrame) -> int | None:
    """Bytes of a plain relation's rows, counted once per session and plan; None for any other frame."""
    if not is_plain(df):
        return None
    known = _measured.setdefault(df.sparkSession, {})
    plan = df._jdf.queryExecution().optimizedPlan().semanticHash()
    if plan not in known:
        width = F.lit(8 * len(df.columns))
        for name, kind in df.dtypes:
            if kind == "string":
                width = width + F.coalesce(F.octet_length(name), F.lit(0))
            elif kind.startswith("array"):
                width = width + 16 * F.coalesce(F.size(name), F.lit(0))
        known[plan] = int(df.agg(F.sum(width.cast("long"))).first()[0] or 0)
    return known[plan]


def broadcast_if_small(df: DataFrame, grown_from: DataFrame | None = None, growth: int = 1) -> DataFrame:
    """Hint a broadcast only when a measured size bounds what is sent.

    ``grown_from`` names the relation the rows were derived from and ``growth`` bounds how many
    bytes one of its bytes can turn into. The relation is measured, not estimated. Beyond the bound, and
    for relations that are costly to measure, the frame is returned as it is: Spark plans a
    shuffled join, which adaptive execution turns into a broadcast or splits on skew by real sizes.
    """
    size = measured_bytes(df if grown_from is None else grown_from)
    return F.broadcast(df) if size is not None and size * growth <= BROADCAST_BYTES else df
