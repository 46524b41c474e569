"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echosieve.llm.common import few_tasks
from echosieve.workspace import Workspace

LABEL_BYTES = 24  # of a row of labels that is sent


def components(links: DataFrame, work: Workspace, broadcast_bytes: int = 0) -> DataFrame:
    """``(id, component)`` for every id of the written ``links(a, b)``: the least id in reach.

    Least-label steps, each followed by a jump to the label's label, so a chain of L links
    takes about log L rounds; every round is a written table.  It is done as soon as no link's
    ends differ.  Labels of at most ``broadcast_bytes`` are sent to the links, which then are
    shuffled once a round.  Links to itself are harmless.
    """
    ids = 2 * links.count()  # at most
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionAll(
        links.select(F.col("b").alias("id"), F.col("a").alias("other"))
    )
    least = both.groupBy("id").agg(F.least("id", F.min("other")).alias("component"))
    labels = work.table(few_tasks(least, ids, LABEL_BYTES), "labels")
    ids = labels.count()  # in every round
    sent = ids * LABEL_BYTES <= broadcast_bytes

    def as_sent(labels: DataFrame) -> DataFrame:
        return F.broadcast(labels) if sent else labels

    while True:
        heard = (
            both.join(as_sent(labels.select(F.col("id").alias("other"), "component")), "other")
            .groupBy("id").agg(F.min("component").alias("heard"))
        )
        stepped = heard.join(as_sent(labels), "id").select(
            "id", F.least("component", "heard").alias("component")
        )
        targets = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        jumped = stepped.join(as_sent(targets), "component").select(
            "id", F.least("component", "next").alias("component")
        )
        labels = work.table(few_tasks(jumped, ids, LABEL_BYTES), "labels")
        ends = [labels.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"]
        apart = links.join(as_sent(ends[0]), "a").join(as_sent(ends[1]), "b").filter("ca != cb")
        if apart.isEmpty():
            return labels
