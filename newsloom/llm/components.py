"""Connected components of a link table, by repeated contraction.

The links are dealt evenly, whatever nodes they share, and each task unites those it got: every
node of its links points to the least node it reaches there. A node that several tasks hold then
points to the least of their answers, and where the answers differ they are links of the next,
smaller round. No task holds more than its part of the links, no key gathers a component, and the
driver sees one count a round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_rows, stored

# Links that one task unites.
LINKS = 200_000


def least_reached(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of `count` nodes the least one that the links a-b lead to."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for ends in (a, b, root[a], root[b]):
            np.minimum.at(root, ends, low)
        root = root[root]
        if (root == before).all():
            return root


def _united(batches):
    a, b = [], []
    for batch in batches:
        a += batch["a"]
        b += batch["b"]
    if a:
        nodes, place = np.unique(np.array(a + b, np.int64), return_inverse=True)
        place = place.reshape(-1)
        root = least_reached(len(nodes), place[: len(a)], place[len(a) :])
        yield {"node": nodes.tolist(), "rep": nodes[root].tolist()}


def components(links: DataFrame, purpose: str = "components", size: int = LINKS) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is its component's least node.

    Repeated and reversed links and loops are harmless; no links give no rows.
    """
    links = stored(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a > b").distinct(),
        purpose,
    )
    found = None
    while (count := links.count()) or found is None:
        dealt = links.repartition(-(-max(1, count) // size), "a", "b")
        parts = stored(arrow_rows(dealt, _united, "node long, rep long"), purpose)
        step = stored(parts.groupBy("node").agg(F.min("rep").alias("root")), purpose)
        if found is None:
            found = step
        else:
            later = step.select(F.col("node").alias("root"), F.col("root").alias("later"))
            found = found.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
        links = stored(
            parts.join(step, "node").filter("rep > root")
            .select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct(),
            purpose,
        )
    return found
