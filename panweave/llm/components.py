"""Connected components of a graph given as a table of links.

Links are kept as pairs of a node and a smaller one, its parent. Each round first contracts them: links are dealt by
their larger node, and each task replaces its links by the shortest ones that connect the same nodes, from every node
to the smallest of its part. So the links of a hub are combined before and after the shuffle and never gathered, as
every task has one link for each of its nodes at most. Then every parent is replaced by its own parent, which halves the paths. When
a round changes nothing, every node hangs on the smallest one of its component.

A task contracts up to ROUND links at a time, and there are as many tasks as the counted links need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panweave.llm.common import stored

#: Links that a task contracts at a time.
ROUND = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the nodes of links (a, b): each one that isn't the smallest of its part, and that smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)  # the roots of both ends get the smaller one
        np.minimum.at(new, label[y], low)
        while (deeper := new[new]).tobytes() != new.tobytes():
            new = deeper
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def contract(links: DataFrame) -> DataFrame:
    """Fewer links (u, v) that connect the same nodes, within each partition. Nodes are numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        waiting = 0
        for batch in batches:
            parts.append(np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)], np.int64).reshape(2, -1))
            waiting += batch.num_rows
            if waiting >= ROUND:
                parts = [np.array(roots(*np.concatenate(parts, axis=1)))]
                if parts[0].shape[1] > ROUND // 2:  # little can be contracted
                    yield linked(parts.pop())
                waiting = sum(p.shape[1] for p in parts)
        if parts:
            yield linked(np.array(roots(*np.concatenate(parts, axis=1))))

    def linked(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs], ["u", "v"])

    return links.mapInArrow(run, "u long, v long")


def mark(state: DataFrame) -> tuple:
    return tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, *, rounds: int = 60) -> DataFrame:
    """node and root (the smallest node of its component) of every node in ``links`` (a, b: long).

    Links of a node with itself and repeated links change nothing; nulls are left out. Nodes without links to
    others aren't in the result.
    """
    state = stored(contract(links.filter("a <> b").select("a", "b")), "links")
    now = mark(state)
    for _ in range(rounds):
        if not now[0]:
            break
        tasks = -(-now[0] // ROUND)
        dealt = state.coalesce(1) if tasks == 1 else state.repartition(tasks, "u")
        state = stored(contract(dealt), "links")
        if tasks > 1:
            # A hub is a parent of many and has none itself: its part of the left side can be split.
            up = state.groupBy("u").agg(F.min("v").alias("up")).withColumnRenamed("u", "v")
            up = stored(up, "parents")
            state = stored(state.join(up, "v", "left").select("u", F.coalesce("up", "v").alias("v")), "links")
        now, before = mark(state), now
        if tasks == 1 or now == before:
            break
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
