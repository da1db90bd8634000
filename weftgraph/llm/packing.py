"""Fixed-capacity containers filled by bulk-synchronous best fit.

Sizes are whole tokens up to the capacity, so the sorted sequence of items and of gaps is held as runs of equal values:
at most capacity + 1 runs each, however many documents there are. One sweep over the runs finds for every gap the
largest item it can hold; ranks within a run settle which item meets which gap. Only the ranks of the
documents (exact offset numbering) and the final look-up touch the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import RANK, number_rows

CAPACITY = 2048


def plan_containers(sizes: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Moves (size, first rank, number, first container, offset) and the number of containers, for size -> number of items.

    A round sweeps items and gaps in ascending order, items before gaps of the same value, with a stack: a gap takes the
    items on top, the largest that fit and that no smaller gap took. Gaps shrink, and rounds go on until nothing fits; then as many
    empty containers are opened as the rest needs at least.
    """
    left = {s: n for s, n in sizes.items() if n > 0 and s > 0}
    taken = dict.fromkeys(left, 0)
    groups: list[tuple[int, int, int]] = []  # gap, first container, number
    moves: list[tuple[int, int, int, int, int]] = []
    used = 0
    while left:
        rest = sum(s * n for s, n in left.items())
        new = max(1, -(-rest // capacity))
        groups.append((capacity, used, new))
        used += new
        matched = True
        while matched and left:
            matched = False
            least = min(left)
            after: list[tuple[int, int, int]] = []
            stack: list[list[int]] = []
            order, i = sorted(left), 0
            for gap, first, n in sorted(g for g in groups if g[0] >= least):
                while i < len(order) and order[i] <= gap:
                    stack.append([order[i], left[order[i]]])
                    i += 1
                while n and stack:
                    s, have = stack[-1]
                    k = min(n, have)
                    moves.append((s, taken[s], k, first, capacity - gap))
                    taken[s] += k
                    left[s] -= k
                    after.append((gap - s, first, k))
                    first, n, matched = first + k, n - k, True
                    if k == have:
                        stack.pop()
                    else:
                        stack[-1][1] -= k
                if n:
                    after.append((gap, first, n))
            left = {s: n for s, n in left.items() if n}
            groups = after
    return np.array(sorted(moves), dtype=np.int64).reshape(-1, 5), used


def pack(items: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(id, piece_no, n_tokens, token_start, container_id, offset): every item placed once, no container over ``capacity``.

    An item over the capacity is cut into full containers and a rest; no other item is split. Items of size 0 or NULL take no space
    and are spread over the containers. Repeated ids are items of their own. Ties of equal sizes go by id. No items, no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    base = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("size"))
    cuts = F.expr(f"sequence(0L, greatest(size - 1, 0L) div {capacity}L)")
    parts = base.select("id", "size", F.explode(cuts).alias("piece_no")).select(
        "id", F.col("piece_no").cast("int").alias("piece_no"), (F.col("piece_no") * capacity).alias("token_start"), F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece_no") * capacity).alias("n_tokens")
    )
    ranked = number_rows(parts, ["n_tokens"], ["id", "piece_no"])
    sizes = {r[0]: r[1] for r in ranked.groupBy("n_tokens").count().collect()}  # at most capacity + 1 rows
    moves, used = plan_containers(sizes, capacity)
    shared = items.sparkSession.sparkContext.broadcast((moves, max(used, 1)))  # bounded by sizes and gaps, not by items

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, n = shared.value
        key = (m[:, 0] << 44) + m[:, 1]
        for f in frames:
            size, rank = f["n_tokens"].to_numpy(np.int64), f[RANK].to_numpy(np.int64)
            container, offset = rank % n, np.zeros(len(f), np.int64)
            real = size > 0
            if real.any():
                i = np.searchsorted(key, (size[real] << 44) + rank[real], side="right") - 1
                container[real] = m[i, 3] + rank[real] - m[i, 1]
                offset[real] = m[i, 4]
            yield f[["id", "piece_no", "n_tokens", "token_start"]].assign(container_id=container, offset=offset)

    kind = dict(parts.dtypes)["id"]
    return ranked.mapInPandas(place, f"id {kind}, piece_no int, n_tokens long, token_start long, container_id long, offset long").withColumnRenamed("id", id_col)
