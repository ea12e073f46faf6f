"""Recall of op2_nearest_vectors against brute force over a whole table: python -m tests.llm.recall FOLDER."""

from __future__ import annotations

import sys

import numpy as np

from gridstone.llm import ann
from gridstone.llm.queries import op2_nearest_vectors


def brute(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, k: int = 5) -> dict[int, list[int]]:
    """The nearest ``k`` ids of each query by cosine, ties to the smaller id."""
    n, out = ann.unit(x), {}
    for at in np.array_split(queries, max(1, len(queries) // 200)):
        score = n[at] @ n.T
        score[np.arange(len(at)), at] = -np.inf
        top = np.argpartition(-score, 4 * k, axis=1)[:, : 4 * k] if score.shape[1] > 4 * k else np.tile(np.arange(score.shape[1]), (len(at), 1))
        for q, row, near in zip(at, score, top):
            # enough ties at the edge to choose the smaller ids
            near = np.flatnonzero(row >= np.sort(row[near])[::-1][min(k, len(near)) - 1] - 1e-12)
            out[int(ids[q])] = [int(ids[i]) for i in near[np.lexsort((ids[near], -np.round(row[near], 12)))][:k] if np.isfinite(row[i])]
    return out


def recall(spark, folder: str) -> float:
    base = ann.usable(spark.read.parquet(f"{folder}/embeddings.parquet")).distinct().toPandas().sort_values("vec_id")
    ids, x = base["vec_id"].to_numpy(), np.array(base["vec"].tolist())
    want = brute(ids, x, np.flatnonzero(ids % 50 == 0))
    got: dict[int, set[int]] = {}
    for r in op2_nearest_vectors(spark, folder).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return sum(len(set(w) & got.get(q, set())) for q, w in want.items()) / max(1, sum(map(len, want.values())))


if __name__ == "__main__":
    from gridstone.session import build

    print(round(recall(build("local[8]", "recall"), sys.argv[1]), 4))
