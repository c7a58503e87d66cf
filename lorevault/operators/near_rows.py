"""The most similar of the rows shortly before each row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lorevault.operators.running import running


def most_similar_before(rows: DataFrame, by: str, order: str, vector: str, within: int, least: float, part: int = 5000) -> DataFrame:
    """``order`` of each row, and of the most similar row among the ``within`` rows of its group before it, if cosine similarity is at least ``least``: row, before, similarity.

    Rows are dealt into blocks of ``within``; a block meets itself and the one before, so
    a task holds two blocks, whatever the size of the group. Ties go to the later row. Vectors must be
    of one length and not zero; ``order`` is a number without repeats.
    """
    placed = running(rows.select(by, order, vector), "place", F.lit(1), "sum", [by], F.floor(F.col(order) / part), [F.col(order)])
    block = F.floor((F.col("place") - 1) / within)
    both = placed.select(by, order, vector, "place", F.explode(F.array(F.struct(block.alias("b"), F.lit(True).alias("asks")), F.struct((block + 1).alias("b"), F.lit(False).alias("asks")))).alias("x")).select(by, order, vector, "place", "x.*")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", kind="stable")
        asks = pdf["asks"].to_numpy()
        if not asks.any():
            return pd.DataFrame({"row": [], "before": [], "similarity": []})
        x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        place, ids = pdf["place"].to_numpy(), pdf[order].to_numpy()
        out = []
        for i in np.array_split(np.flatnonzero(asks), max(1, int(asks.sum()) // 512)):
            s = np.round(x[i] @ x.T, 9)
            gap = place[i][:, None] - place[None, :]
            s[(gap <= 0) | (gap > within)] = -2
            # The last of equals: ties go to the later row.
            j = s.shape[1] - 1 - s[:, ::-1].argmax(1)
            best = s[np.arange(len(i)), j]
            keep = best >= least
            out.append(pd.DataFrame({"row": ids[i][keep], "before": ids[j][keep], "similarity": best[keep]}))
        return pd.concat(out)

    return both.groupBy(by, "b").applyInPandas(compare, "row long, before long, similarity double")
