"""Choosing frames of a video: those that differ from the last one chosen, thinned evenly (SRC-11)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def changed(prints: list[np.ndarray], threshold: float = 12.0) -> list[int]:
    """Positions of the frames whose mean absolute difference from the last chosen one is above the threshold."""
    kept: list[int] = []
    for i, p in enumerate(prints):
        if not kept or float(np.abs(p.astype(float) - prints[kept[-1]].astype(float)).mean()) > threshold:
            kept.append(i)
    return kept


def thinned(kept: list[int], most: int = 24) -> list[int]:
    if len(kept) <= most:
        return kept
    return [kept[int(k * len(kept) / most)] for k in range(most)]


def sampled(frames: DataFrame, threshold: float = 12.0, most: int = 24) -> DataFrame:
    """(video, t) of the chosen frames of (video, t, pixels array<int>); a video's frames are one group, in order of t."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t").drop_duplicates("t")
        at = thinned(changed([np.asarray(p) for p in pdf["pixels"]], threshold), most)
        return pdf.iloc[at][["video", "t"]]

    return frames.where("pixels is not null and t is not null").select("video", "t", "pixels").groupBy("video").applyInPandas(run, "video string, t int")
