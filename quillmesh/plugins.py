"""What needs a model or a network: fetching, embedding and judging, as functions that are passed in, with offline stand-ins.

Each runs per batch inside ``mapInPandas``; a failure becomes a row with an error, never a failed job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Fetcher = Callable[[str], str | None]
Embedder = Callable[[list[str]], list[list[float] | None]]
Judge = Callable[[str, str], str | None]


def hashed_embedder(dim: int = 64) -> Embedder:
    """Vectors of hashed words: equal texts have equal vectors, texts with common words are near."""

    def run(texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for t in texts:
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % dim] += 1 if h >> 63 else -1
            n = float(np.linalg.norm(v))
            out.append((v / n).tolist() if n else None)
        return out

    return run


def same_words_judge(share: float = 0.6) -> Judge:
    """Says yes if the two texts have most of their words in common."""

    def run(a: str, b: str) -> str:
        x, y = set((a or "").lower().split()), set((b or "").lower().split())
        return "yes" if x and len(x & y) >= share * min(len(x), len(y) or 1) else "no"

    return run


def fetch(urls: DataFrame, fetcher: Fetcher, column: str = "url") -> DataFrame:
    """(url, body, error) of every distinct URL."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for u in pdf[column]:
                try:
                    rows.append((u, fetcher(u), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((u, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["url", "body", "error"])

    return urls.select(column).where(f"{column} is not null").distinct().mapInPandas(run, "url string, body string, error string")


def embed(texts: DataFrame, embedder: Embedder, dim: int = 64, batch: int = 32) -> DataFrame:
    """(id, embedding, error): vectors of (id, text), checked for length and finite entries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                try:
                    vecs, error = embedder(part["text"].fillna("").tolist()), None
                except Exception as e:  # noqa: BLE001
                    vecs, error = [None] * len(part), f"{type(e).__name__}: {e}"[:300]
                fine = [v if v is not None and len(v) == dim and bool(np.isfinite(v).all()) else None for v in vecs]
                why = [error or (None if f is not None else "no usable vector") for f in fine]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": pd.Series(fine, dtype=object), "error": pd.Series(why, dtype=object)})

    return texts.select("id", "text").mapInPandas(run, "id long, embedding array<float>, error string")


def judge_pairs(pairs: DataFrame, judge: Judge) -> DataFrame:
    """(a, b, same): the verdict on (a, b, text_a, text_b); anything but yes is not the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said = []
            for x, y in zip(pdf["text_a"], pdf["text_b"]):
                try:
                    said.append((judge(x, y) or "").strip().lower() == "yes")
                except Exception:  # noqa: BLE001
                    said.append(False)
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "same": said})

    return pairs.mapInPandas(run, "a long, b long, same boolean")
