"""Filling containers of a fixed number of tokens by best-fit decreasing.

A text longer than a container is split into full containers and a rest; nothing else is split. Items go to shards of about
SHARD_ITEMS by hash, and each shard is packed in one task: items in order of falling size, each into the open bin with the
least remaining room that still holds it, found by descending a segment tree over the remaining capacities. A shard's size
is bounded, so no task holds more than a fixed number of items however many there are; each shard leaves at most a few bins
poorly filled.

Defined results: null and empty texts have no tokens and go into no container; ties are broken by doc_id and piece; equal
texts are packed each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .tokens import TOKENIZER, count_tokens

CAPACITY = 1024
SHARD_ITEMS = 20_000


class Rooms:
    """A segment tree over remaining capacities: how many open bins have each, and the tightest that holds a size."""

    def __init__(self, capacity: int):
        self.width = 1 << (capacity + 1).bit_length()
        self.tree = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, name: int) -> None:
        self.bins[room].append(name)
        node = room + self.width
        while node:
            self.tree[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns (room, bin) of the open bin of least room >= size."""
        node = size + self.width
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.width
        while node:
            self.tree[node] -= 1
            node >>= 1
        return room, self.bins[room].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; sizes come in falling order."""
    rooms, out, opened = Rooms(capacity), [], 0
    for size in sizes:
        found = rooms.take(size)
        if found is None:
            found, opened = (capacity, opened), opened + 1
        room, name = found
        out.append(name)
        if room > size:
            rooms.add(room - size, name)
    return out


def _items(capacity: int, path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens = np.array(count_tokens(list(pdf["text"]), path), dtype=np.int64)
            pieces = -(-tokens // capacity)
            doc = np.repeat(pdf["doc_id"].to_numpy(), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(capacity, np.repeat(tokens, pieces) - piece * capacity)
            yield pd.DataFrame({"doc_id": doc, "piece": piece, "token_start": piece * capacity, "tokens": size})

    return run


def _pack(capacity: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True])
        bins = best_fit_decreasing(pdf["tokens"].tolist(), capacity)
        return pd.DataFrame({"container": [f"{key[0]}-{b}" for b in bins], "doc_id": pdf["doc_id"].to_numpy(), "piece": pdf["piece"].to_numpy(), "token_start": pdf["token_start"].to_numpy(), "tokens": pdf["tokens"].to_numpy()})

    return run


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(container, doc_id, piece, token_start, tokens)."""
    items = stage(documents.select("doc_id", "text").filter("text is not null").mapInPandas(_items(capacity, path), "doc_id long, piece long, token_start long, tokens long"), "items")
    full = items.filter(F.col("tokens") == capacity).select(F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container"), "doc_id", "piece", "token_start", "tokens")
    rest = items.filter(F.col("tokens") < capacity)
    shards = max(1, -(-rest.count() // shard_items))
    sharded = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    return full.unionByName(sharded.groupBy("shard").applyInPandas(_pack(capacity), "container string, doc_id long, piece long, token_start long, tokens long"))
