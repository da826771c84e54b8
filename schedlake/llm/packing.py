"""Texts packed into containers of fixed capacity by sum-of-squares online packing.

The packer keeps ``N[h]``, the number of open containers filled to level h, and places each
item, as it arrives, where the sum of ``N[h] ** 2`` grows least. Blocks of items are packed
apart, each with its own level array, so no task holds more than a block. What a block leaves
in badly filled open containers arrives once more: these rests of all blocks are packed by the
same rule in ever fewer blocks, so the waste does not grow with the number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schedlake.llm import tokens
from schedlake.session import spread, store

CAPACITY = 2048
#: Containers that one block aims at.
BLOCK_CONTAINERS = 512
#: Fill below which a container still open at the end of a block is emptied into the next pass.
WELL_FILLED = 0.995

_PLACED = "container string, doc_id bigint, part_no int, n_tokens int, offset int, open boolean"


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, items taken in the order given.

    Placing size s on level h changes the sum of squares by 2 (N[h+s] - N[h]) + 2; opening a
    container or closing one touches one level only. Ties go to the fullest resulting container.
    """
    level = np.zeros(capacity + 1, dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    into = np.full(len(sizes), -1, dtype=np.int64)
    made = 0
    for i, s in enumerate(sizes.tolist()):
        if s == capacity:
            into[i], made = made, made + 1
            continue
        now = level[: capacity - s + 1]
        cost = 2 * (level[s:] - now) + 2
        cost[0] = 2 * level[s] + 1
        cost[-1] = 1 - 2 * now[-1]  # a container filled to the brim is closed
        # Only levels with an open container may take the item; level 0 is a new one.
        cost[1:][now[1:] == 0] = np.iinfo(np.int64).max
        h = len(cost) - 1 - int(np.argmin(cost[::-1]))
        if h == 0:
            box, made = made, made + 1
        else:
            box = open_at[h].pop()
            level[h] -= 1
        if h + s < capacity:
            level[h + s] += 1
            open_at[h + s].append(box)
        into[i] = box
    return into


def token_items(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = tokens.TOKENIZER) -> DataFrame:
    """``(doc_id, part_no, n_tokens)``: texts as items; one above the capacity as full parts and a rest.

    Null and empty texts hold no tokens and make no item; rows without a doc_id are left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                full, rest = divmod(tokens.load(tokenizer).count(text), capacity)
                out += [(doc, k, capacity) for k in range(full)] + [(doc, full, rest)] * bool(rest)
            yield pd.DataFrame(out, columns=["doc_id", "part_no", "n_tokens"])

    some = documents.where((F.octet_length("text") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "text")
    return spread(some).mapInPandas(run, "doc_id bigint, part_no int, n_tokens int")


def _packed(items: DataFrame, blocks: int, capacity: int, name: str, largest_first: bool) -> DataFrame:
    """Every item placed; ``open`` marks those whose container is not well filled at the end of its block."""
    order = ["n_tokens", "doc_id", "part_no"] if largest_first else ["doc_id", "part_no", "n_tokens"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, ascending=[not largest_first, True, True], ignore_index=True)
        size = frame["n_tokens"]
        box = sum_of_squares(size.to_numpy(), capacity)
        fill = np.bincount(box, weights=size, minlength=1)
        number = name + frame["block"].astype(str) + ":" + pd.Series(box).astype(str)
        return pd.DataFrame({
            "container": number, "doc_id": frame["doc_id"], "part_no": frame["part_no"], "n_tokens": size,
            "offset": size.groupby(box).cumsum() - size, "open": fill[box] < WELL_FILLED * capacity,
        })

    block = F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(blocks)).cast("int")
    return items.withColumn("block", block).groupBy("block").applyInPandas(run, _PLACED)


def pack(items: DataFrame, capacity: int = CAPACITY, block_containers: int = BLOCK_CONTAINERS, largest_first: bool = False) -> DataFrame:
    """``(container, doc_id, part_no, n_tokens, offset)`` for ``items(doc_id, part_no, n_tokens)``.

    Every item lies whole in one container. Items arrive in the order of doc_id and part_no,
    and are spread over blocks by a hash of both, so a hot document spreads too. Later passes
    know all their items and take the largest first, as does the first with ``largest_first``;
    the last pass is one block. An empty table gives an empty result; repeated rows are items each.
    """
    size = lambda df: df.agg(F.sum("n_tokens")).first()[0] or 0
    done, passes, left = [], 0, size(items)
    while True:
        blocks = max(1, -(-left // (capacity * block_containers)))
        placed = store(_packed(items, blocks, capacity, f"{passes}:", largest_first or passes > 0))
        items, before = placed.where("open").select("doc_id", "part_no", "n_tokens"), left
        left = size(items)
        passes += 1
        # One block leaves nothing to gain; nor do blocks that fill hardly any container.
        if blocks == 1 or left > 0.9 * before:
            return reduce(DataFrame.unionByName, [*done, placed]).drop("open")
        done.append(placed.where("NOT open"))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = tokens.TOKENIZER, largest_first: bool = False) -> DataFrame:
    """Tokenize once, then pack."""
    return pack(store(token_items(documents, capacity, tokenizer)), capacity, largest_first=largest_first)
