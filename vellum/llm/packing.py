"""Items of varying length into containers of fixed capacity with little room left.

Texts are measured once in tokens of a public tokenizer; one longer than a container is cut into full pieces and a rest, all
others stay whole.  Full pieces are containers of their own.  The rest is dealt by hash into blocks of bounded expected size;
each block is divided into windows by Karmarkar-Karp multiway differencing: the two partial partitions with the largest spread
are merged, the fullest windows of one on the emptiest of the other.  Windows come out nearly equal; their number starts at
the least possible and rises while any window is over capacity.

Defined results: null and empty texts are items of length 0 and go into a container like any other; repeated ids are separate
items, and no two containers have one id; an empty table has no containers.  An item's ``start`` is its first token in its text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import written

CAPACITY = 2_048
BLOCK_ITEMS = 2_000
#: How the vocabulary's tokenizer cuts text before merging (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str):
    """The tokenizer of a rank file; loaded once per worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def measured(docs: DataFrame, vocabulary: str, doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, n_tokens)`` of whole texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc", "n_tokens"])

    kind = docs.schema[doc_key].dataType.simpleString()
    return docs.select(F.col(doc_key).alias("doc"), F.col(text).alias("text")).mapInArrow(count, f"doc {kind}, n_tokens bigint")


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Items of each of ``k`` windows by multiway differencing.

    A partial partition is a list of ``(sum, tree)`` in falling order; windows that are still empty are left out.
    A tree is an item's number or a pair of trees.
    """
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            new = a + b
        else:
            turn = b[::-1]
            new = a[: len(a) - over] + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[len(a) - over :], turn[:over])] + turn[over:]
        new.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (-(new[0][0] - (new[-1][0] if len(new) == k else 0)), tick, new))
        tick += 1
    windows = []
    for _, tree in heap[0][2] if heap else ():
        items, stack = [], [tree]
        while stack:
            x = stack.pop()
            stack.extend(x) if isinstance(x, tuple) else items.append(x)
        windows.append(items)
    return windows


def packed_block(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; every size must be at most that."""
    real = [i for i, s in enumerate(sizes) if s > 0]
    total = sum(sizes)
    k = max(1, -(-total // capacity))
    while True:
        windows = [[real[i] for i in w] for w in differencing([sizes[i] for i in real], k)] or [[]]
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            break
        k += 1
    windows[-1].extend(i for i, s in enumerate(sizes) if s <= 0)
    return windows


def packed(docs: DataFrame, vocabulary: str, doc_key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row per container: its id, tokens, number of items, and the items ``(doc, piece, start, n_tokens)``.

    ``vocabulary`` is the path of the tokenizer's rank file, as executors see it.
    """
    kind = docs.schema[doc_key].dataType.simpleString()
    sizes = written(measured(docs, vocabulary, doc_key, text).withColumn("row", F.monotonically_increasing_id()), "token-counts")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")
    items = sizes.select("doc", "row", "n_tokens", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece")).withColumn("start", F.col("piece").cast("bigint") * capacity)
    items = items.select("doc", "row", "piece", "start", F.least(F.lit(capacity), F.col("n_tokens") - F.col("start")).alias("n_tokens"))
    names = ("doc", "piece", "start", "n_tokens")
    full = items.where(F.col("n_tokens") == capacity).select(F.concat_ws("-", F.lit("full"), "row", "piece").alias("container_id"), "n_tokens", F.lit(1).alias("n_items"), F.array(F.struct(*names)).alias("items"))
    blocks = max(1, -(-sizes.where((F.col("n_tokens") % capacity != 0) | (F.col("n_tokens") == 0)).count() // block_items))
    schema = f"container_id string, n_tokens bigint, n_items int, items array<struct<doc:{kind},piece:int,start:bigint,n_tokens:bigint>>"

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "piece"])
        rows = list(zip(*[frame[c].tolist() for c in names]))
        block = int(frame["block"].iloc[0])
        out = []
        for k, w in enumerate(packed_block([r[-1] for r in rows], capacity)):
            own = [dict(zip(names, rows[i])) for i in sorted(w)]
            out.append((f"{block}-{k}", sum(x["n_tokens"] for x in own), len(own), own))
        return pd.DataFrame(out, columns=["container_id", "n_tokens", "n_items", "items"])

    rest = items.where(F.col("n_tokens") < capacity).withColumn("block", F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)))
    # blocks cost CPU, not bytes: a partition each, up to some thousands, so that they are not merged for their size
    tasks = blocks if blocks <= 2_000 else -(-blocks // 4)
    return rest.repartition(tasks, "block").groupBy("block").applyInPandas(fill, schema).unionByName(full)
