"""Documents into containers of fixed capacity, neighbours on a Hilbert curve together.

Every document gets a hashed vector (the sum of fixed pseudo-random directions
of its distinct tokens), which is standardised over all documents and quantised
to a cell of a Hilbert curve. Documents are range-sorted by that key; each range
is packed as a stream: a segment of the curve, some dozens of containers long,
is packed by best fit in order of decreasing size, and what is left in
containers that did not fill goes on to the next segment. So only the last
containers of a range can be underfilled. Memory is bounded by a segment.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..common import cut_lineage
from .tokens import VOCABULARY, encoding, ship

DIMS, BITS = 6, 10


def directions(tokens: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Pseudo-random directions of token numbers, by integer hashing: the same in every process."""
    x = tokens.astype(np.uint64)[:, None] * np.uint64(dims) + np.arange(dims, dtype=np.uint64)[None]
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
    return (x >> np.uint64(11)).astype(np.float64) / 2**52 - 1.0


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer cells (rows, dims): the transposed index, by Gray code and axis exchange."""
    x = cells.astype(np.int64).copy()
    n, dims = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[:, i] & q) != 0
            x[on, 0] ^= p
            t = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= t
            x[:, i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[:, dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(n, dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Containers (free space, items) of items (size, id, part), by best fit in order of decreasing size."""
    open_bins: list[tuple[int, int]] = []  # (free, number), sorted
    bins: list[list] = []
    free: list[int] = []
    for item in sorted(items, key=lambda t: (-t[0], t[1], t[2])):
        at = bisect_left(open_bins, (item[0], -1))
        if at < len(open_bins):
            room, k = open_bins.pop(at)
        else:
            room, k = capacity, len(bins)
            bins.append([])
            free.append(capacity)
        bins[k].append(item)
        free[k] = room - item[0]
        if free[k] > 0:
            insort(open_bins, (free[k], k))
    return list(zip(free, bins))


class Packer:
    """Packs a stream of items in curve order; ``add`` and ``close`` return containers that are done, as lists of (size, id, part).

    An item above the capacity gives full containers of its own and one rest,
    which is packed like an item. Items of size 0 take no room.
    """

    def __init__(self, capacity: int, segment: int = 64, slack: float = 0.005):
        self.capacity, self.segment, self.slack = capacity, segment, slack
        self.waiting: list[tuple[int, int, int]] = []
        self.load = 0

    def add(self, ident: int, size: int) -> list[list[tuple[int, int, int]]]:
        done, part = [], 0
        while size > self.capacity:
            done.append([(self.capacity, ident, part)])
            size -= self.capacity
            part += 1
        self.waiting.append((size, ident, part))
        self.load += size
        # items of no size are bounded too
        if self.load >= self.segment * self.capacity or len(self.waiting) >= self.segment * 4096:
            done += self._settle()
        return done

    def _settle(self) -> list[list[tuple[int, int, int]]]:
        packed = sorted(best_fit(self.waiting, self.capacity), key=lambda p: p[0])
        done, self.waiting, self.load = [], [], 0
        for k, (room, content) in enumerate(packed):
            # what did not fill goes on, but never more than half a segment
            if room <= self.slack * self.capacity or k < len(packed) // 2:
                done.append(content)
            else:
                self.waiting += content
                self.load += self.capacity - room
        return done

    def close(self) -> list[list[tuple[int, int, int]]]:
        done = [content for _, content in best_fit(self.waiting, self.capacity)]
        self.waiting, self.load = [], 0
        return done


def document_sizes(df: DataFrame, ident: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc, n_tokens and the hashed vector of each row of a non-null id; a null text has no tokens."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(vocabulary)
        cache = directions(np.arange(enc.n_vocab + 1))
        for b in batches:
            sizes, vectors = [], np.zeros((len(b), DIMS))
            for i, t in enumerate(b["_text"]):
                ids = enc.encode_ordinary(t) if t else []
                sizes.append(len(ids))
                if ids:
                    seen = np.unique(np.array(ids))
                    vectors[i] = cache[seen].sum(0) / np.sqrt(len(seen))
            out = pd.DataFrame({"doc": b["_id"].to_numpy(), "n_tokens": np.array(sizes, dtype=np.int64)})
            for d in range(DIMS):
                out[f"v{d}"] = vectors[:, d]
            yield out

    ship(df.sparkSession, vocabulary)
    lean = df.select(df[ident].cast("bigint").alias("_id"), df[text].alias("_text")).filter("_id IS NOT NULL")
    return lean.mapInPandas(work, "doc bigint, n_tokens bigint, " + ", ".join(f"v{d} double" for d in range(DIMS)))


def pack_documents(
    df: DataFrame,
    capacities: Mapping[str, int],
    ident: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    segment: int = 64,
    containers_per_range: int = 256,
    most_ranges: int = 20_000,
) -> DataFrame:
    """One row per part of a document and capacity: pack_kind, container_id, doc_id, part_no, n_tokens.

    Every document is in one container of each kind; only one above the
    capacity is cut, into full containers and a rest. Sizes in a container never
    sum to more than the capacity. Empty and null texts are items of no size.
    Rows of a null id are left out; a repeated id is packed once per row. An
    empty table gives no rows; capacities below 1 are refused.
    """
    if not capacities or min(capacities.values()) < 1:
        raise ValueError("capacities must be at least 1")
    sized = cut_lineage(document_sizes(df, ident, text, vocabulary))
    stats = sized.agg(F.sum("n_tokens").alias("all"), *[f(f"v{d}").alias(f"{n}{d}") for d in range(DIMS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    total = stats["all"] or 0
    mean = np.array([stats[f"m{d}"] or 0.0 for d in range(DIMS)])
    spread = np.array([stats[f"s{d}"] or 1.0 for d in range(DIMS)])
    ranges = int(max(1, min(most_ranges, total // (containers_per_range * max(capacities.values())))))

    @F.pandas_udf(LongType())
    def key(*vs: pd.Series) -> pd.Series:
        z = (np.stack([v.to_numpy() for v in vs], axis=1) - mean) / np.where(spread > 0, spread, 1.0)
        # the logistic function, close to the normal distribution's: cells about equally filled
        share = 1.0 / (1.0 + np.exp(-1.702 * np.clip(z, -8, 8)))
        cells = np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
        return pd.Series(hilbert_key(cells))

    keyed = sized.select("doc", "n_tokens", key(*[F.col(f"v{d}") for d in range(DIMS)]).alias("_key"))
    laid = keyed.repartitionByRange(ranges, "_key", "doc").sortWithinPartitions("_key", "doc", "n_tokens")
    kinds = dict(capacities)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        packers = {name: Packer(cap, segment) for name, cap in kinds.items()}
        count = dict.fromkeys(kinds, 0)

        def frame(got: list[tuple[str, list]]) -> pd.DataFrame:
            rows = []
            for name, containers in got:
                for content in containers:
                    rows += [(name, base | count[name], ident_, part, size) for size, ident_, part in content]
                    count[name] += 1
            return pd.DataFrame(rows, columns=["pack_kind", "container_id", "doc_id", "part_no", "n_tokens"])

        for b in batches:
            yield frame([(name, p.add(i, n)) for i, n in zip(b["doc"].tolist(), b["n_tokens"].tolist()) for name, p in packers.items()])
        yield frame([(name, p.close()) for name, p in packers.items()])

    return laid.mapInPandas(work, "pack_kind string, container_id bigint, doc_id bigint, part_no int, n_tokens bigint")


def fill_report(packed: DataFrame, capacities: Mapping[str, int]) -> DataFrame:
    """pack_kind, capacity_tokens, n_containers, n_tokens, least_containers, fill: how close the packing is to no unused space."""
    per = packed.groupBy("pack_kind").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    cap = F.create_map(*[F.lit(x) for k, v in capacities.items() for x in (k, v)])[F.col("pack_kind")]
    return per.select("pack_kind", cap.alias("capacity_tokens"), "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / cap).alias("least_containers"), (F.col("n_tokens") / (F.col("n_containers") * cap)).alias("fill"))
