"""Exact top-k search by inner product in a bit-sliced index.

Vectors are quantised to integers and stored by bit: one bitmap over the rows of a block per component and binary digit. A
query adds the slices, shifted by the digits of its own components, with bitmap arithmetic: carry-save adders on bitmaps, all
rows of a block at once. First the slices of the low digits are left out; the rows whose upper bound reaches the k-th best
lower bound are found by going from the most significant slice of the sums downward, and only those are resolved exactly.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

#: Rows of a block: a bitmap of 2 kB per slice.
BLOCK_ROWS = 1 << 14
#: Queries that meet a block at a time.
QUERY_ROWS = 1 << 11
#: Low binary digits that the first sum leaves out.
LEFT_OUT = 3
SCALE = 256


def quantised(vector, scale=SCALE):
    """Column: components times ``scale``, rounded down; null for a null vector or one with a null or non-finite component."""
    values = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(usable, values)


class Slices:
    """Bit-sliced index of a block of integer vectors (rows x components), in two's complement from each component's least value."""

    def __init__(self, values):
        self.values = values.astype(np.int64)
        self.n, components = values.shape
        self.words = -(-self.n // 64)
        # Stored are differences from the least value of a component: digits of numbers that are not negative.
        self.least = self.values.min(axis=0) if self.n else np.zeros(components, np.int64)
        shifted = self.values - self.least
        self.digits = max(int(shifted.max()).bit_length(), 1) if shifted.size else 1
        bits = np.zeros((self.words * 64, components, self.digits), np.uint8)
        bits[:self.n] = (shifted[:, :, None] >> np.arange(self.digits)) & 1
        packed = np.packbits(bits.transpose(1, 2, 0).reshape(components * self.digits, -1), axis=1, bitorder="little")
        self.slices = np.ascontiguousarray(packed).view(np.uint64).reshape(components, self.digits, self.words)

    def _sums(self, terms, n_digits):
        """Slices of the sum over rows of ``terms``, bitmaps by weight 2**i: full adders until one bitmap a digit is left."""
        out = np.zeros((n_digits, self.words), np.uint64)
        carried = []
        for i in range(n_digits):
            stack = np.array([*terms.get(i, []), *carried]) if terms.get(i) or len(carried) else np.zeros((0, self.words), np.uint64)
            carried = []
            while len(stack) > 2:
                m = len(stack) // 3
                a, b, c, rest = stack[:m], stack[m:2 * m], stack[2 * m:3 * m], stack[3 * m:]
                half = a ^ b
                carried.extend((a & b) | (c & half))
                stack = np.concatenate([half ^ c, rest])
            if len(stack) == 2:
                carried.append(stack[0] & stack[1])
                out[i] = stack[0] ^ stack[1]
            elif len(stack) == 1:
                out[i] = stack[0]
        return out

    def top(self, query, k, skip=None, left_out=LEFT_OUT):
        """Places and scores of the ``k`` best rows for an integer query, ties to the earlier row; ``skip``: a bitmap of rows to pass."""
        query = query.astype(np.int64)
        low = min(left_out, self.digits - 1)
        # A negative weight counts the complement of a slice: q * s = -|q| + |q| * (not s).
        terms, base, spread = {}, int(query @ self.least), 0
        for component in np.flatnonzero(query):
            q, weight = int(query[component]), abs(int(query[component]))
            spread += weight * ((1 << low) - 1)
            for digit in range(low, self.digits):
                slice_ = self.slices[component, digit]
                if q < 0:
                    slice_, base = ~slice_, base - (weight << digit)
                for place in range(weight.bit_length()):
                    if weight >> place & 1:
                        terms.setdefault(place + digit, []).append(slice_)
            if q < 0:
                base -= weight * ((1 << low) - 1)
        total = sum(len(x) << i for i, x in terms.items())
        sums = self._sums(terms, max(total.bit_length(), 1))
        alive = np.full(self.words, ~np.uint64(0))
        if self.n % 64:
            alive[-1] = np.uint64((1 << self.n % 64) - 1)
        if skip is not None:
            alive &= ~skip
        wanted = min(k, int(np.bitwise_count(alive).sum()))
        if not wanted:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # From the most significant slice down: rows surely above, rows level so far, and the k-th best lower bound.
        above, level, bound = np.zeros(self.words, np.uint64), alive, 0
        for i in range(len(sums) - 1, -1, -1):
            ones = level & sums[i]
            if int(np.bitwise_count(above | ones).sum()) >= wanted:
                level, bound = ones, bound | 1 << i
            else:
                above, level = above | ones, level & ~sums[i]
        # What the left-out digits could add puts more rows at the border: all sums from bound - spread on.
        rows = self._from(sums, max(bound - spread, 0)) & alive
        places = np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little")[:self.n])
        scores = self.values[places] @ query
        order = np.lexsort((places, -scores))[:wanted]
        return places[order], scores[order]

    @staticmethod
    def _from(sums, least):
        """Bitmap of the rows whose sum is at least ``least``."""
        above, level = np.zeros(sums.shape[1], np.uint64), np.full(sums.shape[1], ~np.uint64(0))
        for i in range(len(sums) - 1, -1, -1):
            if least >> i & 1:
                level = level & sums[i]
            else:
                above, level = above | (level & sums[i]), level & ~sums[i]
        return above | level if not least >> len(sums) else np.zeros_like(above)


def _best_of_block(k):
    def search(key, queries, rows):
        out = []
        if len(rows) and len(queries):
            rows = rows.sort_values("id", kind="stable", ignore_index=True)
            width = max(rows["vector"].str.len().max(), queries["vector"].str.len().max())
            filled = lambda v: np.array([np.pad(x, (0, width - len(x))) for x in v], np.int64).reshape(len(v), width)
            ids, times, index = rows["id"].to_numpy(), rows["times"].to_numpy(), Slices(filled(rows["vector"]))
            for query, vector in zip(queries["id"], filled(queries["vector"])):
                own = np.searchsorted(ids, [query, query + 1])
                skip = None
                if own[0] < own[1]:
                    marks = np.zeros(index.words * 64, np.uint8)
                    marks[own[0]:own[1]] = 1
                    skip = np.packbits(marks, bitorder="little").view(np.uint64)
                places, scores = index.top(vector, k, skip)
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[places], "score": scores, "times": times[places]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "times": []}).astype("int64")
    return search


def search(queries: DataFrame, rows: DataFrame, k, block_rows=BLOCK_ROWS, query_rows=QUERY_ROWS) -> DataFrame:
    """The ``k`` rows of largest inner product per query: query_id, rank, vec_id, score; ties to the smaller id.

    Both tables have id (bigint) and vector (integers, array<bigint>). Rows with a null id or vector take no part; rows
    that are repeated are found as often as they are there, equal queries are one query; missing components are 0. Rows with the
    query's id are its own and never found. Blocks of rows meet blocks of queries: each block's index is built where it is searched,
    and yields k rows a query. Repeated rows travel once, with their number.
    """
    usable = lambda df: df.select("id", "vector").dropna().groupBy("id", "vector").agg(F.count("*").alias("times"))
    n_rows, n_queries = rows.count(), queries.count()
    row_blocks, query_blocks = max(-(-n_rows // block_rows), 1), max(-(-n_queries // query_rows), 1)
    block = lambda n: F.pmod(F.xxhash64("id", "vector"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    placed = usable(rows).withColumn("block", block(row_blocks)).withColumn("part", every(query_blocks))
    asked = usable(queries).drop("times").withColumn("part", block(query_blocks)).withColumn("block", every(row_blocks))
    small_batches(placed)
    best = asked.groupBy("block", "part").cogroup(placed.groupBy("block", "part")).applyInPandas(
        _best_of_block(k), "query_id bigint, vec_id bigint, score bigint, times bigint")
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("times", F.lit(k).cast("bigint")))))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
