"""Functions that run inside Python tasks on small, already aggregated groups.

They are pickled by value, so executors need numpy, pandas and pyarrow but not this package.
"""

import heapq
import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _best_cut(good, bad, start, end, floor):
    """(gain, position) of the best cut of rows start..end-1, the left part ending at position."""
    g, b = good[start:end].cumsum(), bad[start:end].cumsum()
    left_n, total_g, total_b = g + b, g[-1], b[-1]
    right_n = left_n[-1] - left_n
    allowed = (left_n >= floor) & (right_n >= floor)
    allowed[-1] = False
    if total_g == 0 or total_b == 0 or not allowed.any():
        return None
    g, b, left_n, right_n = g[allowed], b[allowed], left_n[allowed], right_n[allowed]
    gain = (g * g + b * b) / left_n + ((total_g - g) ** 2 + (total_b - b) ** 2) / right_n
    best = int(np.argmax(gain))
    whole = (total_g ** 2 + total_b ** 2) / (total_g + total_b)
    return float(gain[best] - whole), start + int(np.flatnonzero(allowed)[best])


def grow_tree(pdf, max_leaf_nodes, min_samples_leaf):
    """Cuts of one feature's best-first Gini tree from its (value, good, bad) histogram."""
    pdf = pdf.sort_values("value")
    value = pdf["value"].to_numpy()
    good, bad = pdf["good"].to_numpy(float), pdf["bad"].to_numpy(float)
    floor = max(math.ceil(min_samples_leaf * (good.sum() + bad.sum())), 1)
    queue, cuts, leaves = [], [], 1

    def offer(start, end):
        found = _best_cut(good, bad, start, end, floor)
        if found:
            heapq.heappush(queue, (-found[0], start, end, found[1]))

    offer(0, len(value))
    while queue and leaves < max_leaf_nodes:
        _, start, end, at = heapq.heappop(queue)
        cuts.append((value[at] + value[at + 1]) / 2)
        leaves += 1
        offer(start, at + 1)
        offer(at + 1, end)
    return pd.DataFrame({"feature": pdf["feature"].iloc[0], "cut": sorted(cuts)}, columns=["feature", "cut"])


def alike_runs(batches):
    """Sorted (feature, value, good, bad) rows of Arrow ``batches`` with neighbours of one bad rate joined; ``value`` is the last one's."""
    held = None
    for batch in batches:
        out = []
        for row in zip(*[batch.column(c).to_pylist() for c in ("feature", "value", "good", "bad")]):
            if held and held[0] == row[0] and held[2] * row[3] == row[2] * held[3]:
                held = (row[0], row[1], held[2] + row[2], held[3] + row[3])
            else:
                if held:
                    out.append(held)
                held = row
        yield _histogram_batch(out)
    if held:
        yield _histogram_batch([held])


def _histogram_batch(rows):
    feature, value, good, bad = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_pydict({"feature": pa.array(feature, pa.string()), "value": pa.array(value, pa.float64()),
                                       "good": pa.array(good, pa.int64()), "bad": pa.array(bad, pa.int64())})


def _chi_square(g1, b1, g2, b2):
    """Chi-square of two neighbouring intervals; without goods or without bads they are alike."""
    sides = (g1 + b1) * (g2 + b2) * (g1 + g2) * (b1 + b2)
    return (g1 + b1 + g2 + b2) * (g1 * b2 - g2 * b1) ** 2 / sides if sides else 0.0


#: Pairs of neighbours a merge holds in its heap at a time.
HEAP_PAIRS = 200_000


#: Up to so many rows of a pair all its products are whole numbers below 2**53, so that an array gives the cost to the last bit.
EXACT_ROWS = 1_500


def _pair_costs(good, bad, left, right):
    """:func:`_chi_square` of many pairs."""
    g1, b1, g2, b2 = good[left], bad[left], good[right], bad[right]
    rows = g1 + b1 + g2 + b2
    few = rows <= EXACT_ROWS
    sides = np.where(few, (g1 + b1) * (g2 + b2) * (g1 + g2) * (b1 + b2), 0)
    costs = np.divide(rows * (g1 * b2 - g2 * b1) ** 2, sides, out=np.zeros(len(left)), where=sides > 0)
    # All pairs of a feature together have twice its rows, so large ones are few.
    for k in np.flatnonzero(~few).tolist():
        costs[k] = _chi_square(int(g1[k]), int(b1[k]), int(g2[k]), int(b2[k]))
    return costs


def chi_merge(pdf, bins, heap_pairs=HEAP_PAIRS):
    """Cuts of one feature after the most alike neighbours were joined, one pair after the other, until ``bins`` intervals are left.

    Intervals are a linked list in arrays, pairs a heap by cost and place; a pair whose intervals have changed since is passed over.
    The heap holds the ``heap_pairs`` most alike pairs and those that become as alike; when none is left it is filled again.
    """
    order = np.argsort(pdf["value"].to_numpy(), kind="stable")
    value, good, bad = (pdf[c].to_numpy()[order] for c in ("value", "good", "bad"))
    good, bad = good.astype(np.int64), bad.astype(np.int64)
    n = left = len(value)
    before, after, stamp = np.arange(-1, n - 1), np.arange(1, n + 1), np.zeros(n, np.int64)
    while left > bins:
        heap, limit = [], None
        places = np.flatnonzero((stamp >= 0) & (after < n))
        costs = _pair_costs(good, bad, places, after[places])
        if len(places) > heap_pairs:
            # The limit is a pair (cost, place), so that equal costs are cut by place.
            most = np.partition(costs, heap_pairs - 1)[heap_pairs - 1]
            taken = costs < most
            equal = np.flatnonzero(costs == most)[:heap_pairs - int(taken.sum())]
            limit = (float(most), int(places[equal[-1]]))
            taken[equal] = True
            places, costs = places[taken], costs[taken]
        heap = [(c, i, j, a, b) for c, i, j, a, b in zip(
            costs.tolist(), places.tolist(), after[places].tolist(), stamp[places].tolist(), stamp[after[places]].tolist())]
        del places, costs
        heapq.heapify(heap)

        def offer(i, j):
            cost = _chi_square(int(good[i]), int(bad[i]), int(good[j]), int(bad[j]))
            if limit is None or (cost, i) <= limit:
                heapq.heappush(heap, (cost, i, j, int(stamp[i]), int(stamp[j])))

        while left > bins and heap:
            _, i, j, a, b = heapq.heappop(heap)
            if stamp[i] != a or stamp[j] != b:
                continue
            good[i] += good[j]
            bad[i] += bad[j]
            value[i] = value[j]
            after[i], stamp[j], left = after[j], -1, left - 1
            stamp[i] += 1
            following, earlier = int(after[i]), int(before[i])
            if following < n:
                before[following] = i
                offer(i, following)
            if earlier >= 0:
                offer(earlier, i)
    kept = value[stamp >= 0].tolist()
    return pd.DataFrame({"feature": pdf["feature"].iloc[0], "cut": kept[:-1]}, columns=["feature", "cut"])


def summed_scores(s, g, b, kind=None):
    """Distinct scores in ascending order, NaN last, with the sums of ``g`` and ``b``. Sorted runs one after the other are fastest to sort ``stable``."""
    order = np.argsort(s, kind=kind)
    # Both zeros are one score.
    s = s[order] + 0.0
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))
    starts = np.flatnonzero(new)
    return s[starts], np.add.reduceat(g[order], starts), np.add.reduceat(b[order], starts)


def score_blocks(batches, most):
    """(k, s, g, b): :func:`summed_scores` of each group ``k`` as bytes, of about ``most`` rows at a time."""
    held, rows = [], 0

    def blocks():
        k, *values = (np.concatenate(x) for x in zip(*held))
        # Numbers of 16 bits are dealt out, not compared.
        order = np.argsort(k.astype(np.uint16) if k.max() < 1 << 16 else k, kind="stable")
        k, values = k[order], [x[order] for x in values]
        ends = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
        for start, end in zip(ends, ends[1:]):
            s, g, b = summed_scores(*[x[start:end] for x in values])
            yield pa.RecordBatch.from_pydict({"k": pa.array([int(k[start])], pa.int32()), "s": [s.tobytes()], "g": [g.tobytes()], "b": [b.tobytes()]})

    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in "ksgb"])
            rows += batch.num_rows
        if rows >= most:
            yield from blocks()
            held, rows = [], 0
    if held:
        yield from blocks()


def block_facts(block, step):
    """Group of a block of scores, its rows, sums of g and b, and every ``step``-th score."""
    s, g, b = (np.frombuffer(x) for x in block[1:])
    return block[0], len(s), float(g.sum()), float(b.sum()), s[::step].tobytes()


def cut_block(block, cuts, places):
    """Pieces of a block of scores between the ``cuts`` of its group: (partition, (group, piece, s, g, b))."""
    k = block[0]
    s, g, b = (np.frombuffer(x) for x in block[1:])
    ends = [0, *np.searchsorted(s, cuts[k], "left").tolist(), len(s)]
    for piece, (start, end) in enumerate(zip(ends, ends[1:])):
        if start < end:
            yield places[k][piece], (k, piece, s[start:end].tobytes(), g[start:end].tobytes(), b[start:end].tobytes())


def rate_pieces(items, totals):
    """Per group and piece: (k, piece, sum of g, sum of b, pairs in order, highest and lowest gap of the running shares)."""
    found = {}
    for _, (k, piece, *values) in items:
        found.setdefault((k, piece), []).append([np.frombuffer(x) for x in values])
    for (k, piece), parts in found.items():
        _, g, b = summed_scores(*[np.concatenate(x) for x in zip(*parts)], kind="stable")
        goods, bads = np.cumsum(g), np.cumsum(b)
        good, bad = totals[k]
        gap = goods / good - bads / bad if good and bad else np.zeros(1)
        yield k, piece, float(goods[-1]), float(bads[-1]), float((b * (goods - g + g / 2)).sum()), float(gap.max()), float(gap.min())
