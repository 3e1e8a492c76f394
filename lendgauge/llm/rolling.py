"""Hashes of words, word windows and byte windows over a whole Arrow batch of texts at a time."""

import numpy as np

#: Odd, so that its powers can be undone modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes that part words.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def mixed(x, seed=0):
    """Finaliser: spreads every bit of a 64-bit number over all others."""
    z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def powers(base, n):
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def joined(column):
    """Bytes of all texts of an Arrow string or binary column, one after the other, and where each starts; null is empty."""
    texts = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer(b"".join(texts), np.uint8), starts


def range_sums(values):
    """Function of (first, past): hash of that range of ``values``, whatever stands before it."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(BASE, n)[:n], out=sums[1:])
    back = powers(INVERSE, n + 1)
    return lambda first, past: (sums[past] - sums[first]) * back[first]


class Words:
    """Words of a batch: byte ranges ``first``, ``past``, the text ``owner`` of each, ``begin`` of each text's words, ``hash``."""

    def __init__(self, column, seed=0):
        self.data, self.starts = joined(column)
        n = len(self.data)
        inside = ~SPACE[self.data]
        border = np.zeros(n + 1, bool)
        border[self.starts] = True
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1] | border[1:n]
        closes[:-1] &= ~inside[1:] | border[1:n]
        self.first, self.past = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.owner = np.searchsorted(self.starts, self.first, "right") - 1
        self.begin = np.searchsorted(self.owner, np.arange(len(self.starts)))
        values = mixed(self.data.astype(np.uint64), seed + 101)
        # The length goes in as well: the sum alone doesn't tell ranges with the same first values apart from shorter ones.
        self.hash = mixed(range_sums(values)(self.first, self.past) + (self.past - self.first).astype(np.uint64), seed)

    def windows(self, size, seed=0):
        """Hash of each ``size`` words in a row that lie in one text, and the place of its first word."""
        at = np.arange(max(len(self.hash) - size + 1, 0))
        at = at[self.owner[at] == self.owner[at + size - 1]] if len(at) else at
        return mixed(range_sums(self.hash)(at, at + size), seed), at


def sliding_min(values, size):
    """Smallest of each ``size`` values in a row."""
    out, reach = values, 1
    while reach < size:
        step = min(reach, size - reach)
        out = np.minimum(out[:-step], out[step:])
        reach += step
    return out
