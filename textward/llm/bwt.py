"""Column-wise construction of the Burrows-Wheeler transform and common prefixes of many strings.

Each round inserts the next longer suffix of every string; shorter strings begin later, so that all are whole
after the last round. The transform so far lies in two
files in suffix order: the symbol before each suffix, and the length of the prefix that it shares
with the suffix above it. One sequential pass reads the files, finds
where the new suffixes go and what prefixes they share, and the next pass writes the files with them in.
Per round, memory holds a block and what one round inserts.

Where: the new suffix c+s of a string stands, among the suffixes that begin with c, at the number of
records with symbol c before the record of s. Common prefix: one more than the least common prefix
between the record of s and the record of the last c before it; the next c after it is brought up to
date in the same way. Whose suffix a record is follows at the end from the transform itself: the k-th
record with symbol c leads to the k-th suffix that begins with c.

Files are unlinked scratch of one task, gone with it; they hold nothing that another task reads.
It is the order to any depth; ``repeats`` needs it to the width of a window only and sorts by ``suffixes``.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 18
#: Bytes of a final record, lowest first: symbol, common prefix, length of the suffix; the string above.
_PREFIX, _LENGTH, _STRING = 1, 2, 32
MOST = 255


class _Pass:
    """What a sequential pass over the records knows of the part it has seen."""

    def __init__(self, totals: np.ndarray, strings: int):
        # symbol 0 stands before whole strings, whose records lead nowhere
        self.starts = strings + np.concatenate(([0, 0], np.cumsum(totals[1:-1])))
        self.seen = np.zeros(256, np.int64)
        self.least = np.zeros(256, np.int64)  # of the common prefixes after the last record with each symbol
        self.last_new = np.zeros(256, bool)
        self.put: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # position, string, common prefix
        self.fix: list[tuple[np.ndarray, np.ndarray]] = []

    def block(self, symbol: np.ndarray, prefix: np.ndarray, fresh: np.ndarray, strings: np.ndarray) -> None:
        """The next records, and of those that the last round put in: places in the block, and strings."""
        n = len(symbol)
        order = np.argsort(symbol, kind="stable")
        count = np.bincount(symbol, minlength=256)
        ends = np.cumsum(count)
        first = ends - count
        there = np.flatnonzero(count)
        heads, tails = first[there], ends[there] - 1
        is_new = np.zeros(n, bool)
        is_new[fresh] = True
        new = is_new[order]
        # in order of symbols: a record matters if it is new or follows a new one with the same symbol
        places = np.flatnonzero(new)
        places = places[np.searchsorted(places, count[0]) :]
        follow = np.append(places, -1) + 1
        follow = follow[:-1][(follow[:-1] < ends[symbol[order[places]]])] if len(places) else places
        late = heads[self.last_new[there] & (there > 0)]
        follow = np.concatenate((follow, late))
        follow = follow[~new[follow]]
        k = np.concatenate((places, follow))
        if len(k):
            at = order[k]
            sym = symbol[at]
            rank = self.seen[sym] + k - first[sym]
            is_head = k == first[sym]
            shared = np.empty(len(k), np.int64)
            shared[is_head] = np.minimum(self.least[sym[is_head]], self._up_to(prefix, order[heads])[np.searchsorted(there, sym[is_head])])
            a, b = order[k[~is_head] - 1] + 1, at[~is_head] + 1
            if len(a):
                by = np.argsort(a)
                bounds = np.stack([a[by], b[by]], 1).ravel()
                between = np.empty(len(a), np.int64)
                between[by] = np.minimum.reduceat(np.append(prefix, np.uint8(0)), bounds)[::2]
                shared[~is_head] = between
            shared = np.where(rank == 0, 0, np.minimum(shared + 1, MOST))
            where, m = self.starts[sym] + rank, len(places)
            of = np.empty(n, np.int64)
            of[fresh] = strings
            self.put.append((where[:m], of[at[:m]], shared[:m]))
            self.fix.append((where[m:], shared[m:]))
        after = self._from(prefix, order[tails] + 1)
        self.least = np.minimum(self.least, int(prefix.min()))
        self.least[there] = after
        self.last_new[there] = new[tails]
        self.seen += count

    @staticmethod
    def _up_to(prefix: np.ndarray, places: np.ndarray) -> np.ndarray:
        """For each place the least prefix up to and with it."""
        by = np.argsort(places)
        p = places[by]
        out = np.empty(len(p), np.int64)
        out[by] = np.minimum.accumulate(np.minimum.reduceat(prefix[: p[-1] + 1], np.concatenate(([0], p[:-1] + 1))))
        return out

    @staticmethod
    def _from(prefix: np.ndarray, places: np.ndarray) -> np.ndarray:
        """For each place the least prefix from it on; the most where nothing follows."""
        by = np.argsort(places)
        p = places[by]
        out, inner = np.full(len(p), MOST, np.int64), np.searchsorted(p, len(prefix))
        if inner:
            out[by[:inner]] = np.minimum.accumulate(np.minimum.reduceat(prefix, p[:inner])[::-1])[::-1]
        return out

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions in the next file, strings, common prefixes; positions and common prefixes to correct. All in order of position."""
        none = np.zeros(0, np.int64)
        q, s, p = (np.concatenate([x[i] for x in self.put]) if self.put else none for i in range(3))
        fq, fp = (np.concatenate([x[i] for x in self.fix]) if self.fix else none for i in range(2))
        by, fby = np.argsort(q), np.argsort(fq)
        return q[by], s[by], p[by], fq[fby], fp[fby]


def suffix_order(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> Iterator[np.ndarray]:
    """Blocks of the final records, in suffix order: the strings lie in ``text`` at ``starts``.

    Strings hold no byte 0 (which ends them) and have at most 254 bytes. Equal suffixes stand in the
    order of their strings' lengths, longest first, then of their numbers.
    """
    m = len(lengths)
    if not m:
        return
    number = np.argsort(-lengths, kind="stable")  # from here on strings go by their place in this order
    lengths, ends = lengths[number], (starts + lengths)[number].astype(np.int64)
    rounds = int(lengths[0])
    begun = np.searchsorted(-lengths, np.arange(-rounds, 2), "left")[1:].tolist()  # strings that have begun, by round

    def before(strings: np.ndarray, turn: int) -> np.ndarray:
        """The symbols before the suffixes that this round inserts."""
        left = rounds - turn  # symbols that all strings still lack
        out = np.zeros(len(strings), np.uint8)
        if left:
            out[:] = text[ends[strings] - (lengths[strings] - left) - 1]
        return out

    strings = np.arange(begun[0])
    symbols = before(strings, 0)
    totals = np.bincount(symbols, minlength=256)
    old = tempfile.TemporaryFile(), tempfile.TemporaryFile()
    symbols.tofile(old[0])
    np.zeros(len(symbols), np.uint8).tofile(old[1])
    size, now = len(symbols), _Pass(totals, begun[min(1, rounds)])
    for lo in range(0, size, block):
        some = strings[lo : lo + block]
        now.block(symbols[lo : lo + block], np.zeros(len(some), np.uint8), some - lo, some)
    for turn in range(1, rounds + 1):
        q, strings, prefixes, fq, fp = now.result()
        # the empty suffixes of strings that begin stand behind those of the others
        new = np.arange(begun[turn - 1], begun[turn])
        q, strings, prefixes = np.concatenate((new, q)), np.concatenate((new, strings)), np.concatenate((np.zeros(len(new), np.int64), prefixes))
        symbols = before(strings, turn)
        totals += np.bincount(symbols, minlength=256)
        slot = q - np.arange(len(q))  # old records before each new one
        now = _Pass(totals, begun[min(turn + 1, rounds)])
        files, at, out, done, fixed = (tempfile.TemporaryFile(), tempfile.TemporaryFile()), 0, 0, 0, 0
        for f in old:
            f.seek(0)
        while True:
            records = [np.fromfile(f, np.uint8, block) for f in old]
            have = len(records[0])
            upto = np.searchsorted(slot, at + have, "left") if have and at + have < size else len(q)
            n = have + upto - done
            if not n:
                break
            here = q[done:upto] - out
            is_old = np.ones(n, bool)
            is_old[here] = False
            both = np.empty(n, np.uint8), np.empty(n, np.uint8)
            for x, was, put in zip(both, records, (symbols, prefixes), strict=True):
                x[is_old] = was
                x[here] = put[done:upto]
            to = np.searchsorted(fq, out + n, "left")
            both[1][fq[fixed:to] - out] = fp[fixed:to]
            for x, f in zip(both, files, strict=True):
                x.tofile(f)
            now.block(*both, here, strings[done:upto])
            at, out, done, fixed = at + have, out + n, upto, to
        for f in old:
            f.close()
        old, size = files, out
    # whose suffix each record is: from the shortest suffixes on, along the transform
    for f in old:
        f.seek(0)
    symbols = np.fromfile(old[0], np.uint8)
    order = np.argsort(symbols, kind="stable")[totals[0] :]
    leads = np.empty(size, np.int64)
    leads[order] = m + np.arange(len(order))
    of, far = np.empty(size, np.int64), np.empty(size, np.uint8)
    strings = place = np.arange(m)
    for length in range(rounds + 1):
        of[place], far[place] = strings, length
        longer = lengths[strings] > length
        strings, place = strings[longer], leads[place[longer]]
    for lo in range(0, size, block):
        part = slice(lo, lo + block)
        prefix = np.fromfile(old[1], np.uint8, block)
        yield symbols[part].astype(np.uint64) | prefix.astype(np.uint64) << np.uint64(8) | far[part].astype(np.uint64) << np.uint64(16) | number[of[part]].astype(np.uint64) << np.uint64(_STRING)
    for f in old:
        f.close()


def fields(records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common prefix with the record above, length, string."""
    f = records.view(np.uint8).reshape(len(records), 8)
    return f[:, _PREFIX].copy(), f[:, _LENGTH].copy(), (records >> np.uint64(_STRING)).astype(np.int64)
