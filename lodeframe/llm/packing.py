"""Best-fit packing of token sequences by linear grouping.

Lengths are at most 1024, so a histogram of them says all that a plan needs, whatever the number of documents.
1. Large lengths, longest first, are cut into groups of equal cardinality and rounded up to their group's longest.
2. Configurations of these few sizes are optimised: a linear programme over all of them, solved by column generation
   (a knapsack finds the configuration that the prices undervalue most). Whole multiples are taken; what is left over, at
   most a bin or so for each group, goes into the fullest configurations it allows.
3. The actual lengths take the slots; equal bins are kept as one run, so the plan's size doesn't follow the input's.
4. Small pieces go where they fit best, longest first: into what rounding up left of the bins, too.
GROUPS and LARGE are tried, and the plan of the fewest bins wins: many groups round little, few are repeated more often.
Pieces then learn their place from their rank among the pieces of their length (distributed prefix counts).

Defined cases: null or empty text is the end id alone; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prefix_sums, stored, table
from .textbatch import Run, lean, released, runs

SIZE = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
GROUPS = (24, 48, 96)
#: The linear programme's columns are looked for so many times a group at most; what is found by then is a valid plan.
ROUNDS = 40
#: Lengths above one of these shares of SIZE count as large.
LARGE = (0.2, 0.36, 0.45)
NEWLINE = 10
#: New pieces that the tokenizer is given in one text.
LINES = 100
#: Bytes of texts that are cut at a time: working arrays take some 60 times as many.
CUT_BYTES = 1 << 18
#: Special tokens' strings, which the tokenizer reads as one id, look like this.
SPECIAL = re.compile(rb"<\|")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids of many texts: cut where the tokenizer's pre-tokeniser always cuts, each distinct piece encoded once.

    A cut stands before a blank, and around a newline, that has a printing ASCII character or a letter on both sides;
    Unicode's white space beyond ASCII never counts as such.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.t, self.keep = Tokenizer.from_file(path), keep
        self.newline = self.t.encode("\n", add_special_tokens=False).ids
        self.start()

    def start(self) -> None:
        """Known pieces: sorted hashes, and where their ids stand; those learnt last are in a level of their own."""
        none = np.zeros(0, np.int64)
        self.levels = [(np.zeros(0, np.uint64), none, none), (np.zeros(0, np.uint64), none, none)]
        self.ids = np.zeros(0, np.uint32)

    def cuts(self, run: Run) -> np.ndarray:
        d, n = run.data, len(run.data)
        if n < 3:
            return np.zeros(0, np.int64)
        plain = d > 0x20
        before = plain.copy()  # may stand before a cut
        tail = (d >= 0x80) & (d < 0xC0)
        odd2, odd3 = d == 0xC2, (d == 0xE1) | (d == 0xE2) | (d == 0xE3)
        before[1:] &= ~(tail[1:] & odd2[:-1])
        before[2:] &= ~(tail[2:] & odd3[:-2])
        after = plain & ~odd2 & ~odd3
        i = np.arange(1, n - 1)
        one = before[:-2] & after[2:]
        blank, line = one & (d[1:-1] == 0x20), one & (d[1:-1] == NEWLINE)
        return np.concatenate([i[blank], i[line], i[line] + 1])

    def encode(self, run: Run) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and the number of each text's."""
        n = len(run.data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(run.n, np.int64)
        cut = np.zeros(n + 1, bool)
        cut[run.offsets[:-1]] = cut[self.cuts(run)] = True
        starts = np.flatnonzero(cut[:n])
        ends = np.append(starts[1:], n)
        place, h = pd.factorize(run.hashes(starts, ends))
        first = np.empty(len(h), np.int64)
        first[place[::-1]] = np.arange(len(place))[::-1]
        if sum(len(x) for x, _, _ in self.levels) > self.keep:
            self.start()
        begin, lens = self.find(h)
        new = np.flatnonzero(lens < 0)
        if len(new):
            begin[new], lens[new] = self.learn(run, starts[first[new]], ends[first[new]], h[new])
        lens, begin = lens[place], begin[place]
        total = np.concatenate([[0], np.cumsum(lens)])
        ids = self.ids[np.repeat(begin - total[:-1], lens) + np.arange(total[-1])]
        bounds = np.searchsorted(starts, run.offsets)
        return ids, total[bounds[1:]] - total[bounds[:-1]]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, lens = np.zeros(len(h), np.int64), np.full(len(h), -1)
        for keys, b, n in self.levels:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                begin[hit], lens[hit] = b[at[hit]], n[at[hit]]
        return begin, lens

    def learn(self, run: Run, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes new pieces: those of one word, at most a blank before it, as lines of one text; others one by one."""
        d = run.data
        odd = (d <= 0x20) | (d == 0x7F) | (d == 0xC2) | (d > 0xC5)  # plain: ASCII and accented Latin letters
        for m in SPECIAL.finditer(d.tobytes()):
            odd[m.start()] = True
        seen = np.concatenate([[0], np.cumsum(odd)])
        blank = (d[starts] == 0x20) & (ends - starts > 1)
        simple = (seen[ends] - seen[starts] == blank) & (len(self.newline) == 1)
        lens = np.full(len(starts), -1)
        flat: list[np.ndarray] = []
        rest = np.flatnonzero(~simple)
        order = np.concatenate([np.flatnonzero(simple), rest])
        a, b = starts[simple], ends[simple]
        if len(a):
            at = spread_out(a, b + 1)  # the byte after each piece makes room for a line's end
            text = np.append(d, np.uint8(NEWLINE))[at]
            text[np.cumsum(b - a + 1) - 1] = NEWLINE
            raw, cut = text.tobytes(), [0, *np.cumsum(b - a + 1)[LINES - 1 : -1 : LINES].tolist(), len(text)]
            parts = [raw[x : y - 1].decode() for x, y in zip(cut, cut[1:])]  # short texts: the tokenizer takes them faster
            ids = np.array([i for e in self.t.encode_batch_fast(parts, add_special_tokens=False) for i in (*e.ids, self.newline[0])][:-1], np.uint32)
            lines = np.flatnonzero(np.append(ids, self.newline[0]) == self.newline[0])
            if len(lines) == len(a):
                lens[simple] = np.diff(lines, prepend=-1) - 1
                flat.append(ids[ids != self.newline[0]])
            else:
                rest = order = np.arange(len(starts))
        for e, i in zip(self.t.encode_batch_fast([d[starts[i] : ends[i]].tobytes().decode() for i in rest.tolist()], add_special_tokens=False), rest.tolist()):
            lens[i] = len(e.ids)
            flat.append(np.array(e.ids, np.uint32))
        begin = np.empty(len(starts), np.int64)
        begin[order] = len(self.ids) + np.concatenate([[0], np.cumsum(lens[order])[:-1]])
        self.ids = np.concatenate([self.ids, *flat])
        self.levels[1] = _sorted(self.levels[1], (h, begin, lens))
        if len(self.levels[1][0]) > 60_000:
            self.levels = [_sorted(*self.levels), (h[:0], begin[:0], lens[:0])]
        return begin, lens


def spread_out(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = ends - starts
    return np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def _sorted(a: tuple, b: tuple) -> tuple:
    both = [np.concatenate([x, y]) for x, y in zip(a, b)]
    order = np.argsort(both[0], kind="stable")
    return tuple(x[order] for x in both)


def _pieces(path: str, size: int, end: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        released()  # what reading the tokenizer's file took
        for b in batches:
            ids_of = b["doc_id"].to_pylist()
            for r in runs(b["text"], CUT_BYTES):
                flat, counts = enc.encode(r)
                out: list[tuple] = []
                at = 0
                for i, n in enumerate(counts.tolist()):
                    ids = np.append(flat[at : at + n], np.uint32(end)).astype("<u4")
                    at += n
                    begin, first = 0, len(ids) % size or min(size, len(ids))
                    for p, stop in enumerate(range(first, len(ids) + 1, size)):
                        out.append((ids_of[r.lo + i], p, begin, stop - begin, zlib.crc32(ids[begin:stop].tobytes())))
                        begin = stop
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END_ID) -> DataFrame:
    """Pieces of every row's ids. path: a tokenizer file."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_pieces(path or tokenizer_path(), size, end)), schema)


class Plan:
    """Runs of equal bins: segments (length, first rank, count, first sequence, offset)."""

    def __init__(self, size: int):
        self.size, self.bins, self.used = size, 0, defaultdict(int)
        self.segments: list[tuple[int, int, int, int, int]] = []
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, count)

    def put(self, length: int, count: int, seq: int, offset: int) -> None:
        self.segments.append((length, self.used[length], count, seq, offset))
        self.used[length] += count

    def best_fit(self, length: int, count: int) -> None:
        """Each piece goes to the open bin with the least gap that holds it, or to a new bin."""
        while count:
            gap = min((g for g, v in self.open.items() if g >= length and v), default=None)
            if gap is None:
                k = self.size // length
                each = [(count // k, k), (1, count % k)] if count >= k else [(1, count)]
                for n, per in each:
                    if n and per:
                        for j in range(per):
                            self.put(length, n, self.bins, j * length)
                        self.open[self.size - per * length].append((self.bins, n))
                        self.bins += n
                return
            seq, n = self.open[gap].pop()
            m = min(n, count)
            if m < n:
                self.open[gap].append((seq + m, n - m))
            self.put(length, m, seq, self.size - gap)
            self.open[gap - length].append((seq, m))
            count -= m

    def repeat(self, uses: dict[int, int], times: int, counts: list[int], queues: list[list[list[int]]]) -> None:
        """A configuration so many times: actual lengths of its groups take the slots."""
        taken = []
        for x, n in uses.items():
            counts[x] -= n * times
            taken += [_take(queues[x], times) for _ in range(n)]
        where = [0] * len(taken)
        while times:
            m = min(t[w][1] for t, w in zip(taken, where))
            offset = 0
            for i, t in enumerate(taken):
                length = t[where[i]][0]
                self.put(length, m, self.bins, offset)
                offset += length
                t[where[i]][1] -= m
                where[i] += not t[where[i]][1]
            self.open[self.size - offset].append((self.bins, m))
            self.bins += m
            times -= m


def optimised(sizes: list[int], counts: list[int], size: int) -> list[tuple[np.ndarray, float]]:
    """Configurations (pieces of each size) and how often to use each, with the fewest bins as a linear programme has it."""
    s, n = np.array(sizes), np.array(counts, float)
    basis = np.diag((size // s).astype(float))
    for _ in range(ROUNDS * len(s)):
        inverse = np.linalg.inv(basis)
        price = inverse.sum(0)
        value, config = _knapsack(s, price, size)
        if value <= 1 + 1e-9:
            break
        step, x = inverse @ config, inverse @ n
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = config
    x = np.linalg.solve(basis, n)
    return [(basis[:, i].astype(np.int64), float(x[i])) for i in range(len(s)) if x[i] > 1e-9]


def _knapsack(s: np.ndarray, price: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The configuration worth most, piece by piece: best[k] is the most that k pieces or fewer are worth in each room."""
    best, taken = [np.zeros(size + 1)], []
    at = np.arange(size + 1)[None, :] - s[:, None]
    for _ in range(size // int(s.min())):
        worth = np.where(at >= 0, best[-1][np.maximum(at, 0)] + price[:, None], 0.0)
        which = worth.argmax(0)
        top = worth[which, np.arange(size + 1)]
        taken.append(np.where(top > 0, which, -1))
        best.append(top)
    config, room = np.zeros(len(s)), size
    for which in reversed(taken):
        if which[room] >= 0:
            config[which[room]] += 1
            room -= int(s[which[room]])
    return float(best[-1][size]), config


def grouped(histogram: np.ndarray, size: int, groups: int, share: float) -> Plan:
    """The plan with so many groups of the lengths above a share of size."""
    plan = Plan(size)
    left = histogram.astype(np.int64).copy()
    if left[size]:
        plan.best_fit(size, int(left[size]))
        left[size] = 0
    large = [x for x in range(size - 1, int(size * share), -1) if left[x]]
    total = int(left[large].sum()) if large else 0
    queues: list[list[list[int]]] = []  # of each group: [length, count], longest first
    if total:
        per, room = -(-total // groups), 0
        for x in large:
            n = int(left[x])
            while n:
                if not room:
                    if not queues or queues[-1][0][0] != x:  # groups of one length are one
                        queues.append([])
                    room = per
                m = min(n, room)
                queues[-1].append([x, m])
                room -= m
                n -= m
    left[large] = 0
    sizes = [q[0][0] for q in queues]
    counts = [sum(c for _, c in q) for q in queues]
    if sizes:
        for config, times in sorted(optimised(sizes, counts, size), key=lambda c: -c[1]):
            uses = {g: int(n) for g, n in enumerate(config) if n}
            plan.repeat(uses, min(int(times + 1e-9), *(counts[g] // n for g, n in uses.items())), counts, queues)
    for g in range(len(sizes)):
        while counts[g]:
            uses = _fullest(sizes, counts, g, size)
            plan.repeat(uses, min(counts[x] // n for x, n in uses.items()), counts, queues)
    for x in range(size - 1, 0, -1):
        if left[x]:
            plan.best_fit(x, int(left[x]))
    return plan


def _take(queue: list[list[int]], n: int) -> list[list[int]]:
    out = []
    while n:
        m = min(n, queue[0][1])
        out.append([queue[0][0], m])
        queue[0][1] -= m
        n -= m
        if not queue[0][1]:
            queue.pop(0)
    return out


def _fullest(sizes: list[int], counts: list[int], g: int, size: int) -> dict[int, int]:
    """The fullest configuration that holds one piece of group g, as {group: pieces}: a bounded knapsack."""
    room = size - sizes[g]
    best: list[tuple[int, int] | None] = [None] * (room + 1)  # fill: (group, its pieces in it)
    best[0] = (-1, 0)
    reach = [0]
    for x in range(g, len(sizes)):
        most = counts[x] - (x == g)
        if most <= 0 or sizes[x] > room:
            continue
        new = []
        for fill in reach:
            for n in range(1, min(most, (room - fill) // sizes[x]) + 1):
                to = fill + n * sizes[x]
                if best[to] is None:
                    best[to] = (x, n)
                    new.append(to)
        reach += new
        if best[room] is not None:
            break
    fill = max(reach)
    uses: dict[int, int] = defaultdict(int)
    uses[g] += 1
    while fill:
        x, n = best[fill]
        uses[x] += n
        fill -= n * sizes[x]
    return uses


def plan(histogram: np.ndarray, size: int = SIZE) -> Plan:
    return min((grouped(histogram, size, g, share) for g in GROUPS for share in LARGE), key=lambda p: p.bins)


def place(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Stored pieces with sequence_id and offset."""
    histogram = np.zeros(size + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most `size` rows
        histogram[r["length"]] = r["count"]
    segments = sorted(plan(histogram, size).segments)
    length, rank, _, seq, offset = (np.array(x, np.int64) for x in zip(*segments)) if segments else [np.zeros(0, np.int64)] * 5
    key = (length << 50) + rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = b["rank"].to_numpy()
            at = np.searchsorted(key, (b["length"].to_numpy() << 50) + r, "right") - 1
            yield pa.RecordBatch.from_arrays([*[b[c] for c in b.schema.names if c != "rank"], pa.array(seq[at] + r - rank[at]), pa.array(offset[at])], names=[*[c for c in b.schema.names if c != "rank"], "sequence_id", "offset"])

    hashed = cut.withColumn("h", F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "piece", "ids_crc32")))
    # about as many ranges in a length as pieces in a range, since most pieces may have one length. A literal: a table of
    # Python's rows would start a second set of Python workers on each executor, which stays for the next stages
    digits = ", ".join(str(-(-n.bit_length() // 8)) for n in histogram[1:].tolist())
    hashed = hashed.withColumn("digits", F.expr(f"element_at(array({digits}), cast(length AS INT))"))
    ranked = prefix_sums(hashed, ["length"], [F.col(c) for c in ("h", "doc_id", "piece", "start", "ids_crc32")], F.expr("substring(h, 1, digits)"), F.lit(1).cast("long"), "rank")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.select(*cut.columns, "rank").mapInArrow(lean(run), f"{fields}, sequence_id long, offset long")


def op9_best_fit(spark, sf_dir: str) -> DataFrame:
    return place(stored(pieces(table(spark, sf_dir, "documents"))))


QUERIES = {"op9_best_fit": op9_best_fit}
SQL: dict[str, str] = {}
