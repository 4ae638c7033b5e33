"""Suffix-array dedup: passages of SPAN bytes or more that repeat across documents, by a logarithmic index family.

Which suffixes: of each SPAN-byte string one K-byte substring is its anchor (the least by hash, the leftmost of equals), so
equal strings have equal anchors. Round 1 counts anchors' texts (keyed.py); strings whose anchor stands in one text only
cannot repeat and drop out. Round 2 compares whole blocks (neighbouring strings with one anchor): a block that stands in a
smaller doc_id is settled, and so is one whose anchor has no other block. Round 3 takes the suffixes of the first copy of
each block that is left: the borders of repeats.

The family: documents come in GENERATIONS of like size, by doc_id. Each batch of a generation's texts gets its suffix array:
its suffixes in alphabetical order of their first PREFIX bytes, those alike in the order of the fingerprints of their first
SPAN bytes, with the least doc_id of each string. (Alphabetical order to the end would carry SPAN bytes a suffix through
each exchange instead of 16; what is asked of the order is that long matches are neighbours.) Suffixes are dealt to buckets
by fingerprint. In each bucket a generation's arrays are merge-scanned against one another and against the levels that exist, for
matches that start in a smaller doc_id; then they become a level themselves, and levels of one size merge, so that there are
few. Levels are tables in the shared folder: a Family takes further batches whenever they come.

Defined cases: null text is empty; a null doc_id counts as the largest; rows with one doc_id never remove each other's
bytes; matches never cross rows; texts under SPAN bytes lose nothing; an empty table gives no rows.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scan_partitions, spread, stored, table
from .jaccard import _frequencies
from .keyed import BATCH_BYTES, U64, key_bits, pack, pack_small, ranges, unpack, unpack_small
from .textbatch import RUN_BYTES, Run, per_text, runs

SPAN = 50
K = 28
PREFIX = 8
#: Parts of the documents, by doc_id, that enter the family one after the other.
GENERATIONS = 4
NO_ID = np.iinfo(np.int64).max
STATE = pa.schema([("kind", pa.int32()), ("batch", pa.int64()), ("gen", pa.int32()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
STATE_SQL = "kind int, batch long, gen int, bucket int, a binary, b binary, c binary"


def blocks(run: Run, span: int = SPAN, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal rows of neighbouring strings with one anchor: first and last start, and the anchor's hash."""
    n = len(run.data)
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none, np.zeros(0, U64)
    h = run.rolling(k)
    mask = U64((1 << int(n).bit_length()) - 1)
    m = h & ~mask
    m |= np.arange(n - k + 1, dtype=U64)
    width, size = span - k + 1, 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if width > size:
        m = np.minimum(m[: len(m) - (width - size)], m[width - size :])
    anchor = (m & mask).astype(np.int64)
    a, b = run.offsets[:-1], run.offsets[1:]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.maximum(a, b - span + 1), 1)
    np.add.at(edge, b, -1)
    p = np.flatnonzero(np.cumsum(edge)[: n - span + 1] == 0)
    if not len(p):
        return none, none, np.zeros(0, U64)
    anchor = anchor[p]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)]))
    last = np.append(first[1:] - 1, len(p) - 1)
    return p[first], p[last], h[anchor[first]]


def starts(p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
    n = p2 - p1 + 1
    return np.repeat(p1 - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else p1


#: Starts of strings in a run; their first PREFIX bytes as a number, fingerprints of SPAN bytes, doc_ids.
Strings = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def strings_at(run: Run, p: np.ndarray, ids: np.ndarray) -> Strings:
    first = np.zeros(len(p), U64)
    for i in range(PREFIX):
        first = (first << U64(8)) | run.data[p + i].astype(U64)
    return p, first, run.hashes(p, p + SPAN), ids


class Batch:
    """Some texts; recomputed from their bytes wherever the batch goes."""

    def __init__(self, texts: list[Run], bits: int):
        self.runs, self.bits = texts, bits
        self.blocks = [blocks(r) for r in texts]
        self.keys = np.concatenate([k for _, _, k in self.blocks] or [np.zeros(0, U64)]) >> U64(64 - bits)
        self.u, self.place = np.unique(self.keys, return_inverse=True)

    def texts_with(self) -> np.ndarray:
        own, at = [], 0
        for r, (p1, _, _) in zip(self.runs, self.blocks):
            own.append(np.searchsorted(r.offsets, p1, "right") - 1 + at)
            at += r.n
        pairs = np.unique(np.concatenate(own) * max(1, len(self.u)) + self.place) if len(self.u) else np.zeros(0, np.int64)
        return np.bincount(pairs % max(1, len(self.u)), minlength=len(self.u))

    def pairs(self, flagged: np.ndarray, ids: np.ndarray) -> "Pairs":
        return Pairs(self, flagged, ids)


class Pairs:
    """The flagged blocks of a batch: distinct (anchor, whole block) pairs in order, and the least doc_id of each."""

    def __init__(self, batch: Batch, flagged: np.ndarray, ids: np.ndarray):
        self.runs = batch.runs
        self.p1, self.p2, self.run, owner, fp = [], [], [], [], []
        at = begin = 0
        place = []
        for i, (r, (p1, p2, _)) in enumerate(zip(batch.runs, batch.blocks)):
            keep = flagged[batch.place[at : at + len(p1)]]
            place.append(batch.place[at : at + len(p1)][keep])
            at += len(p1)
            p1, p2 = p1[keep], p2[keep]
            self.p1.append(p1)
            self.p2.append(p2)
            self.run.append(np.full(len(p1), i))
            owner.append(ids[begin + np.searchsorted(r.offsets, p1, "right") - 1])
            begin += r.n
            fp.append(r.hashes(p1, p2 + SPAN) >> U64(24))
        self.p1, self.p2, self.run, self.owner = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (self.p1, self.p2, self.run, owner))
        place, fp = np.concatenate(place or [np.zeros(0, np.int64)]), np.concatenate(fp or [np.zeros(0, U64)])
        order = np.lexsort((fp, place))
        place, fp = place[order], fp[order]
        new = np.ones(len(order), bool)
        new[1:] = (place[1:] != place[:-1]) | (fp[1:] != fp[:-1])
        first = np.flatnonzero(new)
        self.keys, self.fp = batch.u[place[first]], fp[first]
        self.least = np.minimum.reduceat(self.owner[order], first) if len(first) else self.owner
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1

    def settle(self, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Blocks that stand whole in a smaller doc_id; first blocks whose anchor has others, too."""
        smaller, several, begin = np.zeros(len(self.keys), bool), np.zeros(len(self.keys), bool), 0
        for r in sorted((r for r in answers if r["kind"] == 2), key=lambda r: r["bucket"]):
            smaller[unpack(r["at"]).astype(np.int64) + begin] = True
            several[unpack(r["n"]).astype(np.int64) + begin] = True
            begin += r["size"]
        whole = smaller[self.of] | (self.owner > self.least[self.of])
        return whole, ~whole & several[self.of]

    def strings(self, blocks: np.ndarray) -> list["Strings"]:
        """Of each run the strings in these blocks."""
        out = []
        for i, r in enumerate(self.runs):
            b = np.flatnonzero(blocks & (self.run == i))
            p = starts(self.p1[b], self.p2[b])
            out.append(strings_at(r, p, np.repeat(self.owner[b], self.p2[b] - self.p1[b] + 1)))
        return out


def _state(texts: list[Run], ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    data = np.concatenate([r.data for r in texts])
    sizes = np.concatenate([np.diff(r.offsets) for r in texts])
    return zstandard.ZstdCompressor(level=3).compress(data.tobytes()), ids.astype("<i8").tobytes(), sizes.astype("<i8").tobytes()


def _batch(row: dict, bits: int) -> tuple[Batch, np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["a"]), np.uint8)
    ids, sizes = np.frombuffer(row["b"], "<i8"), np.frombuffer(row["c"], "<i8")
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    texts, lo = [], 0
    while lo < len(ids):
        hi = min(len(ids), max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + RUN_BYTES, "right")) - 1))
        texts.append(Run(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo))
        lo = hi
    return Batch(texts, bits), ids


def _pass(bits: int, buckets: int, bounds: list[int], batch_bytes: int):
    """Batches of texts of one generation each (kind 0), and their anchors by range (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[Run, np.ndarray]]] = {}
        size: dict[int, int] = {}

        def flush(gen: int):
            nonlocal seq
            batch, some = (part << 32) + seq * GENERATIONS + gen, held.pop(gen)
            seq += 1
            size.pop(gen)
            texts = [r for r, _ in some]
            b = Batch(texts, bits)
            n, cut = b.texts_with(), ranges(b.u, bits, buckets)
            rows = [(0, batch, gen, -1, *_state(texts, np.concatenate([x for _, x in some])))]
            rows += [(1, batch, gen, i, pack(b.u[cut[i] : cut[i + 1]]), pack_small(n[cut[i] : cut[i + 1]]), None) for i in range(buckets) if cut[i + 1] > cut[i]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), STATE)], schema=STATE)

        for b in batches:
            own = b["doc_id"].fill_null(NO_ID).to_numpy()
            for r in runs(b["text"]):
                mine = own[r.lo : r.lo + r.n]
                gens = np.searchsorted(np.array(bounds, np.int64), mine)
                for gen in np.unique(gens).tolist():
                    held.setdefault(gen, []).append((chosen(r, gens == gen), mine[gens == gen]))
                    size[gen] = size.get(gen, 0) + len(held[gen][-1][0].data)
                    if size[gen] >= batch_bytes:
                        yield flush(gen)
        for gen in list(held):
            yield flush(gen)

    return run


def chosen(run: Run, some: np.ndarray) -> Run:
    """A run of its own of some of a run's texts."""
    if some.all():
        return Run(run.data.copy(), run.offsets)
    n = np.diff(run.offsets)
    return Run(run.data[np.repeat(some, n)], np.concatenate([[0], np.cumsum(n[some])]))


def _flagged(b: Batch, answers: list[dict]) -> np.ndarray:
    got = sorted((r for r in answers if r["kind"] == 1), key=lambda r: r["bucket"])
    flagged, begin = np.zeros(len(b.u), bool), 0
    for r in got:
        flagged[unpack(r["at"]).astype(np.int64) + begin] = True
        begin += r["size"]
    return flagged


#: Distinct strings in the array's order: prefixes and fingerprints; and the least doc_id of each.
Array = tuple[np.ndarray, np.ndarray, np.ndarray]


def neighbours(first: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The array's order, and which of the strings in it differ from the one before: the others match it for SPAN bytes."""
    order = np.lexsort((fp, first))
    first, fp = first[order], fp[order]
    new = np.ones(len(order), bool)
    new[1:] = (first[1:] != first[:-1]) | (fp[1:] != fp[:-1])
    return order, new


def _array(parts: list[Strings]) -> tuple[Array, np.ndarray]:
    """A suffix array, and each string's place in it."""
    first, fp, owner = (np.concatenate([x[i] for x in parts] or [np.zeros(0, np.int64)]) for i in (1, 2, 3))
    order, new = neighbours(first, fp)
    at = np.flatnonzero(new)
    place = np.empty(len(fp), np.int64)
    place[order] = np.cumsum(new) - 1
    return (first[order][at], fp[order][at], np.minimum.reduceat(owner[order], at) if len(at) else owner), place


def dealt(fp: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of an array's strings bucket by bucket, in the array's order, and the buckets' bounds."""
    bucket = ((fp >> U64(40)) % U64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    return by, np.searchsorted(bucket[by], np.arange(buckets + 1))


def packed(a: Array) -> tuple[bytes, bytes, bytes, bytes]:
    own, place = np.unique(a[2], return_inverse=True)
    return pack(a[0]), a[1].astype("<u8").tobytes(), pack(own), pack_small(place)


def unpacked(first: bytes, fp: bytes, own: bytes, place: bytes) -> Array:
    ids = unpack(own).view(np.int64)
    return unpack(first), np.frombuffer(fp, "<u8").astype(U64), ids[unpack_small(place)] if len(ids) else ids


ANSWER_SQL = "kind int, batch long, bucket int, size long, at binary, n binary"


def _asked(bits: int, buckets: int, step: int):
    """Step 2: the batch's pairs of anchor and block by range, with the least doc_id; step 3: its suffix array by bucket."""
    names = ["batch", "gen", "bucket", "a", "b", "c", "d"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def run(key: tuple, state: pa.Table, answers: pa.Table) -> pa.Table:
        rows, got = [], answers.to_pylist()
        for s in state.to_pylist():
            b, ids = _batch(s, bits)
            pairs = b.pairs(_flagged(b, got), ids)
            if step == 3:
                array, _ = _array(pairs.strings(pairs.settle(got)[1]))
                by, cut = dealt(array[1], buckets)
                rows += [(s["batch"], s["gen"], i, *packed(tuple(x[by[cut[i] : cut[i + 1]]] for x in array))) for i in range(buckets) if cut[i + 1] > cut[i]]
                continue
            keys, least, cut = pairs.keys, pairs.least, ranges(pairs.keys, bits, buckets)
            for i in range(buckets):
                at = slice(cut[i], cut[i + 1])
                if cut[i + 1] > cut[i]:
                    own, place = np.unique(least[at], return_inverse=True)
                    fp = np.ascontiguousarray(pairs.fp[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
                    rows.append((s["batch"], s["gen"], i, pack(keys[at]), pack(own), pack_small(place), fp))
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return run


def _compared(key: tuple, t: pa.Table) -> pa.Table:
    """For each batch's pairs of a range: places with a smaller doc_id elsewhere, and places whose anchor has several blocks."""
    keys = [unpack(x) for x in t["a"].to_pylist()]
    ids = [unpack(x).view(np.int64)[unpack_small(y)] for x, y in zip(t["b"].to_pylist(), t["c"].to_pylist())]
    wide = [np.frombuffer(x, np.uint8).reshape(-1, 5) for x in t["d"].to_pylist()]
    k, i, w = np.concatenate(keys), np.concatenate(ids), np.concatenate(wide)
    f = np.zeros((len(w), 8), np.uint8)
    f[:, :5] = w
    f = f.view("<u8").ravel()
    order = np.lexsort((f, k))
    k, f, own = k[order], f[order], i[order]
    key_new, new = np.ones(len(k), bool), np.ones(len(k), bool)
    key_new[1:] = k[1:] != k[:-1]
    new[1:] = key_new[1:] | (f[1:] != f[:-1])
    first = np.flatnonzero(new)
    low = np.minimum.reduceat(own, first)[np.cumsum(new) - 1]
    several = np.add.reduceat(new.astype(np.int64), np.flatnonzero(key_new))[np.cumsum(key_new) - 1] > 1
    smaller, many = np.zeros(len(k), bool), np.zeros(len(k), bool)
    smaller[order], many[order] = low < own, several
    rows, at = [], 0
    for batch, bucket, x in zip(t["batch"].to_pylist(), t["bucket"].to_pylist(), keys):
        part = slice(at, at + len(x))
        rows.append((2, batch, bucket, len(x), pack(np.flatnonzero(smaller[part])), pack(np.flatnonzero(many[part]))))
        at += len(x)
    return _answers(rows)


def _answers(rows: list[tuple]) -> pa.Table:
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], x) for i, x in enumerate(types)], names=["kind", "batch", "bucket", "size", "at", "n"])


def merged(arrays: list[Array]) -> Array:
    """One array of several: neighbours that match become one, with the least doc_id."""
    first, fp, ids = (np.concatenate([a[i] for a in arrays]) for i in range(3))
    order, new = neighbours(first, fp)
    at = np.flatnonzero(new)
    return first[order][at], fp[order][at], np.minimum.reduceat(ids[order], at) if len(at) else ids


def scanned(array: Array, level: Array) -> np.ndarray:
    """A merge-scan: of each of the array's strings the least doc_id of the level's match, or NO_ID."""
    n = len(array[0])
    first, fp = (np.concatenate([array[i], level[i]]) for i in range(2))
    order, new = neighbours(first, fp)  # array before level where they match
    out = np.full(n, NO_ID)
    at = np.flatnonzero(~new)
    out[order[at - 1]] = level[2][order[at] - n]
    return out


LEVEL_SQL = "kind int, batch long, bucket int, size long, at binary, n binary, a binary, b binary, c binary, d binary"


def _entered(key: tuple, new: pa.Table, levels: pa.Table) -> pa.Table:
    """A bucket's new arrays, scanned against one another and the levels (kind 3: places and ids of strings that start in a
    smaller doc_id than any of their batch), and merged (kind 4)."""
    arrays = [unpacked(*x) for x in zip(*(new[c].to_pylist() for c in "abcd"))]
    if not arrays:
        return pa.Table.from_pylist([], LEVEL)
    old = [unpacked(*x) for x in zip(*(levels[c].to_pylist() for c in "abcd"))]
    own, place = _array([(a[0], *a) for a in arrays])  # all of them in one scan
    bucket = new["bucket"][0].as_py()
    low = own[2].copy()
    for level in old:
        np.minimum(low, scanned(own, level), out=low)
    rows, begin = [], 0
    for batch, a in zip(new["batch"].to_pylist(), arrays):
        least = low[place[begin : begin + len(a[0])]]
        begin += len(a[0])
        at = np.flatnonzero(least < a[2])
        rows.append({"kind": 3, "batch": batch, "bucket": bucket, "size": len(a[0]), "at": pack(at), "n": pack(least[at])})
    rows.append({"kind": 4, "batch": -1, "bucket": bucket, "size": len(own[0]), **dict(zip("abcd", packed(own)))})
    return pa.Table.from_pylist(rows, LEVEL)


LEVEL = pa.schema([("kind", pa.int32()), ("batch", pa.int64()), ("bucket", pa.int32()), ("size", pa.int64()), *[(c, pa.binary()) for c in ("at", "n", "a", "b", "c", "d")]])


def _joined(key: tuple, t: pa.Table) -> pa.Table:
    one = merged([unpacked(*x) for x in zip(*(t[c].to_pylist() for c in "abcd"))])
    return pa.Table.from_pylist([{"kind": 4, "batch": -1, "bucket": key[0].as_py(), "size": len(one[0]), **dict(zip("abcd", packed(one)))}], LEVEL)


class Family:
    """Levels, largest first: (batches in it, stored table whose rows of kind 4 are a suffix array by bucket). Batches must come by rising doc_id: what
    a batch's strings match in a level, or in it, in a smaller doc_id is what add() tells; older batches keep theirs."""

    def __init__(self, spark):
        self.levels: list[tuple[int, DataFrame]] = []
        self.none = spark.createDataFrame([], LEVEL_SQL)

    def add(self, arrays: DataFrame) -> DataFrame:
        """(kind 3, batch, bucket, size, at, n) of arrays (batch, bucket, a, b, c, d), which make a new level."""
        old = self.none
        for _, level in self.levels:
            old = old.unionByName(level.filter("kind = 4"))
        new = arrays.select("batch", "bucket", *"abcd").groupBy("bucket")
        out = stored(new.cogroup(old.select("bucket", *"abcd").groupBy("bucket")).applyInArrow(_entered, LEVEL_SQL), plain=True, by="kind")
        self.levels.append((1, out))
        while len(self.levels) > 1 and self.levels[-2][0] == self.levels[-1][0]:
            (n, x), (m, y) = self.levels.pop(), self.levels.pop()
            both = x.unionByName(y).filter("kind = 4").select("bucket", *"abcd")
            self.levels.append((n + m, stored(both.groupBy("bucket").applyInArrow(_joined, LEVEL_SQL), plain=True, by="kind")))
            discard(x, y, part="kind=4")  # answers of theirs stay
        return out.filter("kind = 3").select(*[x.split()[0] for x in ANSWER_SQL.split(", ")])


def every_suffix(docs: DataFrame, buckets: int) -> DataFrame:
    """Arrays of all strings of docs (doc_id, text), for a family that goes on: nothing is left out beforehand, since what
    comes later may repeat it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            own = b["doc_id"].fill_null(NO_ID).to_numpy()
            for r in runs(b["text"]):
                size = np.diff(r.offsets)
                text = np.flatnonzero(size >= SPAN)
                p = starts(r.offsets[:-1][text], r.offsets[1:][text] - SPAN)
                array, _ = _array([strings_at(r, p, np.repeat(own[r.lo : r.lo + r.n][text], size[text] - SPAN + 1))])
                by, cut = dealt(array[1], buckets)
                rows = [((part << 24) + seq, 0, i, *packed(tuple(x[by[cut[i] : cut[i + 1]]] for x in array))) for i in range(buckets) if cut[i + 1] > cut[i]]
                seq += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4])], names=["batch", "gen", "bucket", *"abcd"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "batch long, gen int, bucket int, a binary, b binary, c binary, d binary")


def _removed(bits: int, buckets: int):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(key: tuple, state: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        got = answers.to_pylist()
        for s in state.to_pylist():
            b, ids = _batch(s, bits)
            pairs = b.pairs(_flagged(b, got), ids)
            whole, first = pairs.settle(got)
            parts = pairs.strings(first)
            (_, fp, least), place = _array(parts)
            by, cut = dealt(fp, buckets)
            for r in got:
                if r["kind"] == 3:
                    at = by[cut[r["bucket"]] + unpack(r["at"]).astype(np.int64)]
                    least[at] = np.minimum(least[at], unpack(r["n"]).view(np.int64))
            at = done = 0
            for i, (r, (p, _, _, owner)) in enumerate(zip(b.runs, parts)):
                p = p[least[place[done : done + len(p)]] < owner]
                done += len(owner)
                all_ = np.flatnonzero(whole & (pairs.run == i))
                edge = np.bincount(p, minlength=len(r.data) + 1) - np.bincount(p + SPAN, minlength=len(r.data) + 1)
                edge += np.bincount(pairs.p1[all_], minlength=len(edge)) - np.bincount(pairs.p2[all_] + SPAN, minlength=len(edge))
                gone = np.cumsum(edge)[:-1] > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                a = r.offsets[:-1]
                a = a[a < len(gone)]
                begins[a] = gone[a]
                kept = r.data[~gone].tobytes()
                size, lost = np.diff(r.offsets), per_text(gone, r.offsets)
                cut = np.concatenate([[0], np.cumsum(size - lost)]).tolist()
                out[0] += ids[at : at + r.n].tolist()
                out[1] += size.tolist()
                out[2] += lost.tolist()
                out[3] += per_text(begins, r.offsets).tolist()
                out[4] += [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(cut, cut[1:])]
                at += r.n
        types = [pa.int64()] * 4 + [pa.string()]
        return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return run


def generations(docs: DataFrame, n: int) -> list[int]:
    """The largest doc_ids of all generations but the last."""
    found = docs.filter("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.02)
    return sorted({int(x) for x in found})


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bits, buckets = key_bits(scan_partitions(docs)), spread(docs)
    bounds = generations(docs, GENERATIONS)
    state = stored(docs.mapInArrow(_pass(bits, buckets, bounds, BATCH_BYTES), STATE_SQL), plain=True, by="kind")
    texts = state.filter("kind = 0").select("batch", "gen", "a", "b", "c")
    asked = state.filter("kind = 1").select("bucket", "batch", "a", "b")
    answers = asked.groupBy("bucket").applyInArrow(_frequencies_small, "batch long, bucket int, size long, at binary, n binary, keys binary")
    answers = stored(answers.select(F.lit(1).alias("kind"), "batch", "bucket", "size", "at", F.lit(None).cast("binary").alias("n")), plain=True)
    discard(state, part="kind=1")
    sent = "batch long, gen int, bucket int, a binary, b binary, c binary, d binary"
    own = lambda gen=None: texts.filter(F.lit(True) if gen is None else F.col("gen") == gen).select((F.col("batch") + 0).alias("batch"), "gen", "a", "b", "c").groupBy("batch")
    pairs = own().cogroup(answers.groupBy("batch")).applyInArrow(_asked(bits, buckets, 2), sent)
    every = answers.union(stored(pairs.groupBy("bucket").applyInArrow(_compared, ANSWER_SQL), plain=True))
    family, settled = Family(docs.sparkSession), every
    for gen in range(len(bounds) + 1):
        mine = settled.filter(F.pmod("batch", F.lit(GENERATIONS)) == gen).groupBy("batch")
        every = every.union(family.add(own(gen).cogroup(mine).applyInArrow(_asked(bits, buckets, 3), sent)))
    out = own().cogroup(every.groupBy("batch")).applyInArrow(_removed(bits, buckets), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def _frequencies_small(key: tuple, t: pa.Table) -> pa.Table:
    return _frequencies(key, t.set_column(t.schema.get_field_index("b"), "b", pa.array([pack(unpack_small(x)) for x in t["b"].to_pylist()], pa.binary())))


def op7_suffix_levels(spark, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
c AS (SELECT doc_id, n, lo, substr(h, 2 * lo + 1, 610) AS part FROM (SELECT doc_id, n, h, unnest(range(0, greatest(n - 49, 0), 256)) AS lo FROM d)),
p AS (SELECT doc_id, lo + i AS p, substr(part, 2 * i + 1, 100) AS s FROM (SELECT doc_id, lo, part, unnest(range(least(256, n - 49 - lo))) AS i FROM c)),
f AS (SELECT md5(s) AS s, min(doc_id) AS least, max(doc_id) AS most FROM p GROUP BY ALL HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT p.doc_id, p.p FROM p JOIN f ON md5(p.s) = f.s WHERE f.least < p.doc_id),
g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM hit),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM (SELECT * FROM r UNION ALL SELECT doc_id, -1, 0 FROM d)),
t AS (SELECT doc_id, CAST(coalesce(sum(b - a) FILTER (a >= 0), 0) AS BIGINT) AS n_removed, CAST(count(*) FILTER (a >= 0) AS BIGINT) AS n_spans,
             string_agg(substr(h, 2 * b + 1, 2 * (coalesce(next, n) - b)), '' ORDER BY b) AS kept
      FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM t JOIN d USING (doc_id)
"""

QUERIES = {"op7_suffix_levels": op7_suffix_levels}
SQL = {"op7_suffix_levels": OP7_SQL}
