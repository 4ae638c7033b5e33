"""Language-model scoring by a probabilistic suffix tree.

A text is the sequence of its lower-cased words' bytes, a blank between words and one end symbol; its probability is that
of its tokens, spelt out. Counts of all contexts of up to DEPTH symbols are taken over every training text. A context is a
candidate if it is seen LEAST times, whatever the corpus' size, and stays if its next-symbol distribution diverges from its
parent's (the context without its oldest symbol): N * KL above PENALTY nats for each symbol seen. Suffixes of contexts that
stay stay too. Distributions are smoothed towards the parent's, which weighs BELIEF for each distinct symbol (one by one
would be Witten-Bell's way, which trusts rare contexts too much), the root's towards a uniform one. A place is scored by the longest suffix of what precedes it that is a state.

The tree grows with the corpus and is never in one place: contexts of a length are dealt out by their parent, so that a
task holds what the divergence test compares. The base score needs each word's exact count, the tree's score the states
along each place: a batch of texts asks once for each of its distinct words, and contexts with a next symbol (keyed.py).

Defined cases: null text is empty (only the end token); a null doc_id is read as "null" for the split; repeated rows are
counted and scored each; without training texts every count is 0 and symbols are uniform; an empty table gives no rows.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, spread, stored, swept, table
from .keyed import U64, pack, pack_small, ranges, unpack, unpack_small
from .suffixes import _state, starts
from .textbatch import LOWER, ROOMY, Run, lean, lean_cogroup, mix, per_text, runs

#: A 64-bit key holds seven symbols beside the next one; the seventh would more than double what is exchanged.
DEPTH = 6
LEAST = 2
PENALTY = 0.5
#: How much the parent's distribution weighs for each distinct symbol seen.
BELIEF = 5
SYMBOLS = 256
#: Text of a batch: the longer, the fewer of its contexts are asked for again by other batches.
BATCH_BYTES = 8 << 20
BLANK, END = 0x20, 0x0A
END_KEY = U64(1)
NO_ID = np.iinfo(np.int64).max
FIELDS = [("kind", pa.int32()), ("batch", pa.int64()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("symbols", pa.int64()), ("tokens", pa.int64())]
STATE = pa.schema(FIELDS)
STATE_SQL = "kind int, batch long, bucket int, a binary, b binary, c binary, symbols long, tokens long"


def held_out(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(("null" if i is None or i == NO_ID else str(i)).encode()) % 5 == 1 for i in ids], bool)


class Tokens:
    """A run's words (64-bit hashes, texts' bounds) and its symbols, each packed with the DEPTH before it."""

    def __init__(self, run: Run):
        low = Run(LOWER[run.data], run.offsets)
        a, b, self.bounds = low.words()
        self.words = low.hashes(a, b)
        n = np.diff(self.bounds)
        data = np.append(low.data, np.uint8(0))
        stream = data[starts(a, b)] if len(a) else np.zeros(0, np.uint8)
        ends = np.cumsum(b - a + 1)
        stream[ends - 1] = BLANK
        full = n > 0
        stream[ends[self.bounds[1:][full] - 1] - 1] = END
        size = np.zeros(run.n, np.int64)
        total = np.concatenate([[0], ends])
        size[:] = total[self.bounds[1:]] - total[self.bounds[:-1]]
        if not full.all():  # texts without words are their end alone
            stream = np.insert(stream, total[self.bounds[:-1]][~full], END)
            size[~full] = 1
        self.at = np.concatenate([[0], np.cumsum(size)])
        self.keys = stream.astype(U64)
        place = np.arange(len(stream)) - np.repeat(self.at[:-1], size)
        for j in range(1, DEPTH + 1):
            before = np.full(len(stream), END, np.uint8)
            before[j:] = stream[:-j]
            before[place < j] = END
            self.keys |= before.astype(U64) << U64(8 * j)


def low(symbols: int) -> np.uint64:
    """The mask of a packed key's last symbols."""
    return U64((1 << 8 * symbols) - 1)


def counted(keys: np.ndarray, flag: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct packed keys, and how many of each are flagged (without flags: how many there are). A key leaves its
    highest bit free, so that the flag is sorted as its last one."""
    both = keys << U64(1)
    both |= U64(1) if flag is None else flag
    both.sort()
    k = both >> U64(1)
    first = heads(k)
    return k[first], np.add.reduceat(both & U64(1), first).astype(np.int64) if len(k) else np.zeros(0, np.int64)


def dealt(k: np.ndarray, depth: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted keys (context of depth symbols, symbol) by bucket, and the buckets' bounds in it. The bucket follows
    from the parent context: its children are all in one."""
    bucket = (mix(((k >> U64(8)) & low(depth - 1)) + U64(depth << 56)) % U64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    return by, np.searchsorted(bucket[by], np.arange(buckets + 1))


def heads(c: np.ndarray) -> np.ndarray:
    """Where each of grouped values begins."""
    return np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    k, c = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def _pass(buckets: int):
    """kind 0: texts; 1: words asked for, with training counts; 2: contexts with a next symbol, with training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        texts: list[Run] = []
        ids: list[np.ndarray] = []
        words: list[tuple[np.ndarray, np.ndarray]] = []
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        tokens = symbols = 0

        def rows(held):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), FIELDS)], schema=STATE)

        def flush():
            batch = (part << 24) + seq
            u, n = summed(words)
            cut = ranges(u, 64, buckets)
            out = [(0, batch, -1, *_state(texts, np.concatenate(ids)), symbols, tokens)]
            out += [(1, batch, i, pack(u[cut[i] : cut[i + 1]]), pack_small(n[cut[i] : cut[i + 1]]), None, 0, 0) for i in range(buckets) if cut[i + 1] > cut[i]]
            k, n = summed(grams)
            for d in range(DEPTH, 0, -1):
                k, n = summed([(k & low(d + 1), n)])
                by, at = dealt(k, d, buckets)
                out += [(2, batch, d * buckets + i, pack(k[by[at[i] : at[i + 1]]]), pack_small(n[by[at[i] : at[i + 1]]]), None, 0, 0) for i in range(buckets) if at[i + 1] > at[i]]
            for x in (texts, ids, words, grams):
                x.clear()
            return rows(out)

        for b in batches:
            own = b["doc_id"].fill_null(NO_ID).to_numpy()
            for r in runs(b["text"]):
                t = Tokens(r)
                mine = own[r.lo : r.lo + r.n]
                train = ~held_out(mine.tolist())
                flag = np.repeat(train, np.diff(t.bounds))
                u, code = np.unique(t.words, return_inverse=True)
                words += [(u, np.bincount(code, weights=flag, minlength=len(u)).astype(np.int64)), (np.array([END_KEY]), np.array([int(train.sum())]))]
                learnt = np.repeat(train, np.diff(t.at))
                grams.append(counted(t.keys, learnt))
                tokens += int(flag.sum() + train.sum())
                symbols += int(learnt.sum())
                texts.append(Run(r.data.copy(), r.offsets))
                ids.append(mine)
                size += len(r.data)
                if sum(len(x) for x, _ in grams) > 4_000_000:
                    grams[:] = [summed(grams)]
                if size >= BATCH_BYTES:
                    yield flush()
                    size, seq, tokens, symbols = 0, seq + 1, 0, 0
        if texts:
            yield flush()

    return run


def _word_counts(key: tuple, t: pa.Table) -> pa.Table:
    parts = [(unpack(a), unpack_small(b)) for a, b in zip(t["a"].to_pylist(), t["b"].to_pylist())]
    u, n = summed(parts)
    known = int((n > 0).sum())
    answers = [pack_small(n[np.searchsorted(u, k)]) for k, _ in parts]
    return pa.table([t["batch"], t["bucket"], pa.array(answers, pa.binary()), pa.array([known] + [0] * (len(parts) - 1), pa.int64())], names=["batch", "bucket", "n", "known"])


TREE = [("bucket", pa.int32()), ("c", pa.binary()), ("total", pa.binary()), ("distinct", pa.binary()), ("stay", pa.binary()), ("k", pa.binary()), ("n", pa.binary())]
TREE_SQL = "bucket int, c binary, total binary, distinct binary, stay binary, k binary, n binary"


def _tree_row(bucket: int, c, total, distinct, stay, k, n) -> pa.Table:
    row = [bucket, pack(c), pack_small(total), pack_small(distinct), stay.astype(np.uint8).tobytes(), pack(k), pack_small(n)]
    return pa.table([pa.array([x], t) for x, (_, t) in zip(row, TREE)], names=[x for x, _ in TREE])


def _contexts(buckets: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        """Candidates among this task's contexts, with their next symbols' counts, and whether they diverge from their
        parents, whose counts are the sums of their children's. All next symbols' counts in bucket 0."""
        bucket = t["bucket"][0].as_py()
        d = bucket // buckets
        k, n = summed([(unpack(a), unpack_small(b)) for a, b in zip(t["a"].to_pylist(), t["b"].to_pylist())])
        k, n = k[n > 0], n[n > 0]
        c = k >> U64(8)
        first = heads(c)
        total = np.add.reduceat(n, first) if len(k) else n
        distinct = np.diff(np.append(first, len(k)))
        own = np.repeat(np.arange(len(first)), distinct)
        u, code = np.unique(k & low(d), return_inverse=True)
        pn = np.bincount(code, n, len(u))
        _, pcode = np.unique(u >> U64(8), return_inverse=True)
        parent = (pn / np.bincount(pcode, pn)[pcode])[code] if len(k) else n
        gain = np.bincount(own, n * np.log(n / total[own] / parent), len(first)) if len(k) else np.zeros(0)
        some = total >= LEAST
        keep = some[own] if len(k) else np.zeros(0, bool)
        out = [_tree_row(bucket, c[first][some], total[some], distinct[some], gain[some] > PENALTY * distinct[some], k[keep], n[keep])]
        if d == 1:
            none = np.zeros(0, np.int64)
            out.append(_tree_row(0, none, none, none, none, u, pn))
        return pa.concat_tables(out)

    return run


def _suffixes(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Suffixes of the contexts that diverge: they stay too."""
        for b in batches:
            for bucket, c, stay in zip(*(b[x].to_pylist() for x in ("bucket", "c", "stay"))):
                at = unpack(c)[np.frombuffer(stay, np.uint8) > 0]
                for d in range(bucket // buckets - 1, 0, -1):
                    at = np.unique(at & low(d))
                    by, cut = dealt(at << U64(8), d, buckets)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(d * buckets, (d + 1) * buckets, dtype=np.int32), np.diff(cut))), pa.array(at[by].view(np.int64))], names=["bucket", "c"])

    return run


def _states(key: tuple, tree: pa.Table, suffixes: pa.Table) -> pa.Table:
    out = [pa.table([pa.array([], t) for _, t in TREE], names=[x for x, _ in TREE])]
    more = suffixes["c"].to_numpy().view(U64)
    for r in tree.to_pylist():
        c, total, distinct, k, n = unpack(r["c"]), unpack_small(r["total"]), unpack_small(r["distinct"]), unpack(r["k"]), unpack_small(r["n"])
        stay = (np.frombuffer(r["stay"], np.uint8) > 0) | np.isin(c, more)
        keep = np.repeat(stay, distinct)
        out.append(_tree_row(r["bucket"], c[stay], total[stay], distinct[stay], stay[stay], k[keep], n[keep]))
    return pa.concat_tables(out)


def _found(sorted_keys: np.ndarray, values: list[np.ndarray], want: np.ndarray) -> list[np.ndarray]:
    """Of each wanted key the values, or 0."""
    if not len(sorted_keys):
        return [np.zeros(len(want), np.int64) for _ in values]
    at = np.minimum(np.searchsorted(sorted_keys, want), len(sorted_keys) - 1)
    hit = sorted_keys[at] == want
    return [np.where(hit, v[at], 0) for v in values]


def _state_counts(key: tuple, asked: pa.Table, states: pa.Table) -> pa.Table:
    """For each batch's keys of a bucket the count (n), and for its contexts how often they are seen (total) and with how many symbols (distinct); 0 of what is no state."""
    none = np.zeros(0, U64)
    s = states.to_pylist()
    c, total, distinct, k, n = (unpack(s[0]["c"]), unpack_small(s[0]["total"]), unpack_small(s[0]["distinct"]), unpack(s[0]["k"]), unpack_small(s[0]["n"])) if s else [none] * 5
    rows = []
    for batch, bucket, a in zip(asked["batch"].to_pylist(), asked["bucket"].to_pylist(), asked["a"].to_pylist()):
        want = unpack(a)
        own = want >> U64(8)
        rows.append((batch, bucket, *map(pack_small, [*_found(k, [n], want), *_found(c, [total, distinct], own[heads(own)])])))
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, types)], names=["batch", "bucket", "n", "total", "distinct"])


def _log10(keys: np.ndarray, root: np.ndarray, got: dict[int, dict], buckets: int) -> np.ndarray:
    """log10 P of sorted packed keys, all of a batch's, from the answers to them by bucket."""
    levels, k = [], keys
    for d in range(DEPTH, 0, -1):
        k, back = np.unique(k & low(d + 1), return_inverse=True)
        levels.append((d, k, back))
    back_to = [x[2] for x in levels[1:]]  # from each level to the shorter one
    p = root[(levels[-1][1] & U64(255)).astype(np.int64)] if len(keys) else np.zeros(0)
    for i in range(DEPTH - 1, -1, -1):
        d, k, _ = levels[i]
        if i < DEPTH - 1:
            p = p[back_to[i]]
        by, at = dealt(k, d, buckets)
        for b in range(buckets):
            mine = by[at[b] : at[b + 1]]
            if not len(mine):
                continue
            r = got[d * buckets + b]
            own = k[mine] >> U64(8)
            many = np.diff(np.append(heads(own), len(own)))
            n, total, distinct = unpack_small(r["n"]), np.repeat(unpack_small(r["total"]), many), np.repeat(unpack_small(r["distinct"]), many)
            p[mine] = np.where(distinct > 0, (n + BELIEF * distinct * p[mine]) / np.maximum(total + BELIEF * distinct, 1), p[mine])
    return np.log10(p[levels[0][2]])


def smoothed_root(k: np.ndarray, n: np.ndarray) -> np.ndarray:
    root = np.zeros(SYMBOLS)
    root[k.astype(np.int64)] = n
    seen = max(1, int((root > 0).sum()))
    return (root + seen / SYMBOLS) / (root.sum() + seen)


class Tree:
    """The same tree in memory, for small corpora. Of each depth: states (sorted contexts) with their log10 weight of the parent, entries (context, symbol) with log10 P."""

    def __init__(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]):
        k, n = counts.get(0, (np.zeros(0, U64), np.zeros(0, np.int64)))
        root = np.zeros(SYMBOLS)
        root[k.astype(np.int64)] = n
        self.root = np.log10(smoothed_root(k, n))
        levels = []
        raw = {0: (np.zeros(1, U64), np.array([root.sum()]), np.arange(SYMBOLS, dtype=U64), root)}
        for d in range(1, DEPTH + 1):
            k, n = counts.get(d, (np.zeros(0, U64), np.zeros(0, np.int64)))
            c = k >> U64(8)
            first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(k) else np.zeros(0, np.int64)
            total = np.add.reduceat(n, first) if len(first) else n
            raw[d] = (c[first], total, k, n)
            distinct = np.diff(np.append(first, len(k)))
            own = np.repeat(np.arange(len(first)), distinct)
            pc, pt, pk, pn = raw[d - 1]
            low = k & U64((1 << 8 * d) - 1)
            at = np.minimum(np.searchsorted(pk, low), max(len(pk) - 1, 0))
            parent = pn[at] / pt[np.searchsorted(pc, low >> U64(8))] if len(k) else n
            gain = np.bincount(own, weights=n * np.log(n / total[own] / parent), minlength=len(first)) if len(k) else np.zeros(0)
            levels.append([c[first], total, distinct, k, n, (gain > PENALTY * distinct) & (total >= LEAST)])
        for d in range(DEPTH - 1, 0, -1):  # suffixes of states are states
            child = np.unique(levels[d][0][levels[d][5]] & U64((1 << 8 * d) - 1))
            levels[d - 1][5] |= np.isin(levels[d - 1][0], child)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for c, total, distinct, k, n, stay in levels:
            own = np.repeat(np.arange(len(c)), distinct)
            keep = stay[own] if len(k) else np.zeros(0, bool)
            weight = BELIEF * distinct / (total + BELIEF * distinct)
            below = 10 ** self.log10(k[keep], len(self.levels))
            p = (n[keep] + BELIEF * distinct[own[keep]] * below) / (total + BELIEF * distinct)[own[keep]]
            self.levels.append((c[stay], np.log10(weight[stay]), k[keep], np.log10(p)))

    def log10(self, keys: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """log10 P(symbol | longest state of at most depth symbols) of packed keys."""
        out = np.zeros(len(keys))
        open_ = np.arange(len(keys))
        for d in range(depth, 0, -1):
            c, weight, k, p = self.levels[d - 1]
            if not len(c) or not len(open_):
                continue
            want = keys[open_] & U64((1 << 8 * (d + 1)) - 1)
            at = np.minimum(np.searchsorted(k, want), len(k) - 1)
            hit = k[at] == want
            out[open_[hit]] += p[at[hit]]
            open_, want = open_[~hit], want[~hit] >> U64(8)
            at = np.minimum(np.searchsorted(c, want), len(c) - 1)
            state = c[at] == want
            out[open_[state]] += weight[at[state]]
        out[open_] += self.root[(keys[open_] & U64(255)).astype(np.int64)]
        return out


def _scored(root: np.ndarray, n_tokens: int, vocabulary: int, buckets: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    whole = np.log10(n_tokens + 0.5 * (vocabulary + 1))

    def run(key: tuple, state: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        every = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
        got, tree = [r for r in every if r["total"] is None], {r["bucket"]: r for r in every if r["total"] is not None}
        for s in state.to_pylist():
            batch, ids = _runs(s)
            tokens = [Tokens(r) for r in batch]
            u = np.unique(np.concatenate([*[t.words for t in tokens], [END_KEY]]))
            count = np.concatenate([unpack_small(r["n"]) for r in got])
            log = np.log10(count + 0.5)
            end = int(np.searchsorted(u, END_KEY))
            keys = np.concatenate([t.keys for t in tokens])
            for t in tokens:
                del t.keys
            codes, uniq = pd.factorize(keys)  # all places at once: one hash table, one sort
            del keys
            order, p = np.argsort(uniq), np.empty(len(uniq))
            p[order] = _log10(uniq[order], root, tree, buckets)
            at = begin = 0
            for r, t in zip(batch, tokens):
                place = np.searchsorted(u, t.words)
                mine = ids[at : at + r.n].tolist()
                at += r.n
                n = np.diff(t.bounds) + 1
                columns = [mine, held_out(mine).tolist(), n.tolist(), (per_text(count[place] > 0, t.bounds) + (count[end] > 0)).tolist(), [n_tokens] * r.n]
                columns += [(per_text(log[place], t.bounds) + log[end] - n * whole).tolist(), per_text(p[codes[begin : begin + t.at[-1]]], t.at).tolist()]
                begin += int(t.at[-1])
                for column, x in zip(out, columns):
                    column += x
        return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return run


def _runs(row: dict) -> tuple[list[Run], np.ndarray]:
    data = np.frombuffer(_decompress(row["a"]), np.uint8)
    ids, sizes = np.frombuffer(row["b"], "<i8"), np.frombuffer(row["c"], "<i8")
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out, lo = [], 0
    while lo < len(ids):
        hi = min(len(ids), max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (1 << 20), "right")) - 1))
        out.append(Run(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo))
        lo = hi
    return out, ids


def _decompress(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(b)


def tree_scores(docs: DataFrame) -> DataFrame:
    """Scores of every row of docs (doc_id, text); rows whose crc32(doc_id as text) mod 5 is not 1 are learnt from."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = spread(docs)
    state = stored(docs.mapInArrow(lean(_pass(buckets), ROOMY), STATE_SQL), plain=True, by="kind")
    totals = state.filter("kind = 0").agg(F.sum("tokens").alias("t")).first()
    n = totals["t"] or 0
    asked = state.filter("kind = 1").select("bucket", "batch", "a", "b")
    answers = stored(asked.groupBy("bucket").applyInArrow(_word_counts, "batch long, bucket int, n binary, known long"), plain=True)
    discard(state, part="kind=1")
    swept(docs.sparkSession)
    vocabulary = answers.agg(F.sum("known")).first()[0] or 0
    contexts = state.filter("kind = 2").select("bucket", "batch", "a", "b")
    tree = built = stored(contexts.select("bucket", "a", "b").groupBy("bucket").applyInArrow(_contexts(buckets), TREE_SQL), plain=True)
    swept(docs.sparkSession)
    first = tree.filter("bucket = 0").select("k", "n").first()  # SYMBOLS counts at most
    root = smoothed_root(unpack(first["k"]), unpack_small(first["n"])) if first else smoothed_root(np.zeros(0), np.zeros(0))
    tree = tree.filter("bucket > 0")
    suffixes = tree.select("bucket", "c", "stay").mapInArrow(_suffixes(buckets), "bucket int, c long").distinct()
    states = stored(tree.groupBy("bucket").cogroup(suffixes.groupBy("bucket")).applyInArrow(_states, TREE_SQL), plain=True)
    discard(built)
    swept(docs.sparkSession)
    # stored, so that contexts and states are gone before texts are dealt out
    found = stored(contexts.select("bucket", "batch", "a").groupBy("bucket").cogroup(states.groupBy("bucket")).applyInArrow(_state_counts, "batch long, bucket int, n binary, total binary, distinct binary"), plain=True)
    discard(states)
    discard(state, part="kind=2")
    swept(docs.sparkSession)
    none = F.lit(None).cast("binary")
    answers = answers.select("batch", "bucket", "n", none.alias("total"), none.alias("distinct")).union(found)
    texts = state.filter("kind = 0").select((F.col("batch") + 0).alias("batch"), "a", "b", "c")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(lean_cogroup(_scored(root, n, vocabulary, buckets)), schema)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def op4_suffix_tree(spark, sf_dir: str) -> DataFrame:
    return tree_scores(table(spark, sf_dir, "documents"))


QUERIES = {"op4_suffix_tree": op4_suffix_tree}
SQL: dict[str, str] = {}
