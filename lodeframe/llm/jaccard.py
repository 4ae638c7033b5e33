"""N-gram Jaccard join by a token-group matrix.

Documents with equal shingle sets form a class; classes are what is joined.
1. Shingles are ordered by document frequency, rarest first (keyed.py). Two sets that reach the threshold share a shingle
   among the first |s| - ceil(t |s|) + 1 of each; shingles of one document alone drop out. What is left are postings: they
   say which classes may be similar, and nothing else.
2. Similar classes are partitioned into groups before any two sets are compared: a class goes to the least class that it
   shares a posting with, and a group is cut into parts of like size (a link joins sets whose sizes differ by 1 / t at most)
   and of PART members or PART_TOKENS tokens at most, dealt by hash.
3. A part is a task's unit. Its matrix has a row for each SUB of its members: their token union. A query's overlap with a row
   bounds that with any member: rows that stay under ceil(t |query|) are closed, the others are opened, and only their
   members' overlaps are counted exactly. First every class asks the group that it is in (the group's least class asks all
   its parts), then, of the pairs of a class and another part that share a posting, those that may still join what no link
   has joined yet.
4. Components of all links.
Links that would join what is joined already are not looked for, so a group of thousands of copies costs a comparison each.

Defined cases: null and empty texts have no shingles and link with nothing; repeated rows (and repeated ids) are copies of
each other; a null doc_id counts as the largest in naming a component and is null if alone; an empty table gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE, met, scan_partitions, spread, stored, table
from .components import components
from .keyed import BATCH_BYTES, U64, key_bits, pack, ranges, unpack
from .textbatch import Run, lean, lean_cogroup, lean_group, mix, runs, windows

#: op5's contract: words in a shingle, and the threshold in hundredths.
SHINGLE, PERCENT = 4, 85
#: The general parameters of near-duplicate stages.
STAGE_SHINGLE, STAGE_PERCENT = 5, 80
NO_ID = np.iinfo(np.int64).max
#: Members and tokens of a part, members of a row of the matrix, queries that a part is asked by at a time, tokens of a task.
PART, PART_TOKENS, SUB, ASKED, TASK_TOKENS = 512, 1 << 18, 16, 512, 1 << 20
#: The filter that spares sets which surely take no part has FILTER_SPARE bits a class, and at most 2 ** FILTER_BITS in all.
FILTER_SPARE, FILTER_BITS = 16, 27


def shingles(run: Run, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, shingle hash) pairs in order; a text of fewer than k words is one shingle."""
    low = run.lowered()
    starts, ends, bounds = low.words()
    h = low.hashes(starts, ends)
    w, at = windows(h, bounds, k)
    owner = np.repeat(np.arange(run.n), np.diff(bounds))
    own, keys = owner[at], w
    count = np.diff(bounds)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = np.full(len(short), 0x5851F42D4C957F2D, U64)
        for i in range(k - 1):
            more = count[short] > i
            place = np.minimum(bounds[short] + i, max(len(h) - 1, 0))
            whole = np.where(more, mix(whole * U64(3) + h[place]), whole)
        own, keys = np.concatenate([own, short]), np.concatenate([keys, whole])
    order = np.lexsort((keys, own))
    own, keys = own[order], keys[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (keys[1:] != keys[:-1])
    return own[new], keys[new]


def signatures(own: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes, and a hash of each set (0: the empty set)."""
    bounds = np.searchsorted(own, np.arange(n + 1))
    size = np.diff(bounds)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(keys ^ U64(0xA0761D6478BD642F)), dtype=U64)])
    sig = mix(total[bounds[1:]] - total[bounds[:-1]] + size.astype(U64) * U64(0xE7037ED1A0B428DB))
    return size, np.where(size == 0, 0, sig.view(np.int64) | 1)


STATE = pa.schema([("kind", pa.int32()), ("batch", pa.int64()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("e", pa.binary())])
STATE_SQL = "kind int, batch long, bucket int, a binary, b binary, c binary, d binary, e binary"


def _pass(k: int, bits: int, buckets: int, batch_bytes: int):
    """State rows (kind 0: ids, sizes, signatures, keys' places by text, marks) and requests (kind 1: keys of a range)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush():
            ids, ns, sigs, keys, marks = (np.concatenate(x) for x in zip(*held))
            held.clear()
            u, place = np.unique(keys, return_inverse=True)
            del keys
            place = place.astype(np.uint32)
            batch = (part << 24) + seq
            order = np.lexsort((place, np.repeat(np.arange(len(ns), dtype=np.int32), ns)))
            rows = [(0, batch, -1, ids.astype("<i8").tobytes(), ns.astype("<i8").tobytes(), sigs.astype("<i8").tobytes(), pack(place[order]), marks.astype("<i8").tobytes())]
            cut = ranges(u, bits, buckets)
            owner = np.repeat(np.arange(len(ns)), ns)
            texts_with = np.bincount(np.unique(owner * max(1, len(u)) + place) % max(1, len(u)), minlength=len(u))
            del owner, place
            rows += [(1, batch, i, pack(u[cut[i] : cut[i + 1]]), pack(texts_with[cut[i] : cut[i + 1]]), None, None, None) for i in range(buckets) if cut[i + 1] > cut[i]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), STATE)], schema=STATE)

        for b in batches:
            ids, marks = b["doc_id"].fill_null(NO_ID).to_numpy(), b["mark"].to_numpy()
            for r in runs(b["text"]):
                own, keys = shingles(r, k)
                n, sig = signatures(own, keys, r.n)
                held.append((ids[r.lo : r.lo + r.n], n, sig, keys >> U64(64 - bits), marks[r.lo : r.lo + r.n]))
                size += len(r.data)
                if size >= batch_bytes:
                    yield flush()
                    size, seq = 0, seq + 1
        if held:
            yield flush()

    return run


def _frequencies(key: tuple, t: pa.Table) -> pa.Table:
    """For each batch's keys of a range: how many there are, and the places, frequencies and values of those in two texts or more."""
    parts = [unpack(x) for x in t["a"].to_pylist()]
    weights = np.concatenate([unpack(x) for x in t["b"].to_pylist()]).astype(np.float64)
    u, place = np.unique(np.concatenate(parts), return_inverse=True)
    n = np.bincount(place, weights=weights).astype(np.int64)
    rows, at = [], 0
    for i, p in enumerate(parts):
        f = n[place[at : at + len(p)]]
        at += len(p)
        many = np.flatnonzero(f > 1)
        rows.append((t["batch"][i].as_py(), t["bucket"][i].as_py(), len(p), pack(many), pack(f[many]), pack(p[many])))
    names = ["batch", "bucket", "size", "at", "n", "keys"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, x) for c, x in zip(zip(*rows), types)], names=names)


def _postings(percent: int):
    names = ["key", "c", "n", "pos"]

    def run(key: tuple, state: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in names]
        got = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
        sizes = [r["size"] for r in got]
        df, keys = np.ones(sum(sizes), np.int64), np.zeros(sum(sizes), np.int64)
        for r, begin in zip(got, np.cumsum([0, *sizes])):
            at = unpack(r["at"]).astype(np.int64) + begin
            df[at] = unpack(r["n"]).astype(np.int64)
            keys[at] = unpack(r["keys"]).view(np.int64)
        for s in state.to_pylist():
            n, sig = np.frombuffer(s["b"], "<i8"), np.frombuffer(s["c"], "<i8")
            place = unpack(s["d"]).astype(np.int64)
            own = np.repeat(np.arange(len(n)), n)
            lead = df[place] == 1
            skipped = np.bincount(own[lead], minlength=len(n))
            rest = np.flatnonzero(~lead)
            order = rest[np.lexsort((place[rest], df[place[rest]], own[rest]))]
            o = own[order]
            pos = np.arange(len(o)) - np.searchsorted(o, np.arange(len(n)))[o] + skipped[o]
            keep = pos < (n - -(-percent * n // 100) + 1)[o]
            # a set of n reaches the threshold with another only if n / (n + 1) does
            keep &= (n[o] + 1) * percent <= n[o] * 100
            o, pos, at = o[keep], pos[keep], place[order][keep]
            for column, x in zip(out, (keys[at], sig[o], n[o], pos)):
                column.append(x)
        return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in out], names=names)

    return run


def _sets(k: int, bits: int, words: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for r in runs(b["text"]):
                own, keys = shingles(r, k)
                n, sig = signatures(own, keys, r.n)
                bit = sig.view(U64) >> U64(64 - bits)
                hit = ((words[(bit >> U64(6)).astype(np.int64)] >> (bit & U64(63))) & U64(1)) == 1
                rows = []
                bounds = np.searchsorted(own, np.arange(r.n + 1))
                for i in np.flatnonzero(hit & (n > 0)).tolist():
                    if int(sig[i]) not in seen:
                        seen.add(int(sig[i]))
                        rows.append((int(sig[i]), keys[bounds[i] : bounds[i + 1]].tobytes()))
                if len(seen) > 200_000:
                    seen.clear()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["c", "s"])

    return run


def _overlaps(x: np.ndarray, flat: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """How many of x each of n owners has."""
    lo, hi = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
    m = hi - lo
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
    return np.bincount(own[at], minlength=n)


class Matrix:
    """Rows: the token unions of SUB members each, members of one component side by side."""

    def __init__(self, c: np.ndarray, label: np.ndarray, sets: list[np.ndarray], sub: int):
        _, of, many = np.unique(label, return_inverse=True, return_counts=True)
        order = np.lexsort((c, [len(x) for x in sets], np.where(many[of] > 1, of, -1)))
        self.c, self.label, self.sets = c[order], label[order].copy(), [sets[i] for i in order]
        self.size = np.array([len(x) for x in self.sets])
        self.row = np.arange(len(c)) // sub
        self.n = int(self.row[-1]) + 1 if len(c) else 0
        flat = np.concatenate(self.sets) if len(c) else np.zeros(0, U64)
        own = np.repeat(self.row, self.size)
        order = np.lexsort((own, flat))
        flat, own = flat[order], own[order]
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (own[1:] != own[:-1])
        self.flat, self.own = flat[new], own[new]

    def opened(self, x: np.ndarray, label: int, percent: int) -> np.ndarray:
        """Members, not of the component, of the rows whose union's overlap with x lets a link be."""
        other = self.label != label
        if not other.any():
            return np.zeros(0, np.int64)
        bound = _overlaps(x, self.flat, self.own, self.n) * 100 >= percent * len(x)
        return np.flatnonzero(other & bound[self.row])

    def links(self, c: int, x: np.ndarray, label: int, percent: int) -> Iterator[tuple[int, int]]:
        """Links of x with members, one for each component that it joins; these are one component from then on."""
        at = self.opened(x, label, percent)
        if not len(at):
            return
        flat = np.concatenate([self.sets[i] for i in at])
        place = np.minimum(np.searchsorted(x, flat), len(x) - 1)
        total = np.concatenate([[0], np.cumsum(x[place] == flat)])
        ends = np.cumsum(self.size[at])
        both = total[ends] - total[ends - self.size[at]]
        hit = at[100 * both >= percent * (self.size[at] + len(x) - both)]
        for m in hit[np.unique(self.label[hit], return_index=True)[1]]:
            yield int(self.c[m]), int(c)
            self.label[self.label == self.label[m]] = label


def _asked(percent: int, sub: int):
    """Of each part: the links of its queries with its members; without queries of others, of its members too."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        part, chunk, asks, c, label, sets = (t[x].to_pylist() for x in ("part", "chunk", "asks", "c", "label", "s"))
        cells: dict[tuple, list[int]] = {}
        for i, cell in enumerate(zip(part, chunk)):
            cells.setdefault(cell, []).append(i)
        out: list[tuple[int, int]] = []
        for at in cells.values():
            members, queries = [i for i in at if not asks[i]], sorted((i for i in at if asks[i]), key=lambda i: c[i])
            m = Matrix(np.array([c[i] for i in members], np.int64), np.array([label[i] for i in members], np.int64), [np.frombuffer(sets[i], U64) for i in members], sub)
            for i in queries:
                out += m.links(c[i], np.frombuffer(sets[i], U64), label[i], percent)
            if chunk[at[0]] < 0:  # the group's own round
                for i in range(len(members)):
                    out += m.links(int(m.c[i]), m.sets[i], int(m.label[i]), percent)
        return pa.table([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], names=["a", "b"])

    return run


def _bitmap(classes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of bits of a filter, and its words: one bit set for each class's upper bits. Its size has a bound."""
    bits = min(FILTER_BITS, max(16, int(classes.count() * FILTER_SPARE).bit_length()))
    bit = F.shiftrightunsigned(F.col("c"), 64 - bits)
    rows = classes.groupBy(F.shiftrightunsigned(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(c, {64 - bits}) & 63 AS INT))")).alias("v"))
    words = np.zeros(1 << (bits - 6), np.int64)
    got = rows.toArrow()  # at most 2 ** (FILTER_BITS - 6) rows
    words[got["w"].to_numpy()] = got["v"].to_numpy()
    return bits, words.view(U64)


def _matched(filled: DataFrame, tokens: int, percent: int) -> DataFrame:
    """(a, b) links of cells (part, chunk, asks, c, label, s) of so many tokens, stored."""
    bucket = F.pmod(F.xxhash64("part", "chunk"), F.lit(tokens // TASK_TOKENS + 1))
    return stored(filled.select("part", "chunk", "asks", "c", "label", "s").withColumn("bucket", bucket).groupBy("bucket").applyInArrow(lean_group(_asked(percent, SUB)), "a long, b long"))


def shared(posts: DataFrame, salts: int) -> DataFrame:
    """Postings (key, c, n) of keys that several classes have, with the list's least class; of lists alike one is left."""
    own = [F.bit_xor(F.xxhash64("c", F.lit(i))).alias(f"x{i}") for i in range(2)]
    lists = posts.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("least"), *own).filter("m > 1")
    return stored(met(posts, lists.groupBy("m", "least", "x0", "x1").agg(F.min("key").alias("key")).select("key", "least"), "key", salts))


def parted(classes: DataFrame, percent: int, salts: int) -> DataFrame:
    """classes (c, g, n) with part: the group, a band of sizes and a hash within it, of which there are as many as the
    band's members and tokens ask for. Links join bands next to each other at most."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(max(0.01, float(np.log(100 / percent))) * (1 + 1e-9)) + 1e-9).cast("int")
    d = classes.withColumn("band", band)
    many = d.groupBy("g", "band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / PART), F.ceil(F.sum("n") / PART_TOKENS)).cast("long").alias("parts"))
    d = met(d, many, ("g", "band"), salts).withColumn("salt", F.pmod(F.xxhash64("c"), F.col("parts")))
    return d.withColumn("part", F.xxhash64("g", "band", "salt")).select("c", "g", "n", "band", "part")


def links_of(posts: DataFrame, sets: DataFrame, percent: int, salts: int) -> DataFrame:
    """(node, label) of classes that link, from shared postings (key, c, n, least) and sets (c, s)."""
    # 2. groups around the least class of each posting list, and their parts
    parts = stored(parted(posts.groupBy("c").agg(F.min("least").alias("g"), F.first("n").alias("n")), percent, salts))
    # 3. each group's own round: its members, and its least class as a query of its parts that can hold a link of it
    cell = lambda d, chunk, asks: d.select("part", chunk.alias("chunk"), F.lit(asks).alias("asks"), "c", "label", "n")
    own = cell(parts.withColumn("label", F.col("c")), F.lit(-1), False)
    lead = parts.select(F.col("c").alias("g"), "c", F.col("c").alias("label"), "n", F.col("band").alias("own_band"), F.col("part").alias("own_part"))
    asks = met(parts.select("g", "part", "band").distinct(), lead, "g", salts).filter("part <> own_part and abs(band - own_band) <= 1")
    asks = stored(cell(asks, F.lit(-1), True))
    tokens = (parts.agg(F.sum("n")).first()[0] or 0) + (asks.agg(F.sum("n")).first()[0] or 0)
    links = _matched(own.join(sets, "c").unionByName(met(asks, sets, "c", salts)), tokens, percent)
    label = components(links, salts)
    known = parts.join(label.select(F.col("node").alias("c"), "label"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    known = stored(known.select("c", "n", "band", "part", "label"))
    # pairs of a class and another part that share a posting. Of a list's components the one of most classes needn't ask:
    # the others ask for links with it
    named = met(posts.select("key", "c"), known, "c", salts)
    per = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    major = per.groupBy("key").agg(F.max(F.struct("m", "label")).alias("x"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    named = stored(met(named, major.select("key", F.col("x.label").alias("major")), "key", salts))
    held = named.groupBy("key", F.col("part").alias("to")).agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.first("band").alias("to_band"))
    pairs = met(named.filter("label <> major"), held, "key", salts).filter("part <> to and abs(band - to_band) <= 1 and not (l1 = label and l2 = label)")
    pairs = stored(pairs.select(F.col("to").alias("part"), "c", "label", "n").distinct())
    asked = stored(pairs.groupBy("part").agg(F.greatest(F.ceil(F.count(F.lit(1)) / ASKED), F.ceil(F.sum("n") / PART_TOKENS)).cast("int").alias("chunks")))
    asks = cell(met(pairs, asked, "part", salts), F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int"), True)
    members = cell(met(known, asked, "part", salts), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), False)
    cells = stored(asks.union(members))
    tokens = cells.agg(F.sum("n")).first()[0]
    return components(links.union(_matched(met(cells, sets, "c", salts), tokens, percent)), salts) if tokens else label


def judged(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, mark, n, c, label) of every row of docs (doc_id, text, mark long): the class (0: no shingles) and the
    component, named by a class. A null doc_id comes back as the largest long."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "mark")
    bits, buckets = key_bits(scan_partitions(docs)), spread(docs)
    state = stored(docs.mapInArrow(lean(_pass(k, bits, buckets, BATCH_BYTES)), STATE_SQL), plain=True)
    answers = state.filter("kind = 1").select("bucket", "batch", "a", "b").groupBy("bucket").applyInArrow(lean_group(_frequencies), "batch long, bucket int, size long, at binary, n binary, keys binary")
    own = state.filter("kind = 0").select((F.col("batch") + 0).alias("batch"), "a", "b", "c", "d")
    posts = own.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(lean_cogroup(_postings(percent)), "key long, c long, n long, pos long")
    posts = shared(stored(posts.groupBy("key", "c").agg(F.first("n").alias("n"))), buckets)
    classes = stored(posts.select("c").distinct())
    width, words = _bitmap(classes)
    sets = docs.select("text").mapInArrow(lean(_sets(k, width, words)), "c long, s binary")
    sets = stored(sets.join(classes, "c", "left_semi").groupBy("c").agg(F.first("s").alias("s")))
    label = links_of(posts, sets, percent, buckets)
    rows = state.filter("kind = 0").select("a", "b", "c", "e").mapInArrow(lean(_unrolled), "doc_id long, n long, c long, mark long")
    return met(rows, label.select(F.col("node").alias("c"), "label"), "c", buckets, "left").withColumn("label", F.coalesce("label", "c"))


def linked(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text)."""
    rows = stored(judged(docs.select("doc_id", "text", F.lit(0).cast("long").alias("mark")), k, percent))
    names = rows.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = met(rows.filter("n > 0"), names, "label", spread(docs)).select("doc_id", "n", "component_id").union(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif("component_id", F.lit(NO_ID)).alias("component_id"))


def deduplicated(docs: DataFrame, k: int = STAGE_SHINGLE, percent: int = STAGE_PERCENT) -> DataFrame:
    """docs, all columns, one row of each component: that of the least doc_id (a null one last), of those the one of the
    least text hash. Rows are told apart by doc_id and text, so that rows with one id, or none, are judged each by what
    they hold; of rows alike in both, one stays. Rows without words all stay."""
    columns = docs.columns
    mark, seen = F.xxhash64("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = stored(judged(docs.select("doc_id", "text", mark.alias("mark")), k, percent).filter("n > 0").select("doc_id", "mark", "label"))
    best = rows.groupBy("label").agg(F.min(F.struct("doc_id", "mark")).alias("x")).select("x.doc_id", "x.mark")
    kept = stored(best.join(rows.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("m")), ["doc_id", "mark"]))
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(WORD_RE)
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), seen.alias("doc_id"), mark.alias("mark"), wordless.alias("wordless"))
    some = wrapped.filter("not wordless")
    out = wrapped.filter("wordless").select("row").union(some.join(kept.filter("m = 1"), ["doc_id", "mark"], "left_semi").select("row"))
    if kept.filter("m > 1").limit(1).count():  # rows alike in id and text are made one where they are read
        one = some.groupBy("doc_id", "mark").agg(F.first("row").alias("row"))
        out = out.union(one.join(kept.filter("m > 1"), ["doc_id", "mark"], "left_semi").select("row"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in columns])


def _unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r[x], "<i8")) for x in "abce"], names=["doc_id", "n", "c", "mark"])


def op5_jaccard(spark, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, w, len(w) AS m FROM w),
p AS (SELECT doc_id, w, m, unnest(range(greatest(m - 3, least(m, 1)))) AS i FROM n),
s AS (SELECT DISTINCT doc_id, CASE WHEN m < 4 THEN array_to_string(w, ' ') ELSE w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] END AS g FROM p),
size AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
sig AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS class FROM s GROUP BY doc_id),
class AS (SELECT class, min(doc_id) AS first FROM sig GROUP BY class),
u AS (SELECT s.doc_id, g, k FROM s JOIN size USING (doc_id) WHERE s.doc_id IN (SELECT first FROM class)),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id AND a.k * 100 >= 85 * b.k AND b.k * 100 >= 85 * a.k
          GROUP BY a.doc_id, b.doc_id, a.k, b.k HAVING 100 * count(*) >= 85 * (a.k + b.k - count(*))),
reach AS (SELECT first AS x, first AS y FROM class UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT n.doc_id, CAST(coalesce(k, 0) AS BIGINT) AS n_shingles, coalesce(component_id, n.doc_id) AS component_id
FROM n LEFT JOIN size USING (doc_id) LEFT JOIN sig USING (doc_id) LEFT JOIN class USING (class) LEFT JOIN least ON least.x = class.first
"""

QUERIES = {"op5_jaccard": op5_jaccard}
SQL = {"op5_jaccard": OP5_SQL}
