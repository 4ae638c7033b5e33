"""Exact top-k inner products by a three-phase uniform threshold.

A pair's score is the sum of its scores in SLICES slices of the dimensions: its local scores. Queries and candidates are
packed into blocks, candidates in the order of their norms; a cell is one block of each.
1. Local lists: in each block the LEAD rows of the largest norms in a slice lead. Each query's k best local scores among them, of each
   slice, are gathered and totalled; the k-th best total is a cutoff t that no member of the answer falls below.
2. t goes to all cells. Whoever reaches t has a local score of t / SLICES or more, so a query whose norms, slice by slice, rule
   that out for a block skips it. For the others the local scores are computed once, in single precision with a margin for
   its rounding, and entries that reach t / SLICES in a slice and t in all are collected.
3. The collected pairs alone are resolved exactly; those of t or more compete for the k places, ties to the smaller id.

Defined cases: vectors that are null, empty or hold null or non-finite components, and rows with a null id, take no part;
rows with the query's id count as the query's own; of repeated query rows one answers (the least vector); vectors of
different lengths meet as if padded with zeros; scores beyond a long stop at its ends. Components are integers, and so
are scores; products that could leave a double's exact range are taken in Python's integers.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

K = 10
SLICES = 4
#: Rows in a block of candidates and (about) of queries; queries of a block that are worked on at a time.
ROWS, QUERY_ROWS, AT_ONCE = 4096, 16384, 512
#: Leading rows of a block for each slice, and blocks whose leading rows make one cell.
LEAD, LEAD_BLOCKS = 64, 16
#: Pairs resolved at a time.
PAIRS = 1 << 16
LOWEST = -(2**63)
BLOB = "ids binary, vectors binary, dims int, narrow boolean"
FIELDS = [("ids", pa.binary()), ("vectors", pa.binary()), ("dims", pa.int32()), ("narrow", pa.bool_())]


def _pack(ids: np.ndarray, m: np.ndarray) -> dict:
    narrow = bool(np.abs(m).max(initial=0) < 2**31)
    return {"ids": ids.astype("<i8").tobytes(), "vectors": m.astype("<i4" if narrow else "<f8").tobytes(), "dims": m.shape[1], "narrow": narrow}


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["vectors"], "<i4" if row["narrow"] else "<f8").reshape(len(ids), row["dims"]).astype(np.float64)


def _matrix(column) -> np.ndarray:
    rows = [np.asarray(v, np.float64) for v in column.to_pylist()]
    out = np.zeros((len(rows), max((len(v) for v in rows), default=0)))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def sliced(dims: int, slices: int) -> list[slice]:
    cuts = np.linspace(0, dims, slices + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]


def norms(m: np.ndarray, slices: int) -> np.ndarray:
    """Of each row the norm of each slice. Huge components make it infinite, which rules nothing out."""
    with np.errstate(over="ignore"):
        return np.stack([np.sqrt((m[:, s] ** 2).sum(1)) for s in sliced(m.shape[1], slices)], 1)


def leading(m: np.ndarray, slices: int) -> np.ndarray:
    """Rows that lead in a slice."""
    if len(m) <= LEAD:
        return np.arange(len(m))
    return np.unique(np.argpartition(-norms(m, slices), LEAD - 1, axis=0)[:LEAD])


def _blocks(slices: int):
    schema = pa.schema([("lead", pa.bool_()), *FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of ROWS rows of one task's candidates, and each block's leading rows."""
        held: list[pa.RecordBatch] = []

        def packed(t: pa.Table):
            ids, m = t["id"].to_numpy(), _matrix(t["vec"])
            at = leading(m, slices)
            return pa.RecordBatch.from_pylist([{"lead": False, **_pack(ids, m)}, {"lead": True, **_pack(ids[at], m[at])}], schema)

        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                held.append(b.slice(lo, ROWS))
                if sum(x.num_rows for x in held) >= ROWS:
                    t = pa.Table.from_batches(held)
                    yield packed(t.slice(0, ROWS))
                    held = t.slice(ROWS).to_batches()
        if sum(x.num_rows for x in held):
            yield packed(pa.Table.from_batches(held))

    return run


def _query_block(key: tuple, t: pa.Table) -> pa.Table:
    row = _pack(t["id"].to_numpy(), _matrix(t["vec"])) | {"qb": key[0].as_py(), "cut": t["cut"].to_numpy().astype("<i8").tobytes()}
    return pa.Table.from_pylist([row], pa.schema([("qb", pa.int32()), *FIELDS, ("cut", pa.binary())]))


def padded(q: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dims = max(q.shape[1], d.shape[1])
    return tuple(x if x.shape[1] == dims else np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (q, d))


def single(q: np.ndarray, d: np.ndarray) -> bool:
    """Whether local scores stay well within single precision's range."""
    return float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * max(1, q.shape[1]) < 2.0**100


def local_scores(q: np.ndarray, d: np.ndarray, slices: int) -> list[np.ndarray]:
    return [q[:, s].astype(np.float32) @ d[:, s].astype(np.float32).T for s in sliced(q.shape[1], slices)]


def resolved(q: np.ndarray, d: np.ndarray, qi: np.ndarray, di: np.ndarray) -> np.ndarray:
    """Exact scores of pairs, as longs."""
    out = np.empty(len(qi), np.int64)
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * q.shape[1] < 2**53
    for lo in range(0, len(qi), PAIRS):
        a, b = q[qi[lo : lo + PAIRS]], d[di[lo : lo + PAIRS]]
        if exact:
            out[lo : lo + PAIRS] = np.einsum("ij,ij->i", a, b)
        else:
            out[lo : lo + PAIRS] = [max(LOWEST, min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(v, w)))) for v, w in zip(a.tolist(), b.tolist())]
    return out


def listed(q: np.ndarray, d: np.ndarray, k: int, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1: pairs in the k best (and one more, which may be the query itself) of a local list."""
    if not single(q, d):
        return np.repeat(np.arange(len(q)), len(d)), np.tile(np.arange(len(d)), len(q))
    n = min(k + 1, len(d))
    best = np.concatenate([np.argpartition(-s, n - 1, axis=1)[:, :n] for s in local_scores(q, d, slices)], 1)
    pairs = np.unique(np.repeat(np.arange(len(q)), best.shape[1]) * len(d) + best.ravel())
    return pairs // len(d), pairs % len(d)


def collected(q: np.ndarray, d: np.ndarray, cut: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase 2: pairs that may reach the cutoff; all that do are among them."""
    bound = norms(q, slices) * norms(d, slices).max(0)[None, :]
    open_ = (bound * (slices * (1 + 1e-9)) >= cut[:, None]).any(1) & (bound.sum(1) * (1 + 1e-9) >= cut)
    if not single(q, d):
        rows = np.flatnonzero(open_ | ~np.isfinite(bound).all(1))
        return np.repeat(rows, len(d)), np.tile(np.arange(len(d)), len(rows))
    rows = np.flatnonzero(open_)
    if not len(rows):
        return rows, rows
    margin = bound[rows] * ((q.shape[1] + 8) * 2.0**-22) + 1
    local = local_scores(q[rows], d, slices)
    every = local[0] if slices == 1 else sum(local[1:], local[0])
    low = lambda x: np.nextafter(x.astype(np.float32), np.float32(-np.inf))[:, None]
    hit = every >= low(cut[rows] - margin.sum(1))
    reach = np.zeros_like(hit)
    for j, s in enumerate(local):
        reach |= s >= low(cut[rows] / slices - margin[:, j])
    at, di = np.nonzero(hit & reach)
    return rows[at], di


def _cell(phase: int, k: int, slices: int):
    names = ["query_id", "vec_id", "score"]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in names]
        asked = [(*_unpack(row), np.frombuffer(row["cut"], "<i8")) for row in right.to_pylist()]
        for row in left.to_pylist():
            ids, d = _unpack(row)
            for qids, q, cut in asked:
                q, d = padded(q, d)
                for lo in range(0, len(qids), AT_ONCE):
                    part, own, least = q[lo : lo + AT_ONCE], qids[lo : lo + AT_ONCE], cut[lo : lo + AT_ONCE]
                    qi, di = listed(part, d, k, slices) if phase == 1 else collected(part, d, least, slices)
                    other = own[qi] != ids[di]
                    qi, di = qi[other], di[other]
                    score = resolved(part, d, qi, di)
                    good = score >= least[qi]
                    qi, di, score = qi[good], di[good], score[good]
                    order = np.lexsort((ids[di], ~score, qi))
                    qi, di, score = qi[order], di[order], score[order]
                    top = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
                    for column, x in zip(out, (own[qi], ids[di], score)):
                        column.append(x[top])
        return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in out], names=names)

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, slices: int = SLICES) -> DataFrame:
    """(query_id, rank, vec_id, score) from (id long, vec array<double> of integers) on both sides."""
    found = "query_id long, vec_id long, score long"
    n, nq = candidates.count(), queries.count()
    nd, nqb = max(1, -(-n // ROWS)), max(1, -(-nq // QUERY_ROWS))
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    ordered = candidates.repartitionByRange(nd, norm, F.monotonically_increasing_id()) if nd > 1 else candidates.coalesce(1)
    blocks = stored(ordered.select("id", "vec").mapInArrow(_blocks(slices), f"lead boolean, {BLOB}").withColumn("db", F.monotonically_increasing_id()))
    whole = blocks.filter("not lead").drop("lead")
    # leading rows of so many blocks make a cell
    lead = blocks.filter("lead").drop("lead").withColumn("db", F.pmod(F.xxhash64("db"), F.lit(-(-nd // LEAD_BLOCKS))))
    asked = queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(nqb)).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.lit(nqb - 1)))

    def cells(phase: int, rows: DataFrame, cut: DataFrame) -> DataFrame:
        packed = cut.groupBy("qb").applyInArrow(_query_block, f"qb int, {BLOB}, cut binary")
        right = packed.join(rows.select((F.col("db") + 0).alias("db")).distinct().withColumn("qb", each), "qb")
        return rows.withColumn("qb", each).groupBy("db", "qb").cogroup(right.groupBy("db", "qb")).applyInArrow(_cell(phase, k, slices), found)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    lists = cells(1, lead, asked.withColumn("cut", F.lit(LOWEST).cast("long")))
    cutoff = lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("cut"))
    with_cut = asked.join(stored(cutoff), asked["id"] == F.col("query_id"), "left").select("qb", "id", "vec", F.coalesce("cut", F.lit(LOWEST).cast("long")).alias("cut"))
    return cells(3, whole, with_cut).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_top_k(spark, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = v.filter(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * 1024).cast("double")).alias("vec"))
    queries = rows.filter(F.col("id") % 100 == 0).groupBy("id").agg(F.min("vec").alias("vec"))
    return top_k(rows, queries)


OP8_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
      FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

QUERIES = {"op8_top_k": op8_top_k}
SQL = {"op8_top_k": OP8_SQL}
