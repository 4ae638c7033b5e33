"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade <= k) = sigmoid(cut_k - w.x): one weight vector for all of the ordered thresholds. x holds a 1 for each selected
word or stem that the text has often enough; they are selected by how far their document shares differ between the classes.
Severity grades are the labels' own: 0 if not toxic, 1 if toxic, 2 if toxic and of low quality. The output is the expected
grade; a text is toxic if P(grade >= 1) reaches a limit. Two thirds of the labelled rows fit the model; the last third,
which it hasn't seen, sets the limit: where the share of toxic rows found, less FALSE times that of others, is largest.

The model is fitted on at most LABELLED rows of each class, taken by a hash of the id. Every text is scored whole.
Defined cases: null text is empty; labels that are null or have no document are left out; without labels of both classes
nothing is toxic; a null quality counts as not low; repeated rows are scored each; an empty table gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table
from .textbatch import LOWER, Run, lean, mix, runs

LABELLED = 1500
FEATURES = 512
#: A feature stands in at least so many of the labelled rows.
SEEN = 3
#: A feature's separation (difference of document shares in standard errors) is at least so much of the best one's:
#: words of a few copied documents separate a little, and would be learnt as if they meant something.
RELATIVE = 0.2
#: And it stands in so many times the share of toxic rows: words that tell languages apart are no sign of anything.
TIMES = 3
#: Bytes of the stems that count as features beside whole words, and numbers of words.
STEMS = (4, 5, 6, 7, 8, 9)
LEVELS = (1, 3)
L2 = 1e-3
STEPS, RATE = 400, 0.05
#: The logarithm of the widest way between the thresholds, which no toxic row of grade 2 would bound.
WIDEST = 4.0
#: The limit where the last third lacks a class, and the price of a false alarm.
LEAST, FALSE = 0.5, 2.0
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(0x80, 0x100)]] = True


def features_of(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, one for each word that has the feature.

    Features of a lower-cased word (a run of letters and digits, so that stops don't hide it): itself, and its first 4 to
    9 bytes, each once for LEVELS[0] words or more, again for LEVELS[1] or more: stems count with whatever follows them.
    """
    low = Run(LOWER[run.data], run.offsets)
    starts, ends = low.spans(~LETTER[low.data])
    owner = np.searchsorted(low.offsets, starts, "right") - 1
    keys, own = [low.hashes(starts, ends)], [owner]
    for k in STEMS:
        longer = ends - starts > k
        keys.append(mix(low.hashes(starts[longer], starts[longer] + k) + np.uint64(k)))
        own.append(owner[longer])
    return np.concatenate(own), np.concatenate(keys)


def leveled(own: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs at each level."""
    order = np.lexsort((keys, own))
    own, keys = own[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (keys[1:] != keys[:-1])])) if len(own) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(own)))
    parts = [(own[first[n >= least]], keys[first[n >= least]] + np.uint64(i)) for i, least in enumerate(LEVELS)]
    return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])


def by_text(run: Run) -> list[np.ndarray]:
    """Of each text the distinct features."""
    own, keys = leveled(*features_of(run))
    order = np.argsort(own, kind="stable")
    return np.split(keys[order], np.cumsum(np.bincount(own, minlength=run.n))[:-1])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        grades = b["grade"].to_numpy()
        for r in runs(b["text"]):
            rows = by_text(r)
            keys = np.concatenate([*rows, np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(grades[r.lo : r.lo + r.n], [len(x) for x in rows])), pa.array(keys.view(np.int64))], names=["grade", "key"])


def _places(keys: np.ndarray):
    """Of each row the places in keys of the features that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in runs(b["text"]):
                rows = [np.flatnonzero(np.isin(keys, h)).astype("<u2").tobytes() for h in by_text(r)]
                yield pa.RecordBatch.from_arrays([*[b[c].slice(r.lo, r.n) for c in ("doc_id", "grade", "last")], pa.array(rows, pa.binary())], names=["doc_id", "grade", "last", "at"])

    return run


class Model:
    def __init__(self, keys: np.ndarray, weights: np.ndarray, cuts: np.ndarray, least: float = LEAST):
        self.keys, self.weights, self.cuts, self.least = keys, weights, cuts, least
        self.bare = np.unique(np.concatenate([keys - np.uint64(i) for i in range(len(LEVELS))])) if len(keys) else keys
        self.low = np.zeros(1 << 16, bool)
        self.low[(self.bare & np.uint64(0xFFFF)).astype(np.int64)] = True

    def score(self, run: Run) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and P(grade >= 1)."""
        z = np.zeros(run.n)
        if len(self.keys):
            own, h = features_of(run)
            maybe = self.low[(h & np.uint64(0xFFFF)).astype(np.int64)]  # few features: most words end here
            own, h = own[maybe], h[maybe]
            at = np.minimum(np.searchsorted(self.bare, h), len(self.bare) - 1)
            hit = self.bare[at] == h
            own, h = leveled(own[hit], h[hit])
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            own, at = own[hit], at[hit]
            np.add.at(z, own, self.weights[at])
        return self.grades(z)

    def grades(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        above = 1 / (1 + np.exp(np.clip(self.cuts[None, :] - z[:, None], -60, 60)))
        return above.sum(1), above[:, 0]


NOTHING = Model(np.zeros(0, np.uint64), np.zeros(0), np.array([30.0, 31.0]))


def selected(rows: DataFrame) -> np.ndarray:
    """Features that mark toxic rows, in order, from (grade, text): counted where the rows are, FEATURES of them collected."""
    n = rows.agg(F.sum((F.col("grade") > 0).cast("int")).alias("toxic"), F.sum((F.col("grade") == 0).cast("int")).alias("other")).first()
    if not n["toxic"] or not n["other"]:
        return np.zeros(0, np.uint64)
    toxic, other = float(n["toxic"]), float(n["other"])
    counts = rows.mapInArrow(lean(_features), "grade int, key long").groupBy("key").agg(F.sum((F.col("grade") > 0).cast("int")).alias("pos"), F.sum((F.col("grade") == 0).cast("int")).alias("neg"))
    p, q = F.col("pos") / toxic, F.col("neg") / other
    some = counts.filter(F.col("pos") + F.col("neg") >= SEEN).filter(p > TIMES * (q + 0.5 / (toxic + other)))
    gap = (p - q) / F.sqrt((p + 1 / toxic) / toxic + q / other)
    best = some.select("key", gap.alias("gap")).orderBy(F.desc("gap"), "key").limit(FEATURES).collect()
    return np.sort(np.array([r["key"] for r in best if r["gap"] > RELATIVE * best[0]["gap"]], np.int64).view(np.uint64))


def weighted(grade: np.ndarray) -> np.ndarray:
    """Toxic rows and the others count half each, however many there are."""
    y = grade > 0
    return np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum()))


def loss(w: np.ndarray, cuts: np.ndarray, own: np.ndarray, col: np.ndarray, grade: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The weighted negative log-likelihood with its penalty, and its gradient by weights and by cuts. own and col: the
    rows and features that meet."""
    z = np.bincount(own, weights=w[col], minlength=len(grade))
    below = 1 / (1 + np.exp(-np.clip(cuts[:, None] - z, -60, 60)))  # P(grade <= k)
    edge, slope = np.zeros((len(cuts) + 2, len(z))), np.zeros((len(cuts) + 2, len(z)))
    edge[1:-1], edge[-1], slope[1:-1] = below, 1, below * (1 - below)
    rows = np.arange(len(z))
    prob = np.maximum(edge[grade + 1, rows] - edge[grade, rows], 1e-12)
    weight = weighted(grade) / prob
    by_z = (slope[grade + 1, rows] - slope[grade, rows]) * weight
    by_cuts = [-(slope[k + 1] * weight)[grade == k].sum() + (slope[k + 1] * weight)[grade == k + 1].sum() for k in range(len(cuts))]
    value = -(np.log(prob) * weighted(grade)).sum() + L2 / 2 * (w @ w)
    return float(value), np.bincount(col, weights=by_z[own], minlength=len(w)) + L2 * w, np.array(by_cuts)


def fit(keys: np.ndarray, rows: list[tuple[np.ndarray, int]]) -> Model:
    """rows: (places in keys of a row's features, grade 0 to 2)."""
    grade = np.array([g for _, g in rows], np.int64)
    if not len(keys) or not (grade > 0).any() or (grade > 0).all():
        return NOTHING
    own, col = np.repeat(np.arange(len(rows)), [len(h) for h, _ in rows]), np.concatenate([h for h, _ in rows])
    x = np.zeros(len(keys) + 2)  # weights, the first cut, the logarithm of the way to the second
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        gap = np.exp(min(x[-1], WIDEST))
        _, by_w, by_cuts = loss(x[:-2], np.array([x[-2], x[-2] + gap]), own, col, grade)
        g = np.concatenate([by_w, [by_cuts.sum(), by_cuts[1] * gap]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(keys, x[:-2], np.array([x[-2], x[-2] + np.exp(min(x[-1], WIDEST))]))


def limit(p: np.ndarray, toxic: np.ndarray) -> float:
    """The P(grade >= 1) from which a text is toxic: the middle of those that do best."""
    if not toxic.any() or toxic.all():
        return LEAST
    grid = np.linspace(0.02, 0.98, 97)
    gain = np.array([(p[toxic] >= t).mean() - FALSE * (p[~toxic] >= t).mean() for t in grid])
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(grid[best[len(best) // 2]])


def model(docs: DataFrame, labels: DataFrame) -> Model:
    """Fitted on at most LABELLED labelled documents of each class."""
    low = F.max(F.when(F.col("quality") == 0, 1).otherwise(0)) if "quality" in labels.columns else F.lit(0)
    good = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"), low.alias("low"))
    good = good.select("doc_id", "toxic", F.when(F.col("toxic") == 1, F.col("low") + 1).otherwise(0).cast("int").alias("grade"))
    order = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]
    some = good.filter("toxic = 1").orderBy(*order).limit(LABELLED).union(good.filter("toxic = 0").orderBy(*order).limit(LABELLED))
    some = some.select("doc_id", "grade", (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 2).alias("last"))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id").select("doc_id", "grade", "last", "text")
    joined = stored(joined.dropDuplicates(["doc_id"]))
    keys = selected(joined.filter("not last").select("grade", "text"))
    if not len(keys):
        return NOTHING
    got = joined.mapInArrow(lean(_places(keys)), "doc_id long, grade int, last boolean, at binary").orderBy("doc_id").collect()  # 2 * LABELLED rows of FEATURES places at most
    rows = [(np.frombuffer(r["at"], "<u2").astype(np.int64), r["grade"], r["last"]) for r in got]
    m = fit(keys, [r[:2] for r in rows if not r[2]])
    seen = [r for r in rows if r[2]]
    if m is not NOTHING and seen:
        p = m.grades(np.array([m.weights[at].sum() for at, _, _ in seen]))[1]
        m.least = limit(p, np.array([g > 0 for _, g, _ in seen]))
    return m


def scored(docs: DataFrame, m: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in runs(b["text"]):
                severity, above = m.score(r)
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(r.lo, r.n), pa.array(severity), pa.array(np.rint(severity).astype(np.int32)), pa.array(above >= m.least)], names=["doc_id", "severity", "grade", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, severity double, grade int, toxic boolean")


def keep_clean(docs: DataFrame, m: Model) -> DataFrame:
    """docs, all columns, without the toxic ones: rows are filtered in place, no join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = [m.score(r)[1] >= m.least for r in runs(b["text"])]
            yield b.filter(pa.array(~np.concatenate(bad))) if bad else b

    return docs.mapInArrow(lean(run), docs.schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, model(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op10_toxicity": op10_toxicity}
SQL: dict[str, str] = {}
