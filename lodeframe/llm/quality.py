"""Quality rules by distribution divergence.

Each document's histogram of character classes, and of its language's common words, is compared with a reference of its
language by Jensen-Shannon divergence's square root (the distance, base 2). References are counted over all documents.
A document passes if both distances stay under limits that widen for short texts (LIMIT + SLACK / sqrt(words)).

Every language with LEAST words or more has a reference, whatever its share: a kilobyte or so for each is sent out.

Defined cases: null text counts as empty and fails; without a reference (a null or empty language, or one of fewer words)
only the base rule counts, and distances are null; repeated rows are judged each; an empty table gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table
from .textbatch import LOWER, SPACE, Run, mix, per_text, runs, windows

MIN_WORDS = 50
COMMON = 64
LEAST = 1000
CHAR_LIMIT, WORD_LIMIT = 0.22, 0.42
CHAR_SLACK, WORD_SLACK = 0.6, 1.6

SYMBOLS = b"#*$%&|<>"
#: Character classes of first bytes (continuation bytes count nowhere).
CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "punctuation", "symbol", "accent", "other")
CLASS = np.full(256, CLASSES.index("other"), np.uint8)
for _names, _bytes in (
    ("lower", range(ord("a"), ord("z") + 1)), ("upper", range(ord("A"), ord("Z") + 1)), ("digit", range(ord("0"), ord("9") + 1)),
    ("blank", (0x20, 0x09)), ("line", (0x0A, 0x0B, 0x0C, 0x0D)), ("stop", b".,;:!?"), ("punctuation", b"\"'()-/@[]\\^_`{}~+="), ("symbol", SYMBOLS), ("accent", (0xC3, 0xC4, 0xC5)),
):
    CLASS[list(_bytes)] = CLASSES.index(_names)
CLASS[0x80:0xC0] = len(CLASSES)
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True


def repeats(keys: np.ndarray) -> np.ndarray:
    """How often each key stands in keys."""
    codes, _ = pd.factorize(keys)
    return np.bincount(codes)[codes] if len(codes) else np.zeros(0, np.int64)


def base(run: Run) -> dict[str, np.ndarray]:
    d = run.data
    starts, ends, bounds = run.words()
    zero = run.offsets
    lead = (d & 0xC0) != 0x80
    out = {"n_words": np.diff(bounds), "word_chars": per_text(lead & ~SPACE[d], zero), "n_symbols": per_text(IS_SYMBOL[d], zero)}
    la, lb = np.concatenate([zero[:-1], np.flatnonzero(d == 10) + 1]), np.concatenate([zero[1:], np.flatnonzero(d == 10)])
    la, lb = np.sort(la, kind="stable"), np.sort(lb, kind="stable")
    some = np.concatenate([[0], np.cumsum(~SPACE[d])])
    full = some[lb] > some[la]
    la, lb = la[full], lb[full]
    owner = np.searchsorted(zero, la, "right") - 1
    key = mix(run.hashes(la, lb) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    again = pd.Series(key).duplicated().to_numpy()
    out["n_dup_lines"] = np.bincount(owner[again], minlength=run.n)
    h = run.hashes(starts, ends)
    w, at = windows(h, bounds, 3)
    word_owner = np.repeat(np.arange(run.n), np.diff(bounds))
    twice = at[repeats(mix(w + word_owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) > 1]
    hit = np.zeros(len(h) + 1, bool)
    for i in range(3):
        hit[twice + i] = True
    out["n_repeat_words"] = per_text(hit[:-1], bounds)
    return out


def class_counts(run: Run) -> np.ndarray:
    c = CLASS[run.data].astype(np.int64)
    owner = np.repeat(np.arange(run.n), np.diff(run.offsets))
    k = len(CLASSES) + 1
    return np.bincount(owner * k + c, minlength=run.n * k).reshape(run.n, k)[:, :-1]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, n): lower-cased words' hashes with kind 1, character classes with kind 0."""
    held: list[pd.Series] = []

    def summed():
        s = pd.concat(held).groupby(level=[0, 1, 2]).sum()
        held[:] = [s]
        return s

    for b in batches:
        langs = np.array(["" if x is None else x for x in b["lang"].to_pylist()], object)
        for r in runs(b["text"]):
            names, code = np.unique(langs[r.lo : r.lo + r.n].astype(str), return_inverse=True)
            low = Run(LOWER[r.data], r.offsets)
            starts, ends, bounds = low.words()
            h = low.hashes(starts, ends).view(np.int64)
            words = pd.DataFrame({"l": np.repeat(code, np.diff(bounds)), "h": h}).value_counts(sort=False)
            classes = class_counts(r)
            for i, name in enumerate(names):
                if i in words.index.get_level_values(0):
                    w = words.loc[i]
                    held.append(pd.Series(w.to_numpy(), pd.MultiIndex.from_arrays([[name] * len(w), [1] * len(w), w.index.to_numpy()])))
                c = classes[code == i].sum(0)
                held.append(pd.Series(c, pd.MultiIndex.from_arrays([[name] * len(c), [0] * len(c), range(len(c))])))
            if sum(map(len, held)) > 3_000_000:
                s = summed()
                if len(s) > 2_000_000:
                    yield _rows(s)
                    held.clear()
    if held:
        yield _rows(summed())


def _rows(s: pd.Series) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(s.index.get_level_values(0), pa.string()), pa.array(s.index.get_level_values(1), pa.int32()), pa.array(s.index.get_level_values(2), pa.int64()), pa.array(s.to_numpy(), pa.int64())], names=["lang", "kind", "key", "n"])


class References:
    """Of each language: class shares, common words' hashes (sorted) and their shares, the rest's share last."""

    def __init__(self, rows: list):
        self.of: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for r in rows:
            classes = np.zeros(len(CLASSES))
            for x in r["classes"]:
                classes[x["key"]] = x["n"]
            words = sorted((x["key"], x["n"]) for x in r["words"])
            share = np.array([n for _, n in words], float) / r["total"]
            self.of[r["lang"]] = classes / classes.sum(), np.array([k for k, _ in words], np.int64), np.append(share, max(0.0, 1 - share.sum()))


def references(docs: DataFrame) -> References:
    """Counted over all documents; one row of COMMON words and the classes for each language comes to the driver."""
    n = stored(docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text").filter("lang <> ''").mapInArrow(_count, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))
    langs = n.filter("kind = 1").groupBy("lang").agg(F.sum("n").alias("total")).filter(F.col("total") >= LEAST)
    rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))
    top = n.withColumn("rank", rank).filter(F.col("rank") <= COMMON)
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "n")))
    return References(langs.join(top.groupBy("lang").agg(of(1).alias("words"), of(0).alias("classes")), "lang").collect())


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of p from q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def distances(run: Run, langs: list, refs: References) -> tuple[np.ndarray, np.ndarray]:
    """Character and word distances; NaN without a reference or without words."""
    char, word = np.full(run.n, np.nan), np.full(run.n, np.nan)
    classes = class_counts(run).astype(float)
    shares = classes / np.maximum(classes.sum(1, keepdims=True), 1)
    low = Run(LOWER[run.data], run.offsets)
    starts, ends, bounds = low.words()
    h = low.hashes(starts, ends).view(np.int64)
    owner = np.repeat(np.arange(run.n), np.diff(bounds))
    count = np.maximum(np.diff(bounds), 1)[:, None]
    full = np.diff(bounds) > 0
    declared = np.array(["" if x is None else x for x in langs], object)
    for lang in set(declared.tolist()) & refs.of.keys():
        c, keys, w = refs.of[lang]
        mine = full & (declared == lang)
        at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
        at = np.where(keys[at] == h, at, len(keys)) if len(keys) else np.zeros(len(h), np.int64)
        k = len(keys) + 1
        hist = np.bincount(owner * k + at, minlength=run.n * k).reshape(run.n, k) / count
        char = np.where(mine, distance(shares, c), char)
        word = np.where(mine, distance(hist, w), word)
    return char, word


FIELDS = [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("char_distance", pa.float64()), ("word_distance", pa.float64())]
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def judge(run: Run, langs: list, refs: References) -> dict[str, np.ndarray]:
    out = base(run)
    n = out["n_words"]
    failed = (n < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * n)
    char, word = distances(run, langs, refs)
    root = np.sqrt(np.maximum(n, 1))
    bad = (char > CHAR_LIMIT + CHAR_SLACK / root) | (word > WORD_LIMIT + WORD_SLACK / root)
    return out | {"base_failed": failed, "kept": ~failed & ~bad, "char_distance": char, "word_distance": word}


def quality(docs: DataFrame, refs: References) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(refs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b["lang"].to_pylist()
            for r in runs(b["text"]):
                got = judge(r, langs[r.lo : r.lo + r.n], sent.value)
                cols = [b["doc_id"].slice(r.lo, r.n), *[pa.array(got[c], t, from_pandas=True) for c, t in FIELDS[1:]]]
                yield pa.RecordBatch.from_arrays(cols, names=[c for c, _ in FIELDS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInArrow(run, SCHEMA)


def op2_divergence(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality(docs, references(docs))


QUERIES = {"op2_divergence": op2_divergence}
SQL: dict[str, str] = {}
