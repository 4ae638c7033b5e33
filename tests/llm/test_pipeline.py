import collections
import re

import corpus_pipeline
from lodeframe.llm import secrets

from .test_operators import ROWS, SCHEMA, bag, sf  # noqa: F401


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def stage(spark, name, rows, d):
    return dict(corpus_pipeline.STAGES)[name](spark, docs(spark, rows), d)


def test_stages_keep_columns_and_bear_no_rows(spark, sf):  # noqa: F811
    for name, _ in corpus_pipeline.STAGES:
        out = stage(spark, name, [], sf)
        assert out.count() == 0
        assert name == "pack" or out.columns == docs(spark, []).columns


def test_toxic_documents_go(spark, sf):  # noqa: F811
    got = stage(spark, "toxicity", ROWS, sf).collect()
    assert bag(map(tuple, got)) == bag(x for x in ROWS if "nasty" not in (x[1] or ""))


def test_one_of_each_group_stays(spark, sf):  # noqa: F811
    got = stage(spark, "near_duplicates", ROWS, sf).collect()
    by = {r.doc_id for r in got}
    assert len(got) == len(by) and {None, 0, 5} <= by
    texts = collections.Counter(re.sub(r"\s+", " ", (r.text or "").lower()).strip() for r in got)
    assert all(n == 1 for t, n in texts.items() if t)
    assert {x[0] for x in ROWS if not (x[1] or "").strip()} <= by


def test_secrets_are_replaced(spark, sf):  # noqa: F811
    got = stage(spark, "secrets", ROWS, sf).collect()
    want = []
    for x in ROWS:
        t = x[1]
        if t is not None and (spans := secrets.scan(t, secrets.network())[1]):
            t = secrets.redact(t, spans)
            x = (x[0], t, *x[2:4], len(t), *x[5:])
        want.append(x)
    assert bag(map(tuple, got)) == bag(want) and any("<SECRET>" in (r.text or "") for r in got)


def test_the_mix_is_what_the_operator_takes(spark, sf):  # noqa: F811
    from lodeframe.llm import mixing

    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = collections.Counter()
    for r in stage(spark, "mix", ROWS, sf).collect():
        got[r.source] += words(r.text)
    sized = docs(spark, ROWS).select(mixing.source_key().alias("skey"), mixing.word_count("text").alias("size"))
    for r in mixing.targets(sized).collect():
        assert abs(got[None if r.skey == "1" else r.skey[1:]] - r.target) <= 1


def test_cut_documents_keep_their_lines(spark):
    from lodeframe.llm.mixing import first_words
    from pyspark.sql import functions as F

    texts = [" one\n two\tthree  \n", "a b", "x\n\ny\r\nz é w", "long " * 5000]
    rows = [(t, n) for t in texts for n in range(1, min(len(t.split()), 6))] + [(texts[3], 4999)]
    for r in spark.createDataFrame(rows, "t string, n long").withColumn("got", first_words(F.col("t"), F.col("n"))).collect():
        assert r.t.startswith(r.got) and len(re.findall(r"[^\x20\x09-\x0D]+", r.got)) == r.n and r.got == r.got.rstrip(" \t\n\v\f\r")


def test_whole_pipeline(spark, sf):  # noqa: F811
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and all(1 <= r.length <= 1024 for r in rows)


def test_rows_without_id_are_judged_by_their_own_text(spark, sf):  # noqa: F811
    near = lambda i: " ".join([f"w{j}" for j in range(60)] + [f"end{i}"])
    row = lambda i, t: (i, t, None, "s", None, None, None, None, None, None, None)
    got = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in stage(spark, "near_duplicates", rows, sf).collect())
    want = lambda *rows: sorted((i is None, i or 0, t or "") for i, t in rows)
    one, other = row(1, near(1)), row(None, near(2))
    assert got([one, other]) == want((1, near(1)))
    assert got([one, other, row(None, "something else that nobody copied at all")]) == want((1, near(1)), (None, "something else that nobody copied at all"))
    two = got([row(None, near(1)), row(None, near(2))])
    assert len(two) == 1
    # unlike texts of one id both stay, a near copy under the same id goes; rows alike in id and text are one
    assert got([row(4, near(1)), row(4, "quite another text than the first one is"), row(4, "quite another text than the first one is")]) == want((4, near(1)), (4, "quite another text than the first one is"))
    assert len(got([row(4, near(1)), row(4, near(2))])) == 1
    assert got([row(None, None), row(None, ""), row(2, " ")]) == want((None, None), (None, ""), (2, " "))
    assert got([row(None, near(3))] * 5 + [row(None, "")] * 3) == want((None, near(3)), (None, ""), (None, ""), (None, ""))


HELD = """
import ctypes, random, re
import pyarrow as pa
from lodeframe.llm import packing

class Docs:
    def select(self, *columns):
        return self
    def mapInArrow(self, work, schema):
        return work

r = random.Random(5)
words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(60_000)]
texts = [" ".join(r.choices(words, k=200)) for _ in range(6000)]
batches = (pa.record_batch([pa.array(range(i, i + 2000)), pa.array(texts[i : i + 2000])], names=["doc_id", "text"]) for i in range(0, 6000, 2000))
packing.F.col = lambda name: packing.F  # no session here
packing.F.cast = packing.F.alias = lambda *a: packing.F
assert sum(b.num_rows for b in packing.pieces(Docs())(batches)) >= 6000
held = lambda: sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
before = held()
pa.default_memory_pool().release_unused()
ctypes.CDLL("libc.so.6").malloc_trim(0)
print(before - held())
"""


def test_a_worker_that_has_cut_pieces_holds_no_free_memory():
    import subprocess
    import sys

    import pytest

    if not sys.platform.startswith("linux"):
        pytest.skip("reads /proc")
    got = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True, timeout=120)
    assert float(got.stdout.split()[-1]) < 25


def test_packing_starts_no_second_set_of_python_workers(spark, sf):  # noqa: F811
    from lodeframe.llm import packing

    out = stage(spark, "pack", ROWS, sf)
    assert "ExistingRDD" not in out._jdf.queryExecution().toString()  # rows that Python made are read by workers of their own
    cut = packing.stored(packing.pieces(docs(spark, ROWS)))
    got = packing.place(cut).collect()
    assert bag((r.doc_id, r.piece, r.length) for r in got) == bag((r.doc_id, r.piece, r.length) for r in cut.collect())
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_a_function_that_has_ended_leaves_no_table_of_powers():
    import pyarrow as pa
    from lodeframe.llm import textbatch

    def work(batches):
        for b in batches:
            for r in textbatch.runs(b["text"]):
                r.hashes(*r.words()[:2])
            assert textbatch._powers
            yield b

    assert len(list(textbatch.lean(work)(iter([pa.record_batch([pa.array(["a b c", None])], names=["text"])])))) == 1
    assert not textbatch._powers


def test_cutting_pieces_takes_little_memory_at_a_time():
    import random
    import tracemalloc

    import pyarrow as pa
    from lodeframe.llm import packing

    r = random.Random(7)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(3000)]
    texts = [" ".join(r.choices(words, k=200)) for _ in range(2500)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    work = packing._pieces(packing.tokenizer_path(), packing.SIZE, packing.END_ID)
    tracemalloc.start()
    got = sum(b.num_rows for b in work(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got >= len(texts) and peak < 25e6
