"""Secret scans: fixed patterns, and a character convolutional network over every candidate in its context.

Base findings come from patterns. What they leave of a run of token characters is a candidate if it has 16 or more: the
network (numpy) reads windows of INSIDE characters that overlap and cover all of it, each with the BEFORE characters before
it and the AFTER characters that follow, embeds them, convolves, takes the maximum of each filter over place, and gives a
logit; a candidate has the largest of its windows'.

It is trained on labelled findings of two origins: a seeded generator's (keys of many shapes in assignments, URLs, headers;
and words, hosts, paths, identifiers, numbers that are none), and the corpus' own base findings in the text that they stand
in (at most REAL of them, the first by a hash of the document; their surroundings also take in generated findings of both
labels). So the training set has a bounded size whatever the corpus. For each shape of candidate (SHAPES) a scale and a
shift fitted on held-out labelled findings turn logits into probabilities, and the threshold is the largest probability
that keeps RECALL of that shape's held-out secrets; a shape without any is never a finding.

Defined cases: null text is empty and has no findings; repeated rows are scanned each; an empty table gives no rows. Texts
are scanned whole; offsets are code points, ends exclusive.
"""

import hashlib
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .textbatch import lean

KINDS = ("assign", "access", "hex", "network")
#: Fixed patterns of the base findings, and the least length of what they must find.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(rb"[0-9a-f]{32,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api")
SHORTEST = 16
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_.=-]{16,}")
LETTER, DIGIT = re.compile(rb"[A-Za-z]"), re.compile(rb"[0-9]")

BEFORE, INSIDE, AFTER = 20, 44, 12
#: Places of windows in a long candidate: so far apart that half a window or more of any part lies in one.
STEP = INSIDE // 2
RECALL = 0.97
#: Labelled findings: of the generator, to train and to calibrate; of the corpus, at most.
TRAINED, CALIBRATED, REAL = 3000, 1800, 600
#: Shapes of candidates, each with its own calibration: letters and digits, letters without digits, no letters.
SHAPES = ("mixed", "letters", "bare")
#: Characters of a corpus finding that are learnt from; its windows take so many from anywhere else.
LONGEST = 200
#: Windows that are read in one pass, and texts' findings in one batch, about.
AT_ONCE = 4096
FILTERS, WIDTH, EMBED, HIDDEN = 32, 5, 10, 24
#: Characters by class for the embedding: each ASCII one its own code, all others one code, 0 beyond the text.
CODES = 129


def narrow(text: str) -> bytes:
    """One byte a code point; what isn't ASCII becomes a byte that no pattern has."""
    return text.encode("ascii", "replace") if not text.isascii() else text.encode("ascii")


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end), leftmost and non-overlapping for each kind."""
    out = []
    low = raw.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(raw)]
    return sorted(out)


def shape(raw: bytes) -> int:
    """The place in SHAPES."""
    return 2 if not LETTER.search(raw) else 0 if DIGIT.search(raw) else 1


def pieces(raw: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What base findings leave of each run, if it is as long as a candidate. base is in order."""
    out, i, reach = [], 0, 0
    for a, b in (m.span() for m in CANDIDATE.finditer(raw)):
        at = max(a, min(reach, b))
        while i < len(base) and base[i][0] < b:
            start, _, end = base[i]
            if start - at >= SHORTEST:
                out.append((at, start))
            at, reach, i = max(at, min(end, b)), max(reach, end), i + 1
        if b - at >= SHORTEST:
            out.append((at, b))
    return out


def windows(a: int, b: int) -> list[tuple[int, int]]:
    """Windows that cover the run from a to b, the last one up to its end."""
    last = max(a, b - INSIDE)
    return [(x, min(b, x + INSIDE)) for x in [*range(a, last, STEP), last]]


def encode(raw: bytes, spans: list[tuple[int, int]]) -> np.ndarray:
    x = np.zeros((len(spans), BEFORE + INSIDE + AFTER), np.uint8)
    for i, (a, b) in enumerate(spans):
        b = min(b, a + INSIDE)
        for at, part in ((BEFORE - min(a, BEFORE), raw[max(0, a - BEFORE) : a]), (BEFORE, raw[a:b]), (BEFORE + INSIDE, raw[b : b + AFTER])):
            x[i, at : at + len(part)] = np.minimum(np.frombuffer(part, np.uint8), 127) + 1
    return x


def probabilities(texts: list[bytes], runs: list[list[tuple[int, int]]], net: "Network") -> list[np.ndarray]:
    """Of each text's runs the probability of the window that is likeliest; so many windows at a time, of all texts
    together, that a long run takes little memory."""
    flat = [(t, a, b) for t, mine in enumerate(runs) for a, b in mine]
    best = np.full(len(flat), -np.inf)
    held: list[tuple[int, np.ndarray]] = []

    def read() -> None:
        if held:
            at, x = np.concatenate([np.full(len(x), i) for i, x in held]), np.concatenate([x for _, x in held])
            np.maximum.at(best, at, net.logits(x))
            held.clear()

    n = 0
    for i, (t, a, b) in enumerate(flat):
        w = windows(a, b)
        for lo in range(0, len(w), AT_ONCE):
            held.append((i, encode(texts[t], w[lo : lo + AT_ONCE])))
            n += len(held[-1][1])
            if n >= AT_ONCE:
                read()
                n = 0
    read()
    p = net.calibrated(best, np.array([shape(texts[t][a:b]) for t, a, b in flat], np.int64))
    return np.split(p, np.cumsum([len(x) for x in runs])[:-1])


class Network:
    """Embedding, one convolution, maxima over what is before, the window and what follows, two dense layers."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        n = lambda *s: (r.standard_normal(s) * np.sqrt(2 / s[0])).astype(np.float32)
        self.p = [(r.standard_normal((CODES, EMBED)) * 0.5).astype(np.float32), n(WIDTH * EMBED, FILTERS), np.zeros(FILTERS, np.float32), n(3 * FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32), n(HIDDEN, 1), np.zeros(1, np.float32)]
        self.scale, self.shift, self.threshold = np.ones(len(SHAPES)), np.zeros(len(SHAPES)), np.full(len(SHAPES), 2.0)

    def forward(self, x: np.ndarray) -> tuple:
        e, w, b, w1, b1, w2, b2 = self.p
        v = e[x]
        n, length, _ = v.shape
        cols = np.concatenate([v[:, i : length - WIDTH + 1 + i] for i in range(WIDTH)], 2)
        c = cols @ w + b
        edge = (0, BEFORE - WIDTH // 2, BEFORE + INSIDE - WIDTH // 2, c.shape[1])
        parts = [c[:, lo:hi] for lo, hi in zip(edge, edge[1:])]
        at = [p.argmax(1) for p in parts]
        pooled = np.concatenate([np.take_along_axis(p, a[:, None], 1)[:, 0] for p, a in zip(parts, at)], 1)
        h0 = np.maximum(pooled, 0)
        h1 = np.maximum(h0 @ w1 + b1, 0)
        return (h1 @ w2 + b2)[:, 0], (cols, at, edge, pooled, h0, h1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 512])[0] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0, np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 4e-3, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        m, v, step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for lo in range(0, len(x), batch):
                i = order[lo : lo + batch]
                z, (cols, at, edge, pooled, h0, h1) = self.forward(x[i])
                e, w, b, w1, b1, w2, b2 = self.p
                dz = ((1 / (1 + np.exp(-z)) - y[i]) / len(i)).astype(np.float32)[:, None]
                d1 = (dz @ w2.T) * (h1 > 0)
                d0 = (d1 @ w1.T) * (pooled > 0)
                dw, db, de = np.zeros_like(w), d0.reshape(-1, 3, FILTERS).sum((0, 1)), np.zeros_like(e)
                rows = np.arange(len(i))[:, None]
                for k in range(3):
                    place = at[k] + edge[k]
                    g = d0[:, k * FILTERS : (k + 1) * FILTERS]
                    seen = cols[rows, place]  # n, filters, width * embed
                    dw += np.einsum("nf,nfc->cf", g, seen)
                    back = (g[:, :, None] * w.T[None]).reshape(len(i), FILTERS, WIDTH, EMBED)
                    for t in range(WIDTH):
                        np.add.at(de, x[i][rows, place + t], back[:, :, t])
                grads = [de, dw, db, h0.T @ d1, d1.sum(0), h1.T @ dz, dz.sum(0)]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def calibrated(self, z: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[shapes] * z + self.shift[shapes], -50, 50)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, shapes: np.ndarray) -> None:
        """Scale, shift and threshold of each shape that has secrets, from held-out findings."""
        z = self.logits(x).astype(np.float64)
        for k in range(len(SHAPES)):
            mine, secret = z[shapes == k], y[shapes == k]
            if not secret.any():
                continue
            scale, shift = 1.0, 0.0
            for _ in range(2000):
                g = 1 / (1 + np.exp(-np.clip(scale * mine + shift, -50, 50))) - secret
                scale, shift = scale - 0.05 * float((g * mine).mean()), shift - 0.05 * float(g.mean())
            self.scale[k], self.shift[k] = scale, shift
            p = np.sort(self.calibrated(mine[secret == 1], np.full(int(secret.sum()), k)))
            self.threshold[k] = p[int(np.floor((1 - RECALL) * len(p)))]


SYLLABLES = "the and ing tion re on er an st de la en ch ein lich que ment eau ado cion user data file page item index main test build v1 api web node core".split()


def labelled(n: int, seed: int, real: list[tuple[str, str, str]] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n labelled findings, half of them secrets: windows, labels, shapes. real: a corpus' own findings with the text before
    and after; a finding of each label in three stands in such a place, a secret in six is such a finding itself."""
    r = random.Random(seed)
    numbers, domains = ["", "1", "7", "12", "42"], ["com", "org", "net", "io"]
    alnum, b64, up = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits
    word = lambda k=3: "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, k)))
    some = lambda chars, lo, hi: "".join(r.choice(chars) for _ in range(r.randint(lo, hi)))
    keys = [
        lambda: some(alnum, 20, 48), lambda: some(b64, 24, 60) + r.choice(["", "=", "=="]), lambda: some("0123456789abcdef", 24, 31), lambda: some("0123456789ABCDEF", 32, 48), lambda: "ghp_" + some(alnum, 30, 36), lambda: "xoxb-" + some(string.digits, 10, 12) + "-" + some(alnum, 20, 24), lambda: r.choice(["sk_live_", "pk_test_", "rk-"]) + some(alnum, 20, 32),
        lambda: some(string.ascii_letters, 20, 32), lambda: "AIza" + some(alnum + "-_", 33, 35), lambda: "eyJ" + some(alnum, 20, 30) + "." + some(alnum + "-_", 20, 40), lambda: some(up, 18, 24), lambda: some(alnum + "-_", 22, 43),
    ]
    lead = [lambda: f"{word()} key = \"", lambda: f"{word()}: ", lambda: "Authorization: Bearer ", lambda: f"https://{word()}.com/?sig=", lambda: f"{word()} {word()} ", lambda: f"export {word().upper()}=", lambda: f"\"{word()}\": \"", lambda: "credential "]
    plain = [
        lambda: word(6) + str(r.randint(0, 99)) + word(6), lambda: f"{word()}{r.choice(numbers)}.{word(2)}.{r.choice(domains)}", lambda: f"www{r.randint(1, 9)}.{word()}.com/{word()}/{word()}", lambda: f"{word()}/{word()}/{word()}_{r.randint(1, 99)}.html", lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}", lambda: f"{word()}-{word()}-{word()}-{r.randint(1, 999)}",
        lambda: f"{word()}_{word()}_{word()}{r.randint(1, 9)}", lambda: f"section{r.randint(1, 99)}.{word()}.{word()}", lambda: "a1" + "=" * r.randint(14, 30), lambda: "x" * r.randint(10, 20) + "1" * r.randint(6, 12), lambda: "-" * r.randint(12, 30) + "v2", lambda: f"{word(2)}.{r.randint(10, 99)}.{word(2)}.{r.randint(10, 99)}.{word(3)}", lambda: word(5) + "." + word(5) + str(r.randint(10, 99)), lambda: "".join(str(r.randint(0, 9)) for _ in range(16)) + r.choice("abcdefgh"),
    ]
    plain += [lambda: "".join(word() for _ in range(r.randint(4, 9))), lambda: "".join(word() for _ in range(r.randint(4, 9))).upper() + r.choice(["", "."]), lambda: "-".join(word() for _ in range(r.randint(3, 9))), lambda: r.choice(".-=_/+") * r.randint(16, 60), lambda: "/".join(word().capitalize() for _ in range(r.randint(3, 9))), lambda: r.choice("abcxyzHA") * r.randint(16, 40), lambda: "".join(r.choice(string.digits) for _ in range(r.randint(16, 30)))]
    around = [lambda: f"{word()} {word()}.", lambda: f"{word()} {word()} ", lambda: f"{word()}@", lambda: f"https://", lambda: f"{word()}\n", lambda: f"{word()}, {word()} | "]  # noqa: F541
    ends = [" ", " ", "\n", ", ", "\" ", "\n\n", ".  "]
    xs, ys, kinds = [], [], []
    while len(xs) < n:
        secret = len(xs) % 2
        body = r.choice(keys if secret else plain)()
        head = "".join(word() + r.choice("/._-/") for _ in range(r.randint(1, 24))) if r.random() < 0.35 else ""
        tail = r.choice("/._") + word() if r.random() < 0.1 else ""
        before = r.choice(lead if secret or r.random() < 0.3 else around)()
        left, right = f"{word()} {word()} {before}", f"{r.choice(ends)}{word()} {word()}"
        if real and r.random() < 1 / 3:
            left, found, right = r.choice(real)
            if secret and r.random() < 0.5 and len(found) >= SHORTEST:
                body, head, tail = found, "", ""
        raw = f"{left}{head}{body}{tail}{right}".encode("ascii")
        a = len(left) + len(head)
        base = base_spans(raw)
        if secret and any(x < a + len(body) and a < y for x, _, y in base):
            continue  # patterns find it
        # of a secret's windows the one that has most of it, of others any; a secret that no piece holds is an empty one
        held = [w for x, y in pieces(raw, base) if x < a + len(body) and a < y for w in windows(x, y)]
        if held or secret:
            most = max(held, key=lambda w: min(w[1], a + len(body)) - max(w[0], a), default=(0, 0)) if secret else r.choice(held)
            xs.append(encode(raw, [most])[0] if held else np.zeros(BEFORE + INSIDE + AFTER, np.uint8))
            ys.append(secret)
            kinds.append(shape(raw[most[0] : most[1]]) if held else shape(body.encode()))
    return np.array(xs), np.array(ys, np.float32), np.array(kinds, np.int64)


def surroundings(raw: bytes, base: list[tuple[int, int, int]]) -> list[tuple[str, str, str]]:
    """Values of base findings (of those that overlap, the longest) with what stands before and after all that overlap. The
    pattern's own keyword is left out, so that the network learns from the value and its neighbourhood. base is in order."""
    out, i = [], 0
    while i < len(base):
        start, reach, j = base[i][0], base[i][2], i
        while j < len(base) and base[j][0] < reach:
            reach, j = max(reach, base[j][2]), j + 1
        first, kind, end = max(base[i:j], key=lambda s: s[2] - s[0])
        a = ASSIGN.match(raw, first).start(2) if kind == 0 else first
        out.append(tuple(x.decode("ascii") for x in (raw[max(0, start - BEFORE) : start], raw[a:end][:LONGEST], raw[reach : reach + AFTER])))
        i = j
    return out


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for t in b["text"]:
            raw = narrow(t.as_py() or "")
            if found := surroundings(raw, base_spans(raw))[:1]:
                rows.append((hashlib.md5(raw).hexdigest(), *found[0]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["h", "l", "f", "r"])


def findings_of(docs: DataFrame) -> list[tuple[str, str, str]]:
    """At most REAL of the corpus' own findings, one a text, by a hash of the text."""
    got = docs.select("text").mapInArrow(lean(_surroundings), "h string, l string, f string, r string").distinct().orderBy("h").limit(REAL).collect()
    return [(x["l"], x["f"], x["r"]) for x in got]


@lru_cache(4)
def trained(real: tuple[tuple[str, str, str], ...]) -> Network:
    net = Network()
    x, y, _ = labelled(TRAINED, 11, real)
    net.train(x, y)
    net.calibrate(*labelled(CALIBRATED, 12, real))
    return net


def network(docs: DataFrame | None = None) -> Network:
    """Trained on the generator's findings, and those of docs: the same weights each time."""
    return trained(tuple(findings_of(docs)) if docs is not None else ())


Spans = list[tuple[int, int, int]]


def scan_all(texts: list[str | None], net: Network) -> list[tuple[Spans, Spans, list[float]]]:
    """Of each text the base findings, all findings, as (start, kind, end), and the probabilities of the network's."""
    raws = [narrow(t or "") for t in texts]
    base = [base_spans(raw) for raw in raws]
    more = [pieces(raw, b) for raw, b in zip(raws, base)]
    out = []
    for raw, b, runs, p in zip(raws, base, more, probabilities(raws, more, net)):
        hit = [(x, y, float(v)) for (x, y), v in zip(runs, p) if v >= net.threshold[shape(raw[x:y])]]
        out.append((b, sorted(b + [(x, 3, y) for x, y, _ in hit]), [v for _, _, v in hit]))
    return out


def scan(text: str | None, net: Network) -> tuple[Spans, Spans]:
    """Base findings, and all findings, of one text."""
    return scan_all([text], net)[0][:2]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "<SECRET>") -> str:
    out, at = [], 0
    for a, _, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, probabilities string"


def findings(docs: DataFrame, net: Network) -> DataFrame:
    """The contract's columns, and the probabilities of the network's spans in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = scan_all(b["text"].to_pylist(), net)
            cols = [b["doc_id"], *[pa.array([sum(s[1] == k for s in base) for base, _, _ in rows], pa.int64()) for k in range(3)]]
            cols += [pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _, _ in rows], pa.string()), pa.array([joined(every) for _, every, _ in rows], pa.string())]
            cols.append(pa.array([",".join(f"{v:.4f}" for v in p) for _, _, p in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), SCHEMA)


def redacted(docs: DataFrame, net: Network) -> DataFrame:
    """docs, all columns, each finding in text replaced; n_chars follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b["text"]]
            new = [t if t is None else redact(t, every) for t, (_, every, _) in zip(texts, scan_all(texts, net))]
            cols = {c: b[c] for c in b.schema.names}
            cols["text"] = pa.array(new, b.schema.field("text").type)
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([n if x == y else len(y) for n, x, y in zip(b["n_chars"].to_pylist(), texts, new)], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(lean(run), docs.schema)


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return findings(docs, network(docs))


QUERIES = {"op1_secrets": op1_secrets}
SQL: dict[str, str] = {}
