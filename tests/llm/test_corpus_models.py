"""Context-tree weighting, periodic runs and importance resampling against brute force, with odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.llm import ctw, periodic, resample

ODD = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "a A\x0bb"), (4, " \t 12 34 !"), (5, "word " * 3000), (6, "x" * 5000), (7, "Ünï  \n\t çödé 😀"), (10, "p q r " * 40 + "z"), (20, "the end " * 9)]
COLUMNS = "doc_id long, text string, n long, key string, row string, chunk string, train string, at string, place string, `a.b` int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 7, "k", "r", "c", "t", "a", "p", 1) for i, t in ODD], COLUMNS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


# -- runs


def plain_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        a = 0
        while a + q < len(words):
            if words[a] != words[a + q]:
                a += 1
                continue
            b = a
            while b + q < len(words) and words[b] == words[b + q]:
                b += 1
            if b + q - a >= max(least, 2 * q):
                found.setdefault((a, b + q - a), q)
            a = b + 1
    return sorted((a, q, n) for (a, n), q in found.items())


def plain_digest(doc_id, text, plant=True):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    drop = {i for a, q, n in runs for i in range(a + q, a + n)}
    best = min(((-n, a, q) for a, q, n in runs), default=None)
    head = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *head, sha("".join(f"{a},{n},{q}\n" for a, q, n in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=0, max_size=60) | st.text(alphabet="abcd", min_size=1, max_size=5).map(lambda s: s * 9), min_size=1, max_size=4), st.integers(2, 14))
def test_runs_of_small_alphabets(texts, least):
    words = [[c.encode() for c in t] for t in texts]
    for w, (a, n, p) in zip(words, periodic._found(words, least)):
        assert sorted(zip(a.tolist(), p.tolist(), n.tolist())) == plain_runs(w, least)


def test_runs_within_copies():
    rng = random.Random(5)
    inner = [b"%d" % rng.randint(0, 9) for _ in range(40)] + [b"x", b"y"] * 9 + [b"%d" % rng.randint(0, 9) for _ in range(40)]
    texts = [inner * 3 + [b"q"] + inner, inner, [b"z", *inner[20:90]], []]
    for w, (a, n, p) in zip(texts, periodic._found(texts, 12)):
        assert sorted(zip(a.tolist(), p.tolist(), n.tolist())) == plain_runs(w)


def test_longest_previous_factors():
    rng = random.Random(7)
    ids = np.array([rng.randint(0, 2) for _ in range(80)] + [3])
    longest, source = periodic.previous_factors(periodic.Ranks(ids))
    seq = ids.tolist()
    for i in range(len(seq)):
        common = [next((k for k in range(len(seq) - i) if seq[i + k] != seq[j + k]), len(seq) - i) for j in range(i)]
        assert longest[i] == max(common, default=0)
        assert not longest[i] or common[source[i]] == longest[i]


def test_run_digests(spark, docs, odd):
    for rows, data in ((odd, ODD), (docs, docs.select("doc_id", "text").collect())):
        got = periodic.digests(rows, prepare=periodic.planted).collect()
        want = [plain_digest(i, t) for i, t in data]
        assert Counter(map(tuple, got)) == Counter(want)
    assert periodic.digests(odd.limit(0)).count() == 0


def test_collapse_keeps_columns(spark, odd):
    got = periodic.collapse(odd)
    assert got.columns == odd.columns and got.schema["text"].dataType == odd.schema["text"].dataType
    by = {(r.doc_id, r.n): r.text for r in got.collect()}
    assert by[(10, 7)] == "p q r z" and by[(5, 7)] == "word" and by[(20, 7)] == "the end" and by[(1, 7)] is None and by[(4, 7)] == " \t 12 34 !"
    runs = {tuple(r) for r in periodic.runs(odd).collect()}
    assert runs == {(i, a, n, q) for i, t in ODD for a, q, n in plain_runs((t or "").encode().split())}


# -- context trees


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class PlainTree:
    """The weighted context tree as it is defined, by recursion."""

    def __init__(self, texts):
        self.n = defaultdict(lambda: [0, 0])
        self.kids = defaultdict(set)
        for t in texts:
            for context, node, bit in self.decisions(t):
                for d in range(ctw.DEPTH + 1):
                    self.n[context[:d], node][bit] += 1
                    if d:
                        self.kids[context[: d - 1], node].add(context[:d])
        self.memo = {}

    @staticmethod
    def decisions(text):
        for i, byte in enumerate(text):
            context = bytes((b"\n" * ctw.DEPTH + text)[i : i + ctw.DEPTH][::-1])
            for j in range(8):
                yield context, (256 | byte) >> (8 - j), byte >> (7 - j) & 1

    def log(self, context, node):
        if (context, node) not in self.memo:
            own = kt(*self.n[context, node])
            if len(context) < ctw.DEPTH:
                below = sum(self.log(c, node) for c in self.kids[context, node])
                own, both = own, np.logaddexp(own, below)
                self.memo[context, node] = (both - math.log(2), math.exp(own - both))
            else:
                self.memo[context, node] = (own, 1.0)
        return self.memo[context, node][0]

    def one(self, context, node, d=0):
        n0, n1 = self.n[context[:d], node] if (context[:d], node) in self.n else (0, 0)
        own = (n1 + 0.5) / (n0 + n1 + 1)
        if d == ctw.DEPTH or (context[: d + 1], node) not in self.n:
            return own
        self.log(context[:d], node)
        weight = self.memo[context[:d], node][1]
        return weight * own + (1 - weight) * self.one(context, node, d + 1)

    def score(self, text):
        return sum(math.log10(p if bit else 1 - p) for p, bit in ((self.one(c, n), b) for c, n, b in self.decisions(text)))


def plain_words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def check_scores(got, data):
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in data]
    words = [plain_words(t) for _, t in data]
    tree = PlainTree([b" ".join([*w, b"\n"]) for w, h in zip(words, held) if not h])
    count = Counter(x for w, h in zip(words, held) if not h for x in (*w, None))
    total, below = sum(count.values()), math.log10(sum(count.values()) + 0.1 * (len(count) + 1))
    want = defaultdict(list)
    for (i, t), h, w in zip(data, held, words):
        want[i].append((h, len(w) + 1, sum(count[x] > 0 for x in (*w, None)), total, sum(math.log10(count[x] + 0.1) - below for x in (*w, None)), tree.score(b" ".join([*w, b"\n"]))))
    assert len(got) == len(data)
    for i in want:
        mine = sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got if r.doc_id == i)
        for a, b in zip(mine, sorted(want[i]), strict=True):
            assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-5)


def test_scores_are_the_tree_s(spark, docs, odd):
    short = [(i, t) for i, t in ODD if i != 5] + [(i, f"held {i} a b c") for i in range(40)]
    rows = spark.createDataFrame([(i, t, "clash", "x") for i, t in short], "doc_id long, text string, chunk string, train string")
    check_scores(ctw.score(rows, ctw.is_tenth()).collect(), short)
    some = docs.where(F.length("text") < 900).limit(60).select("doc_id", "text")
    check_scores(ctw.score(some, ctw.is_tenth()).collect(), [tuple(r) for r in some.collect()])
    assert ctw.score(rows.limit(0)).count() == 0
    alone = ctw.score(rows.where("doc_id = 6"), F.lit(True)).first()
    assert alone.score == pytest.approx(-8 * alone.n_bytes * math.log10(2)) and alone.base_score == 0 and alone.n_known == 0


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(1)
    gram = np.unique(ctw.grams([bytes(rng.integers(97, 100, 400).astype("u1")), b"abc" * 30]))
    n = rng.integers(1, 9, len(gram))
    sums, up = ctw._subtree_sums(gram, n)
    top = ctw.crown(up, *sums)
    for context in (gram[5] >> np.uint64(8), *(np.uint64(int.from_bytes(c[: ctw.DEPTH], "big")) for c in (b"abcabca", b"zzzabca", b"aaa\1\2\3\4"))):
        every = context << np.uint64(8) | np.arange(256, dtype="u8")
        both, m = ctw._added([gram, every], [n, np.zeros(256, dtype="i8")])
        p = 10 ** ctw.probabilities(both, m, top)[np.searchsorted(both, every)]
        assert p.sum() == pytest.approx(1, abs=1e-9)


def test_model_beats_words(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = ctw.score(rows, ctw.is_tenth()).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.avg((F.col("score") > F.col("base_score")).cast("int"))).first()
    assert got[0] > got[1] and got[2] > 0.6  # both are negative


# -- resampling


def plain_features(text, width, size):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(c if ord(c) > 127 or c.isdigit() and ord(c) < 128 or "a" <= c <= "z" else " " for c in words).encode().split(b" ")
    words = [w for w in words if w]
    return len(words), [zlib.crc32(b" ".join(words[i : i + k])) % size for k in range(1, width + 1) for i in range(len(words) - k + 1)]


def plain_draw(data, target, width=1, size=10_000, percent=10, least=20):
    own = [plain_features(t, width, size) for _, t in data]
    s = Counter(b for _, f in own for b in f)
    t = Counter(b for text in target for b in plain_features(text, width, size)[1])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for (i, _), (n, f) in zip(data, own):
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + size) / ((s[b] + 1) * (T + size)))) for b in f)
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("width, percent", [(1, 10), (3, 40), (2, 100)])
def test_draw_is_brute_force(spark, docs, odd, width, percent):
    target = spark.createDataFrame([("the word of a b c",), (None,), ("Ünï x",)], "text string")
    more = [(i, f"{i} " + " ".join(f"w{i * j % 17}" for j in range(15 + i % 9))) for i in range(100, 160)]
    data = ODD + more + [(200, "equal words " * 12), (201, "equal words " * 12), (None, "equal words " * 12)]
    rows = spark.createDataFrame([(i, t, 1, "c") for i, t in data], "doc_id long, text string, n_words int, row string")
    want = plain_draw(data, [r.text for r in target.collect()], width, percent=percent)
    assert Counter(map(tuple, resample.scored(rows, target, width, percent=percent).collect())) == want
    drawn = resample.resample(rows, target, width, percent=percent)
    assert drawn.columns == rows.columns
    assert Counter(r.doc_id for r in drawn.collect()) == Counter(r[0] for r in want.elements() if r[4])


def test_draw_of_documents(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    data = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, resample.scored(docs, bench).collect())) == plain_draw(data, [r.text for r in bench.collect()])
    assert resample.scored(docs.limit(0), bench).count() == 0 and resample.resample(docs.limit(0), bench).count() == 0
