"""The training-data operators against brute force, exact round trips and held-out accuracy, with odd rows."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logloom.llm import byte_bpe, caps, chat, exact, langid, minhash, packing, quality, suffix, url_rules

ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "a"), (4, "12 34 !"), (5, "word " * 30_000), (6, "x" * 5000), (7, "Ünï  \n\t çödé 😀"), (8, "x" * 5000)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 0, "clash", 1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, n long")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_bpe_is_tiktoken(spark, odd):
    ranks = byte_bpe.Ranks.read(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    got = byte_bpe.encode(odd).collect()
    assert [r.ids for r in got] == [plain.encode_ordinary(t or "") for _, t in ODD]
    for r, (_, t) in zip(byte_bpe.digests(odd).collect(), ODD):
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    rng, alphabet = random.Random(2), [" ", "  ", "\n", "'s", "a", "é", "1", "\x1c", "\x85", "-", "the", "語"]
    encoder = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 20))) for _ in range(300)]
    assert [np.frombuffer(d, "<u4").tolist() for d in encoder.encode(texts)] == [plain.encode_ordinary(t) for t in texts]


def test_bpe_edits():
    ranks = byte_bpe.Ranks.read(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    text, rng = byte_bpe.EditableText(ranks, "The quick brown fox. " * 20), random.Random(4)
    for _ in range(60):
        a = rng.randint(0, len(text.text))
        fresh = text.replace(a, min(len(text.text), a + rng.randint(0, 4)), rng.choice(["", " ", "xy", "\n", "'s"]))
        assert text.ids() == plain.encode_ordinary(text.text) and fresh < 12
    text.append(" and more")
    assert text.ids() == plain.encode_ordinary(text.text)
    table = byte_bpe.PrefixTable(ranks, b"thisisalongword" * 30)
    assert table.replace(100, 103, b"QQ") < 200
    assert table.ids() == byte_bpe.PrefixTable(ranks, table.data).ids()


def test_language(spark, docs, odd):
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    by_text = dict(zip(ODD, [r.lang_pred for r in langid.predict(odd, langid.train(odd, F.lit(True))).collect()]))
    assert by_text[(1, None)] == by_text[(2, "")] == by_text[(4, "12 34 !")] == "und" and by_text[(3, "a")] == "en"
    assert langid.identify(odd.limit(0)).count() == 0
    clash = odd.select("*", F.lit("keep").alias("score"), F.lit("me").alias("lang_pred"), F.lit(1).alias("__text"))
    kept = langid.filter_known(clash)
    assert kept.columns == clash.columns and {(r.score, r.lang_pred) for r in kept.collect()} == {("keep", "me")}


def test_language_brute_force(spark, docs):
    """Counts and scores by dictionaries of n-grams; texts longer than a block, ties and repeats."""
    import math

    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect() if r.text]
    rows += [(90_001, rows[0][1], rows[0][2]), (90_001, rows[0][1], rows[0][2]), (90_002, "Ab" * 700_000, "en"), (90_003, "1 a", None)]
    bucket = lambda g: int(np.uint64((sum(ord(c) << 21 * (len(g) - 1 - j) for j, c in enumerate(g)) ^ len(g) << 21 * len(g)) % (1 << 64)) * langid._MIX >> langid._SHIFT)
    memo, number = {}, {}

    def counts(text):
        out, low = {}, text.lower()
        for n in langid.ORDERS:
            for i in range(len(low) - n + 1):
                g = low[i : i + n]
                if g not in memo:
                    memo[g] = bucket(g)
                out[memo[g]] = out.get(memo[g], 0) + 1
        return out

    every = [(lang, counts(text)) for _, text, lang in rows]
    sums = {}
    for (lang, own), (_, text, _) in zip(every, rows):
        if lang is not None and langid.has_letter(text):
            total = sums.setdefault(lang, {})
            number[lang] = number.get(lang, 0) + 1
            for k, n in own.items():
                total[k] = total.get(k, 0) + n
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    langs, model = langid.train(frame, F.lit(True))
    assert langs == sorted(sums)
    found = {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.predict(frame, (langs, model)).collect()}
    size = {x: sum(sums[x].values()) + langid.SMOOTHING * langid.BUCKETS for x in langs}
    want = set()
    for (i, text, _), (_, own) in zip(rows, every):
        logs = [math.log(number[x] / sum(number.values())) + sum(n * math.log((sums[x].get(k, 0) + langid.SMOOTHING) / size[x]) for k, n in own.items()) for x in langs]
        top = max(logs)
        want.add((i, langs[logs.index(top)], 1 / sum(math.exp(v - top) for v in logs)))
    assert {x[:2] for x in found} == {x[:2] for x in want}
    score = {x[0]: x[2] for x in found}
    assert all(abs(score[i] - p) < 1e-3 for i, _, p in want)


def test_quotient_filter_merges():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 300, 500, dtype="u8") << np.uint64(40) for _ in range(4)]
    filters = [exact.QuotientFilter.from_bytes(exact.QuotientFilter.of(p).to_bytes()) for p in parts]
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    merged = exact.QuotientFilter.from_bytes(exact.QuotientFilter.merge(filters).to_bytes())
    assert merged.items()[0].tolist() == keys.tolist() and merged.items()[1].tolist() == counts.tolist()
    assert merged.count(int(keys[3])) == counts[3] and merged.count(12345) == 0


def test_exact(spark, odd):
    got = {(r.doc_id, r.text_sha256): r for r in exact.groups(odd).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1, sha("")].keep_id == 2 and not got[1, sha("")].kept and got[2, sha("")].group_size == 2
    assert got[3, sha("a")].group_size == 3 and got[3, sha("a")].kept and not got[None, sha("a")].kept
    assert got[6, sha("x" * 5000)].keep_id == 8
    kept = exact.dedup(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 7, 8]
    assert exact.groups(odd.limit(0)).count() == 0


def test_packing(spark, odd):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    more = [(40 + k, t) for k, t in enumerate(["a <|endoftext|> b", "<|startoftext|>", "İstanbul's ǅ \u2028 x\x1cy", "don't stop" * 900])] + [(None, f"null {k}") for k in range(60)]
    frame = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = packing.pack(frame, group_tokens=20_000).collect()
    want = []
    for i, t in ODD + more:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want += [(i, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()), len(ids)) for s in range(0, len(ids), 4096)]
    order = lambda x: (x[0] is not None, x)
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows), key=order) == sorted(want, key=order)
    assert len({r.sequence_id >> 32 for r in rows if r.doc_id is None}) > 1
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(odd.limit(0)).count() == 0


def test_first_fit_decreasing():
    rng = random.Random(3)
    sizes = [rng.randint(1, 60) for _ in range(300)]
    room, want = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = next((k for k, r in enumerate(room) if r >= sizes[i]), None)
        if b is None:
            room.append(100)
            b = len(room) - 1
        want[i] = (b, 100 - room[b])
        room[b] -= sizes[i]
    assert packing.first_fit_decreasing(sizes, 100) == want


def components(links, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_minhash(spark, docs, odd):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    base = ("one two three four five six seven eight nine ten " * 3 + "eleven twelve").split()
    rows += [(10_000 + k, " ".join(base + [f"w{k}", f"v{k}"])) for k in range(40)]
    sets = {i: minhash.shingles(t, 2) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * (s := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - s)]
    want = components(links, ids)
    got = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in got)
    out = {(r.doc_id, r.n_shingles): r for r in minhash.classes(odd, width=2).collect()}
    assert out[1, 0].kept and out[2, 0].kept and out[3, 1].component_id == 3 and out[8, 1].component_id == 6 and out[None, 1].kept
    assert minhash.classes(odd.limit(0)).count() == 0 and minhash.dedup(odd).columns == odd.columns


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://COM/en/x", "https://a.Example.com/en/7?q", "https://a.example.com/en/71#x", "http://b.net/de/1", "http://x.example.net/de/8", "http://z.org/es/", "http://notcom/en/1", "://h"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in url_rules.judge(pages).collect()}
    assert [got[i].rule for i in range(len(urls))] == [None, None, None, "com/en/", "example.com/en/7", "example.com/en/7", "net/de/", "example.net/de/8", "org/es/", None, None]
    assert got[3].verdict == "block" and got[5].verdict == "allow" and got[7].host == "x.example.net" and got[10].host == "h" and got[0].host == ""
    rows = [("http://spam.example/buy/%d" % i, 1) for i in range(30)] + [("http://good.example/read/%d" % i, 0) for i in range(60)] + [("http://good.example/buy/%d" % i, 0) for i in range(5)]
    host, path = url_rules.split_url(F.col("url"))
    marked = spark.createDataFrame(rows, "url string, bad int").select(url_rules.tokens(host, path).alias("tokens"), "bad")
    assert url_rules.mine(marked).count() > 0
    rules = url_rules.mine(marked, 0.1, 0.9)
    found = {tuple(r["items"]) for r in rules.collect()}
    seen = [(set(r.tokens), r.bad) for r in marked.collect()]
    for items in found:
        hit = [b for t, b in seen if set(items) <= t]
        assert len(hit) >= 9.5 and sum(hit) / len(hit) >= 0.9
    assert ("w:spam",) in found and not any("p:buy" in i and len(i) == 1 for i in found)
    out = url_rules.judge(spark.createDataFrame([(1, "http://spam.example/new"), (2, "http://good.example/new")], "page_id long, url string"), rules)
    assert {r.page_id: r.verdict for r in out.collect()} == {1: "block", 2: "allow"}
    assert url_rules.mine(marked.limit(0)).count() == 0


def brute_repeats(texts, length):
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        hit = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i : i + length] = True
        out.append((len(t), int(hit.sum()), hashlib.sha256(np.frombuffer(t, "u1")[~hit].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize(("group", "levels"), [(1 << 15, 2), (2, 2), (2, 0)])
def test_suffix(spark, docs, group, levels, monkeypatch):
    monkeypatch.setattr(suffix, "GROUP", group)
    monkeypatch.setattr(suffix, "LEVELS", levels)
    rng = random.Random(6)
    passage = "".join(rng.choices("abcdefgh ", k=700))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").limit(80).collect()]
    rows += [(20_000 + k, "".join(rng.choices("klmnop", k=50 + k)) + passage[k : 600 + k] + "é" * 20) for k in range(12)] + [(30_000, "z" * 900), (30_001, None), (30_002, "")]
    got = {r.doc_id: r for r in suffix.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, t), want in zip(rows, brute_repeats([(t or "").encode() for _, t in rows], 400)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == want


def test_maximal_repeats():
    """Three contexts of the anchor "cde": one repeat of all, a longer one of two, each with all occurrences."""
    begin, stop, found = suffix.repeats([1, 1, 1, 2], [b"xabcdefghy", b"zabcdefghw", b"qabcdeq", b"alone"], [3, 3, 3, 0], [1, 1, 1, 1], 5)
    assert list(zip(begin.tolist(), stop.tolist())) == [(1, 9), (1, 9), (1, 6), (-1, -1)]
    assert {(n, p, tuple(sorted(m.tolist()))) for n, p, m in found} == {(8, 2, (0, 1)), (5, 2, (0, 1, 2))}


def test_repeat_groups(spark):
    """All occurrences of a passage of 450 bytes in 500 documents, each in one repeat that spans it."""
    rng = random.Random(16)
    passage, rows = "".join(rng.choices("abcdefgh ", k=450)), []
    for k in range(500):
        rows.append((k, "".join(rng.choices("klmnop", k=rng.randint(0, 500))) + passage + "".join(rng.choices("klmnop", k=rng.randint(0, 500)))))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in suffix.digests(frame).collect()}
    for (i, t), want in zip(rows, brute_repeats([t.encode() for _, t in rows], 400)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == want
    groups = suffix.repeat_groups(frame).collect()
    text, by = dict(rows), {}
    for r in groups:
        by.setdefault(r["repeat"], set()).add((r.doc_id, r.begin, text[r.doc_id].encode()[r.begin : r.begin + r.n_bytes]))
    assert all(len({s for _, _, s in places}) == 1 and len(places) > 1 for places in by.values())
    assert max(len({d for d, _, _ in places}) for places in by.values()) == 500


def test_suffix_odd(spark, odd):
    clash = odd.select("*", F.lit("keep").alias("body"), F.lit("me").alias("doc"), F.lit(1).alias("spans"))
    assert {(r.body, r.doc, r.spans) for r in suffix.dedup(clash).collect()} == {("keep", "me", 1)} and suffix.dedup_passages(clash).columns == clash.columns
    out = suffix.dedup(odd)
    assert out.columns == odd.columns and {5, 6, 8}.isdisjoint({r.doc_id for r in out.collect()})
    assert suffix.digests(odd.limit(0)).count() == 0


def test_caps(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 64))
    rows = [list(map(float, v)) for v in base] + [list(map(float, base[k % 5] + 0.02 * rng.normal(size=64))) for k in range(60)]
    rows += [None, [], [0.0] * 64, [None] + [1.0] * 63, [float("nan")] * 64, [float("inf")] * 64, rows[0], rows[0], [2 * x for x in rows[0]], [1.0, 0.0], [1.0, 0.01]]
    frame = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    good = {i: np.array(v) for i, v in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.95]
    want = components(links, range(len(rows)))
    got = {r.vec_id: r for r in caps.links(frame).collect()}
    for i in range(len(rows)):
        assert got[i].n_links == sum(i in link for link in links) and got[i].component_id == want[i]
    assert caps.links(frame.limit(0)).count() == 0


def test_quality_brute_force():
    """Scores by loops over filters, chunks and bytes."""
    net = quality.Network(3)
    net.offset[0], net.bias[:] = 0.2, np.linspace(-1, 1, quality.FILTERS)
    texts = ["", None, "abc", "x" * 700, "Größe 語 " * 90, "x" * 700]
    got = net.score(texts)
    for text, score in zip(texts, got):
        raw = b"\0" * (quality.WIDTH - quality.STRIDE) + (text or "").encode()
        halves = max(2, -(-(len(raw) + quality.WIDTH) // quality.SPAN))
        raw = raw + b"\0" * (halves * quality.SPAN + quality.WIDTH - len(raw))
        tops = np.full((halves, quality.FILTERS), -np.inf)
        for h in range(halves):
            for k in range(quality.HALF):
                at = h * quality.SPAN + k * quality.STRIDE
                tops[h] = np.maximum(tops[h], sum(net.embed[b] @ net.filters[j] for j, b in enumerate(raw[at : at + quality.WIDTH])))
        act = np.maximum(tops + net.bias, 0)
        chunks = np.maximum(act[:-1], act[1:])
        x = np.concatenate([chunks.mean(0), chunks.max(0)]) @ net.weights + net.offset[0]
        assert abs(score - 1 / (1 + np.exp(-x))) < 1e-4
    assert got[3] == got[5] and got[0] == got[1]


def test_quality_rows(spark, odd):
    """Repeated labels and rows, ties, an empty table, and texts beyond the bytes of the sample."""
    labels = spark.createDataFrame([(3, 0, 0), (3, 1, 0), (3, None, 0), (4, 0, 1), (7, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd.withColumn("score", F.lit("x")), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert len({r.score for r in got if r.doc_id in (6, 8)}) == 1
    assert quality.classify(odd.limit(0), labels).count() == 0
    assert quality.train(odd, labels, F.lit(True), max_bytes=1) is not None


def test_quality(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.85
    net = quality.Network()
    assert all(0 <= s <= 1 for s in net.score([None, "", "x", "y" * 300_000]))
    assert len(quality.classify(odd, labels.limit(0)).collect()) == len(ODD)


def test_chat(spark):
    nasty = ["<|im_end|>", "<\\|im_start|>", "a\\<\\\\|b", "", "\n\n", "<|", "😀"]
    turns = [(r, t) for r in ("user", "assistant", "we\nird<|\\", "") for t in nasty]
    text, spans = chat.format_chat(turns)
    assert chat.read_chat(text) == turns and chat.masked(text, spans) == "".join(nasty)
    layouts = [{"prompt": "p", "response": "r"}, {"messages": [{"role": "user", "content": "p"}, {"role": "assistant", "content": "r"}]}, {"conversations": [{"from": "human", "value": "p"}, {"from": "gpt", "value": "r"}]}, {"instruction": "p", "input": "", "output": "r", "extra": {"a": [1]}}]
    assert all(chat.canonical(x) == [("user", "p"), ("assistant", "r")] for x in layouts)
    with pytest.raises(ValueError):
        chat.canonical({"foo": "bar"})
    for broken in ("x", text[:-3], text.replace("\n", "", 1), "<|im_start|>user\na<|b<|im_end|>\n"):
        with pytest.raises(ValueError):
            chat.read_chat(broken)
    rows = spark.createDataFrame([(1, 2, "assistant", None, 0), (1, 1, None, "x", 0), (1, 1, None, "x", 0), (None, 5, "assistant", "<|y", 0)], "conv_id long, turn long, role string, text string, part int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(rows)).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(b"\nx\n\nx\nassistant\n\n").hexdigest() and got[None].loss_chars == 3
    assert chat.read_back(chat.format_turns(rows.limit(0))).count() == 0


def test_minhash_hot_group(spark):
    """Variants of one text, most of them just too far apart: the components of brute force."""
    import random

    rng = random.Random(3)
    base, rows = [f"w{rng.randrange(400)}" for _ in range(120)], []
    for k in range(200):
        words = list(base)
        for _ in range(rng.choice([2, 4, 6, 8, 9])):
            words[rng.randrange(120)] = f"x{rng.randrange(60)}"
        rows.append((k, " ".join(words)))
    sets, top = [minhash.shingles(text, 2) for _, text in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if 100 * same >= 80 * (len(sets[i]) + len(sets[j]) - same) and top[i] != top[j]:
                low, high = sorted((top[i], top[j]))
                top = [low if x == high else x for x in top]
    found = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(top))


@pytest.mark.parametrize("uneven", [False, True])
def test_caps_planted(spark, uneven):
    """Pairs planted from 0.9501 to 0.98, each far from all others, are all found, whatever coordinates hold the length."""
    rng = np.random.default_rng(8)
    a, noise = rng.normal(size=(1500, 64)), rng.normal(size=(1500, 64))
    scale = np.where(np.arange(64) < 32, 1.0, 0.3) if uneven else np.ones(64)
    a, noise = a * scale, noise * scale
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise -= (noise * a).sum(1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = np.resize([0.9501, 0.96, 0.97, 0.98], 1500)[:, None]
    b = cosine * a + np.sqrt(1 - cosine**2) * noise
    both = np.concatenate([a, b])
    near = both @ both.T >= 0.95
    np.fill_diagonal(near, False)
    assert near.sum() >= 3000
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(both.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in caps.links(frame).collect()}
    assert [got[i] for i in range(3000)] == near.sum(1).tolist()


def test_passages(spark):
    """The pipeline's stage removes planted passages of 51 words, not of 50, and of 400 bytes with few words."""
    import corpus_pipeline

    rng = random.Random(12)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    text = lambda n, k=5: " ".join(word(k) for _ in range(n))
    shared, short, tiny, long_ = text(51), text(50), text(51, 2), word(420)
    assert len(shared) < 400 and len(tiny) < 160
    rows, want = [], []
    for i, passage in enumerate([shared, shared, short, short, tiny, tiny, long_, long_, shared]):
        a, b = text(70 + i), text(40 + i)
        rows.append((i, f"{a}\n{passage}\t{b}"))
        want.append(f"{a}\n\t{b}" if passage != short else rows[-1][1])
    rows += [(9, shared), (10, None), (11, "é " * 30), (12, text(300))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.suffix_array_dedup(spark, docs, "").collect()}
    assert [got[i] for i in range(6)] == want[:6] and got[8] == want[8] and 9 not in got
    assert all(long_ not in got[i] and len(got[i]) <= len(want[i]) + 2 for i in (6, 7)) and got[11] == "é " * 30 and got[12] == rows[12][1]


def brute_passages(texts, words):
    seen, split = {}, [t.split() for t in texts]
    for w in split:
        for i in range(len(w) - words + 1):
            seen[tuple(w[i : i + words])] = seen.get(tuple(w[i : i + words]), 0) + 1
    out = []
    for w in split:
        hit = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - words + 1):
            if seen[tuple(w[i : i + words])] > 1:
                hit[i : i + words] = True
        out.append([x for x, h in zip(w, hit) if not h])
    return out


def test_passages_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").dropDuplicates(["text"])
    dense = [r.doc_id for r in docs.select("doc_id", "text").collect() if not suffix.sparse(np.frombuffer(r.text.encode(), "u1"), 51, 400)]
    docs = docs.where(F.col("doc_id").isin(dense))  # bytes are compared of the others as well
    rows = docs.select("doc_id", "text").collect()
    want = brute_passages([r.text for r in rows], 51)
    got = {r.doc_id: r.text.split() for r in suffix.dedup_passages(docs).collect()}
    assert sum(len(w) for w in want) < sum(len(r.text.split()) for r in rows)
    assert all(got.get(r.doc_id, []) == w for r, w in zip(rows, want))


def test_url_rules_of_four(spark):
    """A combination of four tokens is bad, each three of them are common among good urls: the rules of brute force."""
    from itertools import combinations

    four = ["h:shop.example", "p:buy", "p:now", "d:2"]
    rows = [(four + ["p:x%d" % (i % 3)], 1) for i in range(30)]
    rows += [([t for t in four if t != left] + ["p:x%d" % (i % 3)], 0) for left in four for i in range(40)] + [(["h:bad.example", "w:bad", "d:1"], 1)] * 20
    marked = spark.createDataFrame(rows, "tokens array<string>, bad int")
    every = sorted({t for items, _ in rows for t in items})
    rules = set()
    for size in range(1, len(every) + 1):
        for items in combinations(every, size):
            hit = [b for t, b in rows if set(items) <= set(t)]
            if len(hit) >= 0.05 * len(rows) and sum(hit) >= 0.8 * len(hit) and not any(r < set(items) for r in rules):
                rules.add(frozenset(items))
    got = url_rules.mine(marked, 0.05, 0.8)
    assert {frozenset(r["items"]) for r in got.collect()} == rules and frozenset(four) in rules
    rate, by_lift = sum(b for _, b in rows) / len(rows), set()
    for size in range(1, len(every) + 1):
        for items in combinations(every, size):
            hit = [b for t, b in rows if set(items) <= set(t)]
            if len(hit) >= 0.05 * len(rows) and sum(hit) >= 1.3 * rate * len(hit) and sum(hit) - len(hit) * rate >= 2 * (len(hit) * rate * (1 - rate)) ** 0.5 and not any(r < set(items) for r in by_lift):
                by_lift.add(frozenset(items))
    got = url_rules.mine(marked, 0.05).collect()
    n = {t: sum(t in x for x, _ in rows) for t in every}
    assert {frozenset(r["items"]) for r in got} == by_lift and all(n[r.token] == min(n[t] for t in r["items"]) for r in got)


def test_url_verdicts(spark):
    """The verdicts of the whole sample tables by rules that are matched one by one, null and repeated urls too."""
    pages, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("pages", "labels"))
    rules = url_rules.mine(url_rules.labelled(pages, labels))
    pages = pages.select("page_id", "url").unionByName(spark.createDataFrame([(-k, None) for k in range(1, 9)] + [(-20 - k, "http://ththre.example.net/fr/1") for k in range(5)], "page_id long, url string"))
    host, path = url_rules.split_url(F.col("url"))
    rows = pages.select("page_id", "url", url_rules.tokens(host, path).alias("tokens")).collect()
    known = [(r.rule_id, set(r["items"])) for r in rules.collect()]
    got = {r.page_id: r for r in url_rules.judge(pages, rules).collect()}
    assert known and len(got) == len(rows) and any(r.mined is not None for r in got.values())
    for r in rows:
        fit = [i for i, items in known if items <= set(r.tokens)]
        own = got[r.page_id]
        if own.rule is None:
            assert own.mined == min(fit, default=None) and own.verdict == ("block" if fit else "allow")


def test_chat_layouts(spark):
    """Tables of four layouts, chosen by the fingerprint of their schema, give one result; so do JSON records."""
    own = "<|im_end|><|im_start|>assistant ok"
    flat = spark.createDataFrame([(1, 0, "user", own), (1, 1, "assistant", own), (2, 0, "user", "q"), (2, 1, "assistant", "")], "conv_id long, turn long, role string, text string")
    nested = spark.createDataFrame([(1, [("user", own), ("assistant", own)], 5), (2, [("user", "q"), ("assistant", None)], 6)], "conv_id long, messages array<struct<role:string,content:string>>, other int")
    named = spark.createDataFrame([(1, [("human", own), ("gpt", own)]), (2, [("human", "q"), ("gpt", "")])], "conv_id long, conversations array<struct<from:string,value:string>>")
    pairs = spark.createDataFrame([(1, own, own, ""), (2, "q", None, None)], "conv_id long, prompt string, response string, system string")
    tables = [nested, named, pairs]
    want = sorted(chat.read_back(chat.format_turns(flat)).collect())
    for rows in tables:
        assert sorted(chat.read_back(chat.format_turns(rows)).collect()) == want
        records = chat.format_records(rows.select("conv_id", F.to_json(F.struct(*[c for c in rows.columns if c != "conv_id"])).alias("record")).where("conv_id = 1"), "conv_id").first()
        assert chat.read_chat(records.formatted) == [("user", own), ("assistant", own)] and chat.masked(records.formatted, records.loss) == own
    steps = spark.createDataFrame([(1, "do", "this", "done")], "conv_id long, instruction string, input string, output string")
    assert [r.formatted for r in chat.format_turns(steps).orderBy("part").collect()] == ["<|im_start|>user\ndo\n\nthis<|im_end|>\n", "<|im_start|>assistant\ndone<|im_end|>\n"]
    with pytest.raises(ValueError):
        chat.format_turns(steps.select("conv_id", "input"))


def test_chat_long_text():
    """A turn of 20 million characters takes a small multiple of its size."""
    import tracemalloc

    text = "<|" + "a b\n" * 5_000_000
    tracemalloc.start()
    piece, begin, end = chat.format_turn("assistant", text)
    assert chat.read_chat(piece) == [("assistant", text)] and chat.masked(piece, [(begin, end)]) == text
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6


@pytest.mark.parametrize("dim", [256, 768])
def test_caps_dimensions(dim):
    """Of pairs planted at 0.9501 and more, 0.999 share a filter."""
    rng = np.random.default_rng(dim)
    a, noise = rng.normal(size=(2000, dim)), rng.normal(size=(2000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise -= (noise * a).sum(1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = np.resize([0.9501, 0.96], 2000)[:, None]
    b = cosine * a + np.sqrt(1 - cosine**2) * noise
    found = [len(np.intersect1d(x, y)) > 0 for x, y in zip(caps.decode(a), caps.decode(b))]
    assert np.mean(found) >= 0.999


def test_merge_is_a_sum():
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 7):
        parts = [np.unique(rng.integers(0, 50, rng.integers(0, 40), dtype="u8"), return_counts=True) for _ in range(n)]
        keys, counts = np.unique(np.concatenate([np.repeat(*p) for p in parts]), return_counts=True)
        merged = exact.QuotientFilter.merge([exact.QuotientFilter(k, c, 0, 8) for k, c in parts])
        assert merged.items()[0].tolist() == keys.tolist() and merged.items()[1].tolist() == counts.tolist()


def test_refused_thresholds(spark, docs):
    with pytest.raises(ValueError):
        minhash.classes(docs, percent=50)
    with pytest.raises(ValueError):
        caps.links(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>"), 0.5)
