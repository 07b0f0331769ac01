"""The corpus pipeline as a whole, stage by stage against brute force."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from logloom.llm import langid, minhash, suffix

SF = "/root/testdata/sf0.001"


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


def repeated(texts, length):
    """Of each sequence which places a repeated stretch of ``length`` covers."""
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[tuple(t[i : i + length])] = seen.get(tuple(t[i : i + length]), 0) + 1
    out = []
    for t in texts:
        hit = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[tuple(t[i : i + length])] > 1:
                hit[i : i + length] = True
        out.append(hit)
    return out


def without_passages(text, words, byte_hit):
    raw = text.encode()
    begins, stops = suffix.word_spans(np.frombuffer(raw, dtype="u1"))
    gone = np.zeros(len(raw), dtype=bool) if byte_hit is None else byte_hit.copy()
    edge = np.diff(np.concatenate([[0], words.astype(int), [0]]))
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        gone[begins[a] : stops[b - 1]] = True
    return np.frombuffer(raw, dtype="u1")[~gone].tobytes().decode("utf-8", "ignore")


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"score": F.lit("a"), "lang_pred": F.lit("b"), "body": F.lit("c"), "doc": F.lit("d"), "node": F.lit("e")})
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "suffix_array_dedup", "packing"]
    rows = {r.doc_id: r for r in docs.collect()}

    def step(name, frame):
        out = stages[name](spark, frame, SF)
        assert out.columns == docs.columns
        got = out.collect()
        assert all((r.score, r.lang_pred, r.body, r.doc, r.node) == tuple("abcde") for r in got)
        return spark.createDataFrame(got, docs.schema), {r.doc_id: r.text for r in got}

    frame, text = step("language_id", docs)
    trained = langid.train(docs, F.lit(True))
    found = {i: langid.score([r.text], *trained) for i, r in rows.items()}
    assert set(text) == {i for i, (lang, p) in found.items() if lang[0] != "und" and p[0] >= 0.5}
    keep = {}
    for i, t in text.items():
        keep[t] = max(i, keep.get(t, i))
    frame, text = step("exact_dedup", frame)
    assert set(text) == set(keep.values())
    sets, ids = {i: minhash.shingles(t, 5) for i, t in text.items()}, sorted(text)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * (n := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    roots = components(links, ids)
    frame, text = step("near_dedup", frame)
    assert set(text) == {i for i in ids if roots[i] == i}
    order = sorted(text)
    sparse = [i for i in order if suffix.sparse(np.frombuffer(text[i].encode(), dtype="u1"), 51, 400)]
    by_byte = dict(zip(sparse, repeated([text[i].encode() for i in sparse], 400)))
    by_word = dict(zip(order, repeated([text[i].split() for i in order], 51)))
    want = {i: without_passages(text[i], by_word[i], by_byte.get(i)) for i in order}
    frame, left = step("suffix_array_dedup", frame)
    assert left == {i: t for i, t in want.items() if t} and left != text
    assert {r.doc_id: r.n_chars for r in frame.collect() if left[r.doc_id] != text[r.doc_id]} == {i: len(t) for i, t in left.items() if t != text[i]}
    packed = stages["packing"](spark, frame, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    size = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    assert {r.doc_id: r.doc_tokens for r in packed} == size and sum(r.length for r in packed) == sum(size.values())
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    assert {(r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()} == {(r.doc_id, r.start, r.ids_crc32) for r in packed} and set(plain.columns) < set(docs.columns)
