"""Packing: first-fit decreasing with a tournament tree, in randomised groups of documents.

Each text is tokenized whole (null: empty) and closed by one more id.  A document longer than a sequence is cut
into full pieces and a rest.  Documents fall into random groups (a hash of a seed and of the row's place in the written
pieces, so that rows of one doc_id or of none are spread as well) of about ``group_tokens`` tokens; in a group, pieces go in
falling order of length each into the first sequence that has room, which the tournament tree over the sequences' room
finds in logarithmic time.  Equal lengths go in the order of doc_id, start, checksum and row.

Ids are those of the tokenizer as it is loaded, so a special token's text becomes its id.  Sequence ids are
``group << 32 | number in the group``.  Repeated rows are packed each; a null doc_id is one
value like others; an empty table gives no pieces.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, cut, group_bounds, slices

SEQUENCE, CLOSING = 4096, 2
CACHE = 300_000


class Tournament:
    """Room of bins in a complete binary tree whose inner nodes hold the larger child's room."""

    def __init__(self, size: int, room: int):
        self.leaves = 1
        while self.leaves < max(1, size):
            self.leaves *= 2
        self.room = [room] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """The first bin with room for ``length``, and what was used in it before; takes the room."""
        room = self.room
        if room[1] < length:
            raise ValueError("no bin has room")
        at = 1
        while at < self.leaves:
            at *= 2
            if room[at] < length:
                at += 1
        bin_, left = at - self.leaves, room[at]
        room[at] = left - length
        while at > 1:
            at //= 2
            most = room[2 * at] if room[2 * at] >= room[2 * at + 1] else room[2 * at + 1]
            if room[at] == most:
                break
            room[at] = most
        return bin_, left


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item."""
    tree, out = Tournament(len(lengths), capacity), [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        bin_, left = tree.place(lengths[i])
        out[i] = (bin_, capacity - left)
    return out


class WordEncoder:
    """Texts to ids through a cache of words: the tokenizer drops white space and never merges across it."""

    #: What str.split() and the tokenizer's pattern may see differently.
    _AWKWARD = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\xa0 ᠎ -‏ -  -⁯　﻿]|<\|")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        # a word of letters is one match of the tokenizer's pattern, and its last token says that it ends there
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str], together: int = 500) -> list[bytes]:
        """Words of letters only, many of them in one text."""
        out = []
        groups = [words[i : i + together] for i in range(0, len(words), together)]
        for group, data in zip(groups, self._plain([" ".join(g) for g in groups])):
            stops = 4 * (np.flatnonzero(self.closes[np.frombuffer(data, dtype="<u4")]) + 1)
            if len(stops) != len(group):
                out += self._plain(group)
                continue
            begin = 0
            for stop in stops.tolist():
                out.append(data[begin:stop])
                begin = stop
        return out

    #: Letters whose lower case is the tokenizer's own, before or after it composes characters.
    _PLAIN = re.compile(r"[^\x00-\u012f\u0131-\u024f]")
    #: A run of these after a letter or digit is a match of the tokenizer's pattern of its own.
    _TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of different words, of which the cache learns those that it lacks."""
        if len(self.words) > CACHE:
            self.words = {w: self.words[w] for w in self.words.keys() & set(words)}
        parts: dict[str, tuple[str, ...]] = {}
        for word in words:
            if word not in self.words:
                head = word.rstrip(self._TAIL)
                parts[word] = (head, word[len(head) :]) if head and head != word and head[-1].isalnum() and not self._PLAIN.search(head[-1]) else (word,)
        fresh = {p for own in parts.values() for p in own if p not in self.words}
        letters = [w for w in fresh if w.isalpha() and (w.isascii() or not self._PLAIN.search(w))]
        self.words.update(zip(letters, self._letters(letters)))
        rest = list(fresh.difference(letters))
        self.words.update(zip(rest, self._plain(rest)))
        for word, own in parts.items():
            if len(own) > 1:
                self.words[word] = self.words[own[0]] + self.words[own[1]]
        return [self.words[w] for w in words]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        use, low = [], []
        for i, t in enumerate(texts):
            if self._AWKWARD.search(t):
                out[i] = self._plain([t])[0]
            else:
                use.append(i)
                low.append(t.lower() if t.isascii() or not self._PLAIN.search(t) else t)
        if not use:
            return out
        # words become numbers; each different word is looked up once, and the ids are put together by places
        lists = pc.ascii_split_whitespace(pa.array(low, pa.string()))
        coded = lists.values.dictionary_encode()
        known, number = self._known(coded.dictionary.to_pylist()), coded.indices.to_numpy()
        size = np.array([len(k) // 4 for k in known], dtype="i8")
        n = size[number]
        stops = np.append(0, np.cumsum(n))
        begin = (np.cumsum(size) - size)[number]
        ids = np.frombuffer(b"".join(known), dtype="<u4")[np.repeat(begin - stops[:-1], n) + np.arange(stops[-1])].tobytes()
        bounds = (4 * stops[lists.offsets.to_numpy()]).tolist()
        for i, a, b in zip(use, bounds[:-1], bounds[1:]):
            out[i] = ids[a:b]
        return out


def pieces(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, closing: int = CLOSING) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece, before packing, and row, another number for each document."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    end = int(closing).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = WordEncoder(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, 4_000_000):
                rows = []
                for i, data in enumerate(encoder.encode([t or "" for t in part.column(1).to_pylist()])):
                    data += end
                    n = len(data) // 4
                    rows += [(i, s, min(sequence, n - s), zlib.crc32(data[4 * s : 4 * (s + sequence)]), n, row + i) for s in range(0, n, sequence)]
                cols = [np.array(c, dtype="i8") for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(cols[0])), *map(pa.array, cols[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])
                row += part.num_rows

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long")


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, closing: int = CLOSING, group_tokens: int = 512 * SEQUENCE, seed: int = 5) -> DataFrame:
    """Each piece with its sequence_id and offset."""
    cutted = cut(pieces(docs, path, sequence, closing), "pieces")
    total = cutted.agg(F.sum("length")).first()[0] or 0
    n = max(1, -(-total // group_tokens))
    grouped = cutted.withColumn("__group", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in by_group(batches, ["__group"], 20_000):
            group, length = whole.column("__group").to_numpy(), whole.column("length").to_numpy()
            ids, offsets = np.empty(len(group), dtype="i8"), np.empty(len(group), dtype="i8")
            bounds = group_bounds(group)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                for i, (bin_, offset) in enumerate(first_fit_decreasing(length[a:b].tolist(), sequence), a):
                    ids[i], offsets[i] = int(group[a]) << 32 | bin_, offset
            out = whole.select(names).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))
            yield from out.to_batches()

    ordered = grouped.repartition("__group").sortWithinPartitions("__group", F.desc("length"), "doc_id", "start", "ids_crc32", "row")
    return ordered.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
