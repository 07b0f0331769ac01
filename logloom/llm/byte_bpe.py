"""Byte-level BPE by prefix dynamic programming.

For a rank table whose tokens arise by merging, the encoding of each prefix of a byte string ends in
exactly one token, and a sequence of tokens is an encoding if and only if each adjacent pair is one.
``PrefixTable`` keeps that last token for each prefix.  The token that ends at byte ``i`` depends only on
the bytes before ``i`` and the entries before ``i``, hence

* appending bytes leaves all earlier entries as they are, and
* after an edit, entries agree again with the old ones as soon as as many consecutive entries as the
  longest token has bytes are the same.

Texts are first split by the tokenizer's pattern; matches are encoded separately, as tiktoken does.

Nulls count as empty texts; an empty text has no ids.  Repeated rows give repeated results, an empty table
an empty result.  Only ``doc_id`` and ``text`` are read, so further columns never clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Entries that a worker's caches may hold; a full cache is emptied, which costs time and nothing else.
CACHE = 400_000


class Ranks:
    """A rank table, with memoised tests for tokens and pairs of tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._alone: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}

    @classmethod
    def read(cls, path: str) -> Ranks:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def merged(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first: the definition, used for pairs only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def alone(self, token: int) -> bool:
        found = self._alone.get(token)
        if found is None:
            found = self._alone[token] = self.merged(self.tokens[token]) == [token]
        return found

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte."""
        if token not in self._halves:
            data = self.tokens[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                _, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def tested(self, left: int, right: int) -> bool:
        """Would merging their joined bytes give just these two?  Both merge trees are undone, latest merge
        first; a merge across the border that would have come before the one undone next forbids the pair."""
        ranks, tokens, undone = self.ranks, self.tokens, 1 << 62
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and across < undone:
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                undone, left = left, a[1]
            else:  # of equal merges the left one comes first
                undone, right = right + 1, b[0]

    def pair(self, left: int, right: int) -> bool:
        found = self._pairs.get((left, right))
        if found is None:
            if len(self._pairs) > CACHE:
                self._pairs.clear()
            found = self._pairs[left, right] = self.tested(left, right)
        return found

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixTable:
    """The last token of each prefix of one match of the pattern."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", [-1]
        self.append(data)

    def _fill(self, end: int) -> int:
        ranks, data, last = self.ranks, self.data, self.last
        for start in range(max(0, end - ranks.longest), end):
            token = ranks.ranks.get(data[start:end])
            if token is not None and (ranks.pair(last[start], token) if start else ranks.alone(token)):
                return token
        raise ValueError("the rank table does not hold every byte")

    def append(self, data: bytes) -> None:
        begin = len(self.data)
        self.data += data
        for end in range(begin + 1, len(self.data) + 1):
            self.last.append(self._fill(end))

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` in place of bytes start..stop; returns how many entries were worked out anew."""
        old, moved = self.last, len(data) - (stop - start)
        self.data = self.data[:start] + data + self.data[stop:]
        self.last = old[: start + 1]
        same = 0
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._fill(end))
            same = same + 1 if end - moved > stop and old[end - moved] == self.last[-1] else 0
            if same == self.ranks.longest:
                self.last += old[end - moved + 1 :]
                return end - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        whole = self.ranks.ranks.get(self.data)  # tiktoken looks a whole match up first
        if whole is not None:
            return [whole]
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.ranks.tokens[out[-1]])
        return out[::-1]


class Lockstep:
    """The same prefix tables for many short strings at once: entry ``i`` of all of them is filled in one step.

    Tokens that end at a byte are found by walking a trie of the reversed tokens, whose edges sit in an
    open-addressing table.  Tested pairs sit in a direct-mapped table of fixed size; an evicted pair is tested again.
    """

    LONGEST, PAIR_BITS, EDGE_BITS = 48, 21, 20
    _MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        edges: dict[int, int] = {}
        token_at = [-1]
        for token, i in ranks.ranks.items():
            state = 0
            for byte in reversed(token):
                state = edges.setdefault(state << 8 | byte, len(token_at))
                if state == len(token_at):
                    token_at.append(-1)
            token_at[state] = i
        self.token_at = np.array(token_at, dtype="i4")
        while len(edges) * 2 > 1 << self.EDGE_BITS:
            self.EDGE_BITS += 1
        self.edge_key = np.full(1 << self.EDGE_BITS, -1, dtype="i8")
        self.edge_to = np.zeros(1 << self.EDGE_BITS, dtype="i4")
        mask = (1 << self.EDGE_BITS) - 1
        for key, to, slot in zip(edges, edges.values(), self._slots(np.array(list(edges), dtype="i8"), self.EDGE_BITS).tolist()):
            while self.edge_key[slot] >= 0:
                slot = slot + 1 & mask
            self.edge_key[slot], self.edge_to[slot] = key, to
        self.pair_key = np.full(1 << self.PAIR_BITS, -1, dtype="i8")
        self.pair_ok = np.zeros(1 << self.PAIR_BITS, dtype=bool)
        self.width = np.zeros(max(ranks.tokens, default=0) + 1, dtype="i8")
        for i, token in ranks.tokens.items():
            self.width[i] = len(token)

    @classmethod
    def _slots(cls, key: np.ndarray, bits: int) -> np.ndarray:
        return (key.astype("u8") * cls._MIX >> np.uint64(64 - bits)).astype("i8")

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = state.astype("i8") << 8 | byte
        slot, out = self._slots(key, self.EDGE_BITS), np.full(len(key), -1, dtype="i4")
        todo = np.arange(len(key))
        while len(todo):
            found = self.edge_key[slot]
            hit = found == key
            out[todo[hit]] = self.edge_to[slot[hit]]
            go = ~hit & (found >= 0)
            todo, key, slot = todo[go], key[go], slot[go] + 1 & (1 << self.EDGE_BITS) - 1
        return out

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """left -1: nothing stands before."""
        key = (left.astype("i8") + 1) << 32 | right
        slot = self._slots(key, self.PAIR_BITS)
        ok = self.pair_ok[slot]
        unknown = np.flatnonzero(self.pair_key[slot] != key)
        if len(unknown):
            fresh, back = np.unique(key[unknown], return_inverse=True)
            ranks = self.ranks
            value = np.array([ranks.alone(k & 0xFFFFFFFF) if k < 1 << 32 else ranks.tested((k >> 32) - 1, k & 0xFFFFFFFF) for k in fresh.tolist()], dtype=bool)
            to = self._slots(fresh, self.PAIR_BITS)
            self.pair_key[to] = fresh
            self.pair_ok[to] = value
            kept = self.pair_key[to] == fresh  # of two keys for a slot one is kept
            self.pair_ok[to[kept]] = value[kept]
            ok[unknown] = value[back]
        return ok

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        if not pieces:
            return []
        size = np.array([len(p) for p in pieces], dtype="i8")
        order = np.argsort(-size, kind="stable")
        size = size[order]
        n, most = len(size), int(size[0])
        data = np.frombuffer(b"".join(pieces[i].ljust(most, b"\0") for i in order.tolist()), dtype="u1").reshape(n, most)
        last = np.full((most + 1, n), -1, dtype="i4")
        for end in range(1, most + 1):
            live = int(np.searchsorted(-size, -end, side="right"))
            at, state, found = np.arange(live), np.zeros(live, dtype="i4"), []
            for start in range(end - 1, -1, -1):
                state = self._step(state, data[at, start])
                alive = state >= 0
                at, state = at[alive], state[alive]
                if not len(at):
                    break
                token = self.token_at[state]
                own = token >= 0
                found.append((start, at[own], token[own]))
            here = last[end]
            for start, who, token in reversed(found):
                open_ = here[who] < 0
                who, token = who[open_], token[open_]
                ok = self._pairs(last[start][who], token)
                here[who[ok]] = token[ok]
        at, end, back = np.arange(n), size.copy(), []
        while len(at):
            token = last[end[at], at]
            back.append((at, token))
            end[at] -= self.width[token]
            at = at[end[at] > 0]
        who = np.concatenate([x[0] for x in back])
        step = np.concatenate([np.full(len(x[0]), k) for k, x in enumerate(back)])
        ids = np.concatenate([x[1] for x in back])[np.lexsort((-step, who))].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(who, minlength=n)) * 4
        out: list[bytes] = [b""] * n
        begin = 0
        for i, stop in zip(order.tolist(), ends.tolist()):
            out[i] = ids[begin:stop]
            begin = stop
        return out


class Encoder:
    """Texts to ids as little-endian 32-bit integers, with caches of words and of matches of the pattern."""

    #: Where none of these stands, cutting before each space cuts between matches of the pattern.
    _AWKWARD = re.compile(r"\s \s|[\x1c-\x1f\x85]")

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.by_space = pattern == public_tokenizers.PATTERN
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self._many: Lockstep | None = None

    def piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = np.array(PrefixTable(self.ranks, piece.encode("utf-8", "surrogatepass")).ids(), dtype="<u4").tobytes()
        return found

    def _learn(self, pieces: set[str]) -> None:
        """All pieces are in the cache afterwards."""
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        self._many = self._many or Lockstep(self.ranks)
        short: list[tuple[str, bytes]] = []
        for piece in pieces - self.pieces.keys():
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.ranks.get(data)  # tiktoken looks a whole match up first
            if whole is not None:
                self.pieces[piece] = whole.to_bytes(4, "little")
            elif len(data) > Lockstep.LONGEST:
                self.pieces[piece] = self.piece(piece)
            else:
                short.append((piece, data))
        for i in range(0, len(short), 40_000):
            part = short[i : i + 40_000]
            self.pieces.update(zip([p for p, _ in part], self._many.encode([d for _, d in part])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text the ids."""
        cuts = [([" " + w for w in t.split(" ")] if self.by_space and not self._AWKWARD.search(t) else None) if t else [] for t in texts]
        for words, text in zip(cuts, texts):
            if words:
                if text[0] == " ":
                    del words[0]
                else:
                    words[0] = words[0][1:]
        fresh = set().union(*(w for w in cuts if w)) - self.words.keys()
        split = {w: self.split(w) for w in fresh}
        whole = {i: self.split(texts[i]) for i, w in enumerate(cuts) if w is None}
        need = set().union(*split.values(), *whole.values())
        known = need & self.pieces.keys() if len(self.pieces) > CACHE else ()
        kept = {p: self.pieces[p] for p in known}
        self._learn(need)
        self.pieces |= kept
        get = self.pieces.__getitem__
        if len(self.words) > CACHE:
            known = set().union(*(w for w in cuts if w)) & self.words.keys()
            self.words = {w: self.words[w] for w in known}
        for w, parts in split.items():
            self.words[w] = b"".join(map(get, parts))
        word = self.words.__getitem__
        return [b"".join(map(get, whole[i])) if w is None else b"".join(map(word, w)) for i, w in enumerate(cuts)]


class EditableText:
    """A text with its ids, kept exact over appends and edits by re-encoding near them only."""

    def __init__(self, ranks: Ranks, text: str = "", pattern: str = public_tokenizers.PATTERN):
        self._pattern, self._encoder = regex.compile(pattern), Encoder(ranks, pattern)
        self.text, self.starts, self.parts = "", [], []
        self.replace(0, 0, text)

    def append(self, text: str) -> int:
        return self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, stop: int, new: str) -> int:
        """Returns how many matches were encoded anew."""
        moved = len(new) - (stop - start)
        text = self.text[:start] + new + self.text[stop:]
        keep = max(0, int(np.searchsorted(self.starts, start)) - 2)  # one match can look one character ahead
        old = {s + moved: i for i, s in enumerate(self.starts) if s >= stop}
        starts, parts = self.starts[:keep], self.parts[:keep]
        at, fresh, rest = self.starts[keep] if keep < len(self.starts) else 0, 0, None
        for m in self._pattern.finditer(text, at):
            if m.start() in old and m.start() >= start + len(new):
                rest = old[m.start()]
                break
            starts.append(m.start())
            parts.append(self._encoder.piece(m.group()))
            fresh += 1
        if rest is not None:
            starts += [s + moved for s in self.starts[rest:]]
            parts += self.parts[rest:]
        self.text, self.starts, self.parts = text, starts, parts
        return fresh

    def ids(self) -> list[int]:
        return np.frombuffer(b"".join(self.parts), dtype="<u4").tolist()


#: Characters of the texts that one call of the encoder takes, so that its sets stay small.
SLICE = 2_000_000


def mapped(docs: DataFrame, ranks_path: str | None, pattern: str, row: Callable, schema: str) -> DataFrame:
    """``row(ranks, data)`` gives the further columns of each document from its ids as bytes."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks.read(path)
        encoder = Encoder(ranks, pattern)
        for batch in batches:
            for part in slices(batch, SLICE):
                rows = [row(ranks, data) for data in encoder.encode([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), type=t) for c, t in zip(zip(*rows), fields.types[1:]))], schema=fields)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids of every whole text."""
    return mapped(docs, ranks_path, pattern, lambda ranks, data: (np.frombuffer(data, dtype="<u4").astype("i8"),), "doc_id long, ids array<long>")


def digests(docs: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: texts are encoded, the ids decoded, and digests leave the worker."""

    def row(ranks, data):
        ids = np.frombuffer(data, dtype="<u4").tolist()
        return len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(ranks.decode(ids)).hexdigest()

    return mapped(docs, ranks_path, pattern, row, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
