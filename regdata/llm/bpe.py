"""Byte-level BPE over a given table of ranks.

A text is cut by the pattern of the vocabulary, and each piece becomes ids by two tiers:

1. a minimal perfect hash answers for pieces that are tokens as they stand. It is a
   displacement table: a key's bucket names a seed, and key and seed name the one slot, so a
   look-up for many pieces is a few array operations and one comparison of bytes each;
2. other pieces are merged from single bytes: neighbours sit in a linked list and their
   ranks in a heap, so a piece of n bytes takes n log n steps.

Results are kept per worker in a table of bounded size. Vocabulary and
hash are built once on the driver from a file of fixed size and broadcast.

Defined results: a null text is an empty one, with no ids; null ids decode to no bytes;
an id outside the vocabulary is an error. Repeated rows are encoded alike, other columns
pass through, and a column that has the name of an output is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from regdata.llm.arrow import add_columns, column, list_array, lists, text_of

MEMO = 100_000  # answers kept per worker and table, up to twice: some 80 MB for both tables
# Fixed value: the published pattern in which a space joins the letters, digits or signs after it.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
JOINED = regex.compile(r" (?=\s|$)").search  # a space that does not stand alone before other text
LOAD = 4  # keys per bucket of the hash
TRIES = 64  # seeds tried in one step while the hash is built


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: ``keys[slot]`` for every slot is one key."""

    def __init__(self, keys: list[bytes]):
        n = self.size = len(keys)
        self.buckets = max(1, n // LOAD)
        hashes = self.digest(keys)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.cumsum(np.bincount(bucket, minlength=self.buckets))[:-1])
        free = np.ones(n, dtype=bool)
        self.seed = np.zeros(self.buckets, dtype=np.int64)
        slots = np.zeros(n, dtype=np.int64)
        singles = []
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            members = groups[b]
            if len(members) < 2:
                singles += [b] * len(members)
                continue
            seed = 1
            while True:  # many seeds at once: late buckets find few free slots
                tried = self.place(hashes[members][:, None], np.arange(seed, seed + TRIES)[None, :])
                good = free[tried].all(axis=0)
                if len(members) > 2:
                    good &= (np.diff(np.sort(tried, axis=0), axis=0) > 0).all(axis=0)
                else:
                    good &= tried[0] != tried[1]
                if good.any():
                    seed += int(good.argmax())
                    at = tried[:, (seed - 1) % TRIES]
                    break
                seed += TRIES
            self.seed[b], slots[members], free[at] = seed, at, False
        for b, at in zip(singles, np.flatnonzero(free).tolist()):  # a lone key takes a named slot
            self.seed[b], slots[groups[b]] = -1 - at, at
        self.keys = [b""] * n
        for i, at in enumerate(slots.tolist()):
            self.keys[at] = keys[i]

    @staticmethod
    def digest(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))

    def place(self, hashes: np.ndarray, seed) -> np.ndarray:
        h = (hashes ^ (np.asarray(seed).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((h >> np.uint64(32)) % np.uint64(self.size)).astype(np.int64)

    def find(self, keys: list[bytes]) -> list[int]:
        """Slot of each key, -1 if it is none of the keys."""
        hashes = self.digest(keys)
        seed = self.seed[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        at = np.where(seed < 0, -1 - seed, self.place(hashes, seed)).tolist()
        return [s if self.keys[s] == k else -1 for s, k in zip(at, keys)]


def merge(piece: bytes, ranks: dict[bytes, int], pairs: list[int | None]) -> list[int]:
    """Merge the bytes of a piece, lowest rank first, then leftmost.

    A heap entry packs rank, first byte and end of two neighbouring parts into one number.
    ``pairs`` has the ranks of two bytes, by their 16-bit number.
    """
    n = len(piece)
    bits = n.bit_length()
    low, get = (1 << bits) - 1, ranks.get
    before, end = list(range(-1, n)), list(range(1, n + 1))  # end[i] of the part that begins at i; 0 once merged away
    heap = [(r << bits | i) << bits | i + 2 for i, (a, b) in enumerate(zip(piece, piece[1:])) if (r := pairs[a << 8 | b]) is not None]
    heapq.heapify(heap)
    while heap:
        entry = heapq.heappop(heap)
        stop, i = entry & low, entry >> bits & low
        j = end[i]
        if not 0 < j < n or end[j] != stop:
            continue  # one of the parts has changed since
        end[i], end[j], before[stop] = stop, 0, i
        if stop < n and (r := get(piece[i : end[stop]])) is not None:
            heapq.heappush(heap, (r << bits | i) << bits | end[stop])
        if (h := before[i]) >= 0 and (r := get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r << bits | h) << bits | stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Memory:
    """Answers of a function of many keys, the latest ``MEMO`` to twice as many of them."""

    def __init__(self, answer):
        self.answer, self.fresh, self.old = answer, {}, {}

    def learn(self, keys: set[str]) -> dict[str, bytes]:
        """A table that has all the keys."""
        missing = [k for k in keys if k not in self.fresh]
        if missing:
            if len(self.fresh) + len(missing) > MEMO:
                self.old, self.fresh, missing = self.fresh, {}, list(keys)
            lost = [k for k in missing if k not in self.old]
            self.fresh |= {k: self.old[k] for k in missing if k in self.old}
            self.fresh |= zip(lost, self.answer(lost))
        return self.fresh


class Codec:
    """A vocabulary with its pattern, its perfect hash and the memory of merged pieces."""

    def __init__(self, lines: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.pattern = pattern
        self.splits = pattern == SPACED
        self.hash = PerfectHash(list(self.ranks))
        self.slot_ids = [int(self.ranks[k]).to_bytes(4, "little") for k in self.hash.keys]
        self.tokens = {i: k for k, i in self.ranks.items()}
        self.pairs = [self.ranks.get(bytes((a, b))) for a in range(256) for b in range(256)]
        self._start()

    def _start(self) -> None:
        self.find = regex.compile(self.pattern).findall
        self.pieces, self.spaced = Memory(self.code), Memory(self.spell)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("find", "pieces", "spaced")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._start()

    def code(self, pieces: list[str]) -> list[bytes]:
        """Ids of matches of the pattern."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        return [
            self.slot_ids[slot] if slot >= 0 else struct.pack(f"<{len(ids)}I", *ids) if (ids := merge(key, self.ranks, self.pairs)) else b""
            for key, slot in zip(raw, self.hash.find(raw))
        ]

    def spell(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that follow a space."""
        found = [self.find(" " + t) for t in texts]
        known = self.pieces.learn({p for ps in found for p in ps})
        return [b"".join([known[p] for p in ps]) for ps in found]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers.

        Where spaces only stand alone before other text, each begins a match, so the text
        between two spaces is looked up as a whole.
        """
        if not self.splits or JOINED(text):
            return b"".join(map(self.pieces.learn(set(found := self.find(text))).__getitem__, found))
        head, *rest = text.split(" ")
        known = self.spaced.learn(set(rest))
        return b"".join([*self.code(self.find(head)), *map(known.__getitem__, rest)])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def load_codec(path: str, pattern: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read(), pattern)


def encode(df: DataFrame, codec: Codec, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of a text column (array<int>), without special tokens."""
    shared = df.sparkSession.sparkContext.broadcast(codec)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        coded = [shared.value.encode(text_of(t)) for t in column(batch, text)]
        return [list_array(np.frombuffer(b"".join(coded), dtype="<i4"), [len(c) // 4 for c in coded])]

    return add_columns(df, make, [(ids, T.ArrayType(T.IntegerType()))])


def decode(df: DataFrame, codec: Codec, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for (binary)."""
    shared = df.sparkSession.sparkContext.broadcast(codec)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        values, at = lists(column(batch, ids))
        return [pa.array([shared.value.decode(values[a:b].tolist()) for a, b in zip(at, at[1:])], pa.binary())]

    return add_columns(df, make, [(out, T.BinaryType())])


def digest_ids(df: DataFrame, ids: str = "ids", out: str = "ids_sha256") -> DataFrame:
    """Add the SHA-256 of the ids as little-endian unsigned 32-bit numbers."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        values, at = lists(column(batch, ids))
        values = values.astype("<u4")
        return [pa.array([hashlib.sha256(values[a:b].tobytes()).hexdigest() for a, b in zip(at, at[1:])], pa.string())]

    return add_columns(df, make, [(out, T.StringType())])


def encode_and_back(df: DataFrame, codec: Codec, text: str = "text", ids: str = "ids", out: str = "decoded", digest: str = "ids_sha256") -> DataFrame:
    """:func:`encode`, :func:`decode` and :func:`digest_ids` in one pass, with one worker per task."""
    shared = df.sparkSession.sparkContext.broadcast(codec)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        coded = [shared.value.encode(text_of(t)) for t in column(batch, text)]
        back = [shared.value.decode(np.frombuffer(c, dtype="<u4").tolist()) for c in coded]
        return [
            list_array(np.frombuffer(b"".join(coded), dtype="<i4"), [len(c) // 4 for c in coded]),
            pa.array(back, pa.binary()), pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
        ]

    return add_columns(df, make, [(ids, T.ArrayType(T.IntegerType())), (out, T.BinaryType()), (digest, T.StringType())])
