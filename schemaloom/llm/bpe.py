"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a whole pre-token that is an entry resolves with one
probe. Tier two merges the bytes of a miss on a doubly linked list with a heap of candidate pairs.

Defined results: a null text is encoded as an empty one (no ids, no bytes); a very long text is encoded whole, and a long
pre-token in time that grows with its length; of equal ranks the leftmost pair merges first; special tokens' strings are
ordinary text; repeated rows give repeated results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, read, slices

#: Vocabulary files beyond this many bytes are refused: the ranks are broadcast whole.
MAX_VOCABULARY_BYTES = 64 << 20


class PerfectHash:
    """Minimal perfect hash by hash-and-displace: one displacement per bucket, no empty slot, keys kept to reject strangers."""

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 2)
        self.shift: list[int] = [0] * self.buckets
        self.slots: list[tuple[bytes, int] | None] = [None] * n
        groups: dict[int, list[int]] = {}
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            groups.setdefault((h >> 40) % self.buckets, []).append(i)
        free = bytearray(b"\x01") * n
        single = []
        for b, members in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                single.append((b, members[0]))
                continue
            d = 0
            while True:
                at = [self._slot(hashes[i], d) for i in members]
                if len(set(at)) == len(at) and all(free[a] for a in at):
                    break
                d += 1
            self.shift[b] = d
            for i, a in zip(members, at, strict=True):
                free[a] = 0
                self.slots[a] = (keys[i], values[i])
        left = (i for i in range(n) if free[i])
        for b, i in single:  # a bucket of one names its slot outright
            a = next(left)
            self.shift[b] = -a - 1
            self.slots[a] = (keys[i], values[i])

    def _slot(self, h: int, d: int) -> int:
        return ((h & 0xFFFFFFFF) + d * (((h >> 32) & 0x7FFFFFFF) | 1)) % self.n

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[(h >> 40) % self.buckets]
        entry = self.slots[self._slot(h, d) if d >= 0 else -d - 1]
        return entry[1] if entry is not None and entry[0] == key else -1


class Memo(dict):
    """Pre-token -> its ids as packed int32; emptied when full, so its size is bounded."""

    LIMIT, LONGEST = 600_000, 64

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, token: str) -> bytes:
        out = self.make(token)
        if len(token) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[token] = out
        return out


class Codec:
    """Encoder and decoder of one vocabulary; built on the driver and broadcast, as its size is that of the vocabulary."""

    def __init__(self, vocabulary: bytes, pattern: str):
        ranks = [line.split() for line in vocabulary.splitlines() if line]
        keys, ids = [base64.b64decode(a) for a, _ in ranks], [int(b) for _, b in ranks]
        self.pattern = pattern
        self.table = PerfectHash(keys, ids)
        self.bytes_of: dict[int, bytes] = dict(zip(ids, keys, strict=True))
        self.byte_id = [self.table.get(bytes([b])) for b in range(256)]
        id_of = dict(zip(keys, ids, strict=True))
        #: Every two ids whose joined bytes are an entry: left << 32 | right -> that entry, which is also the merge's rank.
        self.pairs = {a << 32 | b: i for k, i in id_of.items() for j in range(1, len(k)) if (a := id_of.get(k[:j])) is not None and (b := id_of.get(k[j:])) is not None}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("find", "memo")}

    def ready(self) -> Codec:
        """With the parts that each process makes for itself."""
        if "memo" not in self.__dict__:
            self.find = regex.compile(self.pattern).findall
            self.memo = Memo(self._token)
        return self

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost first among equals. now[i] is the rank of the pair at i, so a stale heap entry shows at once."""
        pair = self.pairs.get
        ids = [*map(self.byte_id.__getitem__, piece)]
        n = len(ids)
        now = [pair(a << 32 | b, -1) for a, b in zip(ids, ids[1:])]
        now.append(-1)
        bits = n.bit_length()
        mask = (1 << bits) - 1
        heap = [r << bits | i for i, r in enumerate(now) if r >= 0]
        heapify(heap)
        after = [*range(1, n + 1)]
        before = [*range(-1, n - 1)]
        while heap:
            top = heappop(heap)
            i = top & mask
            rank = top >> bits
            if now[i] != rank:
                continue
            j = after[i]
            ids[i], ids[j], now[j] = rank, -1, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                now[i] = r = pair(rank << 32 | ids[k], -1)
                if r >= 0:
                    heappush(heap, r << bits | i)
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                now[h] = r = pair(ids[h] << 32 | rank, -1)
                if r >= 0:
                    heappush(heap, r << bits | h)
        return [x for x in ids if x >= 0]

    def _token(self, token: str) -> bytes:
        piece = token.encode("utf-8", "surrogatepass")
        whole = self.table.get(piece)
        ids = [whole] if whole >= 0 else self.merge(piece)
        return pack(f"={len(ids)}i", *ids)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.find(text))), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def load_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return data


def encode_decode(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Each document's ids, and the bytes that those ids decode to (``keep_text``: and its text). A map without shuffle; the tables, of a checked size, are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(Codec(load_vocabulary(vocabulary_path), pattern))
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType()), *([T.StructField("text", T.StringType())] if keep_text else [])])
    target = arrow_schema(out)

    def run(batches):
        own = shared.value.ready()
        for batch in batches:
            for ids, texts in slices(batch, 128):
                rows = [own.encode(t or "") for t in texts]
                offsets = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(r) for r in rows], out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, target[0].type), lists.cast(target[1].type), pa.array([own.decode(r) for r in rows], target[2].type), *([pa.array(texts, target[3].type)] if keep_text else [])], schema=target)

    return docs.select(id_col, text_col).mapInArrow(run, out)


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    return digest(encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary), public_tokenizers.PATTERN))
