"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

A text is cut into pre-tokens by the vocabulary's pattern. Two tiers turn a pre-token into
ids. First a minimal perfect hash over the vocabulary's byte strings: a whole pre-token that
is a token is found by two hashes and one comparison. What isn't goes through the merges:
its bytes form a linked list, a heap yields the pair of least rank (the leftmost of equals),
and each merge touches only its two neighbours.

Pre-tokens repeat, so each task keeps the answers of recent ones, in bounded memory."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparkit import bound_batches

#: Pre-tokens whose ids a task keeps, in each of two generations.
KEPT = 1 << 19
#: The letters of the plain path: those of ASCII and Latin-1, as ranges.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_M64 = (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file ("base64 rank" lines), by way of the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def hash_bytes(key: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little")


def _spread(base: int, seed: int) -> int:
    h = base ^ (seed * 0x9E3779B97F4A7C15 & _M64)
    h = (h ^ (h >> 32)) * 0xD6E8FEB86659FD93 & _M64
    return h ^ (h >> 32)


class PerfectHash:
    """Minimal perfect hash by hash and displace. Keys fall into groups of two on average;
    each group, the largest first, gets the first seed that sends all its keys to free slots
    of a table with as many slots as keys. A group of one key names its slot outright (as a
    negative number), which fills the last slots without any search."""

    def __init__(self, keys: list[bytes]):
        n = self.n = max(1, len(keys))
        self.groups = max(1, n // 2)
        base = [hash_bytes(k) for k in keys]
        own: list[list[int]] = [[] for _ in range(self.groups)]
        for i, h in enumerate(base):
            own[h % self.groups].append(i)
        self.seeds = [0] * self.groups
        self.slot_key = [-1] * n
        for g in sorted(range(self.groups), key=lambda g: -len(own[g])):
            if len(own[g]) < 2:
                break
            seed = 1
            while True:
                slots = {_spread(base[i], seed) % n for i in own[g]}
                if len(slots) == len(own[g]) and all(self.slot_key[x] < 0 for x in slots):
                    break
                seed += 1
            self.seeds[g] = seed
            for i in own[g]:
                self.slot_key[_spread(base[i], seed) % n] = i
        free = iter([x for x in range(n) if self.slot_key[x] < 0])
        for g in range(self.groups):
            if len(own[g]) == 1:
                x = next(free)
                self.seeds[g] = -1 - x
                self.slot_key[x] = own[g][0]

    def find(self, key: bytes) -> int:
        """Index of the key that has this slot; the caller compares the key itself."""
        base = hash_bytes(key)
        seed = self.seeds[base % self.groups]
        return self.slot_key[-1 - seed if seed < 0 else _spread(base, seed) % self.n]


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, index: PerfectHash | None = None):
        import regex

        self.ranks = ranks
        self.keys = list(ranks)
        self.ids = [ranks[k] for k in self.keys]
        self.index = index or PerfectHash(self.keys)
        self.find_any = regex.compile(pattern).findall
        # on texts of these characters alone the pattern's classes are known, and the
        # quicker engine gives the same matches
        known = pattern.replace(r"\s\p{L}\p{N}", rf"\s{LETTERS}0-9").replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", "[0-9]")
        self.plain = re.compile(rf"[\t\n\r -~{LETTERS}]*").fullmatch if r"\p" not in known else lambda _: None
        self.find_plain = re.compile(known).findall if r"\p" not in known else None
        self.names = {str(i): k for k, i in ranks.items()}
        self.kept: dict[str, str] = {}
        self.older: dict[str, str] = {}
        # both halves of every way to cut a token that is in the vocabulary on both sides
        self.pairs = {ranks[k[:c]] << 20 | ranks[k[c:]]: r for k, r in ranks.items() for c in range(1, len(k)) if k[:c] in ranks and k[c:] in ranks}
        self.byte_id = [ranks[bytes([x])] for x in range(256)]
        self.first = [ranks.get(bytes([x, y]), -1) for x in range(256) for y in range(256)]

    def pre_token(self, raw: bytes) -> list[int]:
        at = self.index.find(raw)
        if at >= 0 and self.keys[at] == raw:
            return [self.ids[at]]
        return self.merged(raw)

    def merged(self, raw: bytes) -> list[int]:
        """Merge by rank until no neighbouring pair is in the vocabulary. A heap entry holds
        rank and place in one integer; it is stale if the pair at its place has changed. A
        token's id is its rank."""
        pair, first = self.pairs.get, self.first
        part = [self.byte_id[x] for x in raw]
        n = len(part)
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        # rank of the pair that starts at each place, -1 where there is none
        now = [first[a << 8 | b] for a, b in zip(raw, raw[1:], strict=False)]
        now.append(-1)
        heap = [r << 40 | i for i, r in enumerate(now) if r >= 0]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i, r = top & 0xFFFFFFFFFF, top >> 40
            if now[i] != r:
                continue
            j = nxt[i]
            part[i], part[j], now[j] = r, -1, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                q = now[i] = pair(r << 20 | part[k], -1)
                if q >= 0:
                    heapq.heappush(heap, q << 40 | i)
            else:
                now[i] = -1
            h = prv[i]
            if h >= 0:
                q = now[h] = pair(part[h] << 20 | r, -1)
                if q >= 0:
                    heapq.heappush(heap, q << 40 | h)
        return [p for p in part if p >= 0]

    def encode(self, text: str) -> str:
        """Decimal ids joined by one space."""
        found = self.find_plain(text) if self.plain(text) else self.find_any(text)
        while True:
            try:
                return " ".join(map(self.kept.__getitem__, found))
            except KeyError:
                own = self._learn(found)
                if own is not None:
                    return " ".join(map(own.__getitem__, found))

    def _learn(self, found: list[str]) -> dict[str, str] | None:
        """Take the answers of all of `found` into what is kept. When that is full, it turns
        into the older of two generations, from which what is still in use comes back. A
        text with more pre-tokens than are kept gets a dictionary of its own."""
        new = set(found).difference(self.kept)
        if len(self.kept) + len(new) > KEPT:
            self.older, self.kept = self.kept, {}
            new = set(found)
        into = self.kept if len(new) <= KEPT else {}
        older = self.older.get
        for t in new:
            ids = older(t)
            if ids is None:
                ids = " ".join(map(str, self.pre_token(t.encode("utf-8", "replace"))))
            into[t] = ids
        return None if into is self.kept else into

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.names.__getitem__, ids.split(" "))) if ids else b""


_codecs: dict[int, Codec] = {}


def _coded(shared, number: int, pattern: str, columns: list[str]) -> Callable:
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if number not in _codecs:
            _codecs.clear()
            _codecs[number] = Codec(shared.value[0], pattern, shared.value[1])
        codec = _codecs[number]
        for f in frames:
            out = []
            for t in f["_text"]:
                ids = codec.encode(t or "")
                raw = codec.decode(ids)
                out.append((ids.count(" ") + 1 if ids else 0, ids, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), raw))
            got = pd.DataFrame(out, columns=["n_tokens", "token_ids", "ids_sha256", "decoded_sha256", "decoded"], index=f.index)
            yield pd.concat([f[["_key"]], got], axis=1)[columns]

    return rows


_KINDS = {"n_tokens": "long", "token_ids": "string", "ids_sha256": "string", "decoded_sha256": "string", "decoded": "binary"}


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] = ("n_tokens", "ids_sha256", "decoded_sha256")) -> DataFrame:
    """For each row: key and the named columns of n_tokens, token_ids (decimal, joined by one
    space), ids_sha256, decoded_sha256 and decoded (the bytes that the ids stand for).

    Null and empty texts have no tokens. Lone surrogates count as '?'. Repeated rows are
    encoded alike. A null key stays null. An empty table gives an empty result. Columns not
    named are ignored. The vocabulary is read by the driver and broadcast; its size is that
    of the file, whatever the documents.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    ranks = read_ranks(ranks_path)
    shared = spark.sparkContext.broadcast((ranks, PerfectHash(list(ranks))))
    kind = docs.schema[key].dataType
    schema = ", ".join(["_key string", *[f"{c} {_KINDS[c]}" for c in columns]])
    d = docs.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))
    got = d.mapInPandas(_coded(shared, shared._jbroadcast.id(), pattern, ["_key", *columns]), schema)
    return got.select(F.col("_key").cast(kind).alias(key), *columns)
