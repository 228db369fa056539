"""Operator 9: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The pairs of a pre-token wait in buckets, one a merge rank, that hold positions of a linked list. A
two-level bitmap over the ranks tells by find-first-set which bucket is next; positions whose
pair has changed meanwhile are skipped when they come up. Each merge touches two neighbours, so a
pre-token of n bytes takes O(n) queue steps, however long it is. The new pre-tokens of a few texts
share one list and one queue. Short pre-tokens seen before come from a memo of bounded count and
size; long ones are merged anew.

Defined results: null text is empty and has no tokens; every row, repeated or not, gives a row; a
very long text is cut into pre-tokens a stretch at a time, its ids are held whole; no rows give no
rows; other columns are ignored. The vocabulary is read once on the driver (about 1 MB) and broadcast.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens of a memo generation, and the most characters of one; so some 100 MB a worker.
MEMO, MEMO_CHARS = 400_000, 32
SLICE = 64
#: Characters cut into pre-tokens at a time. A stretch ends between a letter and a space before a
#: letter, where every pre-token ends.
STRETCH = 1 << 20
#: Characters whose pre-tokens are looked up and merged together: few enough for a core's cache.
GATHER = 1 << 16
STRETCH_END = regex.compile(r"\p{L}(?= \p{L})")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


#: A low word of the bitmap has 256 ranks; the top word has a bit for every low word in use.
BIT = [1 << k for k in range(4096)]
#: Never in UTF-8, so no pair that reaches over it is a token.
GAP = b"\xff"


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.bytes = np.full(max(ranks.values()) + 1, None, object)
        for k, v in ranks.items():
            self.bytes[v] = k
        self.joins = {k: v for k, v in ranks.items() if len(k) > 1 and GAP not in k}
        self.twos = {(k[0], k[1]): v for k, v in self.joins.items() if len(k) == 2}
        self.ones = [ranks.get(bytes([b]), -1) for b in range(255)] + [-1]
        self.low, self.memo, self.old = [0] * ((max(ranks.values()) >> 8) + 1), {}, {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of every pre-token, as 32-bit numbers in a row: always the least rank, leftmost first. The pre-tokens lie in
        one linked list with gaps between them and share the queue; their orders do not meet."""
        data = GAP + GAP.join(pieces) + GAP
        n, get, low, top, bit = len(data), self.joins.get, self.low, 0, BIT
        after, before, token = list(range(1, n + 1)), list(range(-1, n - 1)), list(map(self.ones.__getitem__, data))
        pair = list(map(self.twos.get, zip(data, data[1:])))
        pair.append(None)
        buckets: dict[int, list[int]] = {}
        for i, r in enumerate(pair):
            if r is not None:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
        for r in buckets:
            low[r >> 8] |= bit[r & 255]
            top |= bit[r >> 8]
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = (word << 8) + (bits & -bits).bit_length() - 1
            low[word] = bits = bits & (bits - 1)
            if not bits:
                top &= top - 1
            positions, wait, held = buckets.pop(rank), 0, []
            if len(positions) > 1:
                positions.sort()
            for i in positions:
                if pair[i] != rank:
                    continue  # stale: merged or changed since it was filed
                if i < wait:
                    held.append(i)
                    continue
                j = after[i]
                k = after[j]
                after[i], before[k], pair[j], token[i] = k, i, None, rank
                pair[i] = least = get(data[i : after[k]])
                if least is not None:
                    if least in buckets:
                        buckets[least].append(i)
                    else:
                        buckets[least] = [i]
                        low[least >> 8] |= bit[least & 255]
                        top |= bit[least >> 8]
                    if least < rank:  # a lower rank has come up: the rest of this pre-token waits
                        wait = data.index(GAP, i)
                p = before[i]
                pair[p] = least = get(data[p:k])
                if least is not None:
                    if least in buckets:
                        buckets[least].append(p)
                    else:
                        buckets[least] = [p]
                        low[least >> 8] |= bit[least & 255]
                        top |= bit[least >> 8]
                    if least < rank:
                        wait = data.index(GAP, i)
            if held:
                buckets.setdefault(rank, []).extend(held)
                low[rank >> 8] |= bit[rank & 255]
                top |= bit[rank >> 8]
        ids, ends, i = [], [0], 1
        while i < n:
            if data[i] == 255:
                ends.append(4 * len(ids))
            else:
                ids.append(token[i])
            i = after[i]
        packed = array("i", ids).tobytes()
        return [packed[a:b] for a, b in zip(ends, ends[1:])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text. Stretches gather up to GATHER characters or one stretch, so that
        each different pre-token among them is looked up, and merged if new, once."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, chars = [], 0
        for text, ids in zip(texts, out):
            at = 0
            while at < len(text):
                cut = STRETCH_END.search(text, at + STRETCH) if len(text) - at > STRETCH else None
                to = cut.end() if cut else len(text)
                held.append((ids, self.find(text, at, to)))
                chars, at = chars + to - at, to
                if chars >= GATHER:
                    self._ids(held)
                    held, chars = [], 0
        self._ids(held)
        return [np.frombuffer(b"".join(parts), np.int32) for parts in out]

    def _ids(self, held: list[tuple[list[bytes], list[str]]]) -> None:
        memo, old, ranks, new, found = self.memo, self.old, self.ranks, [], {}
        for piece in set(chain.from_iterable(pieces for _, pieces in held)):
            ids = memo.get(piece)
            if ids is None:
                ids = old.get(piece)
                if ids is None:
                    whole = ranks.get(data := piece.encode())
                    if whole is None:
                        new.append((piece, data))
                        continue
                    ids = array("i", [whole]).tobytes()
                if len(piece) <= MEMO_CHARS:
                    memo[piece] = ids
            found[piece] = ids
        if new:
            for (piece, _), ids in zip(new, self.merge([data for _, data in new])):
                found[piece] = ids
                if len(piece) <= MEMO_CHARS:
                    memo[piece] = ids
        if len(memo) >= MEMO:  # two generations: what is in use moves on, the rest goes
            self.old, self.memo = memo, {}
        for ids, pieces in held:
            ids.append(b"".join(map(found.__getitem__, pieces)))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.bytes[ids].tolist())


def _rows(vocabulary, pattern: str, what: str):
    """vocabulary: a broadcast dict. A worker process keeps a broadcast's value from task to task,
    and gets its functions' modules anew with each task, so the codec, with its memo, is kept there
    too. what: encode, decode or both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "codec" not in vocabulary.value:
            vocabulary.value["codec"] = Codec(vocabulary.value["ranks"], pattern)
        codec = vocabulary.value["codec"]
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                columns, names = [part.column("key")], ["key"]
                if what == "decode":
                    ids = [np.array(x.as_py() or [], np.int32) for x in part.column("ids")]
                else:
                    ids = codec.encode([x.as_py() or "" for x in part.column("text")])
                    columns, names = [*columns, pa.ListArray.from_arrays(list(accumulate(map(len, ids), initial=0)), np.concatenate(ids))], [*names, "ids"]
                if what != "encode":
                    columns, names = [*columns, pa.array([codec.decode(x) for x in ids], pa.binary())], [*names, "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _apply(df: DataFrame, path: str, pattern: str, what: str, schema: str) -> DataFrame:
    vocabulary = df.sparkSession.sparkContext.broadcast({"ranks": load_ranks(path)})
    return df.mapInArrow(_rows(vocabulary, pattern, what), schema)


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row."""
    return _apply(df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), path, pattern, "encode", "key long, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, key: str = "key", ids: str = "ids") -> DataFrame:
    """(key, decoded) of every row: the bytes its ids stand for."""
    return _apply(df.select(F.col(key).cast("long").alias("key"), F.col(ids).alias("ids")), path, pattern, "decode", "key long, decoded binary")


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded): encodes and decodes the ids in one pass over the rows."""
    return _apply(df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), path, pattern, "both", "key long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document, and ids if asked for."""
    import public_tokenizers

    rows = round_trip(docs, path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
    said = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select(F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(said, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *(["ids"] if with_ids else []))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every document encoded and decoded again."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
