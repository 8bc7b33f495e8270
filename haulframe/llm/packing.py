"""Best-fit packing of tokenised documents into sequences of bounded length.

A document's ids are its byte-level BPE ids followed by an end id.  Longer
documents are cut from the back, so all pieces but the first are full; a
full piece is a sequence of its own and is never shuffled.  The remaining
pieces are dealt into streams of bounded length (the number of streams
follows from their count), and each stream is packed online by bounded-space
best fit: the open bins are kept in a bitset keyed by free space, a piece
goes to the bin that it fills best, and when ``open_bins`` bins are open and
none has room, the fullest closes first.

A stream is fed through a look-ahead of ``look_ahead`` pieces: of those that
wait, the longest one that fits behind the piece fed last goes next, else
the longest of all.  So bins fill up soon after they open, and few open bins
do: the bound is reached all the time, and what closes is full but for less
than the shortest waiting piece.

Defined results: a null text counts as empty, and an empty document is one
piece holding the end id; a null id is a row like any other; repeated rows
are packed once each; very long texts are cut into as many pieces as they
need; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import json
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulframe.llm.tables import written

VOCABULARY = "byte_bpe_50k.json"

#: The published split pattern of this vocabulary, with possessive repeats.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level BPE writes each byte as a letter: printable bytes as themselves, others from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def encoder(path: str) -> tiktoken.Encoding:
    """The vocabulary at ``path`` (a byte-level ``tokenizers`` JSON, or ``tiktoken`` ranks).

    The ids equal those of the ``tokenizers`` library on the same file; the
    other library is three times as fast.
    """
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            read = json.load(f)
            _expect_byte_level(read, path)
            special = {t["content"]: t["id"] for t in read["added_tokens"] if t["special"]}
            letters = _bytes_of_letters()
            ranks = {bytes(letters[c] for c in token): i for token, i in read["model"]["vocab"].items() if token not in special}
        else:
            special = {}
            ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


def _expect_byte_level(read: dict, path: str) -> None:
    """``SPLIT`` is the split of a plain byte-level pre-tokenizer; other files would get other ids."""
    before = read.get("pre_tokenizer") or {}
    model = read["model"]
    plain = (before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
             and read.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout")
             and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))
    if not plain:
        raise ValueError(f"{path}: only byte-level BPE with the standard split is read")


def token_ids(text: str, path: str) -> np.ndarray:
    enc = encoder(path)
    if any(s in text for s in enc.special_tokens_set):
        return np.array(enc.encode(text, allowed_special="all"), np.uint32)
    return enc.encode_to_numpy(text, disallowed_special=())


def cuts(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: only the first may be shorter than ``most``."""
    first = length % most or most
    return [(0, first), *((s, most) for s in range(first, length, most))]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, most: int = 1024,
           end_id: int = 2, path: str | None = None) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32."""
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                ids = np.append(token_ids(text.as_py(), path), end_id).astype("<u4")
                for k, (s, n) in enumerate(cuts(len(ids), most)):
                    doc.append(row)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s:s + n].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def feed(lengths: list[int], most: int, look_ahead: int) -> Iterator[int]:
    """Places in ``lengths`` in the order in which they are packed, seen through a look-ahead."""
    waiting: list[list[int]] = [[] for _ in range(most + 1)]
    waiting_set = 0  # bit n is set while a piece of length n waits
    seen = held = free = 0
    while seen < len(lengths) or held:
        while seen < len(lengths) and held < look_ahead:
            waiting[lengths[seen]].append(seen)
            waiting_set |= 1 << lengths[seen]
            seen += 1
            held += 1
        fits = waiting_set & ((1 << (free + 1)) - 1)
        n = (fits or waiting_set).bit_length() - 1
        free = free - n if fits else most - n
        yield waiting[n].pop()
        held -= 1
        if not waiting[n]:
            waiting_set &= ~(1 << n)


class OpenBins:
    """Bounded-space online best fit: at most ``open_bins`` bins, in a bitset keyed by free space."""

    def __init__(self, most: int, open_bins: int):
        self.most, self.open_bins = most, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(most + 1)]
        self.free_set = 0  # bit f is set while some open bin has f places left
        self.opened = self.bins = self.closed = 0

    def _take(self, free: int) -> int:
        bin_ = self.by_free[free].pop()
        if not self.by_free[free]:
            self.free_set &= ~(1 << free)
        self.opened -= 1
        return bin_

    def place(self, n: int) -> tuple[int, int]:
        """Bin and offset of a piece of length n."""
        fits = self.free_set >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.opened >= self.open_bins:
                self._take((self.free_set & -self.free_set).bit_length() - 1)
                self.closed += 1
            free, bin_ = self.most, self.bins
            self.bins += 1
        if free > n:
            self.by_free[free - n].append(bin_)
            self.free_set |= 1 << (free - n)
            self.opened += 1
        return bin_, self.most - free


def best_fit(lengths: list[int], most: int, open_bins: int, look_ahead: int = 1) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, packed as a stream."""
    bins = OpenBins(most, open_bins)
    where, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in feed(lengths, most, look_ahead):
        where[i], offsets[i] = bins.place(lengths[i])
    return where, offsets


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, most: int = 1024, end_id: int = 2,
         path: str | None = None, stream_pieces: int = 65536, open_bins: int = 64, look_ahead: int = 4096) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = written(pieces(docs, id_col, text_col, most=most, end_id=end_id, path=path), "packing-pieces")
    full = (cut.where(F.col("length") == most)
            .withColumn("sequence_id", -F.monotonically_increasing_id() - 1)
            .withColumn("offset", F.lit(0).cast("bigint")))
    rest = cut.where(F.col("length") < most)
    streams = max(1, math.ceil(rest.count() / stream_pieces))

    def run(part: pa.Table) -> pa.Table:
        # the same order whenever the task runs again
        part = part.sort_by([("id", "ascending"), ("start", "ascending"), ("length", "ascending"), ("ids_crc32", "ascending")])
        where, offsets = best_fit(part.column("length").to_pylist(), most, open_bins, look_ahead)
        ids = pa.array(part.column("stream").to_numpy() * 2 ** 32 + np.array(where, np.int64), pa.int64())
        return part.drop_columns("stream").append_column("sequence_id", ids).append_column("offset", pa.array(offsets, pa.int64()))

    dealt = rest.withColumn("stream", F.pmod(F.monotonically_increasing_id(), F.lit(streams)))
    packed = dealt.groupBy("stream").applyInArrow(run, full.schema)
    return full.unionByName(packed).withColumnRenamed("id", id_col)
