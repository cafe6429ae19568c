"""Packing of documents into fixed-length sequences: first-fit decreasing over a tournament tree, in random groups of documents.

Documents become token ids, one end id each, and are cut into pieces of at most ``length`` ids; only the last piece of a document can be
short. A full piece takes a sequence of its own, wherever first-fit decreasing comes to it, so it gets one where it is cut and does not move. Documents are
dealt at random into groups of about ``group_docs``; each group packs the short pieces of its documents on its own: they are taken from the longest on and go
to the first sequence with room. The tree holds, at each inner node, the most room below it, so a place is found in log2(bins) steps. Groups
bound memory (a document gives each at most one row) and cost little padding.

Token ids are those of the byte-level BPE file of ``tokenizers``, strings of its special tokens included. They are made with ``tiktoken`` from the same
vocabulary as ranks, which gives the same ids several times faster (tests compare them); ``tokenizers`` itself is the fallback where that gives up on a very
long run of one kind. Null or empty texts are one end id. Repeated rows are packed each. Columns of ``docs`` beside id and text are not returned.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import keep, text_of

_LOADED: dict[tuple[str, str], Tokens] = {}


class Tokens:
    """Encoder for one vocabulary: ``ranks`` for tiktoken, ``model`` for tokenizers."""

    def __init__(self, ranks: str, model: str):
        import public_tokenizers
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(ranks, "rb"))}
        with open(model, encoding="utf-8") as f:
            special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
        self.model, self.slow = model, None

    @classmethod
    def load(cls, ranks: str, model: str) -> Tokens:
        if (ranks, model) not in _LOADED:
            _LOADED[ranks, model] = cls(ranks, model)
        return _LOADED[ranks, model]

    def encode(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), dtype="<u4")
        except BaseException as e:  # the library panics (not an Exception) on some very long runs
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            from tokenizers import Tokenizer

            if self.slow is None:
                self.slow = Tokenizer.from_file(self.model)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def _cut(id_type, length: int, end_id: int, ranks: str, model: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens.load(ranks, model)
        for batch in batches:
            for part, _, _ in vec.chunks(batch, "text"):
                row, start, size, crc, total, kept = [], [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = np.append(tokens.encode(text), np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(ids), length):
                        piece = ids[s : s + length].tobytes()
                        row.append(i), start.append(s), size.append(len(piece) // 4), crc.append(zlib.crc32(piece)), total.append(len(ids))
                        if with_ids:
                            kept.append(piece)
                out = [part.column(0).take(pa.array(row, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, size, crc, total)]
                yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.binary())] * with_ids, ["id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    return run


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size; bins are numbered as they open."""
    n = len(sizes)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    width = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * width)
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        node = 1
        while node < width:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], offsets[i] = node - width, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
    return bins, offsets


def _pack(length: int):
    def run(table: pa.Table) -> pa.Table:
        # the order of rows that arrive does not matter: ties in length go by the document's number
        table = table.take(pa.array(np.argsort(table.column("number").to_numpy(), kind="stable")))
        bins, offset = first_fit_decreasing(table.column("length").to_numpy(), length)
        sequence = 2 * ((table.column("group").to_numpy() << 31) + bins)
        return table.drop_columns(["group", "number"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, length: int = 1024, end_id: int = 0, group_docs: int = 8192, seed: int = 11, with_ids: bool = True, id_col: str = "doc_id", text: str = "text", ranks: str | None = None, model: str | None = None) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, ids (binary, if ``with_ids``), sequence_id, offset.

    Texts are tokenised where they are read; what moves is the numbers of short pieces (and their ids, if wanted). Sequences of a full piece have odd ids.
    """
    import public_tokenizers

    ranks, model = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), model or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    pieces = docs.select(F.col(id_col).alias("id"), text_of(text).alias("text")).mapInArrow(_cut(kind, length, end_id, ranks, model, with_ids), fields)
    # numbered where they are written, so numbers stay; not the id decides about groups, so repeated ids spread
    pieces = keep(pieces.withColumn("number", F.monotonically_increasing_id()), "pieces")
    full, short = pieces.where(F.col("length") == length), pieces.where(F.col("length") < length)
    groups = max(1, -(-short.count() // group_docs))
    short = short.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "number"), F.lit(groups)))
    packed = short.groupBy("group").applyInArrow(_pack(length), f"{fields}, sequence_id long, offset long")
    alone = full.withColumns({"sequence_id": 2 * F.col("number") + 1, "offset": F.lit(0).cast("long")}).drop("number")
    return packed.unionByName(alone).withColumnRenamed("id", id_col)
