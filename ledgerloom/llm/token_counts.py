"""Token counts of documents in flat token streams that have no index, by a scan for the end-of-document identifier."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, saved
from .textcore import column_bytes, pieces

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the word pattern of the vocabulary in TOKENIZER, as its publishers give it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EOD = 50256  # the id that this vocabulary leaves free
BLOCK_TOKENS = 1 << 16
SCAN_RUN = 1024  # blocks that one step of the prefix scan adds up

_encoders: dict = {}


def encoder(path: str):
    """The tokenizer of a .tiktoken file, kept for the life of the worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_stream(docs: DataFrame, tokenizer: str = TOKENIZER, eod: int = EOD, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The flat stream of little-endian uint32 token ids of docs, a file for each partition, cut into blocks of block_tokens wherever
    that falls: (file, block, ids, payload). Each document's tokens are followed by eod. ids names the documents whose end mark lies in
    the block, in order; only the writer knows them, and the scan passes them on unread. The vocabulary file must be readable on every
    worker. A null text is an empty document."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, block = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        total, ids, kind = 0, [], None
        enc = encoder(tokenizer)

        def out(data: np.ndarray, named: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([named], pa.list_(kind)), pa.array([data.tobytes()], pa.binary())], ["file", "block", "ids", "payload"])

        for batch in batches:
            kind = batch.schema.field("id").type
            raw, names = column_bytes(batch, "text"), batch.column("id").to_pylist()
            for a, b in pieces(raw):
                for name, tokens in zip(names[a:b], enc.encode_ordinary_batch([t.decode("utf-8", "replace") for t in raw[a:b]], num_threads=1), strict=True):
                    held.append(np.array([*tokens, eod], np.uint32))
                    total += len(tokens) + 1
                    ids.append((total - 1, name))
                if total >= block_tokens:
                    data, at = np.concatenate(held), 0
                    while total - at >= block_tokens:
                        named = [x for end, x in ids if end < at + block_tokens]
                        ids = ids[len(named) :]
                        yield out(data[at : at + block_tokens], named)
                        block, at = block + 1, at + block_tokens
                    held, total, ids = [data[at:]], total - at, [(end - at, x) for end, x in ids]
        if total:
            yield out(np.concatenate(held), [x for _, x in ids])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return batched(rows).mapInArrow(write, f"file long, block long, ids array<{rows.schema['id'].dataType.simpleString()}>, payload binary")


def scan_blocks(blocks: DataFrame, eod: int = EOD, width: int = 4) -> DataFrame:
    """(file, block, ids, ends, lengths): for each block the number of end marks, and the lengths of the runs between them: the first run
    continues what the block before left open, the last one stays open. width: bytes of a token id, 2 or 4."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, lengths = [], []
            for payload in column_bytes(batch, "payload"):
                tokens = np.frombuffer(payload, np.dtype(f"<u{width}"))
                at = np.flatnonzero(tokens == eod)
                ends.append(len(at))
                lengths.append(np.diff(np.concatenate([[-1], at, [len(tokens)]])) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), batch.column("ids"), pa.array(ends, pa.int64()), pa.array(lengths, pa.list_(pa.int64()))], ["file", "block", "ids", "ends", "lengths"])

    schema = f"file long, block long, ids {blocks.schema['ids'].dataType.simpleString()}, ends long, lengths array<long>"
    return batched(blocks.select("file", "block", "ids", "payload")).mapInArrow(scan, schema)


def document_lengths(scanned: DataFrame) -> DataFrame:
    """(file, ordinal, id, n_tokens) of each document, stitched across blocks. A prefix scan over the blocks' end marks, in runs of
    SCAN_RUN blocks and then over the runs, gives each block its first ordinal; runs that share an ordinal are one document. Only
    the runs at the blocks' edges are summed across blocks. A stream that stops without an end mark ends with a document whose id is null."""
    run = F.floor(F.col("block") / SCAN_RUN)
    scanned = saved(scanned.withColumn("run", run))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    runs = scanned.groupBy("file", "run").agg(F.sum("ends").alias("n")).select("file", "run", F.coalesce(F.sum("n").over(before("file", "run")), F.lit(0)).alias("base"))
    inside = scanned.select("file", "run", "block", F.coalesce(F.sum("ends").over(before("file", "run", "block")), F.lit(0)).alias("offset"))
    first = inside.join(runs, ["file", "run"]).select("file", "block", (F.col("base") + F.col("offset")).alias("first"))
    rows = scanned.join(first, ["file", "block"]).select("file", "first", "ends", "ids", F.posexplode("lengths").alias("at", "n"))
    rows = rows.select("file", (F.col("first") + F.col("at")).alias("ordinal"), F.when(F.col("at") < F.col("ends"), F.get("ids", F.col("at"))).alias("id"), "n", (F.col("at") < F.col("ends")).alias("ended"), ((F.col("at") == 0) | (F.col("at") == F.col("ends"))).alias("edge"))
    whole = rows.where("not edge").select("file", "ordinal", "id", F.col("n").alias("n_tokens"))
    stitched = rows.where("edge").groupBy("file", "ordinal").agg(F.max("id").alias("id"), F.sum("n").alias("n_tokens"), F.max("ended").alias("ended"))
    return whole.union(stitched.where("ended or n_tokens > 0").select("file", "ordinal", "id", "n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, eod: int = EOD, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id and n_tokens (end mark not counted) of each row of docs, as the scan finds them in the flat stream of docs.

    Null and empty texts have 0 tokens; very long texts count whole, over as many blocks as they fill; null ids stay null; repeated rows each have a row. Other
    columns are ignored. An empty table gives no rows."""
    return document_lengths(scan_blocks(token_stream(docs, tokenizer, eod, block_tokens), eod)).select(F.col("id").alias("doc_id"), "n_tokens")
