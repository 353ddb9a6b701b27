"""Token ids of a whole corpus under a public byte-level BPE vocabulary, and back.

Pre-tokens (the pieces the vocabulary's pattern cuts a text into) are encoded once per distinct piece of the corpus, not
once per occurrence. Blocks of texts are cut into pre-tokens with positions; a block is one row that holds, per text,
the positions as codes of its own piece list. Pieces are exploded once per block, so a piece that is everywhere makes one
row per block, not one per occurrence. Distinct pieces are shuffled by value, encoded, and their ids joined back to the
blocks, which are reassembled by position. Decoding joins the token-byte table the same way: distinct ids of a block.

Blocks are written to the shared folder, so a lost executor redoes only its own part and both sides of the join see the
same blocks.

Defined cases: null and empty texts give an empty list; texts of any length are taken whole; strings of special tokens
are ordinary text; repeated rows stay repeated rows; an empty table gives no row.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noesis.session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The cutting pattern of the public byte-level BPE vocabularies (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_CHARS = 1_000_000
BLOCK_TEXTS = 4_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a vocabulary file: one base64 token and its id per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    ids, texts, chars = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids.append(i), texts.append(t or "")
            chars += len(texts[-1])
            if chars >= BLOCK_CHARS or len(ids) >= BLOCK_TEXTS:
                yield ids, texts
                ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def _cut_blocks(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import regex
        from pyspark import TaskContext

        pieces_of = regex.compile(pattern).findall
        task = TaskContext.get()
        name = f"{task.partitionId() if task else 0}-{uuid.uuid4().hex[:12]}"
        for n, (ids, texts) in enumerate(_blocks(batches)):
            known: dict[str, int] = {}
            codes, sizes = [], []
            for t in texts:
                found = pieces_of(t)
                sizes.append(len(found))
                codes.extend([known.setdefault(p, len(known)) for p in found])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{name}-{n}"]), pa.array([ids], pa.list_(pa.int64())), pa.array([np.array(sizes, np.int32).tobytes()], pa.binary()),
                    pa.array([np.array(codes, np.int32).tobytes()], pa.binary()), pa.array([list(known)], pa.list_(pa.string())),
                ],
                names=["block", "ids", "sizes", "codes", "pieces"],
            )

    return run


def _encode_pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import tiktoken
        from pyspark import SparkFiles

        sent = SparkFiles.get(os.path.basename(path))

        # a piece is never cut again: the pattern takes it whole
        whole = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(sent if os.path.exists(sent) else path), special_tokens={})
        for b in batches:
            found = [whole.encode_ordinary(p) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], names=["piece", "tokens"])

    return run


def _assemble(key: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, sizes, codes, at, tokens = (b.column(k).slice(r, 1) for k in range(5))
                sizes, codes = np.frombuffer(sizes[0].as_py(), np.int32), np.frombuffer(codes[0].as_py(), np.int32)
                lists = tokens.flatten()
                place = np.empty(len(lists), np.int64)
                place[np.asarray(at.flatten())] = np.arange(len(lists))
                flat, lengths = np.asarray(lists.flatten(), np.int32), np.asarray(lists.value_lengths(), np.int64)
                starts = np.concatenate([[0], np.cumsum(lengths)])[:-1] if len(lengths) else np.zeros(0, np.int64)
                p = place[codes]
                many = lengths[p]
                ends = np.cumsum(many)
                take = np.repeat(starts[p] - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)
                per_text = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
                for lo in range(0, len(sizes), 1000):
                    hi = min(lo + 1000, len(sizes))
                    values = flat[take[per_text[lo] : per_text[hi]]] if len(flat) else np.zeros(0, np.int32)
                    lists_out = pa.ListArray.from_arrays(pa.array((per_text[lo : hi + 1] - per_text[lo]).astype(np.int32)), pa.array(values))
                    yield pa.RecordBatch.from_arrays([ids.flatten().slice(lo, hi - lo), lists_out], names=[key, out])

    return run


def encode_corpus(df: DataFrame, key: str, text: str, *, vocabulary: str = VOCABULARY, pattern: str = PATTERN, out: str = "ids") -> DataFrame:
    """``key, ids``: the token ids of every text, one row per row of ``df``."""
    df.sparkSession.sparkContext.addFile(vocabulary)  # executors get the file with the job; they need not have it
    rows = df.select(F.col(key).cast("long").alias(key), F.col(text).alias("text"))
    blocks = cut(rows.mapInArrow(_cut_blocks(pattern), "block string, ids array<long>, sizes binary, codes binary, pieces array<string>"), "token-blocks")
    pieces = blocks.select("block", F.posexplode("pieces").alias("at", "piece"))
    encoded = pieces.select("piece").distinct().mapInArrow(_encode_pieces(vocabulary), "piece string, tokens array<int>")
    back = pieces.join(encoded, "piece").groupBy("block").agg(F.collect_list(F.struct("at", "tokens")).alias("found"))
    joined = blocks.drop("pieces").join(back, "block", "left").select(
        "ids", "sizes", "codes", F.coalesce(F.col("found.at"), F.array().cast("array<int>")).alias("at"), F.coalesce(F.col("found.tokens"), F.array().cast("array<array<int>>")).alias("tokens")
    )
    return joined.mapInArrow(_assemble(key, out), f"`{key}` long, `{out}` array<int>")


def token_bytes(spark: SparkSession, vocabulary: str = VOCABULARY) -> DataFrame:
    """The token-byte table: ``token, bytes``, one row per vocabulary entry, so its size is that of the vocabulary file."""
    ranks = read_ranks(vocabulary)
    return spark.createDataFrame(pa.table({"token": pa.array(list(ranks.values()), pa.int64()), "bytes": pa.array(list(ranks), pa.binary())}))


def _id_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys and id lists as blocks: distinct ids of a block, and its lists as places among them."""
    import uuid

    from pyspark import TaskContext

    task = TaskContext.get()
    name = f"{task.partitionId() if task else 0}-{uuid.uuid4().hex[:12]}"
    n = 0
    for whole in batches:
        for lo in range(0, whole.num_rows, BLOCK_TEXTS):
            b = whole.slice(lo, BLOCK_TEXTS)
            lists = b.column(1)
            flat = lists.flatten()
            sizes = np.asarray(lists.value_lengths().fill_null(-1), np.int32)
            known, codes = np.unique(np.asarray(flat.fill_null(-1), np.int64), return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{name}-{n}"]), pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([sizes.tobytes()], pa.binary()),
                    pa.array([codes.astype(np.int32).tobytes()], pa.binary()), pa.array([known.tolist()], pa.list_(pa.int64())),
                ],
                names=["block", "keys", "sizes", "codes", "tokens"],
            )
            n += 1


def _to_text(key: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                keys, sizes, codes, at, parts = (b.column(k)[r] for k in range(5))
                piece: dict[int, bytes] = dict(zip(at.as_py(), parts.as_py()))
                codes, texts, begin = np.frombuffer(codes.as_py(), np.int32).tolist(), [], 0
                for n in np.frombuffer(sizes.as_py(), np.int32).tolist():
                    own = [piece.get(c) for c in codes[begin : begin + n]] if n > 0 else []
                    begin += max(n, 0)
                    texts.append(None if n < 0 or None in own else b"".join(own).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(texts, pa.string())], names=[key, out])

    return run


def decode_corpus(df: DataFrame, key: str, ids: str, *, vocabulary: str = VOCABULARY, out: str = "text") -> DataFrame:
    """``key, text``: the inverse of ``encode_corpus``; an empty list gives an empty text, null gives null, an id outside
    the vocabulary gives null. The distinct ids of each block join the token-byte table, so the join sees a block's
    vocabulary and never its tokens; bytes are put in order and read as UTF-8 once per text."""
    rows = df.select(F.col(key).cast("long").alias(key), F.col(ids).alias("ids"))
    blocks = cut(rows.mapInArrow(_id_blocks, "block string, keys array<long>, sizes binary, codes binary, tokens array<long>"), "id-blocks")
    wanted = blocks.select("block", F.posexplode("tokens").alias("at", "token"))
    found = wanted.join(token_bytes(df.sparkSession, vocabulary), "token").groupBy("block").agg(F.collect_list(F.struct("at", "bytes")).alias("found"))
    joined = blocks.drop("tokens").join(found, "block", "left").select(
        "keys", "sizes", "codes", F.coalesce(F.col("found.at"), F.array().cast("array<int>")).alias("at"), F.coalesce(F.col("found.bytes"), F.array().cast("array<binary>")).alias("parts")
    )
    return joined.mapInArrow(_to_text(key, out), f"`{key}` long, `{out}` string")
