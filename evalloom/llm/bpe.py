"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The rank file is read on the driver, checked against a size bound and sent to the workers, so that
only the driver needs it. Long texts are cut where the pre-splitting pattern cannot match across, so
the pieces' ids are the whole text's ids; ids are decoded as raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.session import ship_package

# Fixed value: the public pattern whose matches end at the safe places below.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Between these characters every match of the pattern ends: no alternative runs from a non-space
#: into a space, or from a letter into a digit or back, and only runs of spaces look ahead.
SAFE_CUT = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
#: White space that is so long goes round the pattern: the library's regular expression recurses along a
#: run and overflows its stack near a million characters.
LONG_RUN = regex.compile(r"\p{White_Space}{4096,}")
MAX_RANK_BYTES = 64 << 20


def read_ranks(path: str, max_bytes: int = MAX_RANK_BYTES) -> bytes:
    with open(path, "rb") as f:
        ranks = f.read(max_bytes + 1)
    if len(ranks) > max_bytes:
        raise ValueError(f"{path} exceeds {max_bytes} bytes, the bound for what is sent to workers")
    return ranks


@lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """One encoding per worker process."""
    pairs = (line.split() for line in ranks.splitlines() if line)
    table = {base64.b64decode(token): int(rank) for token, rank in pairs}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def safe_pieces(text: str, size: int | None) -> Iterator[str]:
    """Cut ``text`` at the first safe place after every ``size`` characters; without a size, nowhere."""
    at = 0
    while size is not None and len(text) - at > size:
        cut = SAFE_CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def around_runs(text: str) -> Iterator[tuple[bool, str]]:
    """(is a long run, part): what the pattern's match on a run of white space is, is known without it: all
    of the run at the end of a text, all but its last character before anything else."""
    at = 0
    for run in LONG_RUN.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        yield False, text[at : run.start()]
        yield True, text[run.start() : stop]
        at = stop
    yield False, text[at:]


def encode_pieces(enc: tiktoken.Encoding, text: str, size: int | None) -> Iterator[list[int]]:
    for run, part in around_runs(text) if size is not None else [(False, text)]:
        if run:
            yield enc._encode_single_piece(part)
            continue
        for piece in safe_pieces(part, size):
            yield enc.encode_ordinary(piece)


SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_bpe(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    piece_chars: int = 1 << 16,
    digests: bool = False,
) -> DataFrame:
    """Ids and decoded bytes of every text, or with ``digests`` their SHA-256 instead.

    A null or empty text has no tokens and decodes to no bytes. Repeated rows are encoded row by row,
    other columns are ignored. A digest is fed piece by piece, so its memory does not grow with a
    text's tokens. No shuffle: each input batch is encoded where it is read. Texts are cut at safe
    places only for ``CUT_PATTERN``; with another pattern each text is encoded in one piece. Runs of white
    space of any length are encoded as the one match that they are.
    """
    spark = docs.sparkSession
    ship_package(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    size = piece_chars if pattern == CUT_PATTERN else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, pattern)
        names = [str(i) for i in range(enc.max_token_value + 1)]
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                yield (_digests if digests else _tokens)(part, enc, names, size)

    ready = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return ready.mapInArrow(rows, DIGESTS if digests else SCHEMA)


def _tokens(part: pa.RecordBatch, enc: tiktoken.Encoding, names: list[str], size: int | None) -> pa.RecordBatch:
    ids, decoded = [], []
    for text in part["text"].to_pylist():
        pieces = [np.array(p, np.int32) for p in encode_pieces(enc, text or "", size)]
        ids.append(np.concatenate(pieces))
        decoded.append(b"".join(enc.decode_bytes(p.tolist()) for p in pieces))
    return pa.RecordBatch.from_arrays(
        [part["doc_id"], pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())],
        ["doc_id", "n_tokens", "ids", "decoded"],
    )


def _digests(part: pa.RecordBatch, enc: tiktoken.Encoding, names: list[str], size: int | None) -> pa.RecordBatch:
    out: list[tuple[int, str, str]] = []
    for text in part["text"].to_pylist():
        n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
        for piece in encode_pieces(enc, text or "", size):
            if piece:
                ids.update(((" " if n else "") + " ".join([names[i] for i in piece])).encode())
                decoded.update(enc.decode_bytes(piece))
                n += len(piece)
        out.append((n, ids.hexdigest(), decoded.hexdigest()))
    cols = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays(
        [part["doc_id"], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )
