"""Blocks of documents and buckets of hashes: an exchange with a few bytes per key.

Several operators ask one question of every window of the corpus: does this hash occur elsewhere?
Rows of (hash, document, position) would move many times the input. Here the documents are dealt into
*blocks* by a hash of id and text. A block sends each *bucket* (a range of the hash space) its sorted
distinct hashes as delta-coded bytes, and the bucket answers with a few bits per hash, in the same
order. Where it matters who comes first, a hash comes with the place of its first row in the order of
ids. The number of blocks is all that the driver knows of them, and a block is a function of its rows
alone: no bounds are sampled, rows of one id (or of none) spread like any others, and a recomputed task
repeats what the lost one sent. Rows equal in both id and text would share a block; where there are more
of them than a few blocks hold rows, they are dealt as one row with their number, and each gets its result
afterwards.

A hash that occurs very often is sent once per block, so no bucket grows with a hash's frequency. The
number of request rows is what blocks times buckets could spoil: both grow with the square root of the
corpus, so that a request holds ``ROW_KEYS`` keys on average at any size.
"""

from __future__ import annotations

import ctypes
import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from evalloom.session import checkpoint, ship_package

#: The id that stands for null: rows without an id come first and share it.
NO_ID = -(1 << 63)
REQUEST = "bucket int, block int, body binary"
ANSWER = "block int, level int, bucket int, body binary"
BUCKET_KEYS = 1 << 20
ROW_KEYS = 16
#: Equal rows are dealt as one where they are more than so many times a block's mean number of rows.
MANY_BLOCKS = 4
LEAST_COPIES = 16
#: Copies that one row of an expanded result stands for until it is dealt out.
COPIES_AT_ONCE = 10_000

_LIBC = ctypes.CDLL(None)
_B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Blocks:
    """Documents dealt into blocks. ``frame`` has block, key (the id, null as NO_ID), tie (a hash of the
    text), doc_id and text (binary). Only the id and text columns of the input are used, whatever else
    it holds; with ``carry`` a whole row comes along as the struct ``row``. ``per_byte`` is how many
    keys a byte of text sends at most, about."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, block_bytes: int, per_byte: float, carry: bool = False):
        ship_package(docs.sparkSession)
        row = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
        rows = docs.select(
            F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"),
            F.col(id_col).cast("long").alias("doc_id"),
            F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
            *row,
        )
        self.row_field = rows.schema["row"] if carry else None
        tied = rows.withColumn("tie", F.xxhash64("text"))
        repeats = tied.groupBy("key", "tie").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
        total, n_rows, most = repeats.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        self.n_keys = max(2.0, total * per_byte)
        # A block and a bucket share n_keys / (blocks * buckets) keys: enough for one row of a request.
        self.grow = math.sqrt(max(1.0, ROW_KEYS * self.n_keys / (block_bytes * per_byte * BUCKET_KEYS)))
        self.n_blocks = max(1, math.ceil(total / (block_bytes * self.grow)))
        # Other columns tell carried rows apart, so that they need no collapsing; maps cannot be hashed.
        own = [docs[c] for c, kind in docs.dtypes if carry and not any(x in kind for x in ("map<", "variant"))]
        if own:
            tied = tied.withColumn("own", F.xxhash64(*[F.col(f"row.`{c}`") for c, kind in docs.dtypes if not any(x in kind for x in ("map<", "variant"))]))
        dealt_by = ["key", "tie", *(["own"] if own else [])]
        many = max(LEAST_COPIES, MANY_BLOCKS * n_rows // self.n_blocks)
        self.collapsed = most > many and (not carry or len(own) == len(docs.columns))
        if self.collapsed:
            # At most n_blocks / MANY_BLOCKS of them: a few bytes each, whatever the table's size.
            hot = F.broadcast(repeats.filter(F.col("n") > many).select("key", "tie"))
            dense = tied.join(hot, ["key", "tie"], "left_semi")
            whole = [c for c in tied.columns if c != "doc_id"]
            once = dense.groupBy(*whole).agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("copies"))
            tied = tied.join(hot, ["key", "tie"], "left_anti").withColumn("copies", F.lit(1).cast("long")).unionByName(once)
        self.frame = tied.withColumn("block", F.pmod(F.xxhash64(*dealt_by), F.lit(self.n_blocks)).cast("int")).drop("own")

    @property
    def bits(self) -> int:
        """Bits of the number of keys."""
        return max(1, math.ceil(math.log2(self.n_keys)))

    def bucket_bits(self, keys: int = BUCKET_KEYS, least: int = 6) -> int:
        return max(least, self.bits - int(math.log2(keys * self.grow)))

    def ask(self, fn: Callable[[Texts], Iterator[tuple[int, bytes]]]) -> DataFrame:
        """(bucket, body) of every block, without answers."""

        def apply(group: pa.Table) -> pa.Table:
            return _released(_requests(group, fn(Texts(group))))

        return self.frame.groupBy("block").applyInArrow(apply, REQUEST)

    def ask_with(self, answers: DataFrame, fn: Callable[[Texts, Answers], Iterator[tuple[int, bytes]]]) -> DataFrame:
        def apply(group: pa.Table, told: pa.Table) -> pa.Table:
            return _released(_requests(group, fn(Texts(group), Answers(told))))

        return self._with(answers).applyInArrow(apply, REQUEST)

    def finish(self, answers: DataFrame, fn: Callable[[Texts, Answers], pa.Table], schema: str | StructType) -> DataFrame:
        """A row of ``fn`` for each row of the input; where rows were collapsed, ``fn`` may say in a column
        ``copies`` how many rows each of its own stands for, else all copies have one result."""

        def apply(group: pa.Table, told: pa.Table) -> pa.Table:
            texts = Texts(group)
            out = fn(texts, Answers(told))
            if texts.copies is not None and "copies" not in out.column_names:
                out = out.append_column("copies", pa.array(texts.copies))
            return _released(out)

        if not self.collapsed:
            return self._with(answers).applyInArrow(apply, schema)
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        found = checkpoint(self._with(answers).applyInArrow(apply, StructType([*schema.fields, StructField("copies", LongType())])))
        several = found.filter("copies > 1")
        parts = several.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES_AT_ONCE))))
        parts = parts.repartition(max(1, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        left = F.least(F.lit(COPIES_AT_ONCE).cast("long"), F.col("copies") - F.col("part") * COPIES_AT_ONCE)
        each = parts.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), left)))
        return found.filter("copies = 1").select(*schema.names).unionAll(each.select(*schema.names))

    def _with(self, answers: DataFrame):
        return self.frame.groupBy("block").cogroup(answers.groupBy("block"))


def _released(out: pa.Table) -> pa.Table:
    """Give freed memory back before the next group: workers share their executor's limit."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim:
        trim(0)
    return out


def _requests(group: pa.Table, found: Iterator[tuple[int, bytes]]) -> pa.Table:
    found = list(found)
    block = group["block"][0].as_py() if group.num_rows else 0
    return pa.table(
        {
            "bucket": pa.array([b for b, _ in found], pa.int32()),
            "block": pa.array([block] * len(found), pa.int32()),
            "body": pa.array([x for _, x in found], pa.binary()),
        }
    )


def answer(requests: DataFrame, level: int, fn: Callable[[list[int], list[bytes]], list[bytes]]) -> DataFrame:
    """Answers of every bucket; ``fn`` gets the bodies in the order of their blocks."""

    def apply(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["block"].to_pylist(), group["body"].to_pylist(), strict=True))
        blocks = [b for b, _ in rows]
        told = fn(blocks, [x for _, x in rows])
        return _released(
            pa.table(
                {
                    "block": pa.array(blocks, pa.int32()),
                    "level": pa.array([level] * len(rows), pa.int32()),
                    "bucket": pa.array([group["bucket"][0].as_py()] * len(rows), pa.int32()),
                    "body": pa.array(told, pa.binary()),
                }
            )
        )

    return requests.groupBy("bucket").applyInArrow(apply, ANSWER)


class Texts:
    """The rows of one block in order: by id, then by a hash of the text, then by text."""

    def __init__(self, group: pa.Table):
        keys, texts = group["key"].to_pylist(), group["text"].to_pylist()
        ties = group["tie"].to_numpy().view(np.uint64) if group.num_rows else np.zeros(0, np.uint64)
        ranks = ties.tolist()
        order = sorted(range(len(keys)), key=lambda i: (keys[i], ranks[i], texts[i]))
        self.keys = np.array([keys[i] for i in order], np.int64)
        self.ties = (ties[order] >> np.uint64(32)).astype(np.uint32)
        self.texts: list[bytes] = [texts[i] for i in order]
        ids = group["doc_id"].to_pylist()
        self.ids = pa.array([ids[i] for i in order], pa.int64())
        self.rows = group["row"].take(order) if "row" in group.column_names else None
        self.copies = group["copies"].to_numpy()[order] if "copies" in group.column_names else None


class Answers:
    """The answers to one block: bodies by level, in the order of the buckets."""

    def __init__(self, told: pa.Table):
        rows = zip(told["level"].to_pylist(), told["bucket"].to_pylist(), told["body"].to_pylist(), strict=True)
        self.bodies: dict[int, list[bytes]] = {}
        for level, _, body in sorted(rows, key=lambda x: x[:2]):
            self.bodies.setdefault(level, []).append(body)

    def of(self, level: int) -> list[bytes]:
        return self.bodies.get(level, [])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def hashes(units: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, units), np.uint64, len(units))


def power(n: int, base: np.uint64 = _B) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def rolled(h: np.ndarray, length: int, base: np.uint64 = _B) -> np.ndarray:
    """Hash of the ``length`` units from every position, by doubling; beyond the end it means nothing."""
    out, have, cur, span = None, 0, h, 1
    while True:
        if length & span:
            out = cur if out is None else out * power(span, base) + _ahead(cur, have)
            have += span
        if have == length:
            return out
        cur = cur * power(span, base) + _ahead(cur, span)
        span *= 2


def checks(h: np.ndarray, length: int) -> np.ndarray:
    """Further 32 bits of the same windows, from numbers of their own."""
    return (mix(rolled(mix(h ^ _C), length, _C)) >> np.uint64(32)).astype(np.uint32)


def _ahead(a: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros_like(a)
    if n < len(a):
        out[: len(a) - n] = a[n:]
    return out


class Distinct:
    """Distinct keys in order, where each occurs first, how often, and the place of every key. With
    ``check``, keys are the same only if their checks are too."""

    def __init__(self, keys: np.ndarray, check: np.ndarray | None = None):
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        if check is not None:
            other = check[order]
            if (~new[1:] & (other[1:] != other[:-1])).any():
                order = np.lexsort((check, keys))
                ordered, other = keys[order], check[order]
                new[1:] = ordered[1:] != ordered[:-1]
            new[1:] |= other[1:] != other[:-1]
        at = np.flatnonzero(new)
        self.keys = ordered[at]
        self.first = np.minimum.reduceat(order, at) if len(at) else at
        self.counts = np.diff(np.append(at, len(keys)))
        self.place = np.empty(len(keys), np.int64)
        self.place[order] = np.cumsum(new) - 1


def pack(keys: np.ndarray) -> bytes:
    """Sorted numbers as differences of just so many bytes as the largest one needs."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    raw = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return struct.pack("<IB", len(keys), width) + raw.tobytes()


def unpack(body: bytes) -> tuple[np.ndarray, int]:
    """The numbers, and where the rest of the body begins."""
    n, width = struct.unpack_from("<IB", body)
    end = 5 + n * width
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :width] = np.frombuffer(body, np.uint8, n * width, 5).reshape(n, width)
    return np.cumsum(raw.view("<u8").ravel(), dtype=np.uint64), end


def slices(keys: np.ndarray, key_bits: int, bucket_bits: int) -> Iterator[tuple[int, slice]]:
    """Non-empty buckets of sorted keys."""
    shift = np.uint64(key_bits - bucket_bits)
    buckets = keys >> shift
    yield from runs(buckets)


def runs(values: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    at = np.flatnonzero(new).tolist()
    for a, b in zip(at, [*at[1:], len(values)], strict=False):
        yield int(values[a]), slice(a, b)


def send(keys: np.ndarray, key_bits: int, bucket_bits: int) -> Iterator[tuple[int, bytes]]:
    low = np.uint64((1 << (key_bits - bucket_bits)) - 1)
    for bucket, part in slices(keys, key_bits, bucket_bits):
        yield bucket, pack(keys[part] & low)


def shared_elsewhere(blocks: list[int], bodies: list[bytes]) -> list[bytes]:
    """A bit for every key: whether another block has it."""
    parts = [unpack(x)[0] for x in bodies]
    return _cut(repeated(np.concatenate(parts)), [len(x) for x in parts])


def repeated(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _cut(flags: np.ndarray, sizes: list[int]) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [np.packbits(flags[end - n : end]).tobytes() for n, end in zip(sizes, ends, strict=True)]


def send_first(found: Distinct, check: np.ndarray, row: np.ndarray, texts: Texts, key_bits: int, bucket_bits: int) -> Iterator[tuple[int, bytes]]:
    """Keys with their checks and the places of their first rows in the order of all rows: ids as
    differences, hashes of texts, and one small number per key that says which row is its first."""
    low = np.uint64((1 << (key_bits - bucket_bits)) - 1)
    order = texts.keys.view(np.uint64) ^ np.uint64(1 << 63)
    for bucket, part in slices(found.keys, key_bits, bucket_bits):
        rows, rank = np.unique(row[found.first[part]], return_inverse=True)
        kind = "<u2" if len(rows) <= 1 << 16 else "<u4"
        head = pack(found.keys[part] & low) + pack(order[rows])
        yield bucket, head + texts.ties[rows].astype("<u4").tobytes() + check[found.first[part]].astype("<u4").tobytes() + rank.astype(kind).tobytes()


def earlier_elsewhere(blocks: list[int], bodies: list[bytes]) -> list[bytes]:
    """A bit for every key of ``send_first``: whether another block has it in an earlier row. Rows with
    one id and one hash of the text come in the order of their blocks."""
    keys, check, ids, ties, owner, sizes = [], [], [], [], [], []
    for block, body in zip(blocks, bodies, strict=True):
        k, at = unpack(body)
        order, end = unpack(body[at:])
        at += end
        tie = np.frombuffer(body, "<u4", len(order), at)
        at += 4 * len(order)
        check.append(np.frombuffer(body, "<u4", len(k), at))
        rank = np.frombuffer(body, "<u2" if len(order) <= 1 << 16 else "<u4", len(k), at + 4 * len(k))
        keys.append(k)
        ids.append(order[rank])
        ties.append(tie[rank])
        owner.append(np.full(len(k), block, np.int32))
        sizes.append(len(k))
    columns = [np.concatenate(x) for x in (owner, ties, ids, check, keys)]
    out = np.zeros(len(columns[0]), bool)
    several = np.flatnonzero(repeated(columns[-1]))
    columns = [x[several] for x in columns]
    order = np.lexsort(columns)
    same = (columns[-1][order[1:]] == columns[-1][order[:-1]]) & (columns[-2][order[1:]] == columns[-2][order[:-1]])
    out[several[order[1:][same]]] = True
    return _cut(out, sizes)


def read_bits(bodies: list[bytes], sizes: list[int], per_key: int) -> list[np.ndarray]:
    """The bits of one block's answers: one array for each bit, over all its keys."""
    out: list[list[np.ndarray]] = [[] for _ in range(per_key)]
    for body, n in zip(bodies, sizes, strict=True):
        raw = np.frombuffer(body, np.uint8)
        step = (n + 7) // 8
        for i in range(per_key):
            out[i].append(np.unpackbits(raw[i * step : (i + 1) * step], count=n).astype(bool))
    return [np.concatenate(x) if x else np.zeros(0, bool) for x in out]
