"""Exact duplicates by an exchange of compressed fingerprints.

Texts are equal when identical after lower-casing A-Z. Each task hashes its rows
without moving a text, sorts its distinct fingerprints and sends each owner (a range
of the fingerprint space) its part as Golomb-Rice codes. Owners count a fingerprint
over all senders and answer each with a bitmap: which of the fingerprints sent occur
more than once. Only rows whose bit is set are suspects; their texts alone are
shuffled and compared byte by byte. All other rows are done.

A third of all rows with one text: a sender names a fingerprint once, with a mark
that it holds several; the byte comparison collapses equal texts in each task before
its shuffle; the join that hands groups out is one that AQE splits.

Null text counts as empty. Of equal texts the row with the largest doc_id stays
(null ids are smaller than all others; of repeated rows with that id, one). An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.batches import slices
from strataflow.session import scratch_path

#: Bits of a fingerprint. Equal ones of different texts only cost a comparison.
BITS = 48
#: Rows whose fingerprints one sender sorts together.
SENDER_ROWS = 65_536
#: The suspects' bit map has 2 ** MAP_BITS bits: 2 MB, whatever the number of rows.
MAP_BITS = 24

# --- Golomb-Rice codes of sorted numbers


def encode_gaps(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Sorted distinct numbers as (width, quotients in unary, remainders): gaps cut at 2**width.

    Quotients and remainders lie in streams of their own, so both decode in numpy.
    """
    gaps = np.diff(values, prepend=0)
    mean = max(1, int(values[-1]) // len(values))
    width = max(0, mean.bit_length() - 1)
    quotient = (gaps >> width).astype(np.int64)
    unary = np.ones(int(quotient.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 0
    bits = (gaps[:, None] >> np.arange(width)[None, :]) & 1
    return width, np.packbits(unary).tobytes(), np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def decode_gaps(n: int, width: int, quotients: bytes, remainders: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(quotients, np.uint8)) == 0)[:n]
    quotient = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(remainders, np.uint8))[: n * width].reshape(n, width).astype(np.int64)
    return np.cumsum((quotient.astype(np.int64) << width) + (bits << np.arange(width)[None, :]).sum(1))


# --- what a task makes of its rows

_PRINTS = (
    "kind string, sender bigint, owner int, n int, width int, quotients binary, remainders binary, several binary,"
    " row_no bigint, place int, doc_id bigint, text_sha256 string, text_key bigint"
)
_SCHEMA = pa.schema(
    [
        ("kind", pa.string()),
        ("sender", pa.int64()),
        ("owner", pa.int32()),
        ("n", pa.int32()),
        ("width", pa.int32()),
        ("quotients", pa.binary()),
        ("remainders", pa.binary()),
        ("several", pa.binary()),
        ("row_no", pa.int64()),
        ("place", pa.int32()),
        ("doc_id", pa.int64()),
        ("text_sha256", pa.string()),
        ("text_key", pa.int64()),
    ]
)


def _filled(length: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(length, f.type) for f in _SCHEMA],
        schema=_SCHEMA,
    )


def _send(sender: int, ids: list, keys: list, digests: list[bytes], owners: int) -> Iterator[pa.RecordBatch]:
    """A sender's rows with the place of each one's fingerprint, and its message to each owner."""
    prints = np.frombuffer(b"".join(d[:8] for d in digests), ">u8") >> np.uint64(64 - BITS)
    prints = prints.astype(np.int64)
    unique, back, count = np.unique(prints, return_inverse=True, return_counts=True)
    owner = (unique * owners) >> BITS
    first = np.searchsorted(owner, np.arange(owners + 1))
    place = np.arange(len(unique)) - first[owner]
    n = len(digests)
    yield _filled(
        n,
        kind=["row"] * n,
        sender=np.full(n, sender),
        owner=owner[back],
        row_no=np.arange(n),
        place=place[back],
        doc_id=ids,
        text_sha256=[d.hex() for d in digests],
        text_key=keys,
    )
    used = np.flatnonzero(np.diff(first))
    packed = [encode_gaps(unique[first[o] : first[o + 1]] - -(-(int(o) << BITS) // owners) + 1) for o in used]
    yield _filled(
        len(used),
        kind=["sent"] * len(used),
        sender=np.full(len(used), sender),
        owner=used,
        n=np.diff(first)[used],
        width=[w for w, _, _ in packed],
        quotients=[q for _, q, _ in packed],
        remainders=[r for _, _, r in packed],
        several=[np.packbits(count[first[o] : first[o + 1]] > 1).tobytes() for o in used],
    )


def fingerprints(docs: DataFrame, owners: int) -> DataFrame:
    """Rows and messages of all senders; a sender is a part of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        ids: list = []
        keys: list = []
        digests: list[bytes] = []
        for part, texts in slices(batches):
            ids += part.column("doc_id").to_pylist()
            keys += part.column("text_key").to_pylist()
            digests += [hashlib.sha256(_folded(t)).digest() for t in texts]
            while len(digests) >= SENDER_ROWS:
                head = (ids[:SENDER_ROWS], keys[:SENDER_ROWS], digests[:SENDER_ROWS])
                yield from _send(task << 24 | k, *head, owners)
                del ids[:SENDER_ROWS], keys[:SENDER_ROWS], digests[:SENDER_ROWS]
                k += 1
        if digests:
            yield from _send(task << 24 | k, ids, keys, digests, owners)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, _PRINTS)


def _folded(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased, all else as it is."""
    return text.encode().lower()


def _bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``text_sha256, body`` of the texts whose digest may be in ``wanted``.

    A bit map of fixed size, by the digest's first bits, keeps other texts out; few
    pass beside those wanted, and an exact join follows.
    """
    spot = F.conv(F.substring("text_sha256", 1, MAP_BITS // 4), 16, 10).cast("bigint") + 1
    parts = (
        wanted.select(spot.alias("spot"))
        .groupBy(F.bitmap_bucket_number("spot").alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
        .collect()  # at most 2 ** MAP_BITS bits
    )
    marks = np.zeros(1 << MAP_BITS - 3, np.uint8)
    for r in parts:
        at = (r["part"] - 1) * len(r["bits"])
        marks[at : at + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            found: list[tuple[str, bytes]] = []
            for t in texts:
                body = _folded(t)
                digest = hashlib.sha256(body).digest()
                n = int.from_bytes(digest[:4], "big") >> 32 - MAP_BITS
                if marks[n >> 3] >> (n & 7) & 1:
                    found.append((digest.hex(), body))
            yield pa.RecordBatch.from_pydict(
                {
                    "text_sha256": pa.array([d for d, _ in found], pa.string()),
                    "body": pa.array([b for _, b in found], pa.binary()),
                }
            )

    return docs.select("text").mapInArrow(run, "text_sha256 string, body binary")


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmaps: which fingerprints of each sender are held more than once."""
    got = [decode_gaps(*m) for m in zip(pdf["n"], pdf["width"], pdf["quotients"], pdf["remainders"])]
    several = [np.unpackbits(np.frombuffer(s, np.uint8))[:n] for s, n in zip(pdf["several"], pdf["n"])]
    everything = np.concatenate(got)
    _, back, senders = np.unique(everything, return_inverse=True, return_counts=True)
    twice = np.bincount(back, np.concatenate(several)) > 0
    bits = ((senders > 1) | twice)[back]
    ends = np.cumsum(pdf["n"].to_numpy())
    bitmaps = [np.packbits(bits[e - n : e]).tobytes() for e, n in zip(ends, pdf["n"])]
    return pd.DataFrame({"sender": pdf["sender"], "owner": pdf["owner"], "bitmap": bitmaps})


def deduplicate(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, text_key``: one row per row of ``docs``."""
    spark = docs.sparkSession
    owners = owners or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = scratch_path(spark, "fingerprints")
    # written once: senders, places and row numbers stay the same whatever task is run again
    fingerprints(docs, owners).write.parquet(path, partitionBy="kind")
    made = spark.read.schema(_PRINTS).parquet(path)
    sent, rows = made.where("kind = 'sent'"), made.where("kind = 'row'")
    answers = (
        sent.select("sender", "owner", "n", "width", "quotients", "remainders", "several")
        .groupBy("owner")
        .applyInPandas(_answer, "sender bigint, owner int, bitmap binary")
    )
    byte = "conv(hex(substring(bitmap, place DIV 8 + 1, 1)), 16, 10)"
    marked = (
        rows.select("sender", "owner", "row_no", "place", "doc_id", "text_sha256", "text_key")
        .join(answers, ["sender", "owner"])
        .withColumn("suspect", F.expr(f"CAST({byte} AS INT) >> (7 - place % 8) & 1 = 1"))
        .drop("bitmap", "owner", "place")
    )
    alone = marked.where("NOT suspect").selectExpr(
        "doc_id", "doc_id AS keep_id", "1L AS group_size", "true AS kept", "text_sha256", "text_key"
    )
    suspects = marked.where("suspect")
    # the suspects' texts, compared byte by byte: equal ones collapse in each task before they are sent
    wanted = suspects.select("text_sha256").distinct()
    texts = _bodies(docs, wanted).join(wanted, "text_sha256", "left_semi")
    equal = texts.groupBy("body", "text_sha256").agg(F.count("*").alias("group_size")).drop("body")
    # two texts of one digest would be two rows here: then the digest can't stand for the text, and the query says so
    sizes = equal.groupBy("text_sha256").agg(F.max("group_size").alias("group_size"), F.count("*").alias("texts"))
    verified = sizes.withColumn(
        "group_size",
        F.when(F.col("texts") == 1, F.col("group_size")).otherwise(
            F.raise_error(F.concat(F.lit("two texts share the digest "), "text_sha256")).cast("bigint")
        ),
    ).drop("texts")
    stays = suspects.groupBy("text_sha256").agg(
        F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", "sender", "row_no")).alias("stays")
    )
    groups = verified.join(stays, "text_sha256")
    grouped = suspects.join(groups, "text_sha256").selectExpr(
        "doc_id",
        "stays.doc_id AS keep_id",
        "group_size",
        "sender = stays.sender AND row_no = stays.row_no AS kept",
        "text_sha256",
        "text_key",
    )
    return alone.unionByName(grouped)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are; of repeated rows one."""
    decided = deduplicate(docs).groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    stay = decided.agg(F.max("kept").alias("stays"), F.count("*").alias("copies")).where("stays")
    # the row as one column beside new ones: its own names can't clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("key"))
    kept = rows.join(stay, same)
    several = kept.where("copies > 1").withColumns({"id": F.col("row.doc_id"), "text": F.col("row.text")})
    several = several.dropDuplicates(["id", "text"])
    return kept.where("copies = 1").select("row").unionByName(several.select("row")).select("row.*")
