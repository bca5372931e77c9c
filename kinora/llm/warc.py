"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Archives are written by Spark's text sink with the record end as line separator, one uncompressed file per partition,
to the session's shared folder.  For reading, the text source splits the files among the tasks wherever the record
magic occurs, also inside payloads.  Every piece is a candidate: from its header a task derives the offset at which its
successor has to start.  Pointer jumping from the file's start over these offsets, within splits and then over the
offsets at which chains leave a split, keeps only reachable records.  A record that holds the magic in its payload comes
in several pieces; their bytes are kept at the first reading, and joined.

Defined results: a null html is an empty payload; a page without an id keeps its row with a null id and is never
referred to; repeated pages each have a record, those with the smallest id of equal payloads all being responses;
control characters in a url are escaped in its header.  Bytes that no chain reaches are left out.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinora.session import discard, remove, shared_folder, stored

MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
#: Rows that a broadcast table may have; beyond that the join shuffles.
BROADCAST_ROWS = 200_000
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """A header line, none if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, and refers_to: the smallest page_id of an equal payload."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2(F.col("payload").cast("binary"), 256)})
    equal = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    equal = stored(equal.where("n > 1 and first is not null").select("payload_digest", "first"), "equal")
    joined = rows.join(F.broadcast(equal) if equal.count() <= BROADCAST_ROWS else equal, "payload_digest", "left")
    return joined.withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("first")


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z") -> str:
    """Write a record per row of ``pages``; returns the folder of the archives."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = with_revisits(pages)
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.col(c).cast("string"), F.lit(">"))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), "[\\x00-\\x1F]", "%20")
    head = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.coalesce(name("page_id"), F.lit("<urn:x-page:>"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", name("refers_to")), _line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))).cast("string")),
        F.lit("\r\n"),
    )
    record = F.concat(head, http, F.when(revisit, "").otherwise(F.col("payload")))
    rows.select(record.alias("value")).write.option("lineSep", END).text(folder)
    return folder


_FIELD = re.compile(rb"(?im)^(WARC-Type|WARC-Record-ID|WARC-Refers-To|WARC-Payload-Digest|Content-Length):[ \t]*([^\r\n]*)")
_PAGE = re.compile(rb"<urn:x-page:(-?\d+)>")


def parse(piece: bytes) -> dict | None:
    """Header fields of what follows the magic, the bytes of the whole record, and its block as far as it is here."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {k.lower(): v for k, v in _FIELD.findall(b"\n" + piece[:end])}
    if not fields.get(b"content-length", b"").strip().isdigit():
        return None
    length = int(fields[b"content-length"])
    page, refers = (_PAGE.search(fields.get(k, b"")) for k in (b"warc-record-id", b"warc-refers-to"))
    return {
        "record_bytes": len(MAGIC) + end + 4 + length + 4,
        "record_type": fields.get(b"warc-type", b"").decode("latin-1").strip(),
        "page_id": int(page[1]) if page else None,
        "refers_to": int(refers[1]) if refers else None,
        "declared": fields.get(b"warc-payload-digest", b"").decode("latin-1").strip().removeprefix("sha256:"),
        "block": piece[end + 4 : end + 4 + length],
    }


def payload(record: dict) -> tuple[int, str]:
    """Bytes and digest of the payload; a revisit names them instead of holding it."""
    head, _, body = record["block"].partition(b"\r\n\r\n")
    if record["record_type"] == "revisit":
        length = re.search(rb"(?im)^Content-Length:[ \t]*(\d+)", head)
        return int(length[1]) if length else 0, record["declared"]
    return len(body), hashlib.sha256(body).hexdigest()


CANDIDATE = "file string, split long, place long, size long, record_bytes long, record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string, value binary"
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
_NAMES = [x.split()[0] for x in CANDIDATE.split(", ")]
CHAINED = "file string, split long, place long, size long, start long, record_bytes long, head boolean, whole boolean"
RECORD = "file string, start long, record_type string, page_id long, payload_bytes long, payload_digest string, refers_to long"


def _placed(batch: pa.RecordBatch, at: dict) -> Iterator[tuple[str, int, int, bytes]]:
    """Rows with their offset from the first piece of their split; a task reads a split in order."""
    for file, split, value in zip(batch.column("file").to_pylist(), batch.column("split").to_pylist(), batch.column("value").to_pylist()):
        if at.get("split") != (file, split):
            at["split"], at["place"], at["open"] = (file, split), 0, 0
        yield file, split, at["place"], value
        at["place"] += len(value) + len(MAGIC)


def candidates(spark: SparkSession, folder: str, every_value: bool = False) -> DataFrame:
    """What lies between two magics, with its file, the start of the split that it was read in, and what its header
    declares; stored.  A piece that holds a whole record has its payload's digest, others have their bytes, as have those
    that lie within what an unfinished record before them in the split declares, or with ``every_value`` all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict = {}
        for batch in batches:
            rows = []
            for file, split, place, value in _placed(batch, at):
                record = parse(value)
                whole = record is not None and record["record_bytes"] == len(MAGIC) + len(value)
                inside = place < at["open"]
                if record is not None and not whole:
                    at["open"] = max(at["open"], place - len(MAGIC) + record["record_bytes"])
                told = (None,) * 4 if record is None else (record["record_bytes"], record["record_type"], record["page_id"], record["refers_to"])
                rows.append((file, split, place, len(value), *told, *(payload(record) if whole else (None, None)), value if every_value or inside or not whole else None))
            columns = list(zip(*rows)) or [()] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=_NAMES)

    read = spark.read.option("lineSep", MAGIC).text(folder)
    pieces = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))
    return stored(pieces.mapInArrow(run, CANDIDATE), "pieces", compression="zstd")


def followers(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the ascending ``starts`` each end is; their number if none."""
    n = len(starts)
    to = np.searchsorted(starts, ends)
    found = to < n
    found[found] = starts[to[found]] == ends[found]
    return np.where(found, to, n)


def reachable(starts: np.ndarray, ends: np.ndarray, entry: int = 0) -> np.ndarray:
    """Which of the ascending ``starts`` a chain from offset ``entry`` reaches: pointer jumping, doubling the distance."""
    n = len(starts)
    reached = np.zeros(n + 1, dtype=bool)
    reached[:n] = starts == entry
    to = np.append(followers(starts, ends), n)
    for _ in range(max(1, int(n).bit_length() + 1)):
        reached[to[reached]] = True
        to = to[to]
    return reached[:n]


def last_of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each of the ascending ``starts`` which of them its chain ends with: pointer jumping."""
    n = len(starts)
    to = followers(starts, ends)
    to = np.where(to < n, to, np.arange(n))
    for _ in range(max(1, int(n).bit_length() + 1)):
        to = to[to]
    return to


def _headed(pieces: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``pieces`` of those with a header, and their records' starts and ends."""
    at = np.flatnonzero(pieces["record_bytes"].notna().to_numpy() & (pieces["start"].to_numpy() >= 0))
    starts = pieces["start"].to_numpy()[at]
    return at, starts, starts + pieces["record_bytes"].to_numpy()[at].astype(np.int64)


def small_joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a stored ``right``: broadcast if its counted rows are few enough, else by a shuffle of both."""
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, on, how)


def verify(found: DataFrame) -> DataFrame:
    """The pieces of each file's chain (see CHAINED): heads of records, ``whole`` or not, and what unfinished ones go on in,
    which comes with their ``start``; stored.

    Chains are followed split by split.  Within a split every candidate is led to where its chain leaves the split; a
    file's chain then goes over those few offsets alone, from split to split; last, each split keeps what is reached from
    where that chain enters it.
    """
    key, before = ["file", "split"], Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    found = found.select(*key, "place", "size", "record_bytes", F.col("payload_bytes").isNotNull().alias("whole"))
    splits = found.groupBy(*key).agg(F.max(F.col("place") + F.col("size") + len(MAGIC)).alias("bytes"))
    splits = stored(splits.select(*key, (F.coalesce(F.sum("bytes").over(before), F.lit(0)) - len(MAGIC)).alias("base")), "splits")
    start = (F.col("base") + F.col("place")).alias("start")

    def leave(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("place")
        _, starts, ends = _headed(pieces)
        last = last_of(starts, ends)
        return pd.DataFrame({"file": pieces["file"].iloc[0], "split": pieces["split"].iloc[0], "start": starts, "last": starts[last], "leaves": ends[last]})

    led = small_joined(found, splits, key).select(*key, "place", "record_bytes", start)
    led = stored(led.groupBy(*key).applyInPandas(leave, "file string, split long, start long, last long, leaves long"), "led")
    entries = led.select("file", F.col("leaves").alias("start")).unionByName(splits.select("file", F.lit(0).cast("long").alias("start")))
    entries = stored(entries.distinct(), "entries")

    def chain(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("start")
        return nodes[reachable(nodes["start"].to_numpy(), nodes["leaves"].to_numpy())]

    entered = small_joined(led, entries, ["file", "start"]).select(led.columns).groupBy("file").applyInPandas(chain, led.schema)
    entered = entered.groupBy(*key).agg(F.min("start").alias("entry"), F.max("last").alias("last"))
    entered = splits.join(entered, key, "left").select(*key, "base", "entry", F.last("last", ignorenulls=True).over(before).alias("open"))
    entered = stored(entered, "entered")

    def keep(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("place")
        at, starts, ends = _headed(pieces)
        head = np.zeros(len(pieces), dtype=bool)
        entry, begun = pieces["entry"].iloc[0], pieces["open"].iloc[0]
        if not pd.isna(entry):
            head[at[reachable(starts, ends, int(entry))]] = True
        owner, first = np.cumsum(head) - 1, np.append(np.flatnonzero(head), 0)
        start = np.where(owner >= 0, pieces["start"].to_numpy()[first[owner]], -1 if pd.isna(begun) else int(begun))
        whole = pieces["whole"].to_numpy()
        out = pieces.assign(start=start, head=head, whole=head & whole)
        return out[head | (start >= 0) & ~((owner >= 0) & whole[first[owner]])][[x.split()[0] for x in CHAINED.split(", ")]]

    kept = stored(small_joined(found, entered, key).withColumn("start", start).groupBy(*key).applyInPandas(keep, CHAINED), "chains")
    discard(splits, led, entries, entered)
    return kept


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record (see RECORD).

    All of a record comes from one reading of the archives, however they are split.  Only if a record that goes on in
    another split holds whole records there, the archives are read once more, with the bytes of all pieces.
    """
    piece, names = ["file", "split", "place"], [x.split()[0] for x in RECORD.split(", ")]

    def joined(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["split", "place"])
        record = parse(MAGIC.encode().join(pieces["value"]))
        size, digest = payload(record)
        return pd.DataFrame([(pieces["file"].iloc[0], pieces["start"].iloc[0], record["record_type"], record["page_id"], size, digest, record["refers_to"])], columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    for every_value in (False, True):
        found = candidates(spark, folder, every_value)
        chains = verify(found)
        heads = stored(chains.where("head and whole").select(*piece, "start").join(found.drop("value"), piece).select(*names), "whole")
        begun = stored(chains.where("head and not whole").select("file", "start", (F.col("start") + F.col("record_bytes")).alias("end")), "begun")
        # pieces beyond an unfinished record's end, which no chain reaches, belong to nothing
        before = Window.partitionBy("file", "start").orderBy("split", "place").rowsBetween(Window.unboundedPreceding, -1)
        parts = small_joined(chains.where("not whole").select(*piece, "start", "size"), begun, ["file", "start"])
        parts = parts.withColumn("at", F.col("start") + F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(before), F.lit(0))).where("at < end")
        parts = stored(parts.select(*piece, "start").join(found.select(*piece, "value"), piece), "parts")
        if every_value or parts.where("value is null").isEmpty():
            break
        discard(found, chains, heads, begun, parts)
    rest = stored(parts.groupBy("file", "start").applyInPandas(joined, RECORD), "records")
    if heads.count() + rest.count() != chains.where("head").count():
        raise ValueError("records were lost between the steps")
    discard(found, chains, begun, parts)
    return heads.unionByName(rest)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark, folder = pages.sparkSession, write_archives(pages)
    found = read_archives(spark, folder)
    remove(spark, folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
