"""WARC archives: a writer with identical-payload revisits and a splittable reader.

Archive format: every WARC record is a gzip member of its own.  Spark's text writer
puts the members down as they are (one row is one member) through its own commit
protocol, so a lost executor leaves no half record; its line separator is an empty
gzip member, which every gzip reader passes over.

Reader: Spark's text reader deals out byte ranges and cuts them at the three bytes a
gzip member begins with (magic and the deflate method).  A cut is a candidate only:
the member after it is validated by decoding it, check sum included.  The three bytes
also occur by chance inside compressed data; a candidate that does not decode to its
end is continued by the next piece.  A task owns the records that start inside its
range; what it cannot finish (a chance cut beyond the end of its range) goes, as rows,
to a small second step that joins the pieces of neighbouring ranges.  File names must
not end in a suffix that Hadoop decompresses by itself (.gz).

Defined cases: null html is an empty payload; a null url is an empty target; rows with
equal payloads and equal smallest page_id are all responses; null page_ids come after
all others; an empty table writes an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territoria.llm.common import text_udf

MAGIC = b"\x1f\x8b\x08"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


EMPTY_MEMBER = _member(b"")
_BYTES = "ISO-8859-1"  # one character per byte

RECORD = ("page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, "
          "payload binary, digest_ok boolean")


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, page_id, url: str, digest: str, size: int, refers_to, block: bytes) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join((url or '').split())}",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """One record per row.  Of equal payloads the smallest page_id is the response, others revisit it;
    payloads below min_revisit_bytes are all responses."""
    def responses(rows: list) -> list:
        out = []
        for r in rows:
            payload = (r["html"] or "").encode()
            digest = _digest(payload)
            out.append({"digest": digest, "size": len(payload),
                        "member": _member(_record("response", r["page_id"], r["url"], digest, len(payload), None, _HTTP + payload))})
        return out

    def final(rows: list) -> list:
        out = []
        for r in rows:
            first = r["first_id"]
            if first is None or r["page_id"] == first:
                out.append(r["member"])
            else:
                out.append(_member(_record("revisit", r["page_id"], r["url"], r["digest"], r["size"], first, _HTTP)))
        return out

    base = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    sha = F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    # The digests alone are grouped; equal ones meet before the shuffle already.
    firsts = base.where(size >= min_revisit_bytes).groupBy(sha.alias("sha")).agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.where("n > 1").select("sha", "first_id", F.crc32("sha").alias("k"))
    made = text_udf(responses, "struct<digest: string, size: bigint, member: binary>")(F.struct("page_id", "url", "html"))
    rows = base.select("page_id", "url", sha.alias("sha"), made.alias("m"))
    rows = rows.select("page_id", "url", "sha", F.crc32("sha").alias("k"), "m.*")
    # (sha, k) is dealt anew on both sides, so a payload with very many copies can be split by the skew join.
    joined = rows.join(firsts, ["sha", "k"], "left")
    member = text_udf(final, "binary")(F.struct("page_id", "url", "digest", "size", "member", "first_id"))
    joined.select(member.alias("member")).select(F.col("member").cast("string").alias("value")) \
        .write.option("lineSep", EMPTY_MEMBER.decode(_BYTES)).option("encoding", _BYTES).text(path)


def _decode(data: bytes) -> tuple[str, bytes]:
    """("whole" | "part" | "bad", decoded bytes)."""
    z = zlib.decompressobj(31)
    try:
        out = z.decompress(data)
    except zlib.error:
        return "bad", b""
    return ("whole", out) if z.eof else ("part", b"")


def _parse(data: bytes) -> dict | None:
    """A row of RECORD, or None for what is no WARC record (the empty member)."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/"):
        return None
    field = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        field[name.strip().lower()] = value.strip()
    block = rest[:int(field.get("content-length", "0"))]
    _, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    kind = field.get("warc-type", "")
    digest = field.get("warc-payload-digest", "").removeprefix("sha1:")

    def number(s: str):
        s = s.removeprefix("<urn:page:").removesuffix(">")
        return int(s) if s.lstrip("-").isdigit() else None

    revisit = kind == "revisit"
    return {"page_id": number(field.get("warc-record-id", "")), "url": field.get("warc-target-uri"), "record_type": kind,
            "payload_digest": digest if revisit else _digest(payload),
            "payload_bytes": number(field.get("x-payload-length", "")) if revisit else len(payload),
            "refers_to": number(field.get("warc-refers-to", "")) if revisit else None,
            "payload": None if revisit else payload,
            "digest_ok": revisit or not digest or digest == _digest(payload)}


class _Range:
    """Puts together the pieces of one byte range, in order."""

    def __init__(self):
        self.head, self.pending, self.found = b"", None, False

    def piece(self, value: bytes):
        """Decoded members that end with this piece (at most one)."""
        if self.pending is not None:
            state, data = _decode(self.pending + MAGIC + value)
            if state == "whole":
                self.pending, self.found = None, True
                return data
            if state == "part":
                self.pending += MAGIC + value
                return None
            self._stray(self.pending)
            self.pending = None
        state, data = _decode(MAGIC + value)
        if state == "whole":
            self.found = True
            return data
        if state == "part":
            self.pending = MAGIC + value
        else:
            self._stray(MAGIC + value)
        return None

    def _stray(self, data: bytes) -> None:
        if not self.found:  # may end a member of the range before
            self.head += data


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rows of RECORD for every record in the archive files below path."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
                        ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("digest_ok", pa.bool_()),
                        ("file", pa.string()), ("start", pa.int64()), ("head", pa.binary()), ("tail", pa.binary()), ("found", pa.bool_())])
    none = dict.fromkeys(schema.names)

    def run(batches):
        at, rng = None, None

        def rest():
            if rng is not None and (rng.head or rng.pending):
                yield none | {"file": at[0], "start": at[1], "head": rng.head, "tail": rng.pending or b"", "found": rng.found}

        for batch in batches:
            out = []
            for f, s, v in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "value")), strict=True):
                if (f, s) != at:
                    out += rest()
                    at, rng = (f, s), _Range()
                    if s == 0:  # what stands before the first magic: nothing, in a gzip file
                        continue
                data = rng.piece(v)
                row = _parse(data) if data else None
                if row:
                    out.append(none | row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        out = list(rest())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, carry = [], b""
        for r in pdf.sort_values("start").itertuples():
            if carry:
                state, data = _decode(carry + r.head)
                if state == "whole":
                    row = _parse(data)
                    rows += [row] if row else []
                    carry = b""
                elif state == "part" and not r.found:
                    carry += r.head + r.tail  # the member fills this range and goes on
                    state, data = _decode(carry)
                    if state == "whole":
                        row = _parse(data)
                        rows += [row] if row else []
                        carry = b""
                    continue
            carry = r.tail
        return pd.DataFrame(rows, columns=schema.names[:8])

    lines = spark.read.option("lineSep", MAGIC.decode(_BYTES)).option("encoding", _BYTES).text(path)
    pieces = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    found = pieces.mapInArrow(run, RECORD + ", file string, start long, head binary, tail binary, found boolean")
    whole = found.where("file is null").drop("file", "start", "head", "tail", "found")
    rest = found.where("file is not null").groupBy("file").applyInPandas(stitch, RECORD)
    return whole.unionByName(rest)
