"""WARC archives: writing with an index, reading by coalesced byte ranges."""

import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from scenegrade.llm.common import open_storage, pick, shared_folder, stored, tasks_for

#: Bytes after which a new archive begins; gap between two records that is read along; most bytes of one read.
ARCHIVE_BYTES, GAP, READ_BYTES = 32 << 20, 64 << 10, 8 << 20
#: Payloads under this size are never replaced by a revisit record.
LEAST_REVISIT = 100
CONTROLS = re.compile("[\x00-\x20\x7f]")


def roles(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Adds payload (bytes), payload_bytes, payload_digest, and refers_to: the response's id for revisits, else null.

    Of rows with equal payloads of at least `least` bytes, the smallest page_id is the response. Repeated rows of
    that id are responses as well. Digests are grouped with partial sums; only digests that occur twice are joined
    back, as a skew-safe join.
    """
    rows = pick(pages, page_id="page_id", url="url", html="html").withColumn("payload", F.coalesce("html", F.lit("")).cast("binary"))
    rows = rows.drop("html").withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", F.sha2("payload", 256))
    long = rows.filter(F.col("payload_bytes") >= least)
    shared = long.groupBy("payload_digest").agg(F.min("page_id").alias("response"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    out = rows.join(shared, "payload_digest", "left")
    return out.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))).drop("response")


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def name_of(page_id, digest: str, place: str) -> str:
    """URN of a record: the page, and the place of the record, so that rows with equal ids have records of their own."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest[:16]}{place}>"


def record(page_id, url, payload: bytes, digest: str, refers_to, place: str = "") -> bytes:
    """One record as its own gzip member: the HTTP response with the payload, or for a revisit no block, but the page and
    full digest of the response. `place` tells records of equal pages apart."""
    kind = "response" if refers_to is None else "revisit"
    block = HTTP % len(payload) + payload if refers_to is None else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name_of(page_id, digest, place)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + CONTROLS.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name_of(refers_to, digest, '')}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def parse(data: bytes) -> tuple[dict, bytes]:
    """Headers and payload of one gzip member; a revisit has no payload."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


INDEX = "page_id bigint, url string, archive string, offset bigint, length bigint, payload_bytes bigint, payload_digest string, record_type string"


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes a record per row to archives in `folder`, and the index beside them, which is returned.

    The index holds url, archive, offset, length and payload digest of each record. Null html is empty, null urls get no
    target header. An archive belongs to one task attempt, and only attempts that succeed get into the index.
    """
    rows = roles(pages, least).select(F.col("page_id").cast("bigint"), "url", "payload", "payload_bytes", "payload_digest", F.col("refers_to").cast("bigint"))

    def run(batches):
        part, out, path, size = TaskContext.get().partitionId(), None, None, 0
        seen: set = set()  # of the archive at hand
        for batch in batches:
            made = []
            ids, urls, digests, refers = (batch.column(c).to_pylist() for c in ("page_id", "url", "payload_digest", "refers_to"))
            payloads = batch.column("payload")
            for k, page_id in enumerate(ids):
                if out is None or size >= archive_bytes:
                    if out:
                        out.close()
                    path, size = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.warc.gz", 0
                    seen.clear()
                    fs, name = open_storage(path)
                    fs.create_dir(name.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(name, compression=None)
                again = (page_id, digests[k]) in seen
                seen.add((page_id, digests[k]))
                place = f":{uuid.uuid4().hex}" if again or page_id is None else ""
                data = record(page_id, urls[k], payloads[k].as_py(), digests[k], refers[k], place)
                out.write(data)
                made.append((path, size, len(data), "response" if refers[k] is None else "revisit"))
                size += len(data)
            if made:
                archive, offset, length, kind = map(list, zip(*made))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(archive), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), batch.column("payload_bytes"), batch.column("payload_digest"), pa.array(kind)],
                    names=[c.split()[0] for c in INDEX.split(", ")],
                )
        if out:
            out.close()

    return stored(rows.mapInArrow(run, INDEX), "index", f"{folder}/index.parquet")


def ranges(offsets: list[int], lengths: list[int], gap: int = GAP, most: int = READ_BYTES) -> list[tuple[int, int]]:
    """Slices [a, b) of sorted records that one read covers: neighbours with small gaps, up to `most` bytes."""
    out, a = [], 0
    for b in range(1, len(offsets) + 1):
        if b == len(offsets) or offsets[b] - offsets[b - 1] - lengths[b - 1] > gap or offsets[b] + lengths[b] - offsets[a] > most:
            out.append((a, b))
            a = b
    return out


def read_records(index: DataFrame) -> DataFrame:
    """page_id, url, payload (of the record itself), payload_digest, record_type, refers_to of the selected index rows.

    Everything returned comes from the archives. Index rows are sorted by archive and offset, and ranges that lie close
    are read at once.
    """
    rows = index.select("archive", "offset", "length").repartitionByRange(tasks_for(index), "archive", "offset").sortWithinPartitions("archive", "offset")

    def number(name):
        page = name.removeprefix("<urn:page:").partition(":")[0] if name else ""
        return int(page) if page else None

    def run(batches):
        file, path = None, None
        for batch in batches:
            archives, offsets, lengths = (batch.column(c).to_pylist() for c in ("archive", "offset", "length"))
            a = 0
            while a < len(archives):
                b = a
                while b < len(archives) and archives[b] == archives[a]:
                    b += 1
                if archives[a] != path:
                    path = archives[a]
                    fs, name = open_storage(path)
                    file = fs.open_input_file(name)
                for i, j in ranges(offsets[a:b], lengths[a:b]):
                    start = offsets[a + i]
                    data = file.read_at(offsets[a + j - 1] + lengths[a + j - 1] - start, start)
                    found = []
                    for k in range(a + i, a + j):
                        fields, block = parse(data[offsets[k] - start :][: lengths[k]])
                        found.append((number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), block, fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"], number(fields.get("WARC-Refers-To"))))
                    columns = list(map(list, zip(*found)))
                    kinds = [pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["page_id", "url", "payload", "payload_digest", "record_type", "refers_to"])
                a = b

    return rows.mapInArrow(run, "page_id bigint, url string, payload binary, payload_digest string, record_type string, refers_to bigint")


def archive_digests(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from the archives read back.

    A response's length and digest are taken from its bytes. A revisit's length comes from the response that it refers to.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    records = read_records(write_archives(pages, folder))
    measured = records.select("page_id", F.octet_length("payload").cast("bigint").alias("n"), F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")
    measured = stored(measured, "records")
    responses = measured.filter("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("n").alias("full"))
    joined = measured.join(responses, ["refers_to", "payload_digest"], "left")
    return joined.select("page_id", F.coalesce("full", "n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
