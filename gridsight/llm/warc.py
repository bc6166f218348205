"""Web archives (WARC 1.1) as files of Zstandard frames, written and read by Spark tasks.

An archive starts with a skippable frame that holds the compression dictionary, then has one frame per record, so a
record can be read at its offset alone. Tasks write to the shared folder under names of their own attempt; the
manifest, committed by Spark, lists the files of the attempts that counted. The reader streams one frame at a time.

Payloads are stored whole. A null payload is an empty one, a null url or page_id gives a record without that header
and comes back as null. Of records with equal payloads of at least ``least_bytes`` bytes, those of the smallest
page_id are responses (rows that repeat this page_id, too) and all others are revisits of it. Other columns are ignored.
"""
import hashlib
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from ..operators.common import col
from .common import in_batches, read_file, shared_folder, stored, write_file

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIPPABLE = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, records long, bytes long"
RECORD = "path string, offset long, record_type string, record_id string, url string, page_id long, refers_to long, payload_bytes long, payload_digest string"


def record_id(page_id):
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def build_record(kind, headers, block):
    lines = [VERSION, b"WARC-Type: " + kind.encode()]
    lines += [f"{k}: {v}".encode() for k, v in headers if v is not None]
    lines += [b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(value):
    """Header values keep to one line."""
    return None if value is None else "".join(f"%{ord(c):02X}" if c < " " else c for c in value).strip()


def page_record(page_id, url, payload, digest, refers_to):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    headers = [
        ("WARC-Record-ID", record_id(page_id if page_id is not None else uuid.uuid4())), ("WARC-Date", DATE), ("WARC-Target-URI", _one_line(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Page-ID", page_id),
        ("WARC-Profile", PROFILE if revisit else None), ("WARC-Refers-To", record_id(refers_to) if revisit else None),
        ("Refers-To-Page-ID", refers_to), ("Content-Type", "application/http; msgtype=response")]
    return build_record("revisit" if revisit else "response", headers, http if revisit else http + payload)


def parse_record(data):
    """(kind, headers, block) of one record; raises ValueError unless version, headers and lengths are as they must be."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise ValueError("not a WARC/1.1 record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"malformed header {line[:80]!r}")
        if headers.setdefault(name.decode().lower(), value.strip().decode()) != value.strip().decode():
            raise ValueError(f"two values of header {name!r}")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"no header {name}")
    if not headers["content-length"].isdigit():
        raise ValueError("Content-Length is no number")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {size}, but the block has {len(rest) - 4} bytes")
    return headers["warc-type"], headers, rest[:size]


def page_row(kind, headers, block):
    """The fields of a response or revisit; raises ValueError if the payload is not the one its headers state."""
    head, found, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    if not found or not head.startswith(b"HTTP/1.1 ") or not fields.get(b"Content-Length", b"").isdigit():
        raise ValueError("no HTTP head")
    size, digest = int(fields[b"Content-Length"]), headers.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "revisit":
        if payload or headers.get("warc-profile") != PROFILE or "warc-refers-to" not in headers:
            raise ValueError("malformed revisit")
    elif len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("the payload does not have the stated length and digest")
    number = lambda name: int(headers[name]) if name in headers else None
    return {"record_type": kind, "record_id": headers["warc-record-id"], "url": headers.get("warc-target-uri"), "page_id": number("page-id"),
            "refers_to": number("refers-to-page-id"), "payload_bytes": size, "payload_digest": digest}, None if kind == "revisit" else payload


def frames(stream, chunk=1 << 20):
    """(offset, bytes) of each frame of an archive, decoded with the dictionary in the leading skippable frame."""
    head = stream.read(8)
    dictionary = None
    data, at = head, 0
    if len(head) == 8 and int.from_bytes(head[:4], "little") == SKIPPABLE:
        size = int.from_bytes(head[4:], "little")
        dictionary = stream.read(size)
        if len(dictionary) != size:
            raise ValueError("the dictionary is cut short")
        if dictionary[:4] == FRAME_MAGIC:
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
        data, at = b"", 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    while data or (data := stream.read(chunk)):
        frame, out, start = reader.decompressobj(), [], at
        while True:
            out.append(frame.decompress(data))
            if frame.eof:
                at += len(data) - len(frame.unused_data)
                data = frame.unused_data
                break
            at += len(data)
            if not (data := stream.read(chunk)):
                raise ValueError(f"the frame at {start} is cut short")
        yield start, b"".join(out)


def train_dictionary(pages, key, payload, samples=256, sample_bytes=8192, size=32_768):
    """A dictionary of at most ``size`` bytes from at most ``samples`` payload heads: it only helps compression."""
    mark = F.xxhash64(col(key))
    cut = pages.select(mark.alias("mark")).orderBy("mark").limit(samples).agg(F.max("mark").alias("mark")).first()["mark"]
    heads = pages.filter((mark <= F.lit(cut)) & (F.octet_length(payload) > 0)).select(F.substring(payload, 1, sample_bytes).alias("p")).limit(samples).toPandas()["p"]
    try:
        return zstandard.train_dictionary(size, [bytes(p) for p in heads]).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(pages, key="page_id", url="url", payload="html", least_bytes=100, archive_bytes=256 << 20, level=6):
    """Write one record per page; returns the manifest (path, records, bytes)."""
    spark = pages.sparkSession
    rows = pages.select(
        col(key).cast("long").alias("page_id"), col(url).cast("string").alias("url"),
        F.coalesce(col(payload).cast("binary"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    copies = (
        rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last").select("digest", "first"))
    rows = rows.join(copies, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when((F.col("first") != F.col("page_id")) | (F.col("page_id").isNull() & F.col("first").isNotNull()), F.col("first")).alias("refers_to"))
    dictionary = spark.sparkContext.broadcast(train_dictionary(pages.select(col(key).alias("page_id"), col(payload).cast("binary").alias("payload")), "page_id", "payload"))
    folder = shared_folder(spark, "warc")

    def write(batches):
        lead = dictionary.value
        packer = zstandard.ZstdCompressor(level=level, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(lead) if lead else None)
        out = path = None
        records = size = 0
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                if out is None:
                    out, path = write_file(folder, "pages.warc.zst")
                    records, size = 0, 8 + len(lead) if lead else 0
                    if lead:
                        out.write(SKIPPABLE.to_bytes(4, "little") + len(lead).to_bytes(4, "little") + lead)
                    info = build_record("warcinfo", [("WARC-Record-ID", record_id(path)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    size += out.write(packer.compress(info)) or 0
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(names)}
                frame = packer.compress(page_record(**row))
                out.write(frame)
                records, size = records + 1, size + len(frame)
                if size >= archive_bytes:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

    return stored(in_batches(rows).mapInArrow(write, MANIFEST), "warc-manifest")


def read_archives(manifest, payloads=False):
    """One row per response or revisit of the listed archives; ``payloads`` adds the payload (null for revisits)."""
    schema = RECORD + (", payload binary" if payloads else "")
    names = [f.split()[0] for f in schema.split(", ")]
    types = {"path": pa.string(), "record_type": pa.string(), "record_id": pa.string(), "url": pa.string(), "payload_digest": pa.string(), "payload": pa.binary()}
    arrow = pa.schema([(n, types.get(n, pa.int64())) for n in names])

    def read(batches):
        for batch in batches:
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                rows, held, seen = [], 0, 0
                with read_file(path) as stream:
                    for offset, data in frames(stream):
                        kind, headers, block = parse_record(data)
                        if kind not in ("response", "revisit"):
                            continue
                        row, payload = page_row(kind, headers, block)
                        rows.append(row | {"path": path, "offset": offset} | ({"payload": payload} if payloads else {}))
                        seen, held = seen + 1, held + (len(payload or b"") if payloads else 0)
                        if len(rows) >= 4096 or held >= 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                if seen != expected:
                    raise ValueError(f"{path} has {seen} records, {expected} were written")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    files = manifest.select("path", "records")
    return files.repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path").mapInArrow(read, schema)
