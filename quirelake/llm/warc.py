"""WARC: reading, writing, and deriving metadata and conversion records from responses.

A derived record names the response it comes from (WARC-Refers-To) and keeps
its target URI and date. The metadata record carries the response's status,
HTTP headers, digests and title as WARC fields; the conversion record carries
the page's plain text. Identifiers are made from the source record's, so that a
rerun gives the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.session import table
from quirelake.shipping import shipped

_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed: the URL namespace of RFC 4122
_OPEN = re.compile(r"<!--|<(script|style|noscript|template|head)\b", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "head")} | {"": re.compile("-->")}
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_BREAK = re.compile(r"<(?:/?(?:p|div|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|blockquote|pre|dl|dt|dd|form|main|aside)\b|br\b|hr\b)[^>]*>", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^>]*>")
_BLANK = re.compile(r"[ \t\r\f\v\xa0]+")
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w.:-]+)", re.I)

PIECE, HEAD, MEMBER = 1 << 20, 1 << 20, 8 << 20  # bytes: read at a time, of a record's header at most, packed into one member

RECORD = "headers map<string,string>, block binary"
DERIVED = (
    "key long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "content_length long, block_digest string, source_block_digest string, source_payload_digest string, source_headers string, block string"
)


def digest(data: bytes) -> str:
    """A digest as WARC writes it: SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, chr(31).join(map(str, parts)))}>"


def encode_record(headers: dict[str, str], block: bytes) -> bytes:
    """One record; Content-Length is set to the block's."""
    fields = {**headers, "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:  # a folded line
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip()
            out[last] = value.strip()
    return out


def _inflated(data: bytes) -> Iterator[bytes]:
    """The content of a file piece by piece: as it is, or of its gzip members; a damaged member ends, and the next one goes on."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[k : k + PIECE] for k in range(0, len(data), PIECE))
        return
    at = 0
    while 0 <= at < len(data):
        member, start = zlib.decompressobj(31), at
        try:
            while not member.eof and at < len(data):
                piece = member.decompress(data[at : at + PIECE])
                at += PIECE
                if piece:
                    yield piece
            at = min(at, len(data)) - len(member.unused_data)
            if not member.eof:
                yield b"\0\0\0\0"
        except zlib.error:
            yield b"\0\0\0\0"  # no record begins like this: what the member began is told apart from what follows
            at = start + 2
        at = data.find(b"\x1f\x8b\x08", at)


def decode_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a file, plain or with gzip members, which are never held all at once.

    What is no record, as after a damaged one, is passed over up to the next
    line that begins with WARC/, and reported once as a record of the type
    ``damaged`` with the bytes passed over as its length and an empty block.
    """
    pieces, held, lost = _inflated(data), bytearray(), 0

    def have(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    def damage() -> tuple[dict[str, str], bytes]:
        return {"WARC-Type": "damaged", "Content-Length": str(lost)}, b""

    def skip(n: int) -> None:
        """Passes over n bytes at least, and on to what may be a record."""
        nonlocal lost
        while True:
            found = held.find(b"WARC/", n)
            if found >= 0:
                lost += found
                del held[:found]
                return
            cut = max(n, len(held) - 4)
            lost += min(cut, len(held))
            del held[:cut]
            n = 0
            piece = next(pieces, None)
            if piece is None:
                lost += len(held.strip(b"\r\n"))
                held.clear()
                return
            held.extend(piece)

    while have(1):
        while have(2) and held[:2] == b"\r\n":
            del held[:2]
        if not held:
            break
        if not have(5) or held[:5] != b"WARC/":
            skip(0)
            continue
        end = held.find(b"\r\n\r\n")
        while end < 0 and len(held) < HEAD and have(len(held) + 1):
            end = held.find(b"\r\n\r\n")
        headers = _fields(bytes(held[held.find(b"\r\n") + 2 : end])) if end >= 0 else {}
        size = next((int(v) for k, v in headers.items() if k.lower() == "content-length" and v.isascii() and v.isdigit()), -1)
        # a record ends with two line ends; if none follow, its length or content is damaged
        if size < 0 or not have(end + 4 + size) or (have(end + 4 + size + 4) and held[end + 4 + size : end + 8 + size] != b"\r\n\r\n"):
            skip(5)
            continue
        if lost:
            yield damage()
            lost = 0
        yield headers, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]
    if lost:
        yield damage()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(headers, block) of all records in the files under ``path``; see ``decode_records`` for damaged ones.

    A file is the unit of reading, as gzip members cannot be found from the
    middle; crawls write files of about 1 GB at most. It is held as it lies on
    disk, and unpacked record by record.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for headers, block in decode_records(content.as_py() or b""):
                    yield pa.RecordBatch.from_arrays([pa.array([list(headers.items())], pa.map_(pa.string(), pa.string())), pa.array([block], pa.binary())], ["headers", "block"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    return shipped(files).mapInArrow(decode, RECORD)


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_warc(records: DataFrame, path: str) -> None:
    """Writes (headers, block) as ``.warc.gz`` files, a gzip member for each record (for each 8 MB of a larger one).

    The files come from Spark's own text writer, whose committer leaves no
    half-written file when an executor is lost: a member of less than 16 MB
    ends with a zero byte (the high byte of its size), which serves as the line
    separator. The committed files are then renamed.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = []
            for headers, block in zip(batch.column("headers"), batch.column("block"), strict=True):
                record = encode_record(dict(headers.as_py() or []), block.as_py() or b"")
                members += [_member(record[k : k + MEMBER])[:-1] for k in range(0, len(record), MEMBER)]
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["value"])

    packed = shipped(records).select("headers", "block").mapInArrow(encode, "value binary").select(F.col("value").cast("string"))
    packed.write.option("lineSep", "\0").option("compression", "none").text(path)
    jvm = records.sparkSession.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(records.sparkSession.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            files.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name[:-4] + ".warc.gz"))


def without_hidden(markup: str) -> str:
    """``markup`` with comments, scripts, styles and the like replaced by a space.

    An element that is not closed stays. Each kind's end is looked for in vain
    at most once, so the time is proportional to the length.
    """
    kept, at, start = [], 0, 0
    endless: set[str] = set()
    while found := _OPEN.search(markup, at):
        name = (found[1] or "").lower()
        close = None if name in endless else _CLOSE[name].search(markup, found.end())
        if close is None:
            endless.add(name)
            at = found.end()
        else:
            kept += [markup[start : found.start()], " "]
            start = at = close.end()
    return "".join([*kept, markup[start:]])


def plain_text(markup: str) -> tuple[str, str]:
    """A page's title and its visible text, a line for each block with text."""
    title = _TITLE.search(markup)
    body = _BREAK.sub("\n", without_hidden(markup))
    body = html.unescape(_TAG.sub("", body))
    lines = (_BLANK.sub(" ", line).strip() for line in body.split("\n"))
    return _BLANK.sub(" ", html.unescape(title[1])).strip() if title else "", "\n".join(line for line in lines if line)


def split_http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers and payload of an HTTP response; all is payload if there is no status line."""
    if not block.startswith(b"HTTP/"):
        return "", {}, block
    head, _, payload = block.partition(b"\r\n\r\n")
    status, _, fields = head.partition(b"\r\n")
    return status.decode("latin-1"), _fields(fields), payload


def derive_one(key: int | None, headers: dict[str, str], block: bytes) -> list[tuple]:
    """The metadata and the conversion record of one response, as rows of DERIVED."""
    named = {k.lower(): v for k, v in headers.items()}
    source = named.get("warc-record-id") or record_id(key, named.get("warc-target-uri", ""))
    status, fields, payload = split_http(block)
    kind = next((v for k, v in fields.items() if k.lower() == "content-type"), "")
    charset = _CHARSET.search(kind.encode("utf-8", "replace")) or _CHARSET.search(payload[:1024])
    try:
        markup = payload.decode(charset[1].decode() if charset else "utf-8", "replace")
    except (LookupError, UnicodeError, ValueError):  # a charset that is unknown, no charset of texts, or one that the bytes break
        markup = payload.decode("utf-8", "replace")
    textual = not kind or "html" in kind.lower() or kind.lower().startswith("text/")
    title, text = plain_text(markup) if textual and "plain" not in kind.lower() else ("", markup if textual else "")
    block_digest, payload_digest = digest(block), digest(payload)
    http = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    about = f"status: {status}\r\ntitle: {title}\r\nsource-block-digest: {block_digest}\r\nsource-payload-digest: {payload_digest}\r\n" + "".join(f"http-{k}: {v}\r\n" for k, v in fields.items())
    common = (source, named.get("warc-target-uri"), named.get("warc-date"))
    rows = []
    for record_type, content_type, content in (("metadata", "application/warc-fields", about), ("conversion", "text/plain; charset=utf-8", text)):
        data = content.encode("utf-8", "replace")
        rows.append((key, record_type, record_id(source, record_type), *common, content_type, len(data), digest(data), block_digest, payload_digest, http, data.decode("utf-8")))
    return rows


def derive(responses: DataFrame) -> DataFrame:
    """Two records for each row (key, headers, block) of ``responses``; see DERIVED for the columns.

    Rows whose WARC-Type is given and is not response are left out. Null
    headers and blocks count as empty; an empty block gives records with an
    empty text. Missing identifiers are made from the key and the target URI.
    Repeated rows repeat their records. Other columns are not read.
    """
    names = [c.split()[0] for c in DERIVED.split(", ")]
    types = {"key": pa.int64(), "content_length": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows: list[tuple] = []
                part = batch.slice(k, 256)
                for key, headers, block in zip(*[part.column(c) for c in ("key", "headers", "block")], strict=True):
                    rows += derive_one(key.as_py(), dict(headers.as_py() or []), block.as_py() or b"")
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(name, pa.string())) for c, name in enumerate(names)], names)

    kind = F.element_at("headers", "WARC-Type")
    return shipped(responses).filter(F.coalesce(kind, F.lit("response")) == "response").select(F.col("key").cast("long"), "headers", F.col("block").cast("binary")).mapInArrow(run, DERIVED)


def records_of(derived: DataFrame) -> DataFrame:
    """Derived rows as records (headers, block) that ``write_warc`` writes: linked by WARC-Refers-To, with the block's digest.

    A header whose value is null is left out; line breaks within one become spaces.
    """
    fields = {
        "WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target_uri",
        "WARC-Date": "warc_date", "WARC-Block-Digest": "block_digest", "Content-Type": "content_type",
    }
    pairs = [x for name, column in fields.items() for x in (F.lit(name), F.regexp_replace(column, r"[\r\n]+", " "))]
    headers = F.map_filter(F.create_map(*pairs), lambda _, value: value.isNotNull())
    return derived.select(headers.alias("headers"), F.encode("block", "UTF-8").alias("block"))


def write_derivatives(responses: DataFrame, path: str) -> None:
    """The metadata and conversion records of responses (key, headers, block) as ``.warc.gz`` files below ``path``."""
    write_warc(records_of(derive(responses)), path)


def responses_of_pages(pages: DataFrame, date: str, url: str = "url", html_: str = "html", key: str = "page_id") -> DataFrame:
    """Pages as response records (key, headers, block) with the given capture date."""
    body = F.coalesce(F.col(html_), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"))
    sha = F.sha1(F.concat_ws("\x1f", F.col(key).cast("string"), F.col(url)))
    made = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(sha, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))
    headers = F.create_map(*[x for k, v in (("WARC-Type", F.lit("response")), ("WARC-Record-ID", made), ("WARC-Target-URI", F.coalesce(F.col(url), F.lit(""))), ("WARC-Date", F.lit(date)), ("Content-Type", F.lit("application/http; msgtype=response"))) for x in (F.lit(k), v)])
    return pages.select(F.col(key).alias("key"), headers.alias("headers"), F.concat(head.cast("binary"), body).alias("block"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages."""
    derived = derive(responses_of_pages(table(spark, sf_dir, "pages"), "2024-01-01T00:00:00Z"))
    return derived.withColumnRenamed("key", "page_id")
