r"""Writing web archives, and reading them back as captures.

``write_captures`` turns every row of a table of pages into one transaction of
three records: a request, a response (or a revisit of an equal payload) and a
metadata record. The request and the metadata name the response in
``WARC-Concurrent-To``. Records are built by SQL functions and written by
Spark's text sink, whose line separator is the blank lines that end a record, so
archives can lie in any store that Spark writes, and a lost task is written
anew. A file is one gzip stream.

``read_records`` reads archives (gzip, in one stream or one per record, of this
module or others, WARC 1.0 and 1.1) with Spark's text source, whose line
separator is the version mark that starts a record. A payload may hold that mark
too, so a task puts pieces together again until a record has the length that
its header tells. It streams: a task holds one record at a time.

``transactions`` puts captures together: every request and metadata record is
joined to its response through the concurrent-to identifiers, whichever side
names the other, and one nested row per capture comes out: the response with
arrays of its requests and metadata. ``resolve_revisits`` joins a revisit with the
capture it refers to. Both joins split identifiers that very many records
refer to (``join_unique``).

Of equal payloads of at least ``REVISIT_BYTES`` bytes the row with the largest
id is the response, the others revisit it. Shorter ones are responses.

Defined results: a null payload is empty; every row, repeated ones too, is a
capture of its own (of equal rows one is the response, by its place in the
files); a null id sorts lowest and stays null; a null url becomes the empty
``about:blank``, blanks and control characters of a url become ``%20``; an empty
table gives archives without records and no captures; other columns are not
touched. Reading: an archive that ends inside a record, or holds bytes between
records, ends the job with an error that names the file; files that aren't
compressed are read too, if no record lies across two read splits (an error
says so). A request or metadata record that belongs to no response is
left out of the captures (``read_records`` has it).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderscope.llm.common import LOC, located, materialise, scratch_session, shared_folder, ship_package

REVISIT_BYTES = 1000
HOT_SHARE = 1000  # an identifier is hot that holds more than one in so many rows
HOT_LEAST = 256
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the format.
MARK = b"WARC/1."
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def join_unique(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """``many`` left join ``one`` (at most one row per ``key``). Keys of more
    than one in ``HOT_SHARE`` rows, which are at most ``HOT_SHARE`` keys, meet
    a broadcast of their rows; the rest is shuffled by key."""
    names = [c for c in one.columns if c != key]
    counts = many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("all")).first()["all"]
    hot = [r[key] for r in counts.where(F.col("__n") > max(HOT_LEAST, total // HOT_SHARE)).select(key).collect()]
    if not hot:
        return many.join(one, key, "left").select(*many.columns, *names)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    held = F.broadcast(one.where(F.col(key).isin(hot)))
    spread = many.where(is_hot).join(held, key, "left").select(*many.columns, *names)
    return spread.unionByName(many.where(~is_hot).join(one, key, "left").select(*many.columns, *names))


def record_id(kind: str, *place: str | Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *place))
    part = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *part))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """A record as a text value (its bytes may be any); null headers are left out."""
    lines = [F.lit("WARC/1.1")]
    for name, value in [*headers, ("Content-Length", F.octet_length(block).cast("string"))]:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value)))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def write_captures(
    spark: SparkSession,
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: Column | None = None,
) -> None:
    """Write one transaction per row of ``pages`` into archives in ``folder``."""
    date = (F.lit(DATE) if date is None else date).alias("date")
    url = F.coalesce(F.nullif(F.regexp_replace(F.col(url_col).cast("string"), r"[\x00-\x20\x7F]", "%20"), F.lit("")), F.lit("about:blank"))
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    _, rows = located(spark, pages, [F.col(id_col).cast("long").alias("id"), url.alias("url"), payload.alias("payload"), date])
    rows = rows.withColumn("size", F.octet_length("payload").cast("long"))
    same = F.sha2(F.col("payload").cast("binary"), 256)
    rows = rows.withColumn("same", F.when(F.col("size") >= REVISIT_BYTES, same))
    # One small row per payload that several rows have: the row that is the response.
    first = F.max(F.struct(F.col("id"), *LOC))
    held = rows.where("same IS NOT NULL").groupBy("same").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    held = materialise(spark, held.where("n > 1").select("same", "first"), "shared_payloads")
    rows = join_unique(rows, held, "same")
    place = [F.col(c).cast("string") for c in LOC]
    first_place = [F.col("first")[c].cast("string") for c in LOC]
    revisit = F.col("first").isNotNull() & (F.struct(*LOC) != F.struct(*[F.col("first")[c] for c in LOC]))
    me = record_id("response", *place)
    link, target, when = ("WARC-Concurrent-To", F.concat(F.lit("<"), me, F.lit(">"))), ("WARC-Target-URI", F.col("url")), ("WARC-Date", F.col("date"))
    named = lambda kind: ("WARC-Record-ID", F.concat(F.lit("<"), record_id(kind, *place), F.lit(">")))
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    ask = F.concat(F.lit("GET "), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    status = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    about = F.concat(F.lit("capture-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\r\n"))
    request = _record([("WARC-Type", "request"), named("request"), when, target, link, ("Content-Type", "application/http; msgtype=request")], ask)
    answer = _record(
        [
            ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            named("response"),
            when,
            target,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(F.col("payload").cast("binary")))),
            ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
            ("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<"), record_id("response", *first_place), F.lit(">")))),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        F.when(revisit, status).otherwise(F.concat(status, F.col("payload"))),
    )
    metadata = _record([("WARC-Type", "metadata"), named("metadata"), when, target, link, ("Content-Type", "application/warc-fields")], about)
    records = rows.select(F.explode(F.array(request, answer, metadata)).alias("value"))
    records.write.option("compression", "gzip").option("lineSep", END.decode()).text(folder)


RECORDS = (
    "file string, record_id string, type string, target_uri string, date string, concurrent_to array<string>, "
    "refers_to string, payload_digest string, headers map<string,string>, http string, payload binary"
)


def _id(value: str | None) -> str | None:
    return value.strip().strip("<>") if value else None


def _parse(piece: bytes) -> tuple[int, dict[str, list[str]]] | None:
    """Where the block of a record starts, and its header fields; None if the
    header isn't whole yet. ``piece`` starts after the version mark."""
    cut = piece.find(END)
    if cut < 0:
        return None
    fields: dict[str, list[str]] = {}
    last = None
    for line in piece[:cut].decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:  # a folded line
            fields[last][-1] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        last = name.strip().lower()
        fields.setdefault(last, []).append(value.strip())
    return cut + len(END), fields


def _body(kind: str | None, block: bytes) -> tuple[str | None, bytes]:
    """The HTTP header of a block (null without one) and what follows it."""
    cut = block.find(END) if (kind or "").startswith("application/http") else -1
    return (None, block) if cut < 0 else (block[:cut].decode("utf-8", "replace"), block[cut + len(END) :])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from the pieces between version marks, in file order."""
    names = [c.split(" ")[0] for c in RECORDS.split(", ")]
    kinds = [pa.string()] * 5 + [pa.list_(pa.string())] + [pa.string()] * 2 + [pa.map_(pa.string(), pa.string()), pa.string(), pa.binary()]
    file, held, need, head = None, bytearray(), 0, None
    opened = False

    def finish(name: str) -> None:
        if opened and (held or head):
            raise ValueError(f"{name}: the archive, or a read split of it, ends inside a record")

    for batch in batches:
        out: list[list] = [[] for _ in names]
        size = 0
        for name, start, piece in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), batch.column("value").to_pylist(), strict=True):
            if (name, start) != file:
                if file:
                    finish(file[0])
                file, held, head, need = (name, start), bytearray(), None, 0
                opened = start > 0  # a later split starts at a mark, the file itself before its first
            if not opened:
                if piece.strip():
                    raise ValueError(f"{name}: bytes before the first record")
                opened = True
                continue
            if held:  # the mark was part of the record
                held += MARK
            held += piece
            if head is None:
                parsed = _parse(bytes(held))
                if parsed is None:
                    continue
                at, head = parsed
                need = at + int(head.get("content-length", ["-1"])[0])
                if need < at:
                    raise ValueError(f"{name}: a record without Content-Length")
            if len(held) < need + len(END):
                continue
            if bytes(held[need:]) != END:
                raise ValueError(f"{name}: bytes between records")
            one = lambda key: (head.get(key) or [None])[0]  # noqa: B023, E731
            row = [
                name,
                _id(one("warc-record-id")),
                one("warc-type"),
                one("warc-target-uri"),
                one("warc-date"),
                [_id(v) for v in head.get("warc-concurrent-to", [])],
                _id(one("warc-refers-to")),
                one("warc-payload-digest"),
                [(k, ", ".join(v)) for k, v in head.items()],
                *_body(one("content-type"), bytes(held[at:need])),
            ]
            for column, value in zip(out, row, strict=True):
                column.append(value)
            size += need
            held, head = bytearray(), None
            if size > 1 << 23:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)
                out, size = [[] for _ in names], 0
        if out[0]:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)
    if file:
        finish(file[0])


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives in ``folder``, any type, as ``RECORDS``:
    ``payload`` is the body of an HTTP block, else the whole block."""
    ship_package(spark)
    own = scratch_session(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "256"})
    lines = own.read.option("lineSep", MARK.decode()).text(folder)
    at = lines.metadataColumn("_metadata")
    pieces = lines.select(at["file_path"].alias("file"), at["file_block_start"].alias("start"), F.col("value").cast("binary").alias("value"))
    return pieces.mapInArrow(_records, RECORDS)


def transactions(records: DataFrame, *carried: str) -> DataFrame:
    """One nested row per capture: ``record_id``, ``capture`` (a struct of the
    response's or revisit's fields with the ``carried`` columns), ``requests`` and
    ``metadata`` (arrays of such structs, by record id)."""
    kept = ["record_id", "type", "target_uri", "date", "refers_to", "payload_digest", *carried]
    fields = F.struct(*kept)
    answer = F.col("type").isin("response", "revisit", "resource")
    answers = records.where(answer).select("record_id", F.explode_outer("concurrent_to").alias("other"), fields.alias("capture"))
    others = records.where(~answer & F.col("type").isin("request", "metadata")).select(
        F.col("record_id").alias("own"), F.explode_outer("concurrent_to").alias("other"), fields.alias("fields")
    )
    # Either side may name the other; a metadata record may name the request.
    by_other = others.where("other IS NOT NULL").select("own", F.col("other").alias("answer"))
    by_answer = answers.where("other IS NOT NULL").select(F.col("other").alias("own"), F.col("record_id").alias("answer"))
    links = by_other.union(by_answer).distinct()
    known = answers.select(F.col("record_id").alias("answer")).distinct()
    direct = links.join(known, "answer", "left_semi")
    through = links.join(known, "answer", "left_anti").join(direct.select(F.col("own").alias("answer"), F.col("answer").alias("beyond")), "answer")
    pairs = direct.unionByName(through.select("own", F.col("beyond").alias("answer"))).distinct()
    parts = others.select("own", "fields").distinct().join(pairs, "own")
    sorted_of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("fields.type") == kind, F.col("fields"))))
    grouped = parts.groupBy(F.col("answer").alias("record_id")).agg(sorted_of("request").alias("requests"), sorted_of("metadata").alias("metadata"))
    captures = answers.select("record_id", "capture").dropDuplicates(["record_id"])
    return captures.join(grouped, "record_id", "left")


def resolve_revisits(captures: DataFrame, *taken: Column) -> DataFrame:
    """Add ``referred``: the ``taken`` expressions of the capture that a revisit
    refers to, null for others."""
    held = captures.select(F.col("record_id").alias("refers_to"), F.struct(*taken).alias("referred"))
    return join_unique(captures.withColumn("refers_to", F.col("capture.refers_to")), held, "refers_to").drop("refers_to")


def op12_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``payload_bytes`` and ``payload_digest`` are those of the payload read
    from the archive; a revisit's are those of the capture it refers to."""
    folder = shared_folder(spark, "archives")
    write_captures(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    records = read_records(spark, folder)
    fields = F.when(F.col("type") == "metadata", F.col("payload").cast("string"))
    measured = records.select(
        "record_id", "type", "target_uri", "date", "concurrent_to", "refers_to", "payload_digest",
        F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"),
        F.regexp_extract(fields, r"^capture-id: (-?[0-9]*)", 1).alias("about"),
    )
    captures = transactions(materialise(spark, measured, "records"), "bytes", "sha1", "about")
    flat = materialise(spark, captures.withColumn("page_id", F.try_to_number(F.col("metadata")[0]["about"], F.lit("S9999999999999999999")).cast("long")), "captures")
    found = resolve_revisits(flat, F.col("page_id"), F.col("capture.bytes"), F.col("capture.sha1"))
    revisit = F.col("capture.type") == "revisit"
    return found.select(
        "page_id",
        F.when(revisit, F.col("referred.bytes")).otherwise(F.col("capture.bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("referred.sha1")).otherwise(F.col("capture.sha1")).alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        F.when(revisit, F.col("referred.page_id")).alias("refers_to"),
    )


OP12_SQL = """
WITH p AS (
  SELECT page_id, row_number() OVER () AS r, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS size
  FROM pages),
f AS (SELECT html, max_by(r, coalesce(page_id, -9223372036854775808)) AS r, max(page_id) AS page_id FROM p WHERE size >= 1000 GROUP BY html)
SELECT p.page_id, p.size::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN f.r <> p.r THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.r <> p.r THEN f.page_id END AS refers_to
FROM p LEFT JOIN f ON p.size >= 1000 AND p.html = f.html
"""
