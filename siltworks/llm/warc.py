"""Content-addressed WARC archive.

An archive is two Parquet tables: ``payloads`` holds every distinct payload
once, under its SHA-256; ``headers`` holds the exact header bytes of every
record. Rows are grouped by digest and whole payload, so that two payloads
count as one only if they are byte for byte the same; an archive in which one
digest stood for two payloads is refused. :func:`records` joins the two tables
back into whole records. :func:`read` takes them apart again: size and digest
of a payload are those of the bytes that follow the header in the rebuilt
record, and a record whose length or digest is not the one that its header
states is an error. A revisit has no payload of its own; its size and digest
are those found in the rebuilt response of the same digest, so the copies of a
payload are never moved.

A payload of at least ``least`` bytes is written as one response, that of the
smallest id; all later records revisit it. Smaller payloads are always
responses (their bytes are still stored once).

Skew: copies of a payload collapse inside each map task before they are
shuffled; joins on a digest that many records share broadcast the store's row,
which for responses is under ``least`` bytes long and else carries no payload.

Defined cases: null payload is the empty payload; null ids are written as an
empty id, read back as null and respond only if all their group's ids are null;
rows that repeat an id share the record's id; a null url has no target line and
is read back as null; a url with line ends, which no header line may hold, is
written with them percent-encoded and, exactly, in base64 beside it;
of rows that repeat the responding id, the one with the smallest url responds
(null last) and the others revisit; an empty table gives an empty archive;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete_path, hot_keys, materialize, shared_folder, skew_join

LEAST = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"
#: A line end in a url, and the field that then holds the exact url.
CONTROL, EXACT_URI = "[\r\n]", "X-Target-URI-Base64"


def _payload(name: str) -> Column:
    return F.coalesce(F.encode(F.col(name).cast("string"), "UTF-8"), F.lit("").cast("binary"))


def _address(id_col: Column) -> Column:
    return F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(">"))


def header(kind: Column, id_col: Column, url: Column, first: Column, digest: Column, size: Column, date: str) -> Column:
    """The header block of a record, up to and with the empty line."""
    url = url.cast("string")
    safe = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = kind == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), _address(id_col)),
        F.concat(F.lit("WARC-Target-URI: "), safe),
        F.when(url.rlike(CONTROL), F.concat(F.lit(f"{EXACT_URI}: "), F.replace(F.base64(F.encode(url, "UTF-8")), F.lit("\r\n"), F.lit("")))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _address(first))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(~revisit, F.lit("Content-Type: text/html; charset=utf-8")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(size)),
    ]
    return F.encode(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")), "UTF-8")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row into a new archive at ``path``."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), _payload(payload_col).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    stored = rows.groupBy("digest", "payload").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    stored.withColumn("size", F.octet_length("payload").cast("long")).write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/payloads")
    store = spark.read.parquet(f"{path}/payloads").select("digest", "first", "n", "size")
    if store.groupBy("digest").count().where("count > 1").limit(1).count():
        raise ValueError("two payloads have one digest; the archive can't be addressed by content")
    total = store.agg(F.sum("n")).first()[0] or 0
    same = rows.groupBy("id", "url", "digest").agg(F.count(F.lit(1)).alias("m"))
    found = skew_join(same, store, "digest", hot_keys(store, "digest", "n", total))
    mine = F.col("id").eqNullSafe(F.col("first"))
    rest = found.where(~mine).withColumn("lead", F.lit(False))
    # copies of a row are collapsed, so this window holds the few urls of one id
    lead = found.where(mine).withColumn("lead", F.row_number().over(Window.partitionBy("digest").orderBy(F.col("url").asc_nulls_last())) == 1)
    each = rest.unionByName(lead).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    kind = F.when((F.col("size") < least) | (F.col("lead") & (F.col("i") == 1)), F.lit("response")).otherwise(F.lit("revisit"))
    made = each.withColumn("type", kind).withColumn("header", header(F.col("type"), F.col("id"), F.col("url"), F.col("first"), F.col("digest"), F.col("size"), date))
    made.select("digest", "type", "header").write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/headers")


def field(name: str) -> Column:
    """A field of the header block, null where it is absent."""
    found = F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.contains(F.decode("header", "UTF-8"), F.lit(f"\r\n{name}: ")), found)


def _id_in(name: str) -> Column:
    return F.nullif(F.regexp_extract(field(name), f"<{ID_PREFIX}(.*)>", 1), F.lit(""))


def _url() -> Column:
    exact = field(EXACT_URI)
    return F.when(exact.isNotNull(), F.decode(F.unbase64(exact), "UTF-8")).otherwise(field("WARC-Target-URI"))


def records(spark: SparkSession, path: str, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(responses, revisits): digest, header and, of the whole record, its bytes ``record``."""
    heads = spark.read.parquet(f"{path}/headers")
    store = spark.read.parquet(f"{path}/payloads")
    total = store.agg(F.sum("n")).first()[0] or 0
    # a payload of ``least`` bytes has one response, so only shorter ones can be hot
    small = hot_keys(store.where(F.col("size") < least), "digest", "n", total)
    end = F.lit("\r\n\r\n").cast("binary")
    responses = skew_join(heads.where("type = 'response'"), store.select("digest", "payload"), "digest", small)
    return (
        responses.select("digest", "header", F.concat("header", "payload", end).alias("record")),
        heads.where("type <> 'response'").select("digest", "header", F.concat("header", end).alias("record")),
    )


def _fields(id_type: str) -> list[Column]:
    return [_id_in("WARC-Record-ID").cast(id_type).alias("id"), _url().alias("url"), field("WARC-Type").alias("type"), _id_in("WARC-Refers-To").cast(id_type).alias("refers_to")]


def read(spark: SparkSession, path: str, least: int = LEAST, id_type: str = "long", whole: bool = True) -> DataFrame:
    """Every record: id, url, type, refers_to, payload_bytes, payload_digest, record.

    record: the whole record's bytes, left out unless ``whole``. payload_bytes
    and payload_digest are taken from the rebuilt record, of a revisit from
    that of its response.
    """
    responses, revisits = records(spark, path, least)
    # the body lies between the header block and the four bytes that end a record
    body = F.substring(F.col("record"), F.octet_length("header") + 1, F.octet_length("record") - F.octet_length("header") - 4)
    found = responses.select("digest", *_fields(id_type), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("found"), field("Content-Length").cast("long").alias("stated"), "record")
    right = (F.col("found") == F.col("digest")) & (F.col("payload_bytes") == F.col("stated"))
    checked = F.when(right, F.col("found")).otherwise(F.raise_error(F.concat(F.lit("a record differs from its header; digest "), F.col("digest"))))
    found = found.select("digest", "id", "url", "type", "refers_to", "payload_bytes", checked.alias("payload_digest"), "record")
    again = revisits.select("digest", *_fields(id_type), "record")
    if not whole:
        found, again = materialize(found.drop("record")), again.drop("record")
    # of each payload that is revisited, what its one response holds; small rows
    held = found.where(F.col("payload_bytes") >= least).select("digest", "payload_bytes", "payload_digest")
    counts = spark.read.parquet(f"{path}/payloads").select("digest", "n")
    total = counts.agg(F.sum("n")).first()[0] or 0
    again = skew_join(again, held if not whole else materialize(held), "digest", hot_keys(counts, "digest", "n", total))
    return found.drop("digest").unionByName(again.drop("digest"))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """Write an archive, rebuild its records, and describe every one of them; the archive is then removed."""
    spark = pages.sparkSession
    path = shared_folder(spark, "warc")
    try:
        write(pages, path, id_col, url_col, payload_col, least)
        found = read(spark, path, least, pages.schema[id_col].dataType.simpleString(), whole=False)
        return materialize(found.select(F.col("id").alias(id_col), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"))
    finally:
        delete_path(spark, path)
