"""Image intake: new objects of an inbox with their verdict (S9), and the checks of a product
image (S10).  The same columns serve a batch (``spark.read``) and a stream
(``spark.readStream``) of binary files; the bytes stay where they are, the result is a
manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Prefixes, sizes, and the first bytes of each type.
INBOX, OUTBOX = "inbox/", "outbox/"
MAX_OBJECT_BYTES = 5 * 1024 * 1024
MAX_IMAGE_BYTES = 2 * 1024 * 1024
JPEG, PNG, WEBP = "image/jpeg", "image/png", "image/webp"
EXTENSIONS = {"jpg": JPEG, "jpeg": JPEG, "png": PNG, "webp": WEBP}
OBJECT_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def media_type(content_type: Column) -> Column:
    """A content type without its parameters, in lower case."""
    return F.lower(F.trim(F.element_at(F.split(F.coalesce(content_type, F.lit("")), ";", 2), 1)))


def type_of_name(key: Column) -> Column:
    """The image type that an object's extension names; other extensions have none."""
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(known, F.lower(F.regexp_extract(key, r"\.([A-Za-z0-9]+)$", 1)))


def signature_matches(content: Column, kind: Column) -> Column:
    """Do the first bytes belong to the declared type?  Other types have no signature."""
    head = F.hex(F.substring(content, 1, 12))
    return F.coalesce(F.when(kind == JPEG, head.startswith("FFD8FF")).when(kind == PNG, head.startswith("89504E470D0A1A0A"))
                      .when(kind == WEBP, head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")), F.lit(False))


def validate_images(files: DataFrame) -> DataFrame:
    """``files`` (``content_type, content``, and ``size``, else the length of the bytes) with
    ``reason``, the first rule that fails (NULL: valid): ``empty``, ``too_large`` (over 2 MiB),
    ``unsupported_type`` (not exactly a JPEG, PNG or WebP type), ``signature`` (the bytes are
    not of that type)."""
    size = F.coalesce(F.col("size") if "size" in files.columns else F.lit(None).cast("long"), F.octet_length("content"), F.lit(0))
    kind = F.col("content_type")
    return files.withColumn("reason", F.when(size == 0, "empty").when(size > MAX_IMAGE_BYTES, "too_large")
                            .when(~F.coalesce(kind.isin(JPEG, PNG, WEBP), F.lit(False)), "unsupported_type")
                            .when(~signature_matches(F.col("content"), kind), "signature"))


def judge_objects(objects: DataFrame, inbox: str = INBOX, outbox: str = OUTBOX) -> DataFrame:
    """``objects`` (``key, content_type, size``) with ``reason`` (NULL: accepted) and, for
    accepted ones, ``output_key`` (the output prefix and the rest of the key) and
    ``source_key`` (URL-encoded).  Reasons: ``outside_prefix``, ``not_an_image``, ``size`` (none, 0
    or over 5 MiB)."""
    image = media_type(F.col("content_type")).startswith("image/")
    fits = F.coalesce(F.col("size").between(1, MAX_OBJECT_BYTES), F.lit(False))
    x = objects.withColumn("reason", F.when(~F.coalesce(F.startswith("key", F.lit(inbox)), F.lit(False)), "outside_prefix")
                           .when(~image, "not_an_image").when(~fits, "size"))
    good = F.col("reason").isNull()
    encoded = F.replace(F.url_encode("key"), F.lit("+"), F.lit("%20"))
    for safe, code in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):  # left as they are in a URI component
        encoded = F.replace(encoded, F.lit(code), F.lit(safe))
    return x.withColumn("output_key", F.when(good, F.concat(F.lit(outbox), F.substr("key", F.lit(len(inbox) + 1))))) \
        .withColumn("source_key", F.when(good, encoded))


def decode_key(encoded: Column) -> Column:
    """An object key as events carry it: percent-encoded, blanks as plus signs."""
    return F.try_url_decode(encoded)


def ingest_objects(spark: SparkSession, root: str, streaming: bool = False, inbox: str = INBOX, outbox: str = OUTBOX,
                   max_files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """S9 over the files below ``root``: (accepted, rejected).  Keys are paths below ``root``, types
    follow from the extension, sizes from the file listing: no bytes are read.  As a stream
    each file comes once.  Spark's file sources leave empty files out, so they are in neither
    result; :func:`judge_objects` over an object listing rejects them."""
    reader = spark.readStream.schema(OBJECT_SCHEMA) if streaming else spark.read
    reader = reader.format("binaryFile").option("recursiveFileLookup", "true")
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = reader.load(root)
    key = F.regexp_replace("path", r"^.*?\Q" + root.rstrip("/") + r"/\E", "")
    judged = judge_objects(files.select(key.alias("key"), type_of_name(key).alias("content_type"), F.col("length").alias("size"),
                                        F.col("modificationTime").alias("arrived_at")), inbox, outbox)
    good = F.col("reason").isNull()
    return (judged.where(good).drop("reason").withColumn("processed_at", F.current_timestamp()),
            judged.where(~good).drop("output_key", "source_key"))
