"""Library files: JSON envelopes by book/domain/category, text caches, properties, archives, listings (S*, K*)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import slugify

ENVELOPE = "book string, domain string, category string, items array<struct<id:string,name:string,img:string,system:map<string,string>,meta:struct<book:string,page:int,sources:array<struct<book:string,page:int>>,extractedAt:string,extractorVersion:string,qaStatus:string,hidden:boolean,conflicts:array<string>,variantOf:string,descriptionFrom:string>>>"
SEGMENT = "^[a-z0-9_]+$"


def path_parts(path: Column) -> Column:
    return F.split(F.regexp_replace(path, r"\.[^./]*$", ""), "/")


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """One row per JSON file under ``root``: path segments, parsed envelope, ``error`` ('unreadable' if it is no object, 'bad-segment' for a name
    out of form). Directories that start with '_' are skipped; no file fails the scan."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root)
    parts = path_parts(F.col("_metadata.file_path"))
    rows = raw.select(F.col("_metadata.file_path").alias("path"), "value", *(F.try_element_at(parts, F.lit(-3 + i)).alias(n) for i, n in enumerate(("p_book", "p_domain", "p_category"))))
    envelope = F.from_json("value", ENVELOPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    rows = rows.filter(~F.col("path").rlike("/_[^/]*/")).withColumn("envelope", envelope)
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    form = F.col("p_book").rlike(SEGMENT) & F.col("p_domain").rlike(SEGMENT) & F.col("p_category").rlike(SEGMENT)
    return rows.select("path", F.col("p_book").alias("book"), F.col("p_domain").alias("domain"), F.col("p_category").alias("category"), F.when(is_object, F.col("envelope")).alias("envelope"), F.when(~is_object, "unreadable").when(~form, "bad-segment").alias("error"))


def catalog_tree(spark: SparkSession, root: str) -> DataFrame:
    """One row per file: ``book, domain, category, items`` (their number, 0 for an unreadable file), ``error``; names out of form are left out."""
    files = scan_files(spark, root).filter(~F.col("error").eqNullSafe("bad-segment"))
    return files.select("book", "domain", "category", F.coalesce(F.size("envelope.items"), F.lit(0)).alias("items"), "error").withColumn("items", F.greatest("items", F.lit(0)))


def _items(files: DataFrame) -> DataFrame:
    return files.select("book", "domain", "category", F.posexplode("envelope.items").alias("position", "item")).select("book", "domain", "category", "position", "item.*")


def read_library(spark: SparkSession, root: str, domain: str | None = None) -> DataFrame:
    """The items of all readable files with their place, in the order of their file (``position``)."""
    files = scan_files(spark, root).filter("error is null")
    return _items(files if domain is None else files.filter(F.col("domain") == domain))


def read_category(spark: SparkSession, root: str, book: str, domain: str, category: str) -> DataFrame:
    """S3: the items of one file, the only one read; ValueError for a segment out of form."""
    for segment in (book, domain, category):
        if not re.match(SEGMENT, segment):
            raise ValueError(f"bad-segment: {segment}")
    return _items(scan_files(spark, f"{root}/{book}/{domain}/{category}.json").filter("error is null"))


def write_library(items: DataFrame, path: str) -> None:
    """K1, K3: a table partitioned by book, domain and category; only the partitions that ``items`` has are replaced."""
    items.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book", "domain", "category").parquet(path)


def export_strict(items: DataFrame, path: str, staging: str) -> int:
    """K7: rows written once to ``staging``, checked there and put in the place of ``path``; ValueError for a repeated (domain, id) or no rows at all. The number of
    rows. What was at ``path`` is moved aside first and deleted last, so that either it or the new rows are whole at every moment."""
    items.write.mode("overwrite").parquet(staging)
    spark = items.sparkSession
    written = spark.read.schema(items.schema).parquet(staging)
    n = written.count()
    if not n:
        raise ValueError("nothing to export")
    again = written.groupBy("domain", "id").count().filter("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"duplicate id: {again[0]['domain']}/{again[0]['id']}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    source, target, aside = hadoop.Path(staging), hadoop.Path(path), hadoop.Path(path.rstrip("/") + ".old")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(aside, True)
    had = fs.exists(target)
    if had and not fs.rename(target, aside):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(source, target):
        if had:
            fs.rename(aside, target)
        raise OSError(f"cannot move {staging} to {path}")
    fs.delete(aside, True)
    return n


def registry(spark: SparkSession, path: str) -> DataFrame:
    """{slug: {...}} to one row per book."""
    raw = spark.read.option("wholetext", True).text(path)
    books = F.from_json("value", "map<string,struct<title:string,pdf:string,date:string,cat:string,reprint_of:string,pageOffset:int>>")
    return raw.select(F.explode(books).alias("slug", "b")).select("slug", "b.*")


def properties(lines: DataFrame, line: str, order: str, keys: Sequence[str] = ("desc", "page", "wifi", "source")) -> DataFrame:
    """S12: 'prefix.id = name' and 'prefix.id.key = value' lines to one row per id: ``id, name, fields``. Of a repeated name the first counts, of a repeated key
    the last, by ``order``."""
    sub = rf"^[A-Za-z_]+\.([A-Za-z0-9_-]+)\.({'|'.join(keys)})\s*=\s*(.*?)\s*$"
    name = r"^[A-Za-z_]+\.([A-Za-z0-9_-]+)\s*=\s*(.*?)\s*$"
    is_sub = F.col(line).rlike(sub)
    rows = lines.filter(is_sub | F.col(line).rlike(name)).select(
        F.col(order).alias("o"), F.when(is_sub, F.regexp_extract(line, sub, 1)).otherwise(F.regexp_extract(line, name, 1)).alias("id"),
        F.when(is_sub, F.regexp_extract(line, sub, 2)).otherwise("").alias("key"), F.when(is_sub, F.regexp_extract(line, sub, 3)).otherwise(F.regexp_extract(line, name, 2)).alias("value"),
    )
    one = rows.groupBy("id", "key").agg(F.when(F.col("key") == "", F.min_by("value", "o")).otherwise(F.max_by("value", "o")).alias("value"))
    return one.groupBy("id").agg(F.max(F.when(F.col("key") == "", F.col("value"))).alias("name"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("key") != "", F.struct("key", "value"))))).alias("fields"))


def choice_kinds(members: DataFrame, archive: str, member: str, text: str) -> DataFrame:
    """``uuid, kind`` of every <choice> tag of the XML members: its ref, else its type, else TEXT; the first definition by member and place wins."""
    tags = members.select(archive, member, F.posexplode(F.regexp_extract_all(text, F.lit(r"<choice\b[^>]*>"), F.lit(0))).alias("place", "tag"))
    said = lambda name: F.nullif(F.regexp_extract("tag", rf'{name}="([^"]+)"', 1), F.lit(""))
    rows = tags.select(archive, member, "place", said("uuid").alias("uuid"), F.coalesce(said("ref"), said("type"), F.lit("TEXT")).alias("kind")).filter("uuid is not null")
    return rows.groupBy("uuid").agg(F.min_by("kind", F.struct(archive, member, "place")).alias("kind"))


def text_pages(spark: SparkSession, root: str) -> DataFrame:
    """``book, page, text`` of pages kept as <book>/p<N>.txt."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "p*.txt").text(root)
    parts = path_parts(F.col("_metadata.file_path"))
    return raw.select(F.try_element_at(parts, F.lit(-2)).alias("book"), F.regexp_extract(F.try_element_at(parts, F.lit(-1)), r"^p(\d+)$", 1).try_cast("int").alias("page"), F.col("value").alias("text")).filter("page is not null")


def zip_members(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``archive, member, text`` of the members whose name matches; UTF-8, else Windows-1252. One archive at a time, one member at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = re.compile(pattern)
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                for name in sorted(z.namelist()):
                    if wanted.search(name):
                        raw = z.read(name)
                        try:
                            text = raw.decode("utf-8")
                        except UnicodeDecodeError:
                            text = raw.decode("windows-1252", "replace")
                        yield pd.DataFrame([(archive, name, text)], columns=["archive", "member", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, text string")


def xml_records(texts: DataFrame, text: str, schema: str) -> DataFrame:
    """XML texts read by a declared schema, attributes with the prefix '_'; texts that do not parse give null."""
    return texts.withColumn("record", F.from_xml(text, schema, {"mode": "PERMISSIVE"}))


def list_files(spark: SparkSession, root: str, extensions: Sequence[str]) -> DataFrame:
    """``path, length, modified, tokens`` of files by extension; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    name = F.try_element_at(F.split("path", "/"), F.lit(-1))
    kept = files.filter(F.lower("path").rlike(r"\.(" + "|".join(map(re.escape, extensions)) + ")$"))
    return kept.withColumn("tokens", F.array_distinct(F.filter(F.split(slugify(name), "_"), lambda t: F.length(t) >= 3)))


def stale(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose cached signals are absent or older: no cache row has their path, length and time."""
    return listing.join(cache.select("path", "length", "modified").distinct(), ["path", "length", "modified"], "left_anti")


def sniff(content: Column) -> Column:
    """the kind of a picture by its first bytes, null if it is none."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("47494638"), "gif")
        .when(head.startswith("52494646") & (head.substr(17, 8) == "57454250"), "webp").when(head.startswith("424D"), "bmp")
    )


def dataset_parts(parts: dict[str, DataFrame]) -> DataFrame:
    """K9: several tables as one: ``part, record``, each row a JSON object without its null fields, to be written as one dataset."""
    out = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("part"), F.to_json(F.struct(*df.columns)).alias("record"))
        out = rows if out is None else out.unionByName(rows)
    return out
