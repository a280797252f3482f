import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import library


def envelope(root, book, domain, category, items):
    d = root / book / domain
    d.mkdir(parents=True, exist_ok=True)
    (d / f"{category}.json").write_text(items if isinstance(items, str) else json.dumps({"book": book, "domain": domain, "category": category, "items": items}))


@pytest.fixture
def root(tmp_path):
    envelope(tmp_path, "core", "gear", "lamps", [{"id": "a", "name": "A", "system": {"price": 5, "on": True}}, {"id": "b", "name": "B", "meta": {"page": 3, "qaStatus": "approved", "sources": [{"book": "core", "page": 3}], "conflicts": ["price"], "extractedAt": "2024-01-01", "descriptionFrom": "more", "variantOf": "a"}}])
    envelope(tmp_path, "core", "spells", "light", [])
    envelope(tmp_path, "core", "gear", "broken", "{oops")
    envelope(tmp_path, "_raw", "gear", "lamps", [{"id": "z"}])
    envelope(tmp_path, "Bad Name", "gear", "lamps", [{"id": "y"}])
    return tmp_path


def test_library_scan(spark, root):
    got = {(r["book"], r["category"]): r["error"] for r in library.scan_files(spark, str(root)).collect()}
    assert got == {("core", "lamps"): None, ("core", "light"): None, ("core", "broken"): "unreadable", ("Bad%20Name", "lamps"): "bad-segment"}
    items = library.read_library(spark, str(root)).orderBy("position").collect()
    assert [(r["id"], r["position"]) for r in items] == [("a", 0), ("b", 1)] and items[0]["system"] == {"price": "5", "on": "true"}
    meta = items[1]["meta"]
    assert (meta["qaStatus"], meta["conflicts"], meta["extractedAt"], meta["descriptionFrom"], meta["variantOf"], [tuple(x) for x in meta["sources"]]) == ("approved", ["price"], "2024-01-01", "more", "a", [("core", 3)])
    tree = {(r["domain"], r["category"]): (r["items"], r["error"]) for r in library.catalog_tree(spark, str(root)).collect()}
    assert tree == {("gear", "lamps"): (2, None), ("spells", "light"): (0, None), ("gear", "broken"): (0, "unreadable")}
    one = library.read_category(spark, str(root), "core", "gear", "lamps")
    assert one.count() == 2 and len(one.inputFiles()) == 1
    with pytest.raises(ValueError):
        library.read_category(spark, str(root), "..", "gear", "lamps")


def test_sinks(spark, root, tmp_path):
    items = library.read_library(spark, str(root)).drop("system", "meta", "position")
    out = str(tmp_path / "table")
    library.write_library(items, out)
    library.write_library(items.filter("id = 'a'").withColumn("category", F.lit("new")), out)
    assert sorted((r["category"], r["id"]) for r in spark.read.parquet(out).collect()) == [("lamps", "a"), ("lamps", "b"), ("new", "a")]
    assert library.export_strict(items, str(tmp_path / "x"), str(tmp_path / "stage")) == library.export_strict(items, str(tmp_path / "x"), str(tmp_path / "stage")) == 2 and spark.read.parquet(str(tmp_path / "x")).count() == 2
    with pytest.raises(ValueError, match="duplicate"):
        library.export_strict(items.union(items), str(tmp_path / "x"), str(tmp_path / "stage"))
    with pytest.raises(ValueError, match="nothing"):
        library.export_strict(items.limit(0), str(tmp_path / "x"), str(tmp_path / "stage"))
    assert spark.read.parquet(str(tmp_path / "x")).count() == 2 and not (tmp_path / "x.old").exists()


def test_other_sources(spark, tmp_path):
    lines = ["w.a1 = Lamp", "w.a1.page = 7", "w.b2 = Torch", "x.a1 = Zamp", "w.a1.page = 3", "junk", "w.b2.desc=It = bright "]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    assert sorted((r["id"], r["name"], r["fields"]) for r in library.properties(df, "line", "n").collect()) == [("a1", "Lamp", {"page": "3"}), ("b2", "Torch", {"desc": "It = bright"})]
    (tmp_path / "core").mkdir()
    (tmp_path / "core" / "p3.txt").write_text("page three")
    assert [tuple(r) for r in library.text_pages(spark, str(tmp_path)).collect()] == [("core", 3, "page three")]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("data/en/x.xml", "<item id='1'><name>Lamp</name></item>")
        z.writestr("data/de/x.xml", "<no/>")
        z.writestr("data/en/y.xml", "Überzug".encode("windows-1252"))
    (tmp_path / "b.zip").write_bytes(b"no archive")
    members = library.zip_members(spark, str(tmp_path / "*.zip"), r"/en/.*\.xml$")
    assert sorted(r["text"] for r in members.collect()) == ["<item id='1'><name>Lamp</name></item>", "Überzug"]
    parsed = library.xml_records(members.filter("text like '<%'"), "text", "_id string, name string").first()["record"]
    assert (parsed["_id"], parsed["name"]) == ("1", "Lamp")
    tags = spark.createDataFrame([("a", "y.xml", '<choice uuid="1" type="T"/>'), ("a", "x.xml", '<x><choice uuid="1" ref="R" type="T"/><choice type="U"><choice uuid="2"/></choice></x>'), ("a", "z", None)], "archive string, member string, text string")
    assert {r["uuid"]: r["kind"] for r in library.choice_kinds(tags, "archive", "member", "text").collect()} == {"1": "R", "2": "TEXT"}
    reg = tmp_path / "books.json"
    reg.write_text(json.dumps({"core": {"title": "Core", "pageOffset": 2}, "more": {"date": "2020-01"}}))
    assert sorted((r["slug"], r["pageOffset"], r["date"]) for r in library.registry(spark, str(reg)).collect()) == [("core", 2, None), ("more", None, "2020-01")]


def test_listing_staleness_and_kinds(spark, tmp_path):
    (tmp_path / "icons").mkdir()
    (tmp_path / "icons" / "iron-lamp.png").write_bytes(b"\x89PNG\r\n\x1a\n0000")
    (tmp_path / "icons" / "notes.txt").write_text("x")
    listing = library.list_files(spark, str(tmp_path / "icons"), ["png", "webp"])
    assert [r["tokens"] for r in listing.collect()] == [["iron", "lamp", "png"]]
    assert library.stale(listing, listing).count() == 0 and library.stale(listing, listing.withColumn("length", F.col("length") + 1)).count() == 1
    kinds = spark.createDataFrame([(bytearray(b"\xff\xd8\xff\xe0"),), (bytearray(b"RIFF0000WEBPVP8 "),), (bytearray(b"RIFF0000WAVE"),), (None,)], "c binary")
    assert [r[0] for r in kinds.select(library.sniff(F.col("c"))).collect()] == ["jpeg", "webp", None, None]


def test_stream_equals_table(spark, tmp_path):
    from tessera.streaming.rollup import deduplicated, windowed_counts

    df = spark.createDataFrame([(1, "2024-01-01 00:01:00", "a", 1.0), (2, "2024-01-01 00:04:00", "a", 2.0), (2, "2024-01-01 00:04:00", "a", 2.0), (3, "2024-01-01 09:00:00", "b", 5.0)], "id int, at string, k string, v double")
    df = df.withColumn("at", F.col("at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "at", "k", "v", "5 minutes", "1 hour").writeStream.outputMode("append").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    batch = windowed_counts(df, "at", "k", "v", "5 minutes", "1 hour")
    closed = sorted(map(tuple, spark.sql("select * from counts").collect()))
    assert closed == [("2024-01-01 00:00:00", "a", 3, 5.0)] and set(closed) <= set(map(tuple, batch.collect()))
    q = deduplicated(stream, "at", ["id"], "1 hour").writeStream.outputMode("append").format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start()
    q.awaitTermination(120)
    assert sorted(r["id"] for r in spark.sql("select * from once").collect()) == sorted(r["id"] for r in deduplicated(df, "at", ["id"], "1 hour").collect()) == [1, 2, 3]
