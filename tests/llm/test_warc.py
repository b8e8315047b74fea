import pytest
from pyspark.sql import functions as F

from loomgrid.llm import warc
from loomgrid.llm.shared import scratch


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h{i % 3}.org/{i}", f"<p>{i}</p>" * (i % 7)) for i in range(300)]
    rows += [(10, "http://again.org", "twice"), (None, None, None), (5000, "http://far.org", None), (5000, "http://far.org", None), (70000, "http://last.org", "é" * 100_000)]
    rows += [(60, "http://nested.org", "WARC/1.1\r\nWARC-Page-ID: 7\r\nContent-Length: 2\r\n\r\nhi\r\n\r\nWARC/1.1\r\n")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def key(df):
    return sorted(map(tuple, df.select("page_id", "warc_file", "warc_offset", "warc_length", "sha").collect()))


def statuses(a, b):
    return sorted((r.page_id, r.status) for r in warc.audit(a, b).collect())


def of(pages):
    return warc.manifest(warc.records(pages))


def test_equal_replicas_agree(pages):
    assert statuses(of(pages), of(pages.repartition(5))) == []


@pytest.mark.parametrize("file_bytes", [2_000, warc.FILE_BYTES])
def test_written_files_have_the_manifest(spark, pages, file_bytes):
    path, recorded = scratch(spark, "warc"), warc.records(pages)
    warc.write_warc(recorded, path, file_bytes)
    planned = warc.manifest(recorded, file_bytes)
    assert key(warc.read_manifest(spark, path)) == key(planned) and planned.count() == pages.count()
    files = planned.groupBy("warc_file").agg(F.max(F.col("warc_offset") + F.col("warc_length")).alias("n")).collect()
    sizes = {r.path.split("warc_file=")[1].split("/")[0]: r.length for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path", "length").collect()}
    assert sizes == {str(r.warc_file): r.n for r in files}
    assert statuses(planned, warc.read_manifest(spark, path)) == []


def test_damaged_bytes_are_located(spark, pages, tmp_path):
    recorded = warc.records(pages.where("page_id < 300"))
    good = {}
    for r in warc.manifest(recorded).collect():
        good.setdefault((r.page_id, r.sha), r)
    path = scratch(spark, "warc")
    warc.write_warc(recorded, path)
    content = bytearray(next(r.content for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).collect() if "warc_file=0" in r.path))
    place = {r.page_id: r for r in good.values() if r.page_id not in (10, 60)}
    content[place[43].warc_offset + place[43].warc_length - 6] ^= 1  # a payload byte
    content[place[77].warc_offset : place[77].warc_offset + place[77].warc_length] = bytes(place[77].warc_length)  # lost
    content[place[90].warc_offset + 3] ^= 1  # the beginning of a record: no record any more
    content += b"WARC/1.1\r\nWARC-Page-ID: 999\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    folder = tmp_path / "other" / "warc_file=0"
    folder.mkdir(parents=True)
    (folder / "part-0").write_bytes(bytes(content))
    other = warc.read_manifest(spark, str(tmp_path / "other"))
    want = warc.manifest(recorded).where("warc_file = 0")
    out = {r.page_id: r for r in warc.audit(want, other).collect()}
    assert {i: r.status for i, r in out.items()} == {43: "corrupt", 77: "missing", 90: "missing", 999: "extra"}
    assert all((out[i].warc_offset, out[i].warc_length) == (place[i].warc_offset, place[i].warc_length) for i in (43, 77, 90))
    assert out[999].warc_offset == len(content) - out[999].warc_length


def test_order_and_offset_alone_change_the_root(pages):
    good = of(pages)
    a, b = sorted(good.where("page_id in (14, 21)").collect(), key=lambda r: r.warc_offset)
    swapped = good.withColumn("warc_offset", F.when(F.col("page_id") == a.page_id, b.warc_offset).when(F.col("page_id") == b.page_id, a.warc_offset).otherwise(F.col("warc_offset")))
    assert statuses(good, swapped) == [(14, "moved"), (21, "moved")]
    shifted = good.withColumn("warc_offset", F.col("warc_offset") + F.when(F.col("page_id") == 299, 1).otherwise(0))
    assert statuses(good, shifted) == [(299, "moved")]
    elsewhere = good.withColumn("warc_file", F.when(F.col("page_id") == 70000, 99).otherwise(F.col("warc_file")))
    assert statuses(good, elsewhere) == [(70000, "moved")]


def test_only_differing_branches_are_descended(pages, monkeypatch):
    seen = {}
    materialize = warc.materialize

    def counted(df, name, codec="snappy"):
        out = materialize(df, name, codec)
        seen.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(warc, "materialize", counted)
    good = of(pages)
    assert statuses(good, good.where("page_id <> 5")) == [(5, "missing")]
    assert max(seen["differs"]) == 1 and seen["near"][0] < 2 * pages.count()
    seen.clear()
    assert statuses(good, good) == [] and "differs" not in seen


def test_a_lost_copy_is_found(pages):
    assert statuses(of(pages), of(pages.dropDuplicates())) == [(5000, "missing")]


def test_empty_replicas(pages):
    none = pages.limit(0)
    assert statuses(of(none), of(none)) == []
    assert [s for _, s in statuses(of(pages), of(none))] == ["missing"] * pages.count()
    assert [s for _, s in statuses(of(none), of(pages))] == ["extra"] * pages.count()


def test_clashing_columns(pages):
    names = "replica file at hash sha k a b x y _block _part record part".split()
    good = of(pages).withColumns({n: F.lit(n) for n in names if n != "sha"})
    assert statuses(good, good.where("page_id <> 5")) == [(5, "missing")]
    assert key(of(pages.withColumns({n: F.lit(n) for n in names}))) == key(of(pages))
    a, b = warc.drill(pages.withColumns({n: F.lit(n) for n in names}))
    assert statuses(a, b) == statuses(*warc.drill(pages))


def test_record_form(pages):
    r = warc.records(pages.where("page_id = 3").withColumn("record", F.lit(1))).first().record
    head, body = r.split("\r\n\r\n", 1)
    assert head.startswith("WARC/1.1\r\n") and body == "<p>3</p>" * 3 + "\r\n\r\n" and f"Content-Length: {len(body) - 4}" in head
