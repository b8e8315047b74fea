"""Merkle fixity audit of WARC replicas.

A manifest says where each record of a replica lies and what it hashes to: (page_id, warc_file, warc_offset, warc_length,
sha). ``manifest`` places records that are to be written, ``read_manifest`` parses the bytes of written files, at the same
places. A tree of hashes stands over the ordered offsets of a manifest: a leaf is a record at its offset, the lowest
nodes hash what begins in a range of 64 KiB of a file in order of offset, a node above hashes 16 ranges in order, up to
the whole file, and the files are hashed by 256 in order of their number, up to the replica's root. ``audit`` compares the roots of two
replicas and then only the children of nodes that differ, down to the records that are corrupt, missing, extra or moved.
Records that are the same but in another order or place have other roots.

Payloads are hashed where they are read; only hashes, offsets and lengths are shuffled. Files are cut at ``FILE_BYTES``, so that
a written one can be parsed by one task.

Defined cases: null url or html is empty; a null id is the id -1; repeated ids are records of their own, in order of their
hashes; very long pages are hashed whole, and a file may be longer than ``FILE_BYTES`` by one record; an empty replica misses
every record; two empty ones agree; bytes between records that can't be parsed are no record; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.llm.shared import discard, materialize, small_batches

FAN_BITS = 4
RANGE_BITS = 16
BLOCK_BITS = 12
PART_BITS = 16
FILES_BITS = 8
FILE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
BEGIN, END = "WARC/1.1\r\n", "\r\n\r\n"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """One resource record of WARC 1.1 as a string."""
    name = F.md5(F.concat_ws(" ", page_id.cast("string"), url).cast("binary"))
    uuid = F.regexp_replace(name, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    head = [f"{BEGIN}WARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:", uuid, f">\r\nWARC-Date: {DATE}\r\nWARC-Page-ID: ", page_id.cast("string"), "\r\nWARC-Target-URI: ", url, "\r\nContent-Type: text/html\r\nContent-Length: ", F.octet_length(html).cast("string"), END, html, END]
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in head])


def records(pages: DataFrame) -> DataFrame:
    """(page_id, record): every page as a record."""
    page_id, url, html = F.coalesce(F.col("page_id").cast("long"), F.lit(-1)), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    return pages.select(page_id.alias("page_id"), record(page_id, url, html).alias("record"))


def sha(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def placed(slim: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """``slim`` (page_id, warc_length, sha ..) with warc_file and warc_offset: records follow one another by id and hash.

    Each 4096 ids begin a file, and so does every ``file_bytes`` of them; a task orders the hashes of such a block of ids.
    """
    block = F.shiftright("page_id", BLOCK_BITS)
    before = F.sum("warc_length").over(Window.partitionBy("_block").orderBy("page_id", "sha").rowsBetween(Window.unboundedPreceding, -1))
    at = slim.withColumn("_block", block).withColumn("_at", F.coalesce(before, F.lit(0).cast("long")))
    part = F.floor(F.col("_at") / F.lit(file_bytes))
    first = F.min("_at").over(Window.partitionBy("_block", "_part"))
    named = at.withColumn("_part", part).withColumn("_first", first)
    file = F.shiftleft("_block", PART_BITS) + F.col("_part")
    return named.withColumns({"warc_file": file, "warc_offset": F.col("_at") - F.col("_first")}).drop("_block", "_at", "_part", "_first")


def manifest(recorded: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """The manifest of (page_id, record) as they are placed in files."""
    slim = recorded.select("page_id", F.octet_length("record").cast("long").alias("warc_length"), sha(F.col("record")).alias("sha"))
    return placed(slim, file_bytes)


# ---------------------------------------------------------------- files


def write_warc(recorded: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write (page_id, record) as WARC files: warc_file=N below ``path``, one file in each.

    Spark's text writer commits them; the end of a record is its line end.
    """
    slim = recorded.select("page_id", F.octet_length("record").cast("long").alias("warc_length"), sha(F.col("record")).alias("sha"), "record")
    at = placed(slim, file_bytes).withColumn("value", F.expr(f"substr(record, 1, length(record) - {len(END)})"))
    dealt = at.repartition("warc_file").sortWithinPartitions("warc_file", "warc_offset").select("value", "warc_file")
    dealt.write.partitionBy("warc_file").option("lineSep", END).text(path)


def parse(content: bytes) -> Iterator[tuple[int, int, int]]:
    """(page_id, offset, length) of each record; from bytes that are none it goes on at the next beginning of one."""
    at, begin, end = 0, BEGIN.encode(), END.encode()
    while at < len(content):
        head = content.find(end, at)
        found = content.startswith(begin, at) and head >= 0 and re.search(rb"\r\nWARC-Page-ID: (-?[0-9]+)\r\n(?:.*\r\n)*Content-Length: ([0-9]+)$", content[at:head])
        stop = head + 2 * len(end) + int(found[2]) if found else 0
        if found and content[stop - len(end) : stop] == end:
            yield int(found[1]), at, stop - at
            at = stop
        else:
            at = content.find(begin, at + 1)
            if at < 0:
                return


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of written files, from their bytes alone; a task holds one file, of at most about ``FILE_BYTES``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    number = F.regexp_extract("path", r"warc_file=(-?[0-9]+)", 1).cast("long").alias("warc_file")

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = content.as_py()
                rows = [(i, file, at, n, hashlib.sha256(content[at : at + n]).hexdigest()) for i, at, n in parse(content)]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.string())], names=["page_id", "warc_file", "warc_offset", "warc_length", "sha"])

    return small_batches(files.select(number, "content")).mapInArrow(run, "page_id long, warc_file long, warc_offset long, warc_length long, sha string")


# ---------------------------------------------------------------- trees


def ordered_hash(label: str, *parts: str) -> Column:
    """The hash of a group's rows in their order: of each its ``parts``, the first of which orders them."""
    rows = F.sort_array(F.collect_list(F.struct(*parts)))
    lines = F.array_join(F.transform(rows, lambda r: F.concat_ws(" ", *[r[p].cast("string") for p in parts])), "\n")
    return sha(F.concat(F.lit(f"{label}\n"), lines)).alias("hash")


def trees(good: DataFrame, other: DataFrame) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """(records, levels of offset ranges from the lowest on, levels of files from the lowest on) of both replicas, as written tables.

    Rows of a level are (replica, file, at, hash): ``at`` is the range of offsets, ``file`` the file or range of files.
    """
    columns = ["page_id", "warc_file", "warc_offset", "warc_length", "sha"]
    both = good.select(F.lit(0).alias("replica"), *columns).union(other.select(F.lit(1).alias("replica"), *columns))
    leaves = materialize(both, "leaves")
    at = F.shiftright("warc_offset", RANGE_BITS).alias("at")
    lowest = leaves.groupBy("replica", F.col("warc_file").alias("file"), at).agg(ordered_hash("range", "warc_offset", "warc_length", "page_id", "sha"))
    ranges = [materialize(lowest, "ranges")]
    first, last, most = ranges[0].agg(F.min("file"), F.max("file"), F.max("at")).first()
    for _ in range(-(-int(most or 0).bit_length() // FAN_BITS)):
        up = ranges[-1].groupBy("replica", "file", F.shiftright("at", FAN_BITS).alias("at")).agg(ordered_hash("node", "at", "hash"))
        ranges.append(materialize(up, "nodes"))
    files = [ranges[-1]]
    for _ in range(-(-max(abs(x + (x < 0)) for x in (first or 0, last or 0)).bit_length() // FILES_BITS)):
        up = files[-1].groupBy("replica", F.shiftright("file", FILES_BITS).alias("file")).agg(ordered_hash("files", "file", "hash"))
        files.append(materialize(up.select("replica", "file", F.lit(0).cast("long").alias("at"), "hash"), "nodes"))
    return leaves, ranges, files


def unlike(level: DataFrame, *keys: str) -> DataFrame:
    """The keys whose hashes aren't the same in both replicas, and whether each has any."""
    of = lambda k: F.max(F.when(F.col("replica") == k, F.col("hash")))
    return level.groupBy(*keys).agg(of(0).alias("a"), of(1).alias("b")).where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys)


def below(level: DataFrame, nodes: DataFrame, **shifts: int) -> DataFrame:
    """The rows of a level whose parents are among ``nodes``."""
    named = nodes.select(*[F.col(k).alias(f"_{k}") for k in shifts])
    on = [F.shiftright(k, bits) == F.col(f"_{k}") for k, bits in shifts.items()]
    return level.join(named, on, "left_semi")


def root_of(level: DataFrame) -> dict[int, str]:
    """The root of each replica: the hash of its topmost nodes, two at most."""
    return {r.replica: r.hash for r in level.groupBy("replica").agg(ordered_hash("root", "file", "hash")).collect()}


def audit(good: DataFrame, other: DataFrame) -> DataFrame:
    """(page_id, status, warc_file, warc_offset, warc_length) of every record where ``other`` differs from ``good`` (manifests).

    ``status`` is corrupt (another hash at its place), missing (of other), extra (in other) or moved (the same record,
    elsewhere). The place is that in ``good``, for extra records that in ``other``.
    """
    leaves, ranges, files = trees(good, other)
    roots = root_of(files[-1])
    if roots.get(0) == roots.get(1):
        nothing = leaves.limit(0).select("page_id", F.lit("").alias("status"), "warc_file", "warc_offset", "warc_length")
        return nothing
    differs = materialize(unlike(files[-1], "file"), "differs")
    for level in reversed(files[:-1]):
        differs, last = materialize(unlike(below(level, differs, file=FILES_BITS), "file"), "differs"), differs
        discard(last)
    differs = materialize(differs.withColumn("at", F.lit(0).cast("long")), "differs")
    for level in reversed(ranges[:-1]):
        differs, last = materialize(unlike(below(level, differs, file=0, at=FAN_BITS), "file", "at"), "differs"), differs
        discard(last)
    named = leaves.withColumns({"file": F.col("warc_file"), "at": F.shiftright("warc_offset", RANGE_BITS)})
    near = materialize(below(named, differs, file=0, at=0).drop("file", "at"), "near")
    discard(differs, *ranges, *files[1:])
    # Records of the differing ranges: those at the same place with the same id and hash agree.
    place = ["warc_file", "warc_offset", "warc_length", "page_id", "sha"]
    only = near.groupBy(*place).agg(F.max(F.when(F.col("replica") == 0, 1).otherwise(0)).alias("a"), F.max("replica").alias("b")).where("a <> b")
    # Of one id, the k-th record that good alone has stands against the k-th that other alone has: by hash, then by place.
    rank = F.row_number().over(Window.partitionBy("page_id", "a").orderBy("sha", "warc_file", "warc_offset"))
    ranked = only.withColumn("k", rank).withColumn("_at", F.struct("warc_file", "warc_offset", "warc_length", "sha"))
    pairs = ranked.groupBy("page_id", "k").agg(F.max(F.when(F.col("a") == 1, F.col("_at"))).alias("x"), F.max(F.when(F.col("a") == 0, F.col("_at"))).alias("y"))
    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").when(F.col("x.sha") == F.col("y.sha"), "moved").otherwise("corrupt")
    there = F.coalesce("x", "y")
    return pairs.select("page_id", status.alias("status"), *[there[c].alias(c) for c in ("warc_file", "warc_offset", "warc_length")])


def drill(pages: DataFrame, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """The manifests of a replica and of one with known damage: by the md5 of the id's text, 1 page of 256 each has another last
    character, is lost (its bytes are no record), or comes a second time at the end of its file, under the id that follows -page_id - 1."""
    page_id, url, html = F.coalesce(F.col("page_id").cast("long"), F.lit(-1)), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    given = pages.select(page_id.alias("page_id"), url.alias("url"), html.alias("html"), F.substring(F.md5(page_id.cast("string").cast("binary")), 1, 2).alias("part"))
    # One pass over the payloads gives the hashes of both replicas' records.
    whole, spoiled = record(F.col("page_id"), F.col("url"), F.col("html")), record(F.col("page_id"), F.col("url"), F.concat(F.expr("substr(html, 1, length(html) - 1)"), F.lit("~")))
    again = record(-F.col("page_id") - 2, F.col("url"), F.col("html"))
    slim = given.select("page_id", "part", F.octet_length(whole).cast("long").alias("warc_length"), sha(whole).alias("sha"), F.when(F.col("part") == "00", sha(spoiled)).when(F.col("part") == "02", sha(again)).alias("second"), F.octet_length(again).cast("long").alias("again"))
    good = materialize(placed(slim, file_bytes), "manifest")
    kept = good.where("part <> '01'").withColumn("sha", F.when(F.col("part") == "00", F.col("second")).otherwise(F.col("sha")))
    ends = good.groupBy("warc_file").agg(F.max(F.col("warc_offset") + F.col("warc_length")).alias("end"))
    before = F.coalesce(F.sum("again").over(Window.partitionBy("warc_file").orderBy("page_id", "sha").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = good.where("part = '02'").withColumn("_before", before).join(ends, "warc_file")
    extra = extra.select((-F.col("page_id") - 2).alias("page_id"), F.col("again").alias("warc_length"), F.col("second").alias("sha"), "warc_file", (F.col("end") + F.col("_before")).alias("warc_offset"))
    columns = ["page_id", "warc_length", "sha", "warc_file", "warc_offset"]
    return good.select(*columns), kept.select(*columns).union(extra.select(*columns))
