"""Readers and writers of the analysis files: JSON, delimited text, compressed bitmaps and records."""

from __future__ import annotations

import base64
import json
import struct
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COVERSET = "files map<string, struct<filepath:struct<utf8:string,hex:string>, expanded_hash:string, covered:string, coverable:string, compression:string, config:struct<index:int,inline:array<string>>>>, configs array<array<string>>"
MESSAGE = "reason string, message struct<level:string, code:struct<code:string>, message:string>"


def read_coverset(spark: SparkSession, path: str) -> DataFrame:
    """(file, path, expanded_hash, covered, coverable, compression, config) of a saved set; an error if files or configs is missing."""
    raw = spark.read.schema(COVERSET).option("multiLine", True).json(path)
    ok = F.assert_true(F.col("files").isNotNull() & F.col("configs").isNotNull(), F.lit("files or configs is missing"))
    each = raw.filter(F.coalesce(ok.cast("boolean"), F.lit(True))).select(F.explode("files").alias("file", "f"), "configs")
    name = F.coalesce("f.filepath.utf8", F.decode(F.unhex("f.filepath.hex"), "utf-8"))
    config = F.coalesce("f.config.inline", F.get("configs", F.col("f.config.index")))
    return each.select("file", name.alias("path"), "f.expanded_hash", "f.covered", "f.coverable", F.coalesce("f.compression", F.lit("identity")).alias("compression"), config.alias("config"))


def write_coverset(files: DataFrame, configs: list[list[str]], path: str) -> None:
    """The inverse of ``read_coverset``: one JSON document of files (file, path, expanded_hash, covered, coverable, compression, config_index or config) and configs.

    A set is a report on one program, one document by its form; its files are gathered for that.
    """
    index = F.col("config_index") if "config_index" in files.columns else F.lit(None).cast("int")
    inline = F.col("config") if "config" in files.columns else F.lit(None).cast("array<string>")
    name = F.struct(F.col("path").alias("utf8"), F.lit(None).cast("string").alias("hex"))
    config = F.struct(index.cast("int").alias("index"), F.when(index.isNull(), inline).alias("inline"))
    info = F.struct(name.alias("filepath"), "expanded_hash", "covered", "coverable", "compression", config.alias("config"))
    one = files.groupBy().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file", F.to_json(info).alias("info"))))).alias("files"))
    parsed = F.transform_values("files", lambda _, x: F.from_json(x, COVERSET.split("map<string, ")[1].split(">, configs")[0]))
    one.select(parsed.alias("files"), F.lit(configs).cast("array<array<string>>").alias("configs") if configs else F.array().cast("array<array<string>>").alias("configs")).coalesce(1).write.mode("overwrite").json(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(ord, file, line, col, count, has_count) of a coverage export; items without the usual fields are left out.

    ``ord`` is the file's place in the export. A column that is no number is 1.
    """
    seg = "array<array<string>>"
    raw = spark.read.schema(f"data array<struct<files:array<struct<filename:string, segments:{seg}>>>>").option("multiLine", True).json(path)
    each = raw.select(F.posexplode("data").alias("i", "d")).select("i", F.posexplode("d.files").alias("j", "f")).select(F.struct("i", "j").alias("ord"), F.col("f.filename").alias("file"), F.explode("f.segments").alias("s"))
    each = each.filter("file IS NOT NULL AND file <> '' AND size(s) >= 3")
    has = F.coalesce(~F.get("s", F.lit(3)).isin("false", "0"), F.lit(True))
    col = F.coalesce(F.get("s", F.lit(1)).try_cast("long"), F.lit(1))
    return each.select("ord", "file", F.get("s", F.lit(0)).try_cast("long").alias("line"), col.alias("col"), F.get("s", F.lit(2)).alias("count"), has.alias("has_count")).filter("line IS NOT NULL")


def by_content(segments: DataFrame, sources: DataFrame) -> DataFrame:
    """Segments with ``file`` put as the SHA-256 of the file's bytes, and ``path``; of files of equal bytes the last one of the export counts.

    ``sources`` is (file, content).
    """
    hashed = sources.select(F.col("file").alias("path"), F.sha2("content", 256).alias("hash"))
    each = segments.withColumnRenamed("file", "path").join(hashed, "path")
    last = each.groupBy("hash").agg(F.max("ord").alias("ord"))
    return each.join(last, ["hash", "ord"]).withColumnRenamed("hash", "file")


def read_compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """(idx, directory, file, command, arguments, output) in file order; exactly one of command and arguments is given."""
    entry = "struct<directory:string,file:string,command:string,arguments:array<string>,output:string>"
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<{entry}>")).alias("idx", "c")).select("idx", "c.*")
    one = F.assert_true(F.col("command").isNull() != F.col("arguments").isNull(), F.lit("one of command and arguments is given"))
    return raw.filter(F.coalesce(one.cast("boolean"), F.lit(True)))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """(level, code, message) of the compiler messages among a tool's output lines."""
    rows = spark.read.text(path).filter(F.col("value").startswith("{")).select(F.from_json("value", MESSAGE).alias("m"))
    return rows.filter("m.reason = 'compiler-message'").select("m.message.level", F.col("m.message.code.code").alias("code"), "m.message.message")


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An event log of JSON lines, of each file up to the first line that does not parse; order is the given ``seq``."""
    parsed = F.from_json("value", f"{schema}, bad string", {"columnNameOfCorruptRecord": "bad"})
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("from"), place.alias("place")).filter("value <> ''").select(parsed.alias("e"), "from", "place").select("e.*", "from", "place")
    stop = raw.filter("bad IS NOT NULL").groupBy("from").agg(F.min("place").alias("stop"))
    return raw.filter("bad IS NULL").join(stop, "from", "left").filter("stop IS NULL OR place < stop").drop("bad", "stop", "place", "from")


def merged_metadata(parts: list[DataFrame], key: str = "proj_key") -> DataFrame:
    """All parts as one; an error, when read, if a key stands for two values."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    values = F.count_distinct(F.struct(*[c for c in out.columns if c != key]))
    n = out.groupBy(key).agg(values.alias("n"), *(F.first(c).alias(c) for c in out.columns if c != key))
    return n.filter(F.coalesce(F.assert_true(F.col("n") <= 1, F.lit("a key has two values")).cast("boolean"), F.lit(True))).select(*out.columns)


def write_relations(relations: dict[str, DataFrame], path: str) -> None:
    """One folder of tab-separated text for each relation."""
    for name, df in relations.items():
        df.write.mode("overwrite").option("sep", "\t").csv(f"{path}/{name}")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


@contextmanager
def recorded(spark: SparkSession, path: str) -> Iterator[dict]:
    """A record that its user fills and that is written as JSON at the end, also when the work inside fails."""
    record: dict = {}
    try:
        yield record
    finally:
        spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_graph(nodes: DataFrame, path: str) -> None:
    """Provenance nodes as Parquet, a folder for each run if there is ``run_id``."""
    w = nodes.write.mode("overwrite")
    (w.partitionBy("run_id") if "run_id" in nodes.columns else w).parquet(path)


#: Bytes of a bitmap that are packed or unpacked at a time.
CHUNK = 1 << 13


def lines_of_bitmaps(rows: DataFrame, column: str, name: str = "line") -> DataFrame:
    """(file, line) of base64 bitmaps: bit n of the little-endian bytes is line n; compression is identity, zlib or zstd.

    A bitmap is held as its bytes; its lines are laid out a piece of it at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpack = {"identity": bytes, "zlib": zlib.decompress, "zstd": lambda b: zstandard.ZstdDecompressor().decompressobj().decompress(b)}
        for pdf in batches:
            held: list[pd.DataFrame] = []
            for file, kind, data in pdf.itertuples(index=False):
                raw = np.frombuffer(unpack[kind](base64.b64decode(data or "")), np.uint8)
                for at in range(0, len(raw), CHUNK):
                    lines = np.flatnonzero(np.unpackbits(raw[at : at + CHUNK], bitorder="little")) + 8 * at
                    held.append(pd.DataFrame({"file": file, name: lines}, columns=["file", name]))
                    if sum(map(len, held)) >= 8 * CHUNK:
                        yield pd.concat(held)
                        held = []
            if held:
                yield pd.concat(held)

    return rows.select("file", "compression", column).mapInPandas(run, f"file string, {name} long")


def bitmaps_of_lines(lines: DataFrame, compression: str = "identity") -> DataFrame:
    """(file, bitmap) of (file, line), the inverse of ``lines_of_bitmaps``.

    Distinct lines are packed to pieces of 8 kB first, which one task after the other
    puts together: of a file no more is held than its bitmap. A negative or missing line is a ValueError.
    """

    def piece(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if pd.isna(key[1]) or key[1] < 0:
            raise ValueError("lines are whole numbers from 0 on")
        bits = np.zeros(8 * CHUNK, bool)
        bits[pdf["line"].to_numpy() - 8 * CHUNK * key[1]] = True
        raw = np.packbits(bits, bitorder="little").tobytes()
        return pd.DataFrame({"file": [key[0]], "piece": [key[1]], "raw": [raw.rstrip(b"\0")]})

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        raw = bytearray(int(pdf["piece"].max()) * CHUNK + len(pdf["raw"][pdf["piece"].idxmax()]))
        for n, x in zip(pdf["piece"], pdf["raw"], strict=True):
            raw[n * CHUNK : n * CHUNK + len(x)] = x
        pack = {"identity": bytes, "zlib": lambda b: zlib.compress(bytes(b)), "zstd": lambda b: zstandard.ZstdCompressor().compress(bytes(b))}
        return pd.DataFrame({"file": [key[0]], "bitmap": [base64.b64encode(pack[compression](raw)).decode()]})

    each = lines.select("file", "line", F.floor(F.col("line") / (8 * CHUNK)).cast("long").alias("piece"))
    # the distinct rows are dealt by file and piece, as the pieces are
    pieces = each.repartition("file", "piece").distinct().groupBy("file", "piece").applyInPandas(piece, "file string, piece long, raw binary")
    return pieces.groupBy("file").applyInPandas(whole, "file string, bitmap string")


def read_checks(spark: SparkSession, path: str) -> DataFrame:
    """(run, seq, tag, val) of zstd streams of 9-byte records: a tag, then an unsigned value, little-endian."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        for pdf in batches:
            for name, content in pdf.itertuples(index=False):
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                rows = [(name, i // 9, raw[i], struct.unpack_from("<Q", raw, i + 1)[0]) for i in range(0, len(raw) - len(raw) % 9, 9)]
                yield pd.DataFrame([(*r[:3], str(r[3])) for r in rows], columns=["run", "seq", "tag", "val"])

    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "run string, seq long, tag int, val string")
    return out.withColumn("val", F.col("val").cast("decimal(20,0)"))
