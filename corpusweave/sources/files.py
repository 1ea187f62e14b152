"""JSONL, text and CSV sources, and their sinks."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The encodings tried, in order, after byte order marks; those of texts with a share
#: of zero bytes; those that are chosen from by their Hangul; and the names of collections, which no scan takes.
ENCODINGS = ("utf-8", "utf-8-sig", "cp949", "euc-kr")
ZERO_SHARE, WIDE_ENCODINGS = 0.03, ("utf-16", "utf-16-le", "utf-16-be", "utf-32")
SCORED_ENCODINGS = ("utf-8-sig", "utf-8", "cp949", "euc-kr")
MANY_ZEROS, FEW_ZEROS = 0.25, 0.05
COLLECTIONS = ("all_stories", "all_stories.txt")
FINGERPRINT_BYTES = 64 << 20
MARKS = ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"), (b"\xef\xbb\xbf", "utf-8-sig"))


def _counted_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line's number within its split, from 1; a split's lines come in order."""
    now, n = None, 0
    for batch in batches:
        found = []
        for split in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), strict=True):
            now, n = split, n + 1 if split == now else 1
            found.append(n)
        yield batch.append_column("n", pa.array(found, pa.int64()))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 1) and value of the lines of text files. A file that many tasks read gets its
    numbers from those within each split and the lines of the splits before."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    sizes = raw.groupBy("path", "block").agg(F.count("*").alias("size"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    offsets = sizes.select("path", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    numbered = raw.mapInArrow(_counted_lines, "path string, block long, value string, n long")
    return numbered.join(offsets, ["path", "block"]).select("path", (F.col("before") + F.col("n")).alias("line"), "value")


def _fault(value: Column) -> Column:
    """What keeps a line from being an object; null if nothing does."""
    kinds = F.when(F.startswith(value, F.lit("[")), "array").when(F.startswith(value, F.lit('"')), "string").when(value.isin("true", "false"), "boolean").when(value == "null", "null").otherwise("number")
    return F.when(F.try_parse_json(value).isNull(), "invalid JSON").when(~F.startswith(value, F.lit("{")), F.concat(F.lit("expected object, got "), kinds))


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line and error of the lines of JSON files that aren't objects; blank lines are none."""
    lines = read_lines(spark, path).withColumn("value", F.regexp_replace("value", r"(?U)^\s+|\s+$", ""))
    return lines.where("value <> ''").select("path", "line", _fault(F.col("value")).alias("error")).where("error IS NOT NULL")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, missing_ok: bool = False, located: bool = False) -> DataFrame:
    """Strict JSON lines; blank lines are skipped, anything but an object fails: when it is read, or,
    with `located`, at once, naming the path and number of the first bad line."""
    try:
        out = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        if located and (bad := bad_lines(spark, path).orderBy("path", "line").first()):
            raise ValueError(f"{bad['path']}:{bad['line']}: {bad['error']}")
        return out
    except AnalysisException as e:
        if missing_ok and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def _reads(data: bytes, codec: str) -> bool:
    try:
        data.decode(codec)
    except UnicodeDecodeError:
        return False
    return True


def codec_of(data: bytes) -> tuple[str, str]:
    """The codec of a text and how it takes errors: its mark's, else the first that reads it all."""
    marked = [codec for mark, codec in MARKS if data[: len(mark)] == mark]
    if marked:
        return marked[0], "replace"
    zeros = np.count_nonzero(np.frombuffer(data, np.uint8) == 0)
    tried = (WIDE_ENCODINGS if zeros >= ZERO_SHARE * max(1, len(data)) else ()) + ENCODINGS
    return next(((codec, "strict") for codec in tried if _reads(data, codec)), ("utf-8", "replace"))


def likeliest_codec(data: bytes) -> str:
    """The codec by a mark, by where zero bytes stand, or else that which gives the most Hangul."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16-le" if data[0] == 0xFF else "utf-16-be"
    pairs = np.frombuffer(data, np.uint8) == 0
    even, odd = (np.count_nonzero(pairs[k::2]) / max(1, len(data) // 2) for k in (0, 1))
    if len(data) >= 4 and min(even, odd) < FEW_ZEROS and max(even, odd) > MANY_ZEROS:
        return "utf-16-le" if odd > even else "utf-16-be"

    def share(codec: str) -> float:
        seen = [c for c in data.decode(codec, "ignore") if not c.isspace()]
        return sum("가" <= c <= "힣" for c in seen) / max(1, len(seen))

    return max(SCORED_ENCODINGS, key=share)


def decode(data: bytes, scored: bool = False) -> str:
    """A text from its bytes; with `scored` by likeliest_codec(), and bytes it can't read go."""
    codec, errors = (likeliest_codec(data), "ignore") if scored else codec_of(data)
    return data.decode(codec, errors)


def text_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".txt",), limit: int = 0) -> DataFrame:
    """path, length and content of the files of a folder tree with one of the suffixes, in either
    case; with several suffixes, one file a stem, by the suffixes' order, and no collections. With a
    limit, the first files by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
    name = F.lower(F.substring_index("path", "/", -1))
    files = files.where(reduce(Column.__or__, [F.endswith(name, F.lit(x)) for x in suffixes]))
    if len(suffixes) > 1:
        stem, rank = F.regexp_replace("path", r"\.[^./]*$", ""), reduce(lambda acc, k: acc.when(F.endswith(name, F.lit(suffixes[k])), k), range(len(suffixes)), F)
        ranked = files.select("path", stem.alias("stem"), rank.alias("rank"), F.regexp_replace(name, r"\.[^.]*$", "").alias("name")).where(~F.col("name").isin(*COLLECTIONS))
        files = files.join(ranked.groupBy("stem").agg(F.min_by("path", F.struct("rank", "path")).alias("path")).select("path"), "path")  # names only are grouped
    return files.orderBy("path").limit(limit) if limit else files


def read_texts(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".txt",), scored: bool = False, limit: int = 0) -> DataFrame:
    """path and text of the files of text_files(), whatever their encoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([decode(x.as_py(), scored) for x in batch.column("content")], pa.string())], names=["path", "text"])

    return text_files(spark, path, suffixes, limit).select("path", "content").mapInArrow(run, "path string, text string")


def fingerprints(files: DataFrame) -> DataFrame:
    """files(path, content) with sha256 (of the first 64 MiB and the path) and a positive id of it."""
    digest = F.sha2(F.concat(F.substring("content", 1, FINGERPRINT_BYTES), F.col("path").cast("binary")), 256)
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return files.select("path", digest.alias("sha256"), F.greatest(F.lit(1), number % ((1 << 31) - 1)).cast("long").alias("id"))


def read_json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document of a file, over several lines; a missing or broken one gives no rows."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


LEXICON = "terms array<struct<kind:string,term:string,parts:array<string>,skip:int,weight:double,lift:double,human_count:long,ai_count:long>>"
LEAST_WEIGHT = 0.05


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """The terms of a lexicon file: kind, skip, key (parts joined by tabs), weight, lift and counts.
    Parts are those given or the term's words; a term without any is dropped. A missing kind goes by
    the number of parts, weights are at least 0.05, and a missing file has no terms."""
    t = read_json_document(spark, path, LEXICON).select(F.explode("terms").alias("t")).select("t.*")
    words = F.filter(F.split(F.coalesce("term", F.lit("")), r"(?U)\s+"), lambda w: w != "")
    t = t.withColumn("parts", F.when(F.size("parts") > 0, F.col("parts")).otherwise(words)).where(F.size("parts") > 0)
    kind = F.coalesce(F.nullif("kind", F.lit("")), F.when(F.size("parts") == 1, "unigram").otherwise("bigram"))
    weight = F.greatest(F.lit(LEAST_WEIGHT), F.when(F.isnan("weight"), 1.0).otherwise(F.coalesce("weight", F.lit(1.0))))
    return t.select(kind.alias("kind"), F.coalesce("skip", F.lit(0)).alias("skip"), F.array_join("parts", "\t").alias("key"), weight.alias("weight"), "lift", "human_count", "ai_count")


STATS = "struct<human_q10:double,human_q25:double,human_q50:double,human_q75:double,human_q90:double,human_iqr:double,human_mean:double,ai_mean:double,weight:double,ai_in_human_iqr_rate:double,ai_in_human_q10_q90_rate:double,cliffs_delta_human_vs_ai:double,human_n_chunks:long,ai_n_chunks:long>"
USAGE = "struct<human_distribution:map<string,double>,ai_distribution:map<string,double>,weight:double>"
REFERENCE = f"metrics map<string,{STATS}>, anti_slop {STATS}, translationese {STATS}, pos_ngram_usage map<string,{USAGE}>"
#: The names of the two metrics that a reference file keeps apart.
FOLDED = {"anti_slop": "anti_slop_density", "translationese": "translationese_raw"}


def read_style_reference(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A style reference file as metric rows (metric and its statistics) and usage rows (n, key,
    human_p, ai_p, weight). A missing file gives no rows."""
    doc = read_json_document(spark, path, REFERENCE)
    extra = F.array_compact(F.array(*[F.when(F.col(part).isNotNull(), F.struct(F.lit(name).alias("key"), F.col(part).alias("value"))) for part, name in FOLDED.items()]))
    own = F.filter(F.map_entries(F.coalesce("metrics", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{STATS}>")))), lambda e: ~F.exists(extra, lambda x: x["key"] == e["key"]))
    metrics = doc.select(F.explode(F.concat(own, extra)).alias("m")).select(F.col("m.key").alias("metric"), "m.value.*")
    usage = doc.select(F.explode("pos_ngram_usage").alias("n", "u"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    sides = [F.coalesce(f"u.{side}_distribution", empty) for side in ("human", "ai")]
    usage = usage.select("n", F.col("u.weight").alias("weight"), sides[0].alias("h"), sides[1].alias("a"), F.explode(F.array_union(F.map_keys(sides[0]), F.map_keys(sides[1]))).alias("key"))
    p = lambda side: F.coalesce(F.element_at(side, F.col("key")), F.lit(0.0))
    return metrics, usage.select("n", "key", p("h").alias("human_p"), p("a").alias("ai_p"), F.coalesce("weight", F.lit(0.5)).alias("weight"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; a byte order mark in the header is dropped."""
    df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def null_if_not_finite(value: Column) -> Column:
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def _finite(value: Column, kind: T.DataType) -> Column:
    """The value with null for what isn't finite, at any depth."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return null_if_not_finite(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: _finite(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_finite(value.getField(f.name), f.dataType).alias(f.name) for f in kind]))
    return value


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with NaN and infinities as null, also within arrays, maps and structs."""
    df.select(*[_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]).write.mode(mode).json(path)


def write_ragged_csv(frames: list[DataFrame], path: str) -> None:
    """Frames of different columns as one CSV; what a frame lacks is blank."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    out.write.mode("overwrite").option("header", True).csv(path)


def write_json_document(spark: SparkSession, value: dict, path: str) -> None:
    """A manifest: one JSON object of counts, arguments and paths, as a one-row table."""
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False, indent=2, default=str),)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def manifest(spark: SparkSession, stage: str, arguments: dict, packages: tuple[str, ...] = ("pyspark", "pyarrow", "pandas", "numpy")) -> dict:
    """What a run notes of itself: stage, time, arguments and versions (null: not installed)."""
    from importlib import metadata

    def version(name: str) -> str | None:
        try:
            return metadata.version(name)
        except metadata.PackageNotFoundError:
            return None

    return {"stage": stage, "created_at": time.time(), "args": arguments, "spark": spark.version, "packages": {p: version(p) for p in packages}}


def write_eval_folder(spark: SparkSession, path: str, frames: dict[str, DataFrame], kind: str, arguments: dict) -> dict:
    """Each frame as JSON lines under its name, empty ones too, and a manifest with their counts."""
    counts = {}
    for name, df in frames.items():
        write_jsonl(df, f"{path}/{name}")
        counts[name] = spark.read.schema(df.schema).json(f"{path}/{name}").count()
    noted = manifest(spark, kind, arguments) | {"counts": counts}
    write_json_document(spark, noted, f"{path}/manifest")
    return noted


def write_report(spark: SparkSession, path: str, tests: DataFrame, tasks: list[str], samples: DataFrame, top: int = 12, chars: int = 500, most: int = 20) -> str:
    """A Markdown report: of each task the tests with the largest effects (eval_task, metric,
    left_group, right_group, cliffs_delta) and sample texts (eval_task, group, id, text), the first
    `most` of each group by id, cut to `chars`. Only the rows shown reach the driver."""
    first = Window.partitionBy("eval_task", "group").orderBy("id")  # the limit holds before the shuffle
    samples = samples.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).drop("_n")
    out = ["# Report"]
    for task in tasks:
        rows = tests.where(F.col("eval_task") == task).orderBy(F.abs("cliffs_delta").desc_nulls_last(), "metric", "left_group", "right_group").limit(top).collect()
        out += [f"\n## {task}\n", "| metric | left | right | Cliff's delta |", "| --- | --- | --- | ---: |"]
        out += [f"| {r['metric']} | {r['left_group']} | {r['right_group']} | {'NA' if r['cliffs_delta'] is None else format(r['cliffs_delta'], '.4f')} |" for r in rows]
        for r in samples.where(F.col("eval_task") == task).select("group", "id", F.substring("text", 1, chars + 1).alias("text")).orderBy("group", "id").collect():
            out.append(f"\n### {r['group']} {r['id']}\n\n" + (r["text"] or "")[:chars] + (" [...]" if len(r["text"] or "") > chars else ""))
    text = "\n".join(out) + "\n"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text
