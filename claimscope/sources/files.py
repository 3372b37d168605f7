"""File sources and sinks, through Spark's readers and writers alone, so that any store Spark knows will do."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.functions.digest import Sha256
from claimscope.session import cut, discard

#: Bytes of a file that one task reads and hashes whole, of a file in one round, and of a piece; and names that Spark's reader of lines takes for compressed.
WHOLE, CHUNK, PIECE = 128 << 20, 128 << 20, 1 << 16
PACKED = r"(?i)\.(gz|bz2|deflate|lz4|snappy|zst|zstd|passthrough)$"

_NULL, _EMPTY = "\\N", "\u0001"

#: Columns of a run's result log.
RESULT_LOG = "idx long, post string, predicted_claim string, gold_claim string, meteor double, model string, latency_ms double, input_tokens long, output_tokens long"


def read_posts_csv(spark: SparkSession, path: str, sep: str = ",", line_sep: str | None = None) -> DataFrame:
    """CSV or TSV with header: ``normalized claim`` becomes gold_claim, which is null where the column is absent; quoted line breaks, quotes and
    blanks at the edges are read as they stand; an empty field with quotes is an empty text, one without or \\N is null. The line separator is found in the file unless it is given."""
    rows = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True, lineSep=line_sep, nullValue=_NULL, emptyValue=_EMPTY, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = rows.select(*[F.when(F.col(f"`{c}`") != _EMPTY, F.col(f"`{c}`")).when(F.col(f"`{c}`").isNotNull(), "").alias(c) for c in rows.columns])
    if "normalized claim" in rows.columns:
        rows = rows.withColumnRenamed("normalized claim", "gold_claim")
    return rows if "gold_claim" in rows.columns else rows.withColumn("gold_claim", F.lit(None).cast("string"))


def write_posts_csv(rows: DataFrame, path: str, sep: str = ",") -> None:
    """CSV or TSV with header, every field quoted, quotes doubled; null is \\N."""
    rows.write.csv(path, header=True, sep=sep, quote='"', escape='"', quoteAll=True, emptyValue="", nullValue=_NULL, lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_result_log(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of a JSON-lines log, without failed ones."""
    return predictions(spark.read.schema(RESULT_LOG).json(path))


def predictions(log: DataFrame) -> DataFrame:
    return log.filter(~F.coalesce(F.col("predicted_claim"), F.lit("")).rlike("^(ERROR|TIMEOUT):"))


def to_do(rows: DataFrame, log: DataFrame, key: str = "idx") -> DataFrame:
    """Rows whose id is not in the log yet."""
    return rows.join(log.select(key), key, "left_anti")


def append_results(rows: DataFrame, path: str, kind: str = "json") -> None:
    rows.write.mode("append").format(kind).save(path)


def write_predictions(rows: DataFrame, path: str, run_id: str) -> None:
    """Official prediction file: id, pred_label, run_id by id. The export is small and one file by definition."""
    rows.select("id", F.when(F.col("pred") == 1, "Yes").otherwise("No").alias("pred_label"), F.lit(run_id).alias("run_id")).orderBy("id").coalesce(1).write.mode("overwrite").csv(path, header=True, sep="\t")


def file_profile(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(name, length, n_columns, columns, has_language): a row a file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    lang = any(c.lower() in ("lang", "language") for c in columns)
    return named.select("name", "length", F.lit(len(columns)).alias("n_columns"), F.lit(",".join(columns)).alias("columns"), F.lit(lang).alias("has_language"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each block of a file (path, start, line in order) in pieces of about PIECE bytes; a line break stands in front of each line but a file's first."""
    block, held, size, seq = None, [], 0, 0

    def flush() -> pa.RecordBatch:
        data = b"\n".join(held)
        return pa.RecordBatch.from_pydict({"path": [block[0]], "start": [block[1]], "seq": [seq], "n": [len(data)], "piece": pa.array([data], pa.binary())})

    for batch in batches:
        paths, starts = batch.column("path").dictionary_encode(), batch.column("start").to_numpy()
        names, number = paths.dictionary.to_pylist(), paths.indices.to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(starts) != 0) | (np.diff(number) != 0)) + 1).tolist(), batch.num_rows]
        for lo, hi in itertools.pairwise(edges):
            if lo == hi:
                continue
            if (names[number[lo]], int(starts[lo])) != block:
                if held:
                    yield flush()
                block, held, size, seq = (names[number[lo]], int(starts[lo])), [], 0, 0
                if block[1]:
                    held = [b""]
            for line in batch.column("line").slice(lo, hi - lo).to_pylist():
                held.append(line)
                size += len(line) + 1
                if size >= PIECE:
                    yield flush()
                    held, size, seq = [b""], 0, seq + 1
    if held:
        yield flush()


def _advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of some files in order, each file's state first: (path, state) after its pieces."""
    path, h = None, None
    for batch in batches:
        for name, start, piece in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "piece")), strict=True):
            if start < 0:
                if h:
                    yield pa.RecordBatch.from_pydict({"path": [path], "state": pa.array([h.state()], pa.binary())})
                path, h = name, Sha256(piece)
            else:
                h.update(piece)
    if h:
        yield pa.RecordBatch.from_pydict({"path": [path], "state": pa.array([h.state()], pa.binary())})


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, lengths, states, missing = (batch.column(c).to_pylist() for c in ("path", "length", "state", "missing"))
        digests = []
        for name, length, state, gap in zip(names, lengths, states, missing, strict=True):
            h = Sha256(state)
            if gap in (1, 4):
                h.update(b"\n")
            if h.n != length:
                raise ValueError(f"{name}: {h.n} of {length} bytes read")
            digests.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(digests, pa.string())], ["path", "digest"])


def _chained(large: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, digest) of files (path, length), whose lines are (path, start of the block, line), hashed CHUNK bytes a round: a task goes on from the state in which the round before left its file.

    Spark's reader takes a file apart at line breaks, keeps all other bytes, and leaves out the file's last line break and a byte order mark at its front; the number of bytes tells which of the two are missing.
    """
    pieces = cut(lines.mapInArrow(_pieces, "path string, start long, seq long, n long, piece binary").withColumn("chunk", F.floor(F.col("start") / CHUNK)), "chunk")
    read = pieces.groupBy("path").agg(F.sum("n").alias("n"))
    files = cut(large.join(read, "path", "left").select("path", "length", (F.col("length") - F.coalesce("n", F.lit(0))).alias("missing")))
    mark = Sha256()
    mark.update(b"\xef\xbb\xbf")
    state = files.select("path", F.when(F.col("missing").isin(3, 4), F.lit(mark.state())).otherwise(F.lit(Sha256().state())).alias("state"))
    parts, rounds = 2 * files.count(), pieces.agg(F.max("chunk")).first()[0]
    for k in range(0 if rounds is None else rounds + 1):
        rows = pieces.filter(F.col("chunk") == k).select("path", "start", "seq", "piece")
        rows = rows.unionByName(state.select("path", F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("seq"), F.col("state").alias("piece")))
        after = cut(rows.repartition(parts, "path").sortWithinPartitions("path", "start", "seq").mapInArrow(_advance, "path string, state binary"), free=True)
        discard(state)
        state = after
    found = cut(files.join(state, "path").mapInArrow(_finish, "path string, digest string"))
    discard(pieces, files, state)
    return found


def manifest(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(name, digest) of the files below ``path``, by SHA-256; the name is the path below it.

    A file above WHOLE bytes is read in blocks by many tasks and hashed in rounds, so that no task reads more than about CHUNK bytes of it. Files that Spark's reader of
    lines would decompress by their names are read whole, and so is a stretch without a line break; both must stay below 2 GB. Spark lists no empty files.
    """
    read = lambda kind, **options: spark.read.format(kind).options(recursiveFileLookup=True, pathGlobFilter=pattern, **options).load(path)
    files, packed = read("binaryFile"), F.col("_metadata.file_name").rlike(PACKED)
    whole = files.filter(F.col("length") <= WHOLE).unionByName(files.filter((F.col("length") > WHOLE) & packed)).select("path", F.sha2("content", 256).alias("digest"))
    large = files.filter((F.col("length") > WHOLE) & ~packed).select("path", "length", F.col("_metadata.file_path").alias("key"))
    if not large.isEmpty():
        lines = read("text", lineSep="\n").filter((F.col("_metadata.file_size") > WHOLE) & ~packed)
        lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
        digests = _chained(large.select(F.col("key").alias("path"), "length"), lines)
        whole = whole.unionByName(large.join(digests.withColumnRenamed("path", "key"), "key").select("path", "digest"))
    name = F.regexp_replace(F.element_at(F.split("path", re.escape(path.rstrip("/")) + "/", 2), -1), "^/", "")
    return whole.select(name.alias("name"), "digest")


def check_manifest(spark: SparkSession, path: str, listed: DataFrame) -> DataFrame:
    """(name, status): ok, mismatch, missing or unexpected, by SHA-256 against (name, digest)."""
    joined = manifest(spark, path, "*").withColumnRenamed("digest", "actual").join(listed, "name", "full_outer")
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("digest").isNull(), "unexpected").when(F.lower("digest") == F.col("actual"), "ok").otherwise("mismatch")
    return joined.select("name", status.alias("status"))
