"""File sources and sinks.

File listings use the ``binaryFile`` source with only ``path`` selected (the
content column is pruned, so files are not read). Outputs go through the
DataFrame writers and their commit protocol; "done" markers are a table of
processed input paths written after the batch.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text(spark: SparkSession, path: str, recursive: bool = False, glob_all: bool = False) -> DataFrame:
    """One row per line (value, path). ``glob_all`` appends ``*`` to the path."""
    reader = spark.read.option("recursiveFileLookup", "true") if recursive else spark.read
    return reader.text(path + "*" if glob_all else path).select(
        "value", F.col("_metadata.file_path").alias("path"))


def read_whole_files(spark: SparkSession, path: str, min_partitions: int | None = None) -> DataFrame:
    """One row per file (path, content)."""
    df = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return df.repartition(min_partitions) if min_partitions else df


_TEXT = "org.apache.hadoop.io.Text"
#: Parts the input's path and the document id in a key of ``write_seqfile``.
KEY_MARK = "#"


def read_seqfile(spark: SparkSession, path: str, with_rel: bool = False) -> DataFrame:
    """S3: (String, String) SequenceFile records as (doc_id, text); ``with_rel`` parts keys of ``write_seqfile``
    into (rel, doc_id, text)."""
    rdd = spark.sparkContext.sequenceFile(path, _TEXT, _TEXT)
    rows = spark.createDataFrame(rdd, "doc_id string, text string")
    if not with_rel:
        return rows
    own = F.substring_index("doc_id", KEY_MARK, -1)
    return rows.select(F.substring("doc_id", F.lit(1), F.length("doc_id") - F.length(own) - len(KEY_MARK)).alias("rel"),
                       own.alias("doc_id"), "text")


def write_seqfile(texts: DataFrame, out: str, codec: str | None = None) -> None:
    """Texts (doc_id, text, rel) as SequenceFiles of (``rel#doc_id``, text), by Hadoop's output committer.

    One folder for all inputs: a row's key names its input, so that one large input is written by many tasks and
    many small ones do not each take a job. Null texts and paths are empty. DataFrames have no such writer, hence
    the RDD. ``doc_id`` must not hold the mark; ``rel`` may.
    """
    key = F.concat(F.coalesce("rel", F.lit("")), F.lit(KEY_MARK), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    pairs = texts.select(key, F.coalesce("text", F.lit(""))).rdd.map(tuple)
    pairs.saveAsNewAPIHadoopFile(out, "org.apache.hadoop.mapreduce.lib.output.SequenceFileOutputFormat", _TEXT, _TEXT,
                                 conf={"mapreduce.output.fileoutputformat.compress": str(codec is not None).lower(),
                                       **({"mapreduce.output.fileoutputformat.compress.codec": codec} if codec else {})})


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """All file paths under ``path`` (recursive); P5 with ``glob``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path")


def list_three_levels(spark: SparkSession, root: str) -> DataFrame:
    """Files at folder/subfolder/file depth."""
    return spark.read.format("binaryFile").load(root.rstrip("/") + "/*/*/*").select("path")


def has_suffix(path: Column, suffix: str) -> Column:
    """P5."""
    return path.endswith(suffix)


def relative_path(path: Column, root_marker: str) -> Column:
    """The part of a path after ``root_marker`` (e.g. 'cw-data/')."""
    return F.regexp_replace(path, "^.*?" + root_marker.replace(".", r"\."), "")


def done_table_path(out: str) -> str:
    return out.rstrip("/") + "/_done"


def incremental_inputs(spark: SparkSession, input_root: str, out: str, suffix: str = ".warc",
                       root_marker: str = "cw-data/") -> DataFrame:
    """Input files without a done marker (left anti join on the
    relative path)."""
    inputs = list_files(spark, input_root, "*" + suffix).select(
        "path", relative_path(F.col("path"), root_marker).alias("rel"))
    try:
        done = spark.read.parquet(done_table_path(out)).select("rel")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return inputs  # no marker table yet: everything is pending
    return inputs.join(done, "rel", "left_anti")


def write_texts(texts: DataFrame, out: str, mode: str = "append", partition_col: str | None = "rel") -> None:
    """Converted texts (doc_id, text, rel) as parquet, one folder per input file."""
    w = texts.write.mode(mode)
    if partition_col:
        w = w.partitionBy(partition_col)
    w.parquet(out)


def mark_done(spark: SparkSession, processed_rel: DataFrame, out: str) -> None:
    """After a successful write, record the processed inputs."""
    processed_rel.select("rel").distinct().write.mode("append").parquet(done_table_path(out))


def write_text_per_doc(docs: DataFrame, out: str, buckets: int = 64) -> None:
    """Document texts as text files, grouped by a hash bucket of the id
    (never one file per row)."""
    (docs.select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.regexp_replace("text", r"[\r\n]+", " "))
                 .alias("value"), (F.abs(F.xxhash64("doc_id")) % buckets).alias("bucket"))
     .write.mode("overwrite").partitionBy("bucket").text(out))


def save_text(lines: DataFrame, out: str, single_file: bool = False) -> None:
    """One string column as text files (``single_file`` for small outputs
    such as a vocabulary listing)."""
    df = lines.coalesce(1) if single_file else lines
    df.write.mode("overwrite").text(out)


def parse_sparse_vectors(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Lines 'label idx:count idx:count ...' -> (line_id, term_id, count);
    the first token (document id or pair count) is dropped, and so are pairs
    that are no numbers."""
    toks = F.split(F.trim(F.col(value_col)), " +")
    base = lines.select(F.col(value_col), F.element_at(toks, 1).alias("label"),
                        F.slice(toks, 2, 1 << 30).alias("pairs"))
    ex = base.select("label", F.explode("pairs").alias("p"))
    kv = F.split("p", ":")
    return ex.select("label", kv.getItem(0).try_cast("long").alias("term_id"),
                     F.get(kv, F.lit(1)).try_cast("double").alias("count")).dropna()


def distinct_topic_keys(lines: DataFrame, value_col: str = "value", first: int = 10) -> DataFrame:
    """Distinct keys among the first ``first`` 'key:prob' entries of the
    '{...}' part of each line."""
    body = F.regexp_extract(F.col(value_col), r"\{(.*)\}", 1)
    entries = F.slice(F.split(body, ","), 1, first)
    keys = F.transform(entries, lambda e: F.trim(F.split(e, ":").getItem(0)).try_cast("double"))
    return lines.select(F.explode(keys).alias("key")).where(F.col("key").isNotNull()).distinct()


def read_sparse_vectors(spark: SparkSession, path: str) -> DataFrame:
    return parse_sparse_vectors(spark.read.text(path))
