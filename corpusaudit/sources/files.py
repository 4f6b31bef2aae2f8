"""Reading code: directories of source files, parquet corpora, and checks on requested targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Language by file extension.
LANGUAGES = {
    "py": "python",
    "js": "javascript",
    "ts": "typescript",
    "rb": "ruby",
    "go": "go",
    "rs": "rust",
}


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a scan that has fewer splits than the cluster has cores.

    A corpus of many files already has enough splits and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _place(path: Column) -> Column:
    """A path in one form: Spark escapes it differently in listings and in rows."""
    return F.url_decode(F.replace(F.regexp_replace(path, "^file:/+", "file:/"), F.lit("+"), F.lit("%2B")))


def read_code_dir(spark: SparkSession, root: str) -> DataFrame:
    """(file_id, path, code) of every file below ``root``; line ends become newlines. A file that is
    not UTF-8 has a null code: it is never edited or written, and ``failed_files`` names it.

    Spark's file sources list files of no bytes but do not read them; what is in the listing and has no
    content is added with an empty text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    raw = files.select(F.col("_metadata.file_path").alias("path"), F.col("content").cast("string").alias("value"))
    text = F.when(F.is_valid_utf8("value"), F.col("value"))
    read = raw.select("path", F.regexp_replace(text, "\r\n?", "\n").alias("code"))
    # the listing is the one that the scan itself is planned from
    listed = spark.createDataFrame([(p,) for p in files.inputFiles()], "path string")
    listed = listed.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"))
    with_content = files.select(_place(F.col("_metadata.file_path")).alias("place"))
    empty = listed.withColumn("place", _place(F.col("path"))).join(with_content, "place", "left_anti")
    every = read.unionByName(empty.select("path", F.lit("").alias("code")))
    return every.select(F.col("path").alias("file_id"), "path", "code")


def failed_files(files: DataFrame) -> DataFrame:
    """Files whose text could not be read."""
    return files.filter("code is null").select("file_id", "path", F.lit("unreadable text").alias("error_message"))


def language_of(path: Column) -> Column:
    extension = F.when(F.contains(path, F.lit(".")), F.substring_index(path, ".", -1))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension), F.lit("unknown"))


def language_mix(files: DataFrame) -> DataFrame:
    return (
        files.groupBy(language_of(F.col("path")).alias("language"))
        .agg(F.count("*").alias("n_files"), F.sum(F.length("code").cast("long")).alias("n_chars"))
    )


def python_files(files: DataFrame) -> DataFrame:
    return files.filter(F.endswith(F.col("path"), F.lit(".py")))


def invalid_targets(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Requested paths that the corpus does not hold."""
    wanted = requests.select("target_path").distinct()
    missing = wanted.join(files.select(F.col("path").alias("target_path")), "target_path", "left_anti")
    return missing.select(
        "target_path",
        F.lit("INVALID_PATH").alias("code"),
        F.concat(F.lit("Invalid target path: "), "target_path").alias("message"),
    )
