"""Reading artefacts and writing results through Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T


def read_texts(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """A row per file: filename, text, modified. Unreadable files are skipped."""
    reader = spark.read.option("recursiveFileLookup", recursive).option("ignoreMissingFiles", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("filename"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """S4."""
    return read_texts(spark, path, "*.md")


def find_files(spark: SparkSession, path: str, glob: str, most: int = 20) -> DataFrame:
    """Names of at most so many files; contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return df.select("path", "modificationTime").orderBy("path").limit(most)


def latest_change(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """The latest modification time."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return df.agg(F.max("modificationTime").alias("latest"))


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """S3: one document per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def from_stdin(spark: SparkSession, text: str) -> DataFrame:
    """Text piped in; its name selects the output mode."""
    return spark.createDataFrame([("stdin.txt", text)], "filename string, text string")


def prompt_list(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines without blanks and comments."""
    return prompts_in(spark.read.text(path).withColumnRenamed("value", "line"))


def prompts_in(lines: DataFrame, col: str = "line") -> DataFrame:
    bare = T.trim(F.col(col))
    return lines.select(bare.alias("prompt")).where((F.col("prompt") != "") & ~F.col("prompt").startswith("#"))


def staged(files: DataFrame) -> DataFrame:
    """Added, copied and modified files of a change list (file, content, status)."""
    return files.where(F.substring("status", 1, 1).isin("A", "C", "M"))


def committable(tracked: DataFrame, untracked: DataFrame) -> DataFrame:
    """Tracked files and untracked ones that aren't ignored, flagged."""
    both = tracked.select("file", F.lit(True).alias("tracked")).unionByName(untracked.select("file", F.lit(False).alias("tracked")))
    return both.groupBy("file").agg(F.bool_or("tracked").alias("tracked"))


def editor_context(selection, references):
    """The selection if it says something, else the first readable reference's text, else empty."""
    some = lambda x: F.coalesce(T.trim(x) != "", F.lit(False))
    first = F.get(F.filter(references, lambda r: some(r["text"])), F.lit(0))["text"]
    return F.when(some(selection), selection).otherwise(F.coalesce(first, F.lit("")))


#: References that the host adds by itself.
IMPLICIT = ("vscode.instructions.", "vscode.customizations.", "vscode.implicit.")


def intentional_references(references):
    """References with a typed range, or of an id that isn't added by the host."""
    return F.filter(references, lambda r: r["range"].isNotNull() | ~(r["id"].startswith(IMPLICIT[0]) | r["id"].startswith(IMPLICIT[1]) | r["id"].startswith(IMPLICIT[2])))


def workspace_path(scheme, untitled, file, folder):
    """Path inside the workspace folder, base name outside any, null if it is no file."""
    inside = folder.isNotNull() & file.startswith(F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/")))
    relative = F.substr(file, F.length(F.regexp_replace(folder, "/+$", "")) + 2)
    return F.when(F.coalesce(untitled, F.lit(False)) | (scheme != "file"), F.lit(None).cast("string")).when(inside, relative).otherwise(F.substring_index(file, "/", -1))


def write_text(df: DataFrame, path: str, text_col: str = "output", filename_col: str | None = None) -> None:
    """Results as text, redacted on the way out."""
    from textloom.operators import secrets

    secrets.protected_result(df, text_col, filename_col).select(F.concat(F.col(text_col), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def write_compressed_copies(df: DataFrame, path: str) -> None:
    """``<file>.compressed`` beside each file's name, as a table."""
    from textloom.operators import secrets

    out = secrets.protected_result(df, "output", "filename" if "filename" in df.columns else None)
    out.select(F.concat("filename", F.lit(".compressed")).alias("filename"), "output").write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """An audit record or snapshot."""
    df.write.mode("overwrite").json(path)


def merge_state(path: str, spark: SparkSession, new: DataFrame, key: str) -> DataFrame:
    """The state table with new rows in place of those of the same key."""
    old = spark.read.schema(new.schema).parquet(path)
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def write_state(path: str, spark: SparkSession, new: DataFrame, key: str) -> None:
    """Merge new rows into the state table and put the result in its place; no table yet is an
    empty one. The merged table is whole before the old one goes."""
    target, next_ = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path.rstrip('/')}.next"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    merged = merge_state(path, spark, new, key) if fs.exists(target) else new
    merged.write.mode("overwrite").parquet(next_.toString())
    fs.delete(target, True)
    if not fs.rename(next_, target):
        raise OSError(f"{next_.toString()} couldn't be put in the place of {path}")
