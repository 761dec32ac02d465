"""Files of any store that Hadoop can open: listing, text, and publishing by rename."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def hadoop_path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def file_system(spark: SparkSession, name: str):
    return hadoop_path(spark, name).getFileSystem(spark._jsc.hadoopConfiguration())


def matching(spark: SparkSession, pattern: str) -> list[str]:
    found = file_system(spark, pattern).globStatus(hadoop_path(spark, pattern))
    return [str(status.getPath()) for status in (found or [])]


def exists(spark: SparkSession, name: str) -> bool:
    return file_system(spark, name).exists(hadoop_path(spark, name))


def read_text(spark: SparkSession, name: str) -> str:
    stream = file_system(spark, name).open(hadoop_path(spark, name))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, name: str, text: str) -> None:
    out = file_system(spark, name).create(hadoop_path(spark, name), False)
    out.write(bytearray(text.encode()))
    out.close()


def delete(spark: SparkSession, name: str) -> None:
    file_system(spark, name).delete(hadoop_path(spark, name), True)


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename unless the target exists. Stores must refuse to rename onto an existing file, as HDFS does."""
    jvm = spark._jvm
    at = hadoop_path(spark, target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(hadoop_path(spark, source), at, plain)
        return True
    except Py4JJavaError as refused:
        if "FileAlreadyExistsException" not in str(refused.java_exception):
            raise
        return False
