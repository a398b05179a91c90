"""Where an operator keeps tables and files that several jobs or workers read: the session's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def workers_find_library(spark: SparkSession) -> None:
    """Puts this library's folder on the workers' Python path, for sessions begun elsewhere; on a cluster it is shipped or mounted there."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *have])


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where that is unset (tests, a single machine) one is made."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        os.makedirs(root[7:], exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark then removes a job's shuffle files when the job has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there: lineage ends and a lost executor costs nothing.

    What the job has shuffled is not kept: nothing reads it again.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_in = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that `stored` has given; nothing may read them any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.stored_in)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def column(name: str) -> Column:
    """A column by its name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(docs: DataFrame) -> DataFrame:
    """docs with its columns named c_0, c_1, .. in their order, so that none can clash."""
    return docs.toDF(*[f"c_{i}" for i in range(len(docs.columns))])


def folded(spark: SparkSession):
    """A function that makes names alike which the session takes for the same."""
    return str if spark.conf.get("spark.sql.caseSensitive", "false") == "true" else str.lower


def place(docs: DataFrame, name: str) -> int:
    """The place of the column that a name means: the one of the very name, else one that the session takes for the same."""
    fold = folded(docs.sparkSession)
    return docs.columns.index(name) if name in docs.columns else [fold(c) for c in docs.columns].index(fold(name))


def carried(docs: DataFrame, text: str, new: dict[str, str], keep: list[str] | None) -> tuple[DataFrame, T.StructType]:
    """(rows for a task: the text as _text, then the columns to keep; the schema that the task returns).

    Columns named like a new one, by the session's rule of case, are replaced; those to keep have names of their own on
    the way, so none can clash.
    """
    fold = folded(docs.sparkSession)
    taken, wanted = {fold(k) for k in new}, None if keep is None else {fold(k) for k in keep}
    kept = [(i, f) for i, f in enumerate(docs.schema.fields) if fold(f.name) not in taken and (wanted is None or fold(f.name) in wanted)]
    rows = numbered(docs).select(F.col(f"c_{place(docs, text)}").cast("string").alias("_text"), *[f"c_{i}" for i, _ in kept])
    return rows, T.StructType([*[f for _, f in kept], *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in new.items())).fields])


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store and inner path of a folder's address, for workers that write or read files of an own format."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def local_path(path: str) -> str:
    """The mounted path of a shared file, for memory mapping. The shared folder must be a file: path on every worker."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"memory mapping needs a shared folder that is mounted on every worker; {path} is not a file path")
    return path
