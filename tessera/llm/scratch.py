"""Written intermediate tables in the folder that all executors share.

An operator that reads an intermediate result more than once, or that would
otherwise grow a long lineage, writes it as Parquet below ``spark.checkpoint.dir``.
A lost executor then costs a re-read of that file and nothing else.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The shared folder; a temporary one only in a local session that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _own:
        path = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own[sc.applicationId] = path
    return "file://" + _own[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/tessera/{name}-{uuid.uuid4().hex}"


#: Paths of the tables written by this process, in order.
_written: list[tuple[SparkSession, str]] = []


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_ROWS = 512


def materialize(df: DataFrame, name: str, batch_rows: int = _BATCH_ROWS) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as a plain scan.

    Batches for Python hold ``batch_rows`` rows meanwhile, unless the session asks for
    fewer, so that long texts don't add up in its memory.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_BATCH)
    if not 0 < int(before) <= batch_rows:
        spark.conf.set(_BATCH, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system for ``path`` and the path as its object."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for t in tables:
        if path := getattr(t, "_tessera_path", None):
            fs, p = filesystem(t.sparkSession, path)
            fs.delete(p, True)
            _written[:] = [w for w in _written if w[1] != path]


def mark() -> int:
    """How many tables have been written so far."""
    return len(_written)


def release(since: int, *keep: DataFrame) -> None:
    """Delete all tables written after ``mark`` gave ``since``, but those of ``keep``."""
    kept = {getattr(t, "_tessera_path", None) for t in keep}
    for spark, path in [w for w in _written[since:] if w[1] not in kept]:
        fs, p = filesystem(spark, path)
        fs.delete(p, True)
    _written[since:] = [w for w in _written[since:] if w[1] in kept]


def _nodes(plan):
    """A JVM plan's nodes, from the top."""
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def _plain_scan(df: DataFrame) -> bool:
    """Whether ``df`` is columns and rows of one Parquet table, each row at most once, and the same ones at each scan."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    *above, leaf = _nodes(plan)
    if any(n.nodeName() not in ("Project", "Filter", "SubqueryAlias", "View") for n in above) or not leaf.getClass().getSimpleName().startswith("LogicalRelation"):
        return False
    relation = leaf.relation()
    if not relation.getClass().getSimpleName().startswith("HadoopFsRelation") or relation.fileFormat().toString() != "Parquet":
        return False
    paths = relation.location().rootPaths()
    roots = sorted(paths.apply(i).toString().rstrip("/") + "/" for i in range(paths.size()))
    # A folder that is named twice, or stands inside another, gives its rows twice.
    return not any(b.startswith(a) for a, b in pairwise(roots))


def free_name(name: str, *tables: DataFrame) -> str:
    """``name``, longer by underscores until no column of ``tables`` has it in any spelling."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` as rows of Parquet files: itself, or what it is written to.

    Only columns and filtered rows of one Parquet table stay as they are. Whatever may
    repeat a row of its source, such as a join, a union or an explode, or may give other
    rows at another scan, such as a sample, is written.
    """
    return docs if _plain_scan(docs) else materialize(docs, "rows")


def identified(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column that tells its rows apart and is the same at each scan.

    It is the Parquet file's hash and the row's place in it. Rows that come from no
    plain Parquet scan are written first.
    """
    rows = placed(docs)
    meta = rows.metadataColumn("_metadata")
    return rows.withColumn(name, F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("place")))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over as many partitions as there are cores, at least.

    Only a scan of few splits, such as one file of one row group, is dealt anew. What
    has a shuffle of its own is left alone; asking for its partitions would run it.
    """
    names = [n.nodeName() for n in _nodes(rows._jdf.queryExecution().executedPlan())]
    if any("Exchange" in n or n == "AdaptiveSparkPlan" for n in names):
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def _lean(function):
    """``function``, giving memory that it has freed back to the system after some megabytes read or given."""

    def run(batches):
        import ctypes

        import pyarrow as pa

        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        seen = 0

        def release(more=0):
            nonlocal seen
            seen += more
            if seen > 1 << 22:
                pa.default_memory_pool().release_unused()
                if trim:
                    trim(0)
                seen = 0

        def taken():
            for batch in batches:
                yield batch
                release(batch.nbytes)

        for out in function(taken()):
            yield out
            release(out.nbytes)
        release(1 << 23)

    return run


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow``, with this package on the path of Python workers on the same file system.

    Executors elsewhere get the package as any other, by ``--py-files`` or an image.
    """
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = df.sparkSession.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (env.get("PYTHONPATH"), home)))
    return df.mapInArrow(_lean(function), schema)
