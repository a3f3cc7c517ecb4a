"""The folder that the driver and all executors share, for results that are read more than once."""

import gc
import tempfile
import uuid


def shared_folder(spark):
    """The folder named in ``spark.checkpoint.dir``; in local mode without one, a temporary folder.

    Outside of local mode executors could not see each other's temporary files, so a missing
    setting is an error there.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="mailsift-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def work_folder(spark):
    """A new folder of its own below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/mailsift-{uuid.uuid4().hex}"


def cut_lineage(df):
    """The rows of a result that is read several times, kept in the shared folder."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def removed(spark, folder):
    """Takes away a folder of intermediate results below the shared one; nothing may still read it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark):
    """Lets go of what finished steps left on the driver: only then Spark removes their shuffle files.

    The last query is held until another one has run.
    """
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
