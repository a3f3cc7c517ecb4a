"""Small helpers around Arrow batches, tables and word hashes."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mailsift.sources.shared import work_folder

ROWS = 1000


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(docs, key="doc_id", text="text"):
    """Key and text only, so that extra columns and their names do not matter; a null text is empty."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def aside(docs, used):
    """``docs`` with all columns but those in ``used`` under numbered names, and what gives them their names back.

    So no name that an operator uses within can meet one of the user's.
    """
    named = {f"aside{i}": c for i, c in enumerate(docs.columns) if c not in used}
    moved = docs.toDF(*[c if c in used else f"aside{i}" for i, c in enumerate(docs.columns)])
    return moved, lambda df: df.toDF(*[named.get(c, c) for c in df.columns])


def small(batch, most):
    """A batch in parts of at most ``most`` bytes, or one row where that is larger."""
    if most is None or batch.num_rows < 2 or batch.nbytes <= most:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from small(batch.slice(0, half), most)
        yield from small(batch.slice(half), most)


def add_columns(df, added, make, most=None):
    """``df`` with columns computed per part of an Arrow batch; a column of the same name is replaced.

    ``make()`` runs once per task and returns a function from a batch to the list of new arrays. It
    sees ``ROWS`` rows at a time, and with ``most`` about so many bytes, so that what they become in
    Python stays small.
    """
    added = StructType.fromDDL(added)
    kept = [f for f in df.schema.fields if f.name not in added.names]
    names = [f.name for f in kept] + added.names

    def run(batches):
        compute = make()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                for batch in small(whole.slice(at, ROWS), most):
                    if batch.num_rows:
                        yield pa.RecordBatch.from_arrays([column(batch, f.name) for f in kept] + compute(batch),
                                                         names=names)

    return df.mapInArrow(run, StructType(kept + added.fields))


def written(df, folder=None):
    """The rows of a result as a table in the shared folder; compressed, unlike a checkpoint."""
    folder = folder or work_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def as_bytes(batch, name="text"):
    """The UTF-8 bytes of a text column, one object per row; null is empty."""
    return [b or b"" for b in column(batch, name).cast(pa.binary()).to_pylist()]


def word_hashes(words):
    """64-bit hashes of a list of byte strings, the same on every machine."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def mix(h):
    """A bijection of 64 bits that spreads every bit (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(hashes, size):
    """Hash of every run of ``size`` consecutive word hashes; empty if there are fewer words."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(size):
            out = mix(out + hashes[i:i + n] * ODD[0] + ODD[1])
    return out
