"""What the operators of this subpackage share: scratch tables, Arrow batches, session settings."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
import weakref

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python. Texts differ in length by four orders of magnitude and
#: Spark bounds a batch by rows alone, so the count is kept low.
BATCH_ROWS = 400
#: Characters of a plan's description that Spark keeps of each query; plans with tables as literals have megabytes.
PLAN_CHARS = 50_000


def ship(name: str) -> None:
    """Send the functions of a module to the executors by value, so that they need no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def forget(told: Broadcast) -> None:
    """Drop a broadcast that nothing will use again, on the driver too."""
    _shared.discard(told)
    told.destroy()


class Lazy(dict):
    """A dict that makes a missing value from its key, once."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key):
        got = self[key] = self.make(key)
        return got


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches (``BATCH_ROWS``) and plan descriptions of this session, unless they are smaller already."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.maxPlanStringLength", PLAN_CHARS)):
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


#: Broadcasts made here that may still be held.
_shared: weakref.WeakSet[Broadcast] = weakref.WeakSet()


def share(spark: SparkSession, value) -> Broadcast:
    """Broadcast a value of bounded size, to be let go by ``release``."""
    told = spark.sparkContext.broadcast(value)
    _shared.add(told)
    return told


def release() -> None:
    """Drop the executors' copies of all broadcasts made here. One that is used again is sent again."""
    for told in list(_shared):
        told.unpersist()
        _shared.discard(told)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, one is set on a master that is this machine alone, as in tests; a cluster gets an error.
    """
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if told:
        return told
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


class Scratch:
    """Tables written to the shared folder, to cut lineage; they outlive lost executors.

    An operator drops those that its result doesn't read; ``sweep`` drops the others once the result is written.
    """

    left: dict[str, Scratch] = {}

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", []
        self.n, self.made = 0, {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back."""
        self.n += 1
        self.paths.append(path := f"{self.root}/{self.n}")
        Scratch.left[self.root] = self
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.made[id(back)] = path
        return back

    def discard(self, *frames: DataFrame) -> None:
        """Delete these tables, as ``keep`` returned them."""
        gone = [self.made[id(f)] for f in frames]
        stay = [p for p in self.paths if p not in gone]
        self.paths = gone + stay
        self.drop(last=len(stay))

    def drop_all_but(self, *frames: DataFrame) -> None:
        """Delete all tables but these, as ``keep`` returned them."""
        stay = [self.made[id(f)] for f in frames]
        self.paths = [p for p in self.paths if p not in stay] + stay
        self.drop(last=len(stay))

    def drop(self, last: int = 0) -> None:
        """Delete all tables but the ``last`` ones."""
        gone, self.paths = (self.paths[:-last], self.paths[-last:]) if last else (self.paths, [])
        for path in gone if last else [self.root]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        if not last:
            Scratch.left.pop(self.root, None)


def sweep(*but: Scratch) -> None:
    """Drop every scratch table of this process but those of ``but``; no result that still reads one may be in use."""
    for scratch in list(Scratch.left.values()):
        if scratch not in but:
            scratch.drop()


#: Keys that ``hot_join`` takes for hot, at most.
HOT = 1000


def hot_join(big: DataFrame, small: DataFrame, on: list[str], n: str) -> DataFrame:
    """Inner join of ``big`` with ``small``, one row a key, whose column ``n`` says how many rows of ``big`` a key has.

    Keys with over a thousandth of all rows, fewer than ``HOT``, are joined by broadcast, so that no task gets all of their
    rows; the others by shuffle. Keys are not null.
    """
    total = small.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(small.where(F.col(n) > total / HOT))
    rest = big.join(hot.select(*on), on, "left_anti").join(small.where(F.col(n) <= total / HOT), on)
    return big.join(hot, on).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of the documents that models never learn from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0, F.lit(False))


def sampled(id_col: Column | str, most: int, of: int) -> Column:
    """True for about ``most`` of ``of`` ids, by a threshold on their hash, so that no task orders them; for all if they are no more."""
    if of <= most:
        return F.lit(True)
    return F.xxhash64(id_col) < F.lit(int((most / of) * (1 << 64)) - (1 << 63))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
