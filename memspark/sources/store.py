"""The store on disk: an append-only log of changes, snapshots of it, and readers and writers around them.

Every change is a row of the log. An append claims a number by creating a file that must not exist, writes its
rows under sequence numbers that begin with it, and marks the claim as done; readers pass over the rows of
claims that are not done, so a half-written append is never seen, and two writers never share a number.
A checkpoint compacts what was done before the first open claim into a versioned snapshot, facts with the
intervals they have got, and then moves a pointer; opening reads the snapshot the pointer names and the log
rows after it. Nothing is updated in place, so a job that dies leaves the last state readable.
"""

from __future__ import annotations

import json
import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts, maintain
from ..operators.metadata_schema import Registry
from ..schemas import MEMORY_LOG, STORES

#: A sequence number: the claim, then the partition, then the row in it.
CLAIM_BITS, ROW_BITS = 36, 27
MOST_PARTITIONS = 1 << (CLAIM_BITS - ROW_BITS)
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def _fields(layout: str) -> list[str]:
    """The columns of a flat layout."""
    return [x.strip() for x in layout.split(", ")]


def is_uuid(c: Column) -> Column:
    return F.regexp_like(c, F.lit(UUID))


def from_millis(c: Column) -> Column:
    return F.timestamp_millis(c)


def to_millis(c: Column) -> Column:
    return F.unix_millis(c)


class Store:
    _open: dict[str, Store] = {}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> Store:
        """One store object per path; whoever opens it first decides its settings."""
        return cls._open.setdefault(path.rstrip("/"), cls(spark, path))

    def close(self) -> None:
        Store._open.pop(self.path, None)

    # -- files, through Spark's own file systems
    def _fs(self):
        jvm, p = self.spark._jvm, self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        jvm, fs = self._fs()
        return fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"))

    def _pointer(self) -> tuple[str | None, int]:
        if not self._exists("current"):
            return None, -1
        rows = self.spark.read.schema("snapshot string, seq bigint, at bigint").json(f"{self.path}/current").orderBy(F.desc("at"), F.desc("seq")).limit(1).collect()
        return (rows[0]["snapshot"], rows[0]["seq"]) if rows else (None, -1)

    # -- claims: empty files, <number> and <number>.done
    def _claims(self) -> tuple[int, list[int]]:
        """The highest claim, and those that are not done. Files only; a checkpoint removes what it covers."""
        jvm, fs = self._fs()
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/claims")
        names = {x.getPath().getName() for x in fs.listStatus(p)} if fs.exists(p) else set()
        numbers = sorted(int(n) for n in names if not n.endswith(".done"))
        return max([0, *numbers]), [n for n in numbers if f"{n}.done" not in names]

    def _create(self, name: str) -> bool:
        """A new empty file; whether it was not there before. Atomic on local disks and HDFS; an object store needs conditional writes for several writers."""
        jvm, fs = self._fs()
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/claims/{name}")
        try:
            if fs.getUri().getScheme() == "file":
                # Hadoop's own local files are looked for and then made, in two steps
                local = p.toUri().getPath()
                os.makedirs(os.path.dirname(local), exist_ok=True)
                os.close(os.open(local, os.O_CREAT | os.O_EXCL))
            else:
                fs.create(p, False).close()
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise

    def claim(self) -> int:
        """A number of one's own, above all that were claimed before."""
        n = max(self._claims()[0], self._pointer()[1] >> CLAIM_BITS) + 1
        while not self._create(str(n)):
            n += 1
        return n

    def _done(self, n: int) -> None:
        self._create(f"{n}.done")

    def abandon(self, n: int) -> None:
        """Give up a claim whose writer died before its rows came: rows of it that are there will count."""
        self._done(n)

    # -- log
    def log(self) -> DataFrame:
        """All that counts: the newest snapshot and the log rows after it, of appends that are done."""
        snapshot, seq = self._pointer()
        # a folder for each append: jobs that commit at the same time do not share one
        rows = self.spark.read.schema(MEMORY_LOG).option("recursiveFileLookup", True).parquet(f"{self.path}/log") if self._exists("log") else self.spark.createDataFrame([], MEMORY_LOG)
        rows = rows.filter(F.col("seq") > seq)
        open_ = self._claims()[1]
        rows = rows.filter(~F.shiftright("seq", CLAIM_BITS).isin(open_)) if open_ else rows
        return rows.unionByName(self.spark.read.schema(MEMORY_LOG).parquet(f"{self.path}/{snapshot}")) if snapshot else rows

    def last_seq(self) -> int:
        return max(self.log().agg(F.max("seq")).first()[0] or 0, self._pointer()[1], 0)

    def append(self, df: DataFrame, store: str, op: str = "upsert", order: list | None = None, claim: int | None = None) -> int:
        """Rows of a store as changes, after all appends that began before; gives its claim. Rows go in the order of their ids if no other is given.

        No row of the log is read, and none of df is gathered: numbers are dealt within sorted ranges.
        """
        keys = order or [F.col("id")]
        n = self.claim() if claim is None else claim
        try:
            payload = F.to_json(F.struct(*df.columns)) if op != "delete" else F.lit(None).cast("string")
            rows = df.select(F.col("id").cast("string").alias("id"), payload.alias("payload"), *(k.alias(f"_o{i}") for i, k in enumerate(keys)))
            names = [f"_o{i}" for i in range(len(keys))]
            parts = min(MOST_PARTITIONS, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            sorted_ = rows.repartitionByRange(parts, *names).sortWithinPartitions(*names).withColumn("_n", F.monotonically_increasing_id())
            row = F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
            fits = F.when(row < (1 << ROW_BITS), row).otherwise(F.raise_error(F.lit("more rows in a partition of an append than there are numbers: raise spark.sql.shuffle.partitions")).cast("bigint"))
            seq = F.lit(n << CLAIM_BITS).bitwiseOR(F.shiftleft(F.shiftright("_n", 33), ROW_BITS)).bitwiseOR(fits)
            sorted_.select(seq.alias("seq"), F.current_timestamp().alias("ts"), F.lit(op).alias("op"), F.lit(store).alias("store"), "id", "payload").write.mode("append").parquet(f"{self.path}/log/{n:020d}")
        finally:
            # a job that failed has left no rows
            self._done(n)
        return n

    def delete(self, ids: DataFrame, store: str) -> int:
        """Tombstones for ids the store has; how many these are. Unknown ids are passed over."""
        known = maintain.latest(self.log(), store).select("id").join(ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")
        n = known.count()
        if n:
            self.append(known, store, "delete")
        return n

    def table(self, store: str) -> DataFrame:
        return maintain.replay(self.log(), store, STORES[store])

    def get(self, store: str, ids: DataFrame | str) -> DataFrame:
        """The rows of some ids: one, or a frame with a column id. The log is filtered before it is replayed."""
        rows = self.log().filter(F.col("store") == store)
        if isinstance(ids, str):
            rows = rows.filter(F.col("id") == ids)
        else:
            rows = rows.join(ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")
        return maintain.replay(rows, store, STORES[store])

    def facts(self) -> DataFrame:
        """Facts with their intervals. Those closed by the last checkpoint are settled; only open and newer ones are looked at."""
        layout, seq = STORES["triples"], self._pointer()[1]
        live = maintain.latest(self.log(), "triples").select((F.col("seq") <= seq).alias("_old"), F.from_json("payload", layout).alias("x")).select("_old", "x.*")
        if seq < 0:
            return facts.supersede(live.drop("_old"))
        settled = F.col("_old") & F.col("valid_until").isNotNull()
        return facts.supersede(live.filter(~settled).drop("_old")).unionByName(live.filter(settled).drop("_old"))

    def checkpoint(self, close_facts: bool = False) -> str:
        """Compact: write the live rows of all appends before the first open claim as a new snapshot, then point to it.

        close_facts: with the intervals of facts that later ones have closed, for good: to delete the later one
        does not open the earlier one again.
        """
        highest, open_ = self._claims()
        covered = self._pointer()[1] >> CLAIM_BITS
        end = (min(open_) if open_ else max(highest, max(0, self._pointer()[1]) >> CLAIM_BITS) + 1) << CLAIM_BITS
        rows = self.log().filter(F.col("seq") < end)
        seq = max(end - 1, self._pointer()[1])
        name = f"snapshots/{seq:020d}"
        if not self._exists(name):
            live = maintain.latest(rows).select("seq", "ts", "op", "store", "id", "payload")
            if close_facts:
                closed = self.facts().filter("valid_until IS NOT NULL").select("id", F.to_json(F.struct(*(c.split(" ")[0] for c in _fields(STORES["triples"])))).alias("closed"))
                mine = (F.col("store") == "triples") & (live["id"] == closed["id"])
                live = live.join(closed, mine, "left").select("seq", "ts", "op", "store", live["id"], F.coalesce("closed", "payload").alias("payload"))
            live.write.mode("overwrite").parquet(f"{self.path}/{name}")
        self.spark.createDataFrame([(name, seq)], "snapshot string, seq bigint").withColumn("at", F.unix_micros(F.current_timestamp())).coalesce(1).write.mode("append").json(f"{self.path}/current")
        self._forget("claims", seq >> CLAIM_BITS)
        # whoever still reads by the last pointer has its log rows; those before it are in both snapshots
        self._forget("log", covered)
        return name

    def _forget(self, folder: str, upto: int) -> None:
        jvm, fs = self._fs()
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        for x in fs.listStatus(p) if fs.exists(p) else []:
            n = x.getPath().getName().split(".")[0]
            if n.isdigit() and int(n) <= upto:
                fs.delete(x.getPath(), True)

    # -- schemas
    def save_schemas(self, registry: Registry) -> None:
        self.spark.createDataFrame([(registry.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/schemas")

    def load_schemas(self, strict: bool = True) -> Registry:
        if not self._exists("schemas"):
            return Registry(strict=strict)
        rows = self.spark.read.text(f"{self.path}/schemas", wholetext=True).collect()
        return Registry.from_json(rows[0]["value"] if rows else "", strict)


def read_sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(messages, questions) of a JSON file with sessions and questions."""
    layout = "sessions array<struct<session_id:string,agent_id:string,date:string,messages:array<struct<role:string,content:string,timestamp:string>>>>, questions array<struct<question_id:string,question:string,expected_answer:string,category:string,agent_id:string,related_session_ids:array<string>>>"
    raw = spark.read.schema(layout).json(path, multiLine=True)
    s = raw.select(F.explode("sessions").alias("s"))
    messages = s.select("s.session_id", "s.agent_id", "s.date", F.posexplode("s.messages").alias("pos", "m")).select("session_id", "agent_id", "date", "pos", "m.*")
    return messages, raw.select(F.explode("questions").alias("q")).select("q.*")


def as_episodic(df: DataFrame, content: str, agent: Column, at: Column, importance: Column | None = None, scope: str = "private", keep_id: str | None = None) -> DataFrame:
    """Rows of any source as new episodic rows, under ids of their own or those of a column."""
    return df.select(
        (F.col(keep_id).cast("string") if keep_id else F.expr("uuid()")).alias("id"), F.col(content).alias("content"), F.lit("episodic").alias("memory_type"), agent.alias("agent_id"), F.lit(scope).alias("scope"), F.lit(None).cast("string").alias("team_id"),
        (importance if importance is not None else F.lit(0.5)).alias("importance"), F.lit(1.0).alias("decay_score"), F.lit(0).cast("bigint").alias("access_count"), at.alias("created_at"), at.alias("accessed_at"),
        F.lit(None).cast("array<float>").alias("embedding"), F.lit("{}").alias("metadata"),
    )


def ingest(store: Store, df: DataFrame, content: str, agent: Column, at: str, id_col: str | None = None) -> dict[str, int]:
    """Rows of another product into the store: {"migrated": ..., "failed": ...}.

    at: a column of timestamps, or of milliseconds since 1970. Rows without content, agent or time fail, as do
    ids that are no UUIDs where ids are given; of rows with one id the last in time counts.
    """
    when = from_millis(F.col(at)) if dict(df.dtypes)[at] in ("bigint", "int") else F.col(at).cast("timestamp")
    fine = F.col(content).isNotNull() & agent.isNotNull() & when.isNotNull()
    fine = fine & is_uuid(F.col(id_col)) if id_col else fine
    good = df.filter(F.coalesce(fine, F.lit(False)))
    rows = as_episodic(good, content, agent, when, keep_id=id_col)
    total, n = df.count(), good.count()
    if n:
        store.append(rows, "episodic", order=[F.col("created_at"), F.col("id")])
    return {"migrated": n, "failed": total - n}


def write_report(spark: SparkSession, results: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(results, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
