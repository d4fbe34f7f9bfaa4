"""Processing only new or changed records, over a versioned key and content-hash state.

The state is a set of immutable Parquet parts and one small file per version that lists the parts in
force. A run stages its part beside them and becomes visible by creating the file of the next version,
which succeeds for one run only: a run that dies at any point leaves the former version untouched and
the next run finds the same records due again, and of two runs that began with the same version the
second gets a ``StateConflict``. None is skipped, none is taken twice.

Defined results
* null key: the row can't be tracked and is left out of ``latest`` and of the state;
* null hash: a value like any other (null-safe comparison);
* repeated rows of a key: the one greatest in the given order columns counts, then the greatest hash;
* with an ``order`` column: a row older than the one that the state holds is never due;
* empty input: no change, and the state stays as it is;
* extra columns, whatever their names: carried through ``latest`` untouched.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markloom.runtime import strip_blanks

HASH = "state_hash"
SEQ = "state_seq"
ORDER = "state_order"


class StateConflict(RuntimeError):
    """Another run committed since this one began."""


def content_hash(*cols: Column | str) -> Column:
    """SHA-256 over the columns, nulls kept apart from empty values, names and order included."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def latest(rows: DataFrame, keys: list[str], order: list[Column], payload: dict[str, Column]) -> DataFrame:
    """One row per key: the payload of the row that is greatest in ``order``, then in the payload.

    Map-side combine, so a key that holds a third of all rows costs one row per map task.
    """
    packed = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*[c.alias(n) for n, c in payload.items()]).alias("p"))
    known = rows.dropna(subset=keys)
    return known.groupBy(*keys).agg(F.max(packed).alias("_m")).select(*keys, *[F.col(f"_m.p.{n}").alias(n) for n in payload])


class IncrementalState:
    """Key and hash state under ``path``; ``keys`` are column names and types as in the data.

    ``order``, where given, is the name and type of a column that grows with each newer row of a key.
    """

    def __init__(
        self, spark: SparkSession, path: str, keys: list[tuple[str, str]], compact_after: int = 16, order: tuple[str, str] | None = None
    ):
        self.spark, self.path, self.keys, self.compact_after, self.order = spark, path.rstrip("/"), keys, compact_after, order
        self.names = [k for k, _ in keys]
        self.kept = [HASH, *([ORDER] if order else [])]
        extra = [(HASH, "string"), *([(ORDER, order[1])] if order else []), (SEQ, "bigint")]
        self.schema = T._parse_datatype_string(", ".join(f"`{k}` {t}" for k, t in [*keys, *extra]))

    # -- versions ------------------------------------------------------------------------------

    def _hadoop(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._hadoop("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self) -> list[tuple[str, int]]:
        """(name, time of change in ms) of everything under the path."""
        fs, at = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return [(f.getPath().getName(), f.getModificationTime()) for f in fs.listStatus(at)] if fs.exists(at) else []

    def _versions(self) -> list[str]:
        return sorted(n for n, _ in self._list() if n.startswith("version-"))

    def _load(self, name: str) -> dict:
        stream = self._fs().open(self._hadoop(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def pointer(self) -> dict:
        """Version number and parts in force; version 0 without parts where none was committed."""
        names = self._versions()
        return self._load(names[-1]) if names else {"version": 0, "parts": []}

    def _publish(self, new: dict) -> None:
        """Create the file of this version whole, or fail because another run has done so.

        A file is written beside it first. On the local file system a hard link gives it its name, elsewhere
        a rename that doesn't overwrite; both are refused where the name is taken. (An object store whose
        rename isn't atomic needs a file system client with conditional creation.)
        """
        name, temp = f"version-{new['version']:012d}.json", self._hadoop(f".{uuid.uuid4().hex}")
        fs, jvm = self._fs(), self.spark._jvm
        fs.mkdirs(self.spark._jvm.org.apache.hadoop.fs.Path(self.path))
        text = json.dumps(new).encode()
        if fs.getUri().getScheme() == "file":
            local = temp.toUri().getPath()
            with open(local, "xb") as out:
                out.write(text)
            try:
                os.link(local, os.path.join(os.path.dirname(local), name))
            except FileExistsError as e:
                raise StateConflict(f"version {new['version']} was committed by another run") from e
            finally:
                os.unlink(local)
            return
        out = fs.create(temp, False)
        out.write(bytearray(text))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(temp, self._hadoop(name), options)
        except Exception as e:
            taken = fs.exists(self._hadoop(name))
            fs.delete(temp, False)
            if taken:
                raise StateConflict(f"version {new['version']} was committed by another run") from e
            raise

    def vacuum(self, older_than_s: float = 86_400, keep: int = 2) -> list[str]:
        """Delete what the last ``keep`` versions don't use and nobody changed for ``older_than_s``: parts of
        runs that died, parts that compaction replaced, and older version files. Returns the names."""
        names = self._versions()
        used = {p for n in names[-keep:] for p in self._load(n)["parts"]} | set(names[-keep:])
        before, fs = (time.time() - older_than_s) * 1000, self._fs()
        gone = [n for n, at in self._list() if n not in used and at <= before]
        for n in gone:
            fs.delete(self._hadoop(n), True)
        return gone

    # -- reading, comparing, writing -------------------------------------------------------------

    def read(self, pointer: dict | None = None) -> DataFrame:
        """Keys and hashes in force."""
        parts = (pointer or self.pointer())["parts"]
        if not parts:
            return self.spark.createDataFrame([], self.schema).drop(SEQ)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in parts])
        if len(parts) == 1:
            return rows.drop(SEQ)
        newest = rows.groupBy(*self.names).agg(F.max(F.struct(SEQ, *self.kept)).alias("_m"))
        return newest.select(*self.names, *[F.col(f"_m.{c}").alias(c) for c in self.kept])

    def changes(self, current: DataFrame, hash_col: str, pointer: dict | None = None) -> DataFrame:
        """Rows of ``current`` (one per key) whose key is new or whose hash differs, with ``change`` (which
        takes the place of a column of that name)."""
        kept = [F.col(c).alias(f"_s_{c}") for c in [*self.names, *self.kept]]
        state = self.read(pointer).select(*kept, F.lit(True).alias("_s_known"))
        joined = current.join(state, [current[k] == state[f"_s_{k}"] for k in self.names], "left")
        due = state["_s_known"].isNull() | ~current[hash_col].cast("string").eqNullSafe(state[f"_s_{HASH}"])
        if self.order:
            due = due & F.coalesce(current[self.order[0]] >= state[f"_s_{ORDER}"], F.lit(True))
        kind = F.when(state["_s_known"].isNull(), "new").otherwise("changed")
        return joined.filter(due).select(*[current[c] for c in current.columns if c != "change"], kind.alias("change"))

    def stage(self, changed: DataFrame, hash_col: str, base: dict) -> str:
        """Write the part of the next version; nothing sees it before ``commit``."""
        part, number = f"part-{base['version'] + 1}-{uuid.uuid4().hex}", F.lit(base["version"] + 1).cast("bigint")
        extra = [F.col(self.order[0]).alias(ORDER)] if self.order else []
        rows = changed.select(*self.names, F.col(hash_col).cast("string").alias(HASH), *extra, number.alias(SEQ))
        rows.write.parquet(f"{self.path}/{part}")
        return part

    def commit(self, part: str, base: dict) -> dict:
        """Make ``part`` visible, unless another run has committed since ``base`` was read."""
        new = {"version": base["version"] + 1, "parts": [*base["parts"], part]}
        if len(new["parts"]) > self.compact_after:
            whole = f"part-{new['version']}-{uuid.uuid4().hex}"
            self.read(new).withColumn(SEQ, F.lit(new["version"]).cast("bigint")).write.parquet(f"{self.path}/{whole}")
            new["parts"] = [whole]
        self._publish(new)
        return new

    def run(self, current: DataFrame, hash_col: str, process: Callable[[DataFrame], None]) -> dict:
        """One run: find what is due, let ``process`` take it, then advance the state.

        ``process`` gets exactly the rows recorded in the staged part, and must be idempotent per
        key (overwrite, not append), since a run that dies between it and the commit is repeated.
        """
        base = self.pointer()
        part = self.stage(self.changes(current, hash_col, base), hash_col, base)
        staged = self.spark.read.schema(self.schema).parquet(f"{self.path}/{part}")
        taken = staged.select(*self.names, F.col(HASH).alias("_taken"))
        same = F.col("_taken").eqNullSafe(F.col(hash_col).cast("string"))
        process(current.join(taken, self.names).filter(same).drop("_taken"))
        return self.commit(part, base)


# -- positions of former runs -------------------------------------------------------------------


def checkpoint_position(text: Column) -> Column:
    """Struct(at, last_id) named by a JSON checkpoint, at null where the text names no instant.

    The instant is ISO text with an offset or a number of epoch milliseconds, at the top level or
    inside ``position``; ``last_id`` is read beside it and is null for the end of the instant.
    """
    top, inner = F.get_json_object(text, "$.mapped_at"), F.get_json_object(text, "$.position.mapped_at")
    raw = F.coalesce(top, inner)
    number = raw.try_cast("double")
    instant = F.when(number.isNotNull(), F.timestamp_micros(F.round(number * 1000).try_cast("bigint"))).otherwise(raw.try_cast("timestamp"))
    last = F.when(top.isNotNull(), F.get_json_object(text, "$.last_id")).otherwise(F.get_json_object(text, "$.position.last_id"))
    return F.struct(instant.alias("at"), last.alias("last_id"))


def run_frontier(runs: DataFrame, status: str, checkpoint: str, started: str) -> list[tuple]:
    """Steps (started, at, last_id) of the positions reached by completed runs.

    A run is left out if a run that started later reached at least as far, as everything the
    former covers is covered by the latter. The log has one row per run, not per record; each month of
    it is reduced by a window before anything goes to the driver, and what remains after the last
    removal goes into the plan as a literal.
    """
    completed = runs.filter(F.lower(strip_blanks(F.col(status))) == "completed")
    done = completed.select(
        F.col(started).alias("s"),
        checkpoint_position(F.col(checkpoint)).alias("p"),
    ).filter("s is not null and p.at is not null")
    reach = F.struct(
        F.col("p.at").alias("at"),
        F.col("p.last_id").isNull().alias("whole"),
        F.coalesce("p.last_id", F.lit("")).alias("last"),
    )
    best = done.groupBy("s").agg(F.max(reach).alias("r"))
    later = Window.partitionBy(F.date_trunc("month", "s")).orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    own = best.withColumn("_b", F.max("r").over(later)).filter(F.col("_b").isNull() | (F.col("r") > F.col("_b")))
    steps, furthest = [], None
    for r in sorted(own.select("s", "r.at", "r.whole", "r.last").collect(), key=lambda r: r.s, reverse=True):
        here = (r.at, r.whole, r.last)
        if furthest is None or here > furthest:
            steps.append((r.s, r.at, None if r.whole else r.last))
            furthest = here
    return steps


def covered_by(spark: SparkSession, steps: list[tuple], arrived: Column, instant: Column, key: Column) -> Column:
    """Whether a completed run that started at or after ``arrived`` reached (instant, key).

    Unknown times or keys are not covered.
    """
    if not steps:
        return F.lit(False)
    at = lambda t: F.timestamp_micros(F.lit(int(t.timestamp() * 1_000_000 + 0.5)))
    step = lambda s, a, i: F.struct(at(s).alias("s"), at(a).alias("at"), F.lit(i).cast("string").alias("id"))

    def beyond(x: Column) -> Column:
        inside = (instant < x["at"]) | ((instant == x["at"]) & (x["id"].isNull() | (key <= x["id"])))
        return (arrived <= x["s"]) & inside

    reached = F.exists(F.array(*[step(*s) for s in steps]), beyond)
    return F.coalesce(reached, F.lit(False))


def due_after_runs(
    rows: DataFrame,
    runs: DataFrame,
    state_path: str,
    key: str = "id",
    hash_col: str = "source_hash",
    instant: str = "mapped_at",
    arrived: str = "created_at",
) -> DataFrame:
    """Keys due next (key, hash) given the log of former runs.

    The state that the completed runs have reached is kept under ``state_path`` (key and hash of the
    latest covered row): what it lacks is staged and committed, whatever an earlier call left there, and
    the state is joined with the latest row of every key. Rows that arrived late, behind the position
    of a run that had already started, stay due.
    """
    spark = rows.sparkSession
    steps = run_frontier(runs, "status", "checkpoint", "started_at")
    fields = {key: F.col(key), hash_col: F.lower(F.col(hash_col)), "_i": F.col(instant), "_a": F.col(arrived)}
    known = rows.select(*[c.alias(n) for n, c in fields.items()])
    seen = known.withColumn("_covered", covered_by(spark, steps, F.col("_a"), F.col("_i"), F.col(key).cast("string")))
    order = [F.col("_i"), F.col("_a")]
    store = IncrementalState(spark, state_path, [(key, dict(rows.dtypes)[key])])
    base = store.pointer()
    covered = latest(seen.filter("_covered"), [key], order, {hash_col: F.col(hash_col)})
    if base["parts"]:
        covered = store.changes(covered, hash_col, base)
    at = store.commit(store.stage(covered, hash_col, base), base)
    now = latest(seen, [key], order, {hash_col: F.col(hash_col), "_covered": F.col("_covered")})
    return store.changes(now.filter("not _covered").drop("_covered"), hash_col, at).select(key, hash_col)
