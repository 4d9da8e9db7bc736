"""Parquet tables with a commit log: numbered commits that one writer makes each, deletes that leave files as they are, gapless ids.

A commit says which files come and go, which rows of files are gone, what it read and what it wrote. Two writers never make
the same number, and a commit whose reads another has written since is worked out anew. Rows are Spark's affair: the driver
holds the list of files only, as Spark's own file index does.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Times that a commit is worked out anew after a conflict.
ATTEMPTS = 5
#: Commits after which the whole state is written too, so that readers start from there.
STATE_EVERY = 20
#: Keys of which a commit takes note one by one; one with more counts as having written any.
KEYS = 1000
#: Rows that are gone, in all files together, up to which their words of bits are broadcast (24 bytes each).
BROADCAST_GONE = 2_000_000
#: Share of rows gone from which a file is written anew.
SHARE = 0.3
#: Written by appends that don't say their keys; stands for any key.
ANY = "*"


class Conflict(RuntimeError):
    """Others were always faster."""


@dataclass
class State:
    """A table after a commit. files: name to {dir, rows, numbers (whether its rows get ids), base, gone (a folder, or None), n_gone}; parts: facts about each folder of files; sums: running totals."""

    version: int = -1
    schema: str = ""
    files: dict[str, dict] = field(default_factory=dict)
    parts: dict[str, dict] = field(default_factory=dict)
    next_id: int = 1
    sums: dict[str, int] = field(default_factory=dict)

    def after(self, commit: dict) -> State:
        files = {k: v for k, v in self.files.items() if k not in set(commit.get("remove", ()))}
        next_id = self.next_id
        for name, entry in commit.get("add", {}).items():
            files[name] = {**entry, "base": next_id}
            next_id += entry["rows"] if entry.get("numbers") else 0
        for name, (folder, n) in commit.get("gone", {}).items():
            files[name] = {**files[name], "gone": folder, "n_gone": n}
        parts = {**self.parts, **commit.get("parts", {})}
        used = {f["dir"] for f in files.values()}
        sums = {k: self.sums.get(k, 0) + commit.get("sums", {}).get(k, 0) for k in {*self.sums, *commit.get("sums", {})}}
        return State(self.version + 1, commit.get("schema", self.schema), files, {k: v for k, v in parts.items() if k in used}, next_id, sums)


@dataclass
class Change:
    """What a commit does. reads and writes are file names, keys, or ANY key."""

    add: dict[str, dict] = field(default_factory=dict)
    remove: list[str] = field(default_factory=list)
    gone: dict[str, tuple[str, int]] = field(default_factory=dict)
    parts: dict[str, dict] = field(default_factory=dict)
    sums: dict[str, int] = field(default_factory=dict)
    reads: set[str] = field(default_factory=set)
    writes: set[str] = field(default_factory=set)
    result: Any = None
    #: The table right after the commit.
    made: State | None = None


class LogTable:
    """A table at path. With ids, each row gets the next number as its ``id`` when its commit is made: without gaps, whoever writes at once.

    Commits are made by renaming a finished file to its number where none is (by a hard link on a local file system), which
    HDFS and file systems like it do as one step. A store whose rename overwrites needs another way to ``_put``.
    """

    def __init__(self, spark: SparkSession, path: str, ids: bool = False):
        self.spark, self.path, self.ids = spark, path.rstrip("/"), ids
        self.jvm = spark.sparkContext._jvm
        self._known = State()

    # The log.

    def _at(self, *parts: str):
        path = self.jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _put(self, name: str, content: str) -> bool:
        """Write a file of the log unless there is one; whether this call did."""
        target, fs = self._at("_commits", name)
        if fs.exists(target):
            return False
        draft, _ = self._at("_commits", f".{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(content.encode()))
        out.close()
        try:
            if fs.getScheme() == "file":
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            else:
                options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, target, options)
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            fs.delete(draft, False)
        return True

    def _get(self, name: str) -> dict | None:
        path, fs = self._at("_commits", name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def exists(self) -> bool:
        path, fs = self._at("_commits", "0.json")
        return fs.exists(path)

    def create(self, schema: str) -> None:
        """An empty table, unless there is one."""
        first = {"schema": T.DataType.fromDDL(schema).json()}
        self._put("0.json", json.dumps(first))

    def drop(self) -> None:
        """No table, whether there was one or not."""
        path, fs = self._at()
        fs.delete(path, True)
        self._known = State()

    def state(self, version: int | None = None) -> State:
        """The table after its last commit, or after an earlier one."""
        now = self._known if version is None or self._known.version <= version else State()
        if now.version < 0 and (last := self._get("state.json")) and (version is None or last["version"] <= version):
            now = State(**last)
        while (version is None or now.version < version) and (commit := self._get(f"{now.version + 1}.json")):
            now = now.after(commit)
        if now.version < 0 or version is not None and now.version < version:
            raise LookupError(f"no table at {self.path}" if now.version < 0 else f"no version {version}")
        if version is None:
            self._known = now
        return now

    def _commit(self, now: State, change: Change, what: str) -> State | None:
        """The state after a commit on top of now or what came since; None if that wrote what the change has read."""
        entry = {"what": what, "add": change.add, "remove": change.remove, "gone": change.gone, "parts": change.parts, "sums": change.sums, "writes": sorted(change.writes)}
        text = json.dumps(entry)
        while not self._put(f"{now.version + 1}.json", text):
            other = self._get(f"{now.version + 1}.json")
            if clash(change.reads, set(other.get("writes", ()))):
                return None
            now = now.after(other)
        now = now.after(json.loads(text))
        if now.version % STATE_EVERY == 0:
            self._write_state(now)
        return now

    def _write_state(self, now: State) -> None:
        """An older state is as good: readers go on from it. The file is put in place whole."""
        target, fs = self._at("_commits", "state.json")
        draft, _ = self._at("_commits", f".{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(now.__dict__).encode()))
        out.close()
        fs.delete(target, False)
        fs.rename(draft, target)

    def transact(self, work: Callable[[State], Change | None], what: str, attempts: int = ATTEMPTS) -> Change | None:
        """Work out a change on the table's state and commit it; anew, up to so many times, if others wrote what it read. Gives the change that was made."""
        for _ in range(1 + attempts):
            now = self.state()
            change = work(now)
            if change is None:
                return None
            change.made = self._commit(now, change, what)
            if change.made:
                return change
        raise Conflict(f"{what}: others changed what was read {1 + attempts} times")

    # Rows.

    def schema(self, now: State | None = None) -> T.StructType:
        return T.StructType.fromJson(json.loads((now or self.state()).schema))

    def write(self, rows: DataFrame, *sort: str, **facts: Any) -> Change:
        """A change that adds rows, which are written but not part of the table yet. Facts are kept with them."""
        name = f"d-{uuid.uuid4().hex}"
        folder = f"{self.path}/{name}"
        columns = self.schema().names
        numbers = self.ids and "id" not in rows.columns
        if numbers:
            rows = rows.withColumn("id", F.lit(None).cast("long"))
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema()))
        (rows.sortWithinPartitions(*sort) if sort else rows).write.parquet(folder)
        written = self.spark.read.schema(self.schema()).parquet(folder).select(columns[0], "_metadata.file_name")
        sizes = written.groupBy("file_name").agg(F.count("*").alias("n")).orderBy("file_name").collect()  # a row for each file
        return Change(add={r[0]: {"dir": name, "rows": r[1], "numbers": numbers, "gone": None, "n_gone": 0} for r in sizes}, parts={name: facts} if sizes else {}, writes={ANY})

    def append(self, rows: DataFrame, *sort: str, sums: dict[str, int] | None = None, **facts: Any) -> DataFrame:
        """Add rows, and to running totals. Nothing that others commit meanwhile is in the way. Gives the rows as they are now, with their ids."""
        change = self.write(rows, *sort, **facts)
        change.sums = sums or {}
        self.transact(lambda now: change, "append")
        return self.rows(change.made, change.add)

    def rows(self, now: State, names: Iterable[str] | None = None, places: bool = False) -> DataFrame:
        """The living rows of some files or all; with places, the columns _file and _pos too."""
        files = now.files if names is None else {n: now.files[n] for n in names}
        schema = self.schema(now)
        extra = "_file string, _pos long"
        if not files:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, *T.DataType.fromDDL(extra).fields]) if places else schema)
        cut = [n for n, f in files.items() if f["n_gone"]]
        parts = []
        for own in ([n for n in files if not files[n]["n_gone"]], cut):
            if own:
                read = self.spark.read.schema(schema).parquet(*(f"{self.path}/{files[n]['dir']}/{n}" for n in own))
                if places or self.ids or own is cut:
                    read = read.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_pos"))
                parts.append(self._living(read, now, own) if own is cut else read)
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        if self.ids:
            bases = self.spark.createDataFrame([(n, f["base"]) for n, f in files.items()], "_file string, _base long")
            rows = rows.join(F.broadcast(bases), "_file").withColumn("id", F.coalesce("id", F.col("_base") + F.col("_pos")))
        return rows.select(*schema.names, *(("_file", "_pos") if places else ()))

    def _gone(self, now: State, names: list[str]) -> DataFrame:
        """(_file, word, bits) of files of which rows are gone: the rows of 64 neighbouring places as bits."""
        current = self.spark.createDataFrame([(n, now.files[n]["gone"]) for n in names], "_file string, folder string")
        folders = sorted({now.files[n]["gone"] for n in names})
        bits = self.spark.read.schema("_file string, folder string, word long, bits long").parquet(*(f"{self.path}/{f}" for f in folders))
        return bits.join(F.broadcast(current), ["_file", "folder"]).drop("folder")

    def _living(self, rows: DataFrame, now: State, names: list[str]) -> DataFrame:
        gone = self._gone(now, names).withColumnRenamed("_file", "_f")
        if sum(now.files[n]["n_gone"] for n in names) <= BROADCAST_GONE:
            gone = F.broadcast(gone)
        joined = rows.join(gone, (F.col("_file") == F.col("_f")) & (F.expr("_pos div 64") == F.col("word")), "left")
        return joined.where(F.expr("bits IS NULL OR shiftright(bits, CAST(_pos % 64 AS INT)) & 1 = 0")).drop("_f", "word", "bits")

    def read(self, version: int | None = None) -> DataFrame:
        return self.rows(self.state(version))

    def gone(self, hits: DataFrame, now: State) -> Change:
        """A change after which the rows at the places (_file, _pos) in hits are gone; their files stay as they are."""
        new = hits.groupBy("_file", F.expr("_pos div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(_pos % 64 AS INT)))").alias("bits"))
        touched = [r[0] for r in new.select("_file").distinct().collect()]  # of the files that are listed anyway
        if not touched:
            return Change()
        before = [n for n in touched if now.files[n]["n_gone"]]
        bits = new.unionByName(self._gone(now, before)).groupBy("_file", "word").agg(F.bit_or("bits").alias("bits")) if before else new
        folder = f"g-{uuid.uuid4().hex}"
        bits.select("_file", F.lit(folder).alias("folder"), "word", "bits").write.parquet(f"{self.path}/{folder}")
        counts = self.spark.read.parquet(f"{self.path}/{folder}").groupBy("_file").agg(F.sum(F.bit_count("bits").cast("long"))).collect()
        return Change(gone={r[0]: (folder, r[1]) for r in counts}, reads=set(touched), writes=set(touched))

    def places(self, now: State) -> DataFrame:
        """The living rows with their places (_file, _pos)."""
        return self.rows(now, places=True)

    def gone_or_none(self, hits: DataFrame, now: State) -> Change | None:
        """A change whose result is how many rows go, if any does."""
        change = self.gone(hits.select("_file", "_pos"), now)
        change.result = sum(n - now.files[f]["n_gone"] for f, (_, n) in change.gone.items())
        return change if change.gone else None

    def delete(self, where: Column | None = None, keys: DataFrame | None = None, but: DataFrame | None = None) -> int:
        """Rows that fit the condition, have their key in keys, and don't have it in but, go; files stay as they are. Returns how many went."""

        def work(now: State) -> Change | None:
            hits = self.places(now)
            hits = hits if where is None else hits.where(where)
            hits = hits if keys is None else hits.join(keys, keys.columns, "left_semi")
            hits = hits if but is None else hits.join(but, but.columns, "left_anti")
            return self.gone_or_none(hits, now)

        return done.result if (done := self.transact(work, "delete")) else 0

    def replace(self, hits: Callable[[DataFrame], DataFrame], new: Callable[[DataFrame], DataFrame], what: str = "replace") -> DataFrame:
        """The rows that hits picks (from rows with _file and _pos) become what new makes of them. Gives those rows as they are now.

        Of two writers who pick the same row, the later one picks anew from what the first one left.
        """

        def work(now: State) -> Change | None:
            picked = hits(self.places(now))
            change = self.gone(picked.select("_file", "_pos"), now)
            if not change.gone:
                return None
            # The places are fixed now: what is written is what goes.
            taken = self.rows(now, change.gone, places=True)
            old = self._gone(State(now.version, now.schema, {n: {**now.files[n], "gone": change.gone[n][0]} for n in change.gone}), list(change.gone)).withColumnRenamed("_file", "_f")
            on = (F.col("_file") == F.col("_f")) & (F.expr("_pos div 64") == F.col("word")) & F.expr("shiftright(bits, CAST(_pos % 64 AS INT)) & 1 = 1")
            rows = self.write(new(taken.join(old, on, "left_semi").drop("_file", "_pos")))
            change.add, change.parts = rows.add, rows.parts
            change.writes |= {ANY}
            return change

        done = self.transact(work, what)
        return self.rows(done.made, done.add) if done else self.rows(self.state(), ())

    def insert_keyed(self, make: Callable[[DataFrame], DataFrame], keys: list[str], new: DataFrame) -> DataFrame:
        """Add what make works out from the living rows for new ones, which share keys; anew if others add rows of those keys. Gives the added rows."""
        named = F.to_json(F.struct(*keys))
        some = [r[0] for r in new.select(named).distinct().limit(KEYS + 1).collect()]
        tokens = {ANY} if len(some) > KEYS else {f"key {k}" for k in some}

        def work(now: State) -> Change:
            change = self.write(make(self.rows(now)))
            change.reads, change.writes = tokens, tokens
            return change

        done = self.transact(work, "insert")
        return self.rows(done.made, done.add)

    def compact(self, share: float = SHARE) -> list[str]:
        """Write the living rows of files of which a share of rows is gone anew, with their ids. Returns the files that went."""

        def work(now: State) -> Change | None:
            worn = [n for n, f in now.files.items() if f["n_gone"] and f["n_gone"] >= share * f["rows"]]
            if not worn:
                return None
            change = self.write(self.rows(now, worn))
            return Change(change.add, worn, parts=change.parts, reads=set(worn), writes=set(worn))

        return done.remove if (done := self.transact(work, "compact")) else []


def clash(reads: set[str], writes: set[str]) -> bool:
    """Whether what was read may have been written: the same files or keys; rows of any keys where keys were read."""
    keys = {r for r in reads if r.startswith("key ") or r == ANY}
    return bool(reads & writes) or bool(keys and ANY in writes) or bool(ANY in reads and any(w.startswith("key ") for w in writes))
