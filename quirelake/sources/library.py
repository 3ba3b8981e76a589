"""A versioned library of tables: Parquet files published by a manifest.

A commit writes new files and then the manifest of the new version, which names
a listing for each table: its files, their rows and the range of the table's
key in each. The manifest is created without overwriting, so of two writers of
one version one fails and nothing of it is seen (on a store whose rename can
overwrite, one writer at a time must be arranged for). Readers follow the newest
manifest; old versions stay readable.

Tables are laid out in ranges of their key, with Parquet bloom filters on the
columns that are looked up. A change by key rewrites the files that hold the
keys and no others, an append none. A writer whose version was taken in between
tries again, unless the other one's files overlap with what it read or wrote.
"""

from __future__ import annotations

import bisect
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 3
#: the column that a table is laid out by: the first of these that it has, unless named below
KEYS = ("paper_id", "checksum", "sha256", "analysis_id")
LAID_OUT_BY = {"checksums": ["checksum"], "postings": ["term", "block"], "indexed": ["block"]}
#: columns with a bloom filter
LOOKED_UP = ("paper_id", "checksum", "sha256", "analysis_id", "passage_id")
#: keys of a change or a lookup up to which they are pushed into the scan
PUSHED_KEYS = 1000
#: values of an IN filter up to which a Parquet scan takes each by itself (the default of its setting)
IN_VALUES = 10


class ConflictError(RuntimeError):
    """Another writer has published the version."""


class SchemaVersionError(RuntimeError):
    """The library is older or newer than this code, or not initialised."""


class ChecksumConflictError(RuntimeError):
    """A file's checksum belongs to another paper."""


class MigrationError(RuntimeError):
    """The library holds rows that a newer schema cannot take over."""


class ReadBackError(RuntimeError):
    """What was read back is not what was written."""


def _lower_checksums(library: Library) -> dict[str, DataFrame]:
    """Version 2: checksums in lower case, one paper each. Papers without a source are not given one."""
    if "papers" not in library.manifest()["tables"]:
        return {}
    papers = library.table("papers")
    if "checksum" not in papers.columns:
        return {}
    if "source_path" not in papers.columns or papers.filter("source_path is null").head(1):
        if papers.head(1):
            raise MigrationError("papers without a source path; the library must be built anew")
    lowered = papers.withColumn("checksum", F.lower("checksum"))
    if lowered.groupBy("checksum").count().filter("count > 1").head(1):
        raise MigrationError("checksums that differ in letter case only; the library must be built anew")
    return {"papers": lowered}


def _laid_out(library: Library) -> dict[str, DataFrame]:
    """Version 3: every table in ranges of its key, with listings; the owners of checksums as a table."""
    return {name: library.table(name) for name in library.manifest()["tables"]}


#: what each schema version changes
MIGRATIONS = [lambda _: {}, _lower_checksums, _laid_out]


@dataclass
class _Edit:
    """What a commit does to a table: files taken out (None: all) and put in, and the keys it depends on."""

    schema: str
    added: list[dict] = field(default_factory=list)
    gone: list[str] | None = field(default_factory=list)
    keyed: bool = False
    low: object = None
    high: object = None


def layout(name: str, columns: list[str]) -> list[str]:
    """The columns that a table is ordered by; the ranges of the first are in its listing."""
    return LAID_OUT_BY.get(name) or [k for k in KEYS if k in columns][:1]


def layout_key(name: str, columns: list[str]) -> str | None:
    return next(iter(layout(name, columns)), None)


def any_of(column: str, values: list) -> Column:
    """Whether the column is one of the values, as a tree of short IN filters, each of which a scan can use."""
    tests = [F.col(column).isin(values[k : k + IN_VALUES]) for k in range(0, len(values), IN_VALUES)] or [F.lit(False)]
    while len(tests) > 1:
        tests = [tests[k] | tests[k + 1] if k + 1 < len(tests) else tests[k] for k in range(0, len(tests), 2)]
    return tests[0]


def _overlaps(file: dict, low: object, high: object) -> bool:
    """Whether a file may hold a key from ``low`` to ``high``; a range that is not known may."""
    if None in (file["low"], file["high"], low, high):
        return True
    return file["low"] <= high and low <= file["high"]


def _holds_any(file: dict, values: list) -> bool:
    """Whether a file's range holds one of the sorted values."""
    if file["low"] is None or file["high"] is None:
        return True
    at = bisect.bisect_left(values, file["low"])
    return at < len(values) and values[at] <= file["high"]


def _few(keys: DataFrame, column: str) -> list | None:
    """The distinct values of a column, or None if they are too many to be pushed."""
    found = keys.select(column).distinct().limit(PUSHED_KEYS + 1).collect()
    return [r[0] for r in found] if len(found) <= PUSHED_KEYS else None


class Library:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    # manifests and listings

    def versions(self) -> list[int]:
        folder = self._path("manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, name: str, value: dict) -> None:
        out = self._fs.create(self._path(name), False)
        out.write(json.dumps(value, sort_keys=True).encode())
        out.close()

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            raise SchemaVersionError("the library is not initialised")
        return self._read(f"manifests/{version or known[-1]:08d}.json")

    def _publish(self, manifest: dict) -> None:
        target = self._path(f"manifests/{manifest['version']:08d}.json")
        staged = f"manifests/.{uuid.uuid4().hex}"
        self._write(staged, manifest)
        if self._fs.exists(target) or not self._fs.rename(self._path(staged), target):
            self._fs.delete(self._path(staged), False)
            raise ConflictError(f"version {manifest['version']} exists already")

    def _listing(self, entry: str | None) -> dict:
        """A table's files; before version 3 an entry was the folder of all of them."""
        if entry is None:
            return {"schema": None, "files": []}
        if not entry.startswith("listings/"):
            return {"schema": None, "files": [{"path": entry, "rows": None, "low": None, "high": None}]}
        return self._read(entry)

    def files(self, name: str, version: int | None = None) -> list[dict]:
        """The files of a table: path, rows, low and high (of the layout key)."""
        return self._listing(self.manifest(version)["tables"].get(name))["files"]

    # life cycle

    def initialise(self, migrations: list[Callable[[Library], dict[str, DataFrame]]] | None = None, read_only: bool = False) -> int:
        """Makes a new library or migrates an older one, one published version for each step; returns the schema version.

        A migration takes the library and returns the tables that it changes.
        Opened read-only, a library must be at the current schema version.
        """
        steps = migrations if migrations is not None else MIGRATIONS
        at = self.manifest()["schema_version"] if self.versions() else 0
        if at > len(steps):
            raise SchemaVersionError(f"schema version {at} is newer than {len(steps)}")
        if read_only and at < len(steps):
            raise SchemaVersionError(f"schema version {at} is older than {len(steps)}" if at else "the library is not initialised")
        for k in range(at, len(steps)):
            self.commit(steps[k](self), schema=k + 1)
        return len(steps)

    # writing

    def _stored(self, name: str, rows: DataFrame) -> list[dict]:
        """Writes rows in ranges of the table's key and returns the files."""
        folder = f"data/{uuid.uuid4().hex}/{name}"
        order = layout(name, rows.columns)
        key = next(iter(order), None)
        if "checksum" in rows.columns:
            rows = rows.withColumn("checksum", F.lower("checksum"))
        laid = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
        writer = laid.write
        for column in set(LOOKED_UP) & set(rows.columns):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(f"{self.root}/{folder}")
        ranged = key is not None and isinstance(rows.schema[key].dataType, T.StringType | T.LongType | T.IntegerType)
        low, high = (F.min(key), F.max(key)) if ranged else (F.lit(None), F.lit(None))
        blank = F.max(F.col(key).isNull()) if ranged else F.lit(False)
        found = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{folder}").groupBy("_metadata.file_name").agg(F.count(F.lit(1)).alias("rows"), low.alias("low"), high.alias("high"), blank.alias("blank"))
        return [{"path": f"{folder}/{r['file_name']}", "rows": r["rows"], "low": None if r["blank"] else r["low"], "high": None if r["blank"] else r["high"]} for r in sorted(found.collect(), key=lambda r: r["file_name"])]

    def _edit_by_key(self, name: str, gone: DataFrame, rows: DataFrame | None, listing: dict) -> _Edit:
        """Puts ``rows`` in place of those whose key is in ``gone`` (one column), rewriting the files that hold such keys only."""
        column = gone.columns[0]
        keys = gone.select(column).distinct()
        schema = listing["schema"] or (rows.schema.json() if rows is not None else None)
        if schema is None:
            raise KeyError(name)
        edit = _Edit(schema)
        shape = T.StructType.fromJson(json.loads(schema))
        ordered = column == layout_key(name, shape.names)
        count, low, high = keys.agg(F.count(F.lit(1)), F.min(column), F.max(column)).head()
        edit.keyed = count > 0
        if ordered:
            edit.low, edit.high = low, high
        held = self._scan(name, listing, keys, column) if edit.keyed else None
        touched = [r["file"] for r in held.join(keys, column, "left_semi").select(F.col("__file").alias("file")).distinct().collect()] if held is not None else []
        names = {f["path"].rsplit("/", 1)[1]: f["path"] for f in listing["files"]}
        edit.gone = [names[t] for t in touched]
        parts = [] if rows is None else [rows.select(*shape.names)]
        if edit.gone:
            parts.insert(0, self._open(edit.gone, shape).join(keys, column, "left_anti").select(*shape.names))
        if parts:
            edit.added = self._stored(name, parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
        return edit

    def apply(self, replaced: dict[str, DataFrame] | None = None, appended: dict[str, DataFrame] | None = None, put: dict[str, tuple[DataFrame, DataFrame | None]] | None = None, schema: int | None = None, base: int | None = None, batch: tuple[str, int] | None = None) -> int:
        """Publishes changes of any number of tables as one version, and returns it.

        replaced: whole tables. appended: further rows. put: (keys, rows), rows in place of those with
        a key in ``keys``, a DataFrame of one column. ``base`` is the version that the changes were made
        from, else the newest at the start. Versions published in between are built upon if they left
        alone what the changes depend on; otherwise it is a ConflictError and nothing is changed.

        ``batch`` is a stream's name and the number of its batch, recorded with the version: a batch
        that is recorded already changes nothing, however often it is repeated.
        """
        known = self.versions()
        now = self.manifest(known[-1]) if known else {"version": 0, "schema_version": 0, "tables": {}}
        start = now if base is None or base == now["version"] else self.manifest(base)
        if batch and now.get("batches", {}).get(batch[0], -1) >= batch[1]:
            return now["version"]
        edits: dict[str, _Edit] = {}
        for name, rows in (replaced or {}).items():
            edits[name] = _Edit(rows.schema.json(), self._stored(name, rows), None)
        for name, rows in (appended or {}).items():
            listing = self._listing(start["tables"].get(name))
            shape = T.StructType.fromJson(json.loads(listing["schema"])).names if listing["schema"] else rows.columns
            edits[name] = _Edit(listing["schema"] or rows.schema.json(), self._stored(name, rows.select(*shape)))
        for name, (gone, rows) in (put or {}).items():
            edits[name] = self._edit_by_key(name, gone, rows, self._listing(start["tables"].get(name)))
        while True:
            if now["version"] != start["version"]:
                self._check_unharmed(start, now, edits, batch)
            tables = dict(now["tables"])
            for name, edit in edits.items():
                held = [] if edit.gone is None else [f for f in self._listing(tables.get(name))["files"] if f["path"] not in set(edit.gone)]
                tables[name] = f"listings/{uuid.uuid4().hex}.json"
                self._write(tables[name], {"schema": edit.schema, "files": held + edit.added})
            batches = now.get("batches", {}) | ({batch[0]: batch[1]} if batch else {})
            version = now["version"] + 1
            try:
                self._publish({"version": version, "schema_version": schema if schema is not None else now["schema_version"], "tables": tables, "batches": batches})
                return version
            except ConflictError:
                now = self.manifest()
                if now["version"] < version:
                    raise

    def _check_unharmed(self, start: dict, now: dict, edits: dict[str, _Edit], batch: tuple[str, int] | None) -> None:
        """Fails if what was published since ``start`` touches what the edits depend on."""
        if batch and now.get("batches", {}).get(batch[0], -1) >= batch[1]:
            raise ConflictError(f"batch {batch[1]} of {batch[0]} has been written by another writer")
        if now["schema_version"] != start["schema_version"]:
            raise ConflictError("the schema version has changed")
        for name, edit in edits.items():
            if now["tables"].get(name) == start["tables"].get(name):
                continue
            before = {f["path"] for f in self._listing(start["tables"].get(name))["files"]}
            after = {f["path"]: f for f in self._listing(now["tables"].get(name))["files"]}
            if edit.gone is None or not set(edit.gone) <= after.keys():
                raise ConflictError(f"{name} was changed by another writer")
            if edit.keyed and any(_overlaps(f, edit.low, edit.high) for path, f in after.items() if path not in before):
                raise ConflictError(f"{name} holds new rows of another writer in the same range of keys")

    def commit(self, changes: dict[str, DataFrame], schema: int | None = None, base: int | None = None) -> int:
        """Publishes whole tables together as the next version; ``base``: the version that the changes were made from."""
        if base is not None and base != (self.versions() or [0])[-1]:
            raise ConflictError(f"version {base} is not the newest")
        owners = {"checksums": _owners(changes["papers"])} if "papers" in changes and {"paper_id", "checksum"} <= set(changes["papers"].columns) else {}
        return self.apply(replaced={**changes, **owners}, schema=schema, base=base)

    def append(self, name: str, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Adds rows to a table; see ``apply`` for ``batch``."""
        return self.apply(appended={name: rows}, batch=batch)

    def compact(self, name: str) -> int:
        """A table's rows in new files, after many small changes."""
        return self.apply(replaced={name: self.table(name)})

    def changes(self, name: str, before: int, after: int | None = None) -> DataFrame:
        """What changed in a table between two versions: rows with ``side``, left for gone and right for new.

        Files that both versions list are not read.
        """
        old, new = self.files(name, before), self.files(name, after)
        both = {f["path"] for f in old} & {f["path"] for f in new}
        shape = self.table(name, version=after).schema

        def rest(files: list[dict]) -> DataFrame:
            paths = [f["path"] for f in files if f["path"] not in both]
            return self._open(paths, shape) if paths else self.spark.createDataFrame([], shape)

        return differences(rest(old), rest(new))

    # reading

    def _open(self, paths: list[str], shape: T.StructType | None) -> DataFrame:
        reader = self.spark.read if shape is None else self.spark.read.schema(shape)
        return reader.parquet(*[f"{self.root}/{p}" for p in paths])

    def table(self, name: str, schema: T.StructType | str | None = None, version: int | None = None) -> DataFrame:
        entry = self.manifest(version)["tables"].get(name)
        if entry is None:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        listing = self._listing(entry)
        shape = T.StructType.fromJson(json.loads(listing["schema"])) if listing["schema"] else None
        return self._open([f["path"] for f in listing["files"]], shape) if listing["files"] else self.spark.createDataFrame([], shape)

    def _scan(self, name: str, listing: dict, keys: DataFrame, column: str) -> DataFrame | None:
        """The rows, with the file of each as __file, of the files that may hold one of the keys; None if there is no such file."""
        shape = T.StructType.fromJson(json.loads(listing["schema"])) if listing["schema"] else None
        files = listing["files"]
        if not files:
            return None
        values = _few(keys, column)
        if shape is None or column == layout_key(name, shape.names):
            if values is None:
                span = keys.agg(F.min(column), F.max(column)).head()
                files = [f for f in files if _overlaps(f, span[0], span[1])]
            else:
                files = [f for f in files if _holds_any(f, sorted(v for v in values if v is not None))]
        if not files:
            return None
        rows = self._open([f["path"] for f in files], shape).withColumn("__file", F.col("_metadata.file_name"))
        return rows if values is None or None in values else rows.filter(any_of(column, values))

    def matching(self, name: str, keys: DataFrame | list, column: str, schema: T.StructType | str | None = None, within: dict[str, DataFrame] | None = None) -> DataFrame:
        """The rows of a table whose ``column`` is one of the keys, read from the files that may hold them.

        Files are left out by the listing's ranges where the table is laid out by the column; up to
        ``PUSHED_KEYS`` keys also reach the scan as filters. ``within``: further columns and the only
        values that matter there, for the scan alone; rows with others may or may not be returned.
        """
        entry = self.manifest()["tables"].get(name)
        if entry is None:
            return self.table(name, schema)
        listing = self._listing(entry)
        plain = self.table(name)
        if isinstance(keys, list):
            keys = self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(column, plain.schema[column].dataType)]))
        found = self._scan(name, listing, keys, column)
        if found is None:
            return self.spark.createDataFrame([], plain.schema)
        for other, values in (within or {}).items():
            few = _few(values, other)
            if few is not None and None not in few:
                found = found.filter(any_of(other, few))
        return found.join(keys.select(column).distinct(), column, "left_semi").select(*plain.columns)

    def _looked_up(self, name: str, column: str, value: object) -> DataFrame:
        """The rows whose column has this value: an equality for the scan, over the files that may hold it."""
        listing = self._listing(self.manifest()["tables"].get(name))
        plain = self.table(name)
        ordered = column == layout_key(name, plain.columns)
        files = [f for f in listing["files"] if not ordered or _overlaps(f, value, value)]
        return self._open([f["path"] for f in files], plain.schema).filter(F.col(column) == value) if files else self.spark.createDataFrame([], plain.schema)

    def paper(self, paper_id: str) -> DataFrame:
        return self._looked_up("papers", "paper_id", paper_id)

    def paper_by_checksum(self, checksum: str) -> DataFrame:
        """The paper of a file digest, whatever its letter case."""
        digest = checksum.lower()
        if "checksums" not in self.manifest()["tables"]:
            return self._looked_up("papers", "checksum", digest)
        owner = self._looked_up("checksums", "checksum", digest).head()
        return self.paper(owner["paper_id"]) if owner else self.table("papers").limit(0)

    def passages(self, paper_id: str) -> DataFrame:
        return self._looked_up("passages", "paper_id", paper_id).orderBy("ordinal")

    def paper_ids(self) -> DataFrame:
        return self.table("papers").select("paper_id").orderBy("paper_id")

    def analyses(self, checksum: str | None = None) -> DataFrame:
        """Stored analyses, newest first; of one file's checksum if given."""
        chosen = self.table("analyses") if checksum is None else self._looked_up("analyses", "checksum", checksum.lower())
        return chosen.orderBy(F.desc("updated_at"), F.desc("analysis_id"))

    # writing papers

    def save_papers(self, papers: DataFrame, children: dict[str, DataFrame], keep: list[str] | None = None, key: str = "paper_id", also: dict[str, DataFrame] | None = None) -> int:
        """Puts papers with all their child rows in place of older ones of the same ids, as one version.

        Fails, without writing, if a checksum belongs to another paper, stored
        or new. Columns in ``keep`` retain the stored value. Files without one
        of the papers stay as they are. ``also`` are rows appended to other
        tables in the same version. What was written is read back and compared.
        """
        base = self.manifest()["version"]
        ids = papers.select(key).distinct()
        fresh, old = _owners(papers, key), self.matching("papers", ids, key, papers.schema)
        owned = self.matching("checksums", fresh.select("checksum"), "checksum", fresh.schema)
        taken = fresh.union(owned.select("checksum", key)).groupBy("checksum").agg(F.count_distinct(key).alias("owners"), F.min(key).alias("owner")).filter("owners > 1").orderBy("checksum").head(1)
        if taken:
            raise ChecksumConflictError(f"checksum {taken[0]['checksum']} belongs to {taken[0]['owner']}")
        new = upsert(old.limit(0), papers, [key]) if not keep else upsert(old, papers, [key], keep)
        put = {"papers": (ids, new), "checksums": (fresh.select("checksum").union(_owners(old, key).select("checksum")).distinct(), fresh)}
        put |= {name: (ids, rows) for name, rows in children.items()}
        version = self.apply(put=put, appended=also, base=base)
        for name, rows in children.items():
            back = self.matching(name, ids, key).select(*rows.columns)
            if differences(back, rows).head(1):
                raise ReadBackError(f"{name} of version {version} differs from what was saved")
        return version

    def save_analyses(self, analyses: DataFrame, key: str = "analysis_id", stamp: str = "updated_at") -> int:
        """Puts analyses in place of older ones; those that change nothing keep their stamp."""
        base = self.manifest()["version"]
        if "checksum" in analyses.columns:
            analyses = analyses.withColumn("checksum", F.lower("checksum"))  # as it is stored
        ids = analyses.select(key).distinct()
        old = self.matching("analyses", ids, key, analyses.schema)
        return self.apply(put={"analyses": (ids, upsert_if_changed(old, analyses, [key], stamp))}, base=base)

    def analysis(self, analysis_id: str) -> DataFrame:
        return self._looked_up("analyses", "analysis_id", analysis_id)

    def delete_analyses(self, gone: DataFrame) -> int:
        """Deletes the analyses whose analysis_id is in ``gone``."""
        return self.apply(put={"analyses": (gone.select("analysis_id"), None)}, base=self.manifest()["version"])

    def delete_papers(self, gone: DataFrame, key: str = "paper_id") -> int:
        """Deletes papers and their rows in all tables that have the key, as one version; other files stay."""
        base = self.manifest()
        put: dict[str, tuple[DataFrame, DataFrame | None]] = {}
        for name in base["tables"]:
            if name == "checksums":
                put[name] = (_owners(self.matching("papers", gone.select(key), key), key).select("checksum"), None)
            elif key in self.table(name).columns:
                put[name] = (gone.select(key), None)
        return self.apply(put=put, base=base["version"])

    def drop(self) -> None:
        """Deletes the library with all its versions."""
        self._fs.delete(self._path(""), True)

    def status(self) -> dict:
        """What an inspection shows: missing, outdated, incompatible or ready, and row counts of a ready one."""
        if not self.versions():
            return {"state": "missing"}
        found = self.manifest()
        state = "ready" if found["schema_version"] == SCHEMA_VERSION else "outdated" if found["schema_version"] < SCHEMA_VERSION else "incompatible"
        counts = {name: sum(f["rows"] for f in self._listing(entry)["files"]) for name, entry in sorted(found["tables"].items())} if state == "ready" else {}
        return {"state": state, "version": found["version"], "schema_version": found["schema_version"], "rows": counts}


def _owners(papers: DataFrame, key: str = "paper_id") -> DataFrame:
    """(checksum, key): which paper a checksum, in lower case, belongs to."""
    return papers.select(F.lower("checksum").alias("checksum"), key)


def upsert(existing: DataFrame, new: DataFrame, key: list[str], keep: list[str] | None = None) -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those with equal keys.

    Columns in ``keep`` (like created_at) retain the existing value.
    """
    fresh = new
    if keep:
        old = existing.select(*key, *[F.col(c).alias(f"__{c}") for c in keep])
        fresh = new.join(old, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in keep}).select(*new.columns)
    return existing.join(new.select(*key), key, "left_anti").unionByName(fresh)


def upsert_if_changed(existing: DataFrame, new: DataFrame, key: list[str], stamp: str = "updated_at") -> DataFrame:
    """As ``upsert``; rows whose other columns are all equal keep their old stamp."""
    content = [c for c in new.columns if c not in (*key, stamp)]
    old = existing.select(*key, F.xxhash64(*content).alias("__hash"), F.col(stamp).alias("__stamp"))
    same = F.col("__hash") == F.xxhash64(*content)
    fresh = new.join(old, key, "left").withColumn(stamp, F.when(same, F.col("__stamp")).otherwise(F.col(stamp))).select(*new.columns)
    return existing.join(new.select(*key), key, "left_anti").unionByName(fresh)


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str = "paper_id") -> dict[str, DataFrame]:
    """Every table without the rows of the keys in ``gone``."""
    keys = gone.select(key).distinct()
    return {name: rows.join(keys, key, "left_anti") for name, rows in tables.items()}


def latest(rows: DataFrame, key: str, stamp: str = "updated_at") -> DataFrame:
    """The newest row of each key; of equally new ones the greatest."""
    others = [c for c in rows.columns if c not in (key, stamp)]
    return rows.groupBy(key).agg(F.max(F.struct(stamp, *others)).alias("r")).select(key, "r.*").select(*rows.columns)


#: buckets whose digests are compared before rows are
BUCKETS = 1024


def differences(left: DataFrame, right: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows of one side only, with multiplicity: empty if a read-back equals what was written.

    Rows fall into buckets by their hash. Each side's buckets are summed up to a count and two sums
    of hashes, which do not depend on order; rows of buckets with equal sums go no further, so what is
    shuffled follows the difference. Columns of maps cannot be compared.
    """
    columns = left.columns
    hashed = [F.xxhash64(*columns), F.xxhash64(F.lit(5), *columns)]
    bucket = F.pmod(F.xxhash64(F.lit(9), *columns), F.lit(buckets)).cast("int")

    def signed(rows: DataFrame, sign: int) -> DataFrame:
        halves = [part for h in hashed for part in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]
        return rows.select(bucket.alias("bucket"), F.lit(sign).cast("long").alias("n"), *[(part.cast("long") * sign).alias(f"h{k}") for k, part in enumerate(halves)])

    sums = signed(left, 1).union(signed(right.select(*columns), -1)).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n", "h0", "h1", "h2", "h3")])
    unequal = [r["bucket"] for r in sums.filter("n <> 0 or h0 <> 0 or h1 <> 0 or h2 <> 0 or h3 <> 0").select("bucket").collect()]
    a, b = (rows.select(*columns).filter(bucket.isin(unequal)) for rows in (left, right))
    if not unequal:
        return left.limit(0).withColumn("side", F.lit("left"))
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))
