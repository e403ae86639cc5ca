"""The connector contract as a Spark data source, ``landed_objects``, over what connectors have landed.

A connector (registered by provider) lands batches of objects: ``<path>/<provider>/<workspace>/<number>/`` holds a
batch's Parquet files and counts once its _SUCCESS file is there; numbers ascend from 1. The batch reader gives all
landed rows, split by row groups, and takes filters on the batch number, the type and the id to the files. The
stream reader's offset is the number of the last batch, so that a stopped stream goes on where it was; a batch that
isn't whole yet, and those after it, wait. Changes and access lists are columns:

workspace_id, provider, external_id, type, title, text, uri, metadata, version, changed_at, change (upsert or
removed), owner, viewers, teams (principals: type, id), inherited, raw_acl, landed (the batch's number).

Nothing is read for an implied workspace: provider and workspace_id must be given. Paths are opened by pyarrow's file
systems, so any that it knows will do; network clients are not part of this."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

_PRINCIPAL = "struct<type:string,id:string>"
SCHEMA = (
    "workspace_id string, provider string, external_id string, type string, title string, text string, uri string, metadata map<string,string>, version string, "
    f"changed_at timestamp, change string, owner {_PRINCIPAL}, viewers array<{_PRINCIPAL}>, teams array<{_PRINCIPAL}>, inherited boolean, raw_acl string, landed long"
)
_P = pa.struct([("type", pa.string()), ("id", pa.string())])
ARROW = pa.schema([
    *((c, pa.string()) for c in "workspace_id provider external_id type title text uri".split()), ("metadata", pa.map_(pa.string(), pa.string())), ("version", pa.string()),
    ("changed_at", pa.timestamp("us", tz="UTC")), ("change", pa.string()), ("owner", _P), ("viewers", pa.list_(_P)), ("teams", pa.list_(_P)), ("inherited", pa.bool_()),
    ("raw_acl", pa.string()), ("landed", pa.int64()),
])
#: Bytes of row groups that one task reads, about.
SPLIT = 64 << 20
#: Digits of a batch's folder, so that names sort as numbers do.
DIGITS = 12
#: What a row without a value has.
DEFAULTS = {"change": "upsert", "inherited": False}


class ConnectorError(Exception):
    """code: not_found, unsupported, internal or not_configured."""

    def __init__(self, provider: str, code: str, message: str):
        super().__init__(message)
        self.provider, self.code = provider, code


@dataclass(frozen=True)
class Connector:
    """What a provider's connector can do."""

    provider: str
    display_name: str
    incremental: bool = True
    acl: bool = False
    attachments: bool = False


class Registry:
    """Connectors by provider: no provider twice, and no answer for one that isn't there."""

    def __init__(self):
        self._known: dict[str, Connector] = {}

    def add(self, connector: Connector) -> None:
        if not connector.provider.strip():
            raise ConnectorError("unknown", "internal", "a connector needs a provider")
        if connector.provider in self._known:
            raise ConnectorError(connector.provider, "unsupported", f"there is a connector for {connector.provider} already")
        self._known[connector.provider] = connector

    def get(self, provider: str) -> Connector:
        if provider not in self._known:
            raise ConnectorError(provider, "not_found", f"no connector for {provider}")
        return self._known[provider]

    def list(self) -> list[Connector]:
        return sorted(self._known.values(), key=lambda c: c.provider)


def _given(options: dict, *names: str) -> list[str]:
    for n in names:
        if not (options.get(n) or "").strip():
            raise ConnectorError(options.get("provider") or "unknown", "internal", f"{n} must be given: nothing is read for an implied one")
    return [options[n].strip() for n in names]


def _files(path: str):
    """pyarrow's file system of a path, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Landing:
    """The landed batches of a provider's workspace."""

    def __init__(self, path: str, provider: str, workspace: str):
        if any(not x or "/" in x or x.startswith((".", "_")) for x in (provider, workspace)):
            raise ConnectorError(provider, "internal", "provider and workspace must be names of folders")
        self.url = f"{path.rstrip('/')}/{provider}/{workspace}"
        self.fs, self.base = _files(self.url)

    def complete(self, number: int) -> bool:
        from pyarrow import fs

        return self.fs.get_file_info(f"{self.base}/{number:0{DIGITS}d}/_SUCCESS").type != fs.FileType.NotFound

    def last(self, known: int = 0) -> int:
        """The last batch that has none missing before it, looked for from a known one on."""
        while self.complete(known + 1):
            known += 1
        return known

    def splits(self, after: int, upto: int, size: int = SPLIT) -> list[Split]:
        """Row groups of the batches' files, some together."""
        from pyarrow import fs

        out = []
        for number in range(after + 1, upto + 1):
            for f in sorted(self.fs.get_file_info(fs.FileSelector(f"{self.base}/{number:0{DIGITS}d}", recursive=True)), key=lambda f: f.path):
                if f.type != fs.FileType.File or not f.path.endswith(".parquet"):
                    continue
                if f.size <= size:
                    out.append(Split(f.path, number, None))
                    continue
                meta, own, held = pq.ParquetFile(f.path, filesystem=self.fs).metadata, [], 0
                for k in range(meta.num_row_groups):
                    if own and held + meta.row_group(k).total_byte_size > size:
                        out.append(Split(f.path, number, own))
                        own, held = [], 0
                    own.append(k)
                    held += meta.row_group(k).total_byte_size
                out += [Split(f.path, number, own)] if own else []
        return out


class Split(InputPartition):
    def __init__(self, path: str, number: int, groups: list[int] | None):
        self.path, self.number, self.groups = path, number, groups


class _Reading:
    """What both readers share: the landing, and rows of a split."""

    def __init__(self, options: dict):
        self.path, self.provider, self.workspace = _given(options, "path", "provider", "workspace_id")
        self.types = [x for x in (options.get("include") or "").split(",") if x]
        self.ids: list[str] | None = None
        self.split_size = int(options.get("splitbytes") or options.get("splitBytes") or SPLIT)

    @property
    def landing(self) -> Landing:
        return Landing(self.path, self.provider, self.workspace)

    def rows(self, split: Split | None) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        if split is None:  # Spark reads one split that isn't there where there are none
            return
        file = pq.ParquetFile(split.path, filesystem=self.landing.fs)
        own = set(file.schema_arrow.names)
        fixed = {"workspace_id": self.workspace, "provider": self.provider, "landed": split.number}
        groups = range(file.metadata.num_row_groups) if split.groups is None else split.groups
        for batch in file.iter_batches(batch_size=4096, row_groups=list(groups), columns=[c for c in ARROW.names if c in own and c not in fixed]):
            keep = pa.array([True] * batch.num_rows)
            for name, wanted in (("type", self.types or None), ("external_id", self.ids)):
                if wanted is not None and name in own:
                    keep = pc.and_(keep, pc.is_in(batch.column(name), value_set=pa.array(wanted, pa.string())))
            batch = batch.filter(keep)
            columns = []
            for f in ARROW:
                if f.name in fixed:
                    columns.append(pa.repeat(pa.scalar(fixed[f.name], f.type), batch.num_rows))
                elif f.name in own:
                    c = batch.column(f.name).cast(f.type)
                    columns.append(pc.fill_null(c, DEFAULTS[f.name]) if f.name in DEFAULTS else c)
                else:
                    columns.append(pa.repeat(pa.scalar(DEFAULTS.get(f.name), f.type), batch.num_rows))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(columns, schema=ARROW)


class LandedReader(_Reading, DataSourceReader):
    """All landed rows, or those after a batch (option ``after``)."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.after = int(options.get("after") or 0)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Ids and types are read from the files' rows, batch numbers choose folders; Spark keeps the other filters."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("external_id",), ("type",)):
                values = [f.value] if isinstance(f, EqualTo) else [v for v in f.value if v is not None]
                if f.attribute == ("type",):
                    self.types = [v for v in values if v in self.types] or [""] if self.types else values
                else:
                    self.ids = values if self.ids is None else [v for v in values if v in self.ids]
            elif isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("landed",):
                self.after = max(self.after, f.value - isinstance(f, GreaterThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[Split]:
        landing = self.landing
        return landing.splits(self.after, landing.last(self.after), self.split_size)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        yield from self.rows(partition)


class LandedStreamReader(_Reading, DataSourceStreamReader):
    """Batches as they land. Only the driver's reader looks for new ones, from the last it has seen."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.start, self.seen = int(options.get("after") or 0), 0

    def initialOffset(self) -> dict:
        return {"landed": self.start}

    def latestOffset(self) -> dict:
        self.seen = self.landing.last(max(self.seen, self.start))
        return {"landed": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return self.landing.splits(start["landed"], end["landed"], self.split_size)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        yield from self.rows(partition)

    def commit(self, end: dict) -> None:
        """Acknowledges: the number of the last batch done, written again if need be."""
        landing = self.landing
        with landing.fs.open_output_stream(f"{landing.base}/_acknowledged") as out:
            out.write(str(end["landed"]).encode())


class LandedObjects(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_objects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options)

    def streamReader(self, schema) -> LandedStreamReader:
        return LandedStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format ``landed_objects`` known to the session, with its filters at the files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedObjects)


def land(objects: DataFrame, path: str, provider: str, workspace: str) -> int:
    """Writes a batch of objects (external_id and any others of the columns) and returns its number. Of two that land at
    once one fails, as the folder is there."""
    landing = Landing(path, provider, workspace)
    number = landing.last(delta_cursor(path, provider, workspace)) + 1
    objects.select(*[c for c in objects.columns if c in ARROW.names and c not in ("workspace_id", "provider", "landed")]).write.parquet(f"{landing.url}/{number:0{DIGITS}d}")
    return number


def objects(spark: SparkSession, path: str, provider: str, workspace: str, after: int = 0, include: list[str] | None = None) -> DataFrame:
    """All landed rows after a batch, as a table."""
    register(spark)
    return spark.read.format("landed_objects").options(provider=provider, workspace_id=workspace, after=after, include=",".join(include or [])).load(path)


def stream_objects(spark: SparkSession, path: str, provider: str, workspace: str, after: int = 0, include: list[str] | None = None) -> DataFrame:
    register(spark)
    return spark.readStream.format("landed_objects").options(provider=provider, workspace_id=workspace, after=after, include=",".join(include or [])).load(path)


def current(landed: DataFrame) -> DataFrame:
    """Each object's last landed row (of rows of one batch the last by changed_at and version), removed ones too."""
    rest = [c for c in landed.columns if c != "external_id"]
    order = F.struct("landed", "changed_at", "version", "change")
    # Texts stay out of the comparison; the row itself comes along.
    return landed.groupBy("external_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("external_id", "r.*")


def deltas(landed: DataFrame, cursor: int) -> DataFrame:
    """external_id and change (added, updated, removed) of what landed after a batch, against what was there then:
    an object with the same version is no change."""
    state = lambda now: F.max(F.when(now, F.struct("landed", "changed_at", "version", "change")))
    both = landed.groupBy("external_id").agg(state(F.col("landed") <= cursor).alias("was"), state(F.col("landed") > cursor).alias("now"))
    there = F.coalesce(F.col("was.change") == "upsert", F.lit(False))
    kind = F.when(F.col("now.change") == "removed", F.when(there, "removed")).when(~there, "added").when(~F.col("was.version").eqNullSafe(F.col("now.version")), "updated")
    return both.filter("now is not null").select("external_id", kind.alias("change")).filter("change is not null")


def fetch_object(spark: SparkSession, path: str, provider: str, workspace: str, external_id: str) -> DataFrame:
    """One object's last row, none if it isn't there or was removed."""
    return current(objects(spark, path, provider, workspace).filter(F.col("external_id") == external_id)).filter("change != 'removed'")


def fetch_acl(connector: Connector, spark: SparkSession, path: str, workspace: str, external_id: str) -> DataFrame:
    """The normalised access list of an object: principal_type, principal_id, permission."""
    if not connector.acl:
        raise ConnectorError(connector.provider, "unsupported", f"{connector.provider} has no access lists")
    return acls(fetch_object(spark, path, connector.provider, workspace, external_id)).drop("external_id")


def acls(rows: DataFrame) -> DataFrame:
    """external_id, principal_type, principal_id, permission (own or read) and inherited of objects, each once."""
    tag = lambda c, what: F.transform(F.coalesce(c, F.array().cast(f"array<{_PRINCIPAL}>")), lambda p: F.struct(p["type"].alias("type"), p["id"].alias("id"), F.lit(what).alias("permission")))
    owner = F.when(F.col("owner").isNotNull(), F.array("owner"))
    each = F.explode(F.array_distinct(F.concat(tag(owner, "own"), tag(F.col("viewers"), "read"), tag(F.col("teams"), "read"))))
    return rows.select("external_id", "inherited", each.alias("p")).select("external_id", F.col("p.type").alias("principal_type"), F.col("p.id").alias("principal_id"), "p.permission", "inherited")


def delta_cursor(path: str, provider: str, workspace: str) -> int:
    """The last acknowledged batch, 0 if none is."""
    from pyarrow import fs

    landing = Landing(path, provider, workspace)
    if landing.fs.get_file_info(f"{landing.base}/_acknowledged").type == fs.FileType.NotFound:
        return 0
    with landing.fs.open_input_stream(f"{landing.base}/_acknowledged") as f:
        return int(f.read() or b"0")


def sync(connector: Connector, spark: SparkSession, path: str, workspace: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> dict[str, int]:
    """Hands what landed since the last call to a sink (batch, number) and acknowledges it. Returns the rows by change."""
    total: dict[str, int] = {"total": 0, "removed": 0}

    def each(batch: DataFrame, number: int) -> None:
        sink(batch, number)
        n = batch.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("change") == "removed").alias("r")).first()
        total["total"] += n["n"]
        total["removed"] += n["r"]

    stream = stream_objects(spark, path, connector.provider, workspace)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return total
