"""Incremental refreshes as micro-batches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import logged_query
from ..operators.postings import classify_evidence, dedup_postings, find_evidence, preserve_first_seen, union_sources
from ..session import delete, dropped, written


def merged_snapshot(current: DataFrame, previous: DataFrame | None, source: str, at: F.Column) -> DataFrame:
    """One source's refreshed postings with first sightings kept, and the last ones of all other sources."""
    if previous is None:
        return current
    own = previous.filter(F.col("sourceDataset").eqNullSafe(F.lit(source)))
    return union_sources(preserve_first_seen(current, own, at), previous, source)


def refreshed(raw: DataFrame, normalize: Callable[[DataFrame], DataFrame], terms: DataFrame) -> DataFrame:
    """T6, T10, T2 and A15 over raw rows of one source: postings without copies, with their class."""
    postings = normalize(raw).filter("rejected is null").drop("rejected")
    kept = dedup_postings(postings)
    classes = classify_evidence(kept, find_evidence(kept, terms))
    return kept.join(classes, "id")


POINTER, MANIFESTS = "_current", "_manifests"


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _text(spark: SparkSession, path: str) -> str | None:
    target, files = _file_system(spark, path)
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, text: str):
    target, files = _file_system(spark, path)
    out = files.create(target)
    out.write(bytearray(text.encode()))
    out.close()
    return target, files


def current_version(spark: SparkSession, path: str) -> str | None:
    """The name that the pointer below ``path`` holds: that of a manifest."""
    return _text(spark, f"{path}/{POINTER}")


def manifest_of(spark: SparkSession, path: str, version: str | None) -> dict:
    """``sources``, the folder of each source's postings, and ``before``, the version that this one came after."""
    return {"sources": {}, "before": None} if version is None else json.loads(_text(spark, f"{path}/{MANIFESTS}/{version}"))


def current_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The last complete version below ``path``: the folders of all its sources."""
    name = current_version(spark, path)
    if name is None:
        return None
    folders = manifest_of(spark, path, name)["sources"].values()
    return spark.read.parquet(*(f"{path}/{f}" for f in folders))


def _published(spark: SparkSession, path: str, version: str, sources: dict[str, str]) -> None:
    """Write a manifest under a fresh name and then put its name in the place of the pointer, in one step.

    Nothing that a reader may still read is overwritten: a write that fails, or is repeated, leaves the version before it whole.  The step is the rename of a file, which is
    whole on HDFS and local file systems; a store without such a rename needs a conditional put in its place.
    """
    name = f"{version}-{uuid.uuid4().hex}"
    _put(spark, f"{path}/{MANIFESTS}/{name}", json.dumps({"sources": sources, "before": current_version(spark, path)}, sort_keys=True))
    made, files = _put(spark, f"{path}/{POINTER}-{uuid.uuid4().hex}", name)
    jvm = spark.sparkContext._jvm
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri() if made.toUri().getScheme() else files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(made, jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}"), overwrite)


def _stored(df: DataFrame, path: str) -> str:
    """A fresh folder below ``path`` with the rows."""
    folder = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    return folder


def publish(df: DataFrame, path: str, version: str) -> None:
    """The rows as the whole snapshot, in one folder."""
    _published(df.sparkSession, path, version, {"": _stored(df, path)})


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete manifests before the last ``keep`` versions, and folders of postings that none of those names; gives what went.

    Only for a time without a batch under way, whose folders have no name yet.
    """
    named, folders, at = set(), set(), current_version(spark, path)
    while at is not None and len(named) < keep:
        manifest = manifest_of(spark, path, at)
        named.add(at)
        folders.update(manifest["sources"].values())
        at = manifest["before"] if _text(spark, f"{path}/{MANIFESTS}/{manifest['before']}") else None
    gone = []
    for below, kept in (("", folders), (f"/{MANIFESTS}", named)):
        target, files = _file_system(spark, path + below)
        for status in files.listStatus(target) if files.exists(target) else ():
            name = status.getPath().getName()
            if name not in kept and (below or name.startswith("data-")):
                delete(spark, f"{path}{below}/{name}")
                gone.append(name)
    return sorted(gone)


def refresh_batch(raw: DataFrame, number: int, path: str, normalize: Callable[[DataFrame], DataFrame], terms: DataFrame, at: F.Column) -> None:
    """One batch into the snapshot at ``path``; a batch that was published before changes nothing, and neither does one without postings.

    The sources of a batch are few, as feeds are declared.  Each one's postings are written to a folder of their own, after a look at the folder that they replace; the folders of all other sources
    are named again and not read, so what a batch costs does not depend on them.
    """
    spark = raw.sparkSession
    version = current_version(spark, path)
    if (version or "").startswith(f"v{number}-"):
        return
    before, made = manifest_of(spark, path, version)["sources"], {}
    for row in raw.select("source").distinct().orderBy("source").collect():
        current = written(refreshed(raw.filter(F.col("source").eqNullSafe(F.lit(row.source))), normalize, terms), "refreshed")
        dataset = current.select("sourceDataset").first()
        if dataset is not None:
            name = dataset[0] or ""
            earlier = made.get(name) or before.get(name)
            made[name] = _stored(current if earlier is None else preserve_first_seen(current, spark.read.parquet(f"{path}/{earlier}"), at), path)
        dropped(current)
    if made:
        _published(spark, path, f"v{number}", before | made)


def refresh_postings(stream: DataFrame, path: str, checkpoint: str, normalize: Callable[[DataFrame], DataFrame], terms: DataFrame, at: F.Column | None = None):
    """A query that takes batches of raw rows (``source`` and a feed's fields) into the snapshot at ``path``.

    Each source in a batch is replaced as a whole; a source without rows in the batch keeps its postings, and its folder.  ``vacuum`` deletes what no late version names.
    """
    at = F.current_timestamp() if at is None else at
    batch = lambda raw, number: refresh_batch(raw, number, path, normalize, terms, at)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---- search log


def query_log(events: DataFrame, tie: str | None = None) -> DataFrame:
    """R4 over a table ``session, ts, tab, q``: sanitized searches; one equal to the one before it in the session is left out, and an empty one forgets that.

    ``tie`` is a column that orders searches of one time, such as the event's id; without it they stand by tab and text.
    """
    clean = events.withColumn("query", logged_query("q"))
    mark = F.when(F.col("query").isNull(), F.lit("")).otherwise(F.concat_ws("|", "tab", "query"))
    before = F.lag("_mark").over(Window.partitionBy("session").orderBy("ts", *([tie] if tie else []), "tab", "query"))
    marked = clean.withColumn("_mark", mark).withColumn("_before", F.coalesce(before, F.lit("")))
    return marked.filter("query is not null and _mark <> _before").select("session", "ts", "tab", "query")


def query_log_stream(events: DataFrame, tie: str | None = None, late: str = "1 hour") -> DataFrame:
    """R4 over a stream: the rows of the table form, for searches that come at most ``late`` after those that stand behind them.

    A session's searches wait, in order of time and ``tie``, until the watermark has passed them; then they are judged, each by the one before it.  Besides those that wait, a session keeps the mark of its last
    search; a session without any for longer than ``late`` after its last one is forgotten, so the state is that of live sessions.  A search that comes after its time is left out,
    as any row behind a watermark.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = "bigint" if tie is None else events.schema[tie].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, done, waiting = state.get if state.exists else ("", -1, "[]")
        rows = json.loads(waiting)
        mark_of = state.getCurrentWatermarkMs() * 1000
        for frame in frames if not state.hasTimedOut else ():
            for ts, order, tab, query in zip(frame["ts"], frame["tie"], frame["tab"], frame["query"]):
                at = int(ts.value) // 1000 if ts.unit == "ns" else int(ts.as_unit("us").value)
                if at > mark_of:
                    rows.append([at, None if pd.isna(order) else order if isinstance(order, str) else int(order), tab, query if isinstance(query, str) else None])
        text = lambda v: (v is None, v if isinstance(v, str) else "", 0 if v is None or isinstance(v, str) else v)
        rows.sort(key=lambda r: (r[0], text(r[1]), text(r[2]), (r[3] is not None, r[3] or "")))
        out = []
        ready = [r for r in rows if r[0] <= mark_of]
        for at, _, tab, query in ready:
            mark = "" if query is None else query if tab is None else f"{tab}|{query}"
            if mark and mark != last:
                out.append((key[0], pd.Timestamp(at, unit="us"), tab, query))
            last, done = mark, at
        rows = rows[len(ready) :]
        if not rows and not ready and state.hasTimedOut:
            state.remove()
        else:
            state.update((last, done, json.dumps(rows)))
            # The watermark must pass the first that waits; without any, the session is forgotten some time after its last search.
            wake = (rows[0][0] if rows else max(done, mark_of) + FORGOTTEN_US) // 1000 + 1
            state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session", "ts", "tab", "query"])

    clean = events.select(F.col("session").cast("string").alias("session"), F.col("ts").cast("timestamp").alias("ts"), (F.lit(None).cast("bigint") if tie is None else F.col(tie)).cast(kind).alias("tie"), "tab", logged_query("q").alias("query"))
    kept = clean.withWatermark("ts", late).groupBy("session")
    return kept.applyInPandasWithState(step, "session string, ts timestamp, tab string, query string", "last string, done bigint, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


#: How long a session without searches is remembered, in microseconds of event time.
FORGOTTEN_US = 24 * 3600 * 1_000_000
