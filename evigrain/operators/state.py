"""Histories, retention, manifests and ordered admission."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrain.functions.text import safe_path
from evigrain.runtime import discard, stored

#: Requests of a class that one window takes, and the window.
LIMITS = {"generation": 5, "export": 30}
WINDOW_MS = 60_000
BUSY_RETRY_S = 2


def bounded_history(states: DataFrame, group: str, order: str, state: str, most: int = 30) -> DataFrame:
    """The last `most` states of each group, where equal states in a row count once."""
    within = Window.partitionBy(group).orderBy(order)
    changed = states.withColumn("_before", F.lag(state).over(within)).withColumn("_first", F.row_number().over(within) == 1)
    kept = changed.filter(F.col("_first") | ~F.col(state).eqNullSafe(F.col("_before")))
    turn = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))
    return kept.withColumn("_turn", turn).filter(F.col("_turn") <= most).drop("_before", "_first", "_turn")


def retention(jobs: DataFrame, cutoff: Column) -> DataFrame:
    """Jobs (name, job_id, status, created, updated) with the reason why they stay; null for candidates. Nothing is deleted."""
    valid = F.col("name").rlike("^job-[0-9a-f]{8}$")
    reason = (
        F.when(~valid, "not a regular job directory")
        .when(F.col("job_id") != F.col("name"), "manifest job ID does not match directory")
        .when(F.col("status") == "analyzing", "active job")
        .when((F.col("created") > F.col("updated")) | (F.col("created") > cutoff) | (F.col("updated") > cutoff), "job is inside retention window or has inconsistent timestamps")
    )
    return jobs.withColumn("skipped", reason)


def last_write(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key: an upsert log's state."""
    columns = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_last")).select(*keys, "_last.*")


def flattened_paths(manifests: DataFrame, fields: list[str]) -> DataFrame:
    """(job, kind, path): the paths that a manifest's fields name, without nulls."""
    named = F.array(*[F.struct(F.lit(f).alias("kind"), F.col(f).alias("path")) for f in fields])
    return manifests.select("job", F.explode(named).alias("_p")).select("job", "_p.kind", "_p.path").filter(F.col("path").isNotNull())


def unbound_refs(refs: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """References that no saved artifact answers on all keys."""
    return refs.join(saved.select(*keys).distinct(), keys, "left_anti")


def reference_errors(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """For manifest (path, size, sha) against files (path, content): missing, changed or unlisted files."""
    own = files.select("path", F.octet_length("content").alias("f_size"), F.sha2("content", 256).alias("f_sha"))
    error = F.when(F.col("f_sha").isNull(), "missing").when(F.col("sha").isNull(), "unlisted").when(F.col("f_size") != F.col("size"), "size_mismatch").when(F.col("f_sha") != F.col("sha"), "digest_mismatch")
    return manifest.join(own, "path", "full_outer").select("path", error.alias("error"))


def resolved_paths(paths: DataFrame, links: DataFrame) -> DataFrame:
    """(path, resolved, error): where paths end if links (path, target) are followed; 'cycle' if they never end, 'escape' if they end outside of the folder or are no plain relative paths.

    Each step doubles how many links have been followed, so chains of any length take as many steps as their length has
    bits, and what still stands on a link after all links have been followed is on a cycle or leads into one. Of several
    targets of a path the least counts; null paths and targets are ignored.
    """
    spark = links.sparkSession
    own = links.filter("path IS NOT NULL AND target IS NOT NULL").groupBy("path").agg(F.min("target").alias("at"))
    now = stored(own, "links")
    known = now.df.select(F.col("path").alias("at"))
    for _ in range(now.df.count().bit_length() + 1):
        if now.df.join(known, "at", "left_semi").isEmpty():
            break
        ahead = now.df.select(F.col("path").alias("at"), F.col("at").alias("ahead"))
        after = stored(now.df.join(ahead, "at", "left").select("path", F.coalesce("ahead", "at").alias("at")), "links")
        known = after.df.select(F.col("path").alias("at"))
        discard(spark, now.path)
        now = after
    ends = now.df.join(known.withColumn("_on_link", F.lit(True)), "at", "left")
    found = paths.filter("path IS NOT NULL").select("path").join(ends, "path", "left").withColumn("resolved", F.coalesce("at", "path"))
    error = F.when(F.col("_on_link"), "cycle").when(~safe_path(F.col("resolved")) | ~safe_path(F.col("path")), "escape")
    return found.select("path", F.when(~F.coalesce("_on_link", F.lit(False)), F.col("resolved")).alias("resolved"), error.alias("error"))


class Admission:
    """Admission of one key's requests in order: at most `cap` recorded times in a rolling window.

    A request over the cap is refused and not recorded; one that finds the system busy is refused but recorded.
    """

    def __init__(self, cap: int, window_ms: int = WINDOW_MS, times: list[int] | None = None):
        self.cap, self.window_ms, self.times = cap, window_ms, deque(times or ())

    def __call__(self, now: int, busy: bool) -> tuple[int, int]:
        """(status, seconds to wait)."""
        while self.times and self.times[0] <= now - self.window_ms:
            self.times.popleft()
        if len(self.times) >= self.cap:
            return 429, max(1, math.ceil((self.times[0] + self.window_ms - now) / 1000))
        self.times.append(now)
        return (503, BUSY_RETRY_S) if busy else (200, 0)


def admitted(requests: DataFrame, key: str, kind: str, at: str, seq: str, busy: str, limits: dict[str, int] | None = None, window_ms: int = WINDOW_MS) -> DataFrame:
    """(key, kind, seq, status, retry_after): an ordered pass over each key's requests.

    Partitions are sorted and streamed, and a key's state is its last few times, so no key is gathered.
    """
    caps = limits or LIMITS
    ordered = requests.select(F.col(key).alias("key"), F.col(kind).alias("kind"), F.col(at).cast("long").alias("at"), F.col(seq).alias("seq"), F.col(busy).alias("busy")).repartition("key", "kind").sortWithinPartitions("key", "kind", "at", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if (row.key, row.kind) != now:
                    now, state = (row.key, row.kind), Admission(caps[row.kind], window_ms)
                out.append((row.key, row.kind, row.seq, *state(int(row.at), bool(row.busy))))
            yield pd.DataFrame(out, columns=["key", "kind", "seq", "status", "retry_after"])

    types = dict(ordered.dtypes)
    return ordered.mapInPandas(run, f"key {types['key']}, kind string, seq {types['seq']}, status int, retry_after int")
