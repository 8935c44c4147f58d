"""Source health as state of a stream: one row of counters per source and the failures that may still be taken back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from postmill.operators import health as hl

#: A place in time is (microseconds, event_id). One row per source, Arrow batch and input task reaches the state.
SUMMARY = (
    "source {source}, ts timestamp, total_runs long, empty_runs long, requires_javascript boolean, ok_us long, ok_id long, at_us long, at_id long, "
    "status string, parsed long, discovered long, blocked boolean, failed_us array<long>, failed_id array<long>"
)
COUNTERS = (
    "total_runs long, empty_runs long, requires_javascript boolean, ok_us long, ok_id long, at_us long, at_id long, status string, "
    "parsed long, discovered long, blocked boolean, settled long"
)
HEALTH = (
    "source {source}, total_runs long, empty_runs long, failures long, last_success_at timestamp, last_checked_at timestamp, last_status string, "
    "last_parsed_count long, last_discovered_count long, blocked boolean, requires_javascript boolean"
)
NEVER = (-(1 << 63), -(1 << 63))


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs to one row per source; a success takes back the failures before it at once."""
    names = [part.split()[0] for part in SUMMARY.split(", ")]
    for runs in batches:
        if runs.empty:
            continue
        code, _ = pd.factorize(runs["source"], use_na_sentinel=False)
        order = np.lexsort((runs["event_id"].to_numpy(), runs["us"].to_numpy(), code))
        runs, code = runs.iloc[order], code[order]
        # a run without time has no place: it counts in the totals, but is no success and no failure of a streak
        timed = runs["us"].notna().to_numpy()
        us, ids, ok, at = runs["us"].fillna(0).to_numpy("int64"), runs["event_id"].to_numpy(), runs["parsed"].to_numpy() > 0, np.arange(len(runs))
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        sizes = np.diff(np.r_[first, len(runs)])
        last = runs.iloc[first + sizes - 1]
        success = np.maximum.reduceat(np.where(ok & timed, at, -1), first)
        never, each = success < 0, np.repeat(success, sizes)
        lost = np.repeat(never & np.logical_or.reduceat(ok & ~timed, first), sizes)
        # after the last success, not in its very place; where all successes are without time, no failure is known to follow
        failed = ~ok & timed & ~lost & (at > each) & ((each < 0) | (us != us[each]) | (ids != ids[each]))
        cuts = np.cumsum(np.add.reduceat(failed.astype("int64"), first))[:-1]
        javascript = ~ok & (runs["discovered"].to_numpy() == 0) & (runs["searched"].to_numpy() > 0)
        columns = (
            last["source"], last["ts"], sizes, np.add.reduceat((~ok).astype("int64"), first), np.logical_or.reduceat(javascript, first),
            np.where(never, NEVER[0], us[success]), np.where(never, NEVER[1], ids[success]), last["us"], last["event_id"],
            last["status"], last["parsed"], last["discovered"], last["blocked"], np.split(us[failed], cuts), np.split(ids[failed], cuts),
        )
        yield pd.DataFrame({n: x.array if isinstance(x, pd.Series) else x for n, x in zip(names, columns)})


class SourceHealth(StatefulProcessor):
    """Counters and open failures of a source.

    `failed` keeps failures after the last success and within the watermark: a success may still come before them. Older
    ones can't be taken back any more but by a success after all of them, so their number is enough (`settled`). A source that is
    dead for years has as much state as one that failed for the time the watermark waits.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", COUNTERS)
        self.failed = handle.getListState("failed", "us long, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.counters.get()
        total, empty, javascript, *place = (*old[:3], *old[3:7]) if old else (0, 0, False, *NEVER, *NEVER)
        success, newest = tuple(place[:2]), tuple(place[2:])
        last, settled = (old[7:11], old[11]) if old else ((None, 0, 0, False), 0)
        # every question to the state is a message to the JVM: a new source has asked one
        failed = [tuple(x) for x in self.failed.get()] if old else []
        kept = bool(failed)
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        before = success
        for batch in rows:
            for r in batch.itertuples(index=False):
                total, empty, javascript = total + r.total_runs, empty + r.empty_runs, javascript or r.requires_javascript
                success = max(success, (r.ok_us, r.ok_id))
                if (r.at_us, r.at_id) > newest:
                    newest, last = (r.at_us, r.at_id), (r.status, r.parsed, r.discovered, r.blocked)
                failed += zip(map(int, r.failed_us), map(int, r.failed_id))
        if success != before and success[0] >= mark:
            settled = 0  # settled failures are older than the watermark
        failed = [p for p in failed if p > success]
        settled += sum(p[0] < mark for p in failed)
        failed = [p for p in failed if p[0] >= mark]
        status, parsed, discovered, blocked = last
        self.counters.update((
            int(total), int(empty), bool(javascript), *map(int, success), *map(int, newest), status, int(parsed), int(discovered), bool(blocked), int(settled),
        ))
        if failed:
            self.failed.put(failed)
        elif kept:
            self.failed.clear()
        moment = lambda place: None if place == NEVER else pd.Timestamp(place[0], unit="us")
        yield pd.DataFrame({
            "source": [key[0]], "total_runs": [total], "empty_runs": [empty], "failures": [settled + len(failed)], "last_success_at": pd.Series([moment(success)], dtype="datetime64[us]"),
            "last_checked_at": pd.Series([moment(newest)], dtype="datetime64[us]"), "last_status": [status], "last_parsed_count": [parsed], "last_discovered_count": [discovered],
            "blocked": [blocked], "requires_javascript": [javascript],
        })

    def close(self) -> None:
        pass


def source_states(runs: DataFrame, late: str = "1 day") -> DataFrame:
    """The health of every source that a batch of the stream touches, after that batch (output mode update).

    Runs as in `operators.health.source_health`, in any order. Equal to the batch job as long as no run is later than `late`;
    a later one still counts in the totals, but no longer changes a streak. Runs shrink to a row per source in every
    input task, so a source that holds a third of all runs costs a few rows.
    """
    c, kind = F.col, runs.schema["source"].dataType.simpleString()
    blocked = F.lower(F.coalesce("message", F.lit(""))).rlike(hl.BLOCK_MESSAGE)
    narrow = runs.select(
        "source", "ts", F.unix_micros("ts").alias("us"), c("event_id").cast("long").alias("event_id"), "status",
        *[F.coalesce(c(x).cast("long"), F.lit(0)).alias(x) for x in ("parsed", "discovered", "searched")], blocked.alias("blocked"),
    )
    return (
        narrow.mapInPandas(_summaries, SUMMARY.format(source=kind)).withWatermark("ts", late).groupBy("source")
        .transformWithStateInPandas(SourceHealth(), HEALTH.format(source=kind), "Update", "EventTime")
    )


def health_schema(runs: DataFrame) -> str:
    return HEALTH.format(source=runs.schema["source"].dataType.simpleString())
