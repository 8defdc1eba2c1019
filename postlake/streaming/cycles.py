"""Crawl cycles of page-by-page catalogs as keyed state over a stream of segments.

A source's state is where its next segment starts, when this cycle and the one before began, and what it was read under: listing url, adapter
and version of the crawl policy. A segment under another of these starts over at page one, with no cycle before it. One that completes a
cycle closes what was last seen before the previous cycle began, and opens the next.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from postlake.streaming.deliveries import ROCKSDB, _plain

CHANGES = "source_id long, event_id long, at timestamp, restarted boolean, next_page long, cycle_start timestamp, previous_start timestamp, closes_before timestamp"
STATE = "listing_url string, adapter string, policy long, next_page long, cycle_start timestamp, previous_start timestamp, last_at timestamp, last_event long"
UNDER = ("listing_url", "adapter", "policy")


def step(state: dict | None, segment: dict) -> tuple[dict, bool, object]:
    """(state, whether the source started over, what the segment closes before) after a segment(at, listing_url, adapter, policy, next_page, complete)."""
    under = {k: segment[k] for k in UNDER}
    restarted = state is None or any(state[k] != v for k, v in under.items())
    if restarted:
        state = {**under, "next_page": 1, "cycle_start": segment["at"], "previous_start": None}
    if not segment["complete"]:
        return state | {"next_page": segment["next_page"]}, restarted, None
    done = {**under, "next_page": 1, "cycle_start": segment["at"], "previous_start": state["cycle_start"]}
    return done, restarted, state["previous_start"]


class Cycles(StatefulProcessor):
    def init(self, handle):
        self.state = handle.getValueState("source", STATE)

    def handleInputRows(self, key, rows, timerValues):
        held, last, state = self.state.get(), None, None
        if held is not None:
            state = dict(zip((*UNDER, "next_page", "cycle_start", "previous_start"), (*held[:4], _plain(held[4]), _plain(held[5]))))
            last = (_plain(held[6]), held[7])
        out = []
        for s in pd.concat(list(rows)).sort_values(["at", "event_id"]).to_dict("records"):
            s["at"] = _plain(s["at"])
            mark = (s["at"], int(s["event_id"]))
            if last is not None and mark <= last:
                continue
            last = mark
            state, restarted, closes = step(state, s)
            out.append((key[0], mark[1], s["at"], restarted, int(state["next_page"]), state["cycle_start"], state["previous_start"], closes))
        if out:
            self.state.update((*(state[k] if k != "policy" else int(state[k]) for k in UNDER), int(state["next_page"]), state["cycle_start"], state["previous_start"], *last))
            times = ("at", "cycle_start", "previous_start", "closes_before")
            yield pd.DataFrame(out, columns=[f.split()[0] for f in CHANGES.split(", ")]).astype({c: "datetime64[us]" for c in times})

    def close(self):
        pass


def start(segments: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the changes that all segments(source_id, event_id, at, listing_url, adapter, policy, next_page, complete) there are make."""
    segments.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    changes = segments.groupBy("source_id").transformWithStateInPandas(Cycles(), CHANGES, "Append", "None")
    return changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def closed_by(postings: DataFrame, changes: DataFrame) -> DataFrame:
    """postings(source_id, status, last_seen_at) with gone: open and last seen before the latest time that a cycle of their source closes before."""
    limit = changes.groupBy("source_id").agg(F.max("closes_before").alias("_before"))
    gone = (F.col("status") == "open") & (F.col("last_seen_at") < F.col("_before"))
    return postings.join(limit, "source_id", "left").withColumn("gone", F.coalesce(gone, F.lit(False))).drop("_before")
