"""Tracking as a stream: each video's tracks are a map in keyed state, which an event-time timer clears once the video has ended."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from roadweave.operators.tracker import OUT, Track, Tracker, tracked_frames

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRACK = "place int, live boolean, mean array<double>, cov array<double>, feature array<double>, votes map<string, double>, state string, hits int, last int, id long, conf double"


class VideoTracks(StatefulProcessor):
    """State of a video: its last frame and ids, and a row per track that is alive or in the gallery. Only rows of tracks that changed or went are written."""

    def __init__(self, time: str, keep_s: float, size: tuple[int, int] | None) -> None:
        self.time, self.keep_s, self.size = time, keep_s, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.video = handle.getValueState("video", "last int, ids long")
        self.tracks = handle.getMapState("tracks", "slot long", TRACK)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        last, ids = self.video.get() if self.video.exists() else (-1, 0)
        g = pd.concat(list(rows))
        ends = int(g[self.time].max().timestamp() * 1000 + 1000 * self.keep_s)
        g = g[g["frame"] > last]
        if not len(g):
            return
        tracker = Tracker(size=self.size)
        tracker.ids = ids
        before = self.restored(tracker) if last >= 0 else {}
        out = tracked_frames(tracker, g, last if last >= 0 else None)
        self.kept(tracker, before)
        self.video.update((int(g["frame"].max()), tracker.ids))
        # One timer a video: it rings when nothing has come for keep_s of event time.
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(ends)
        if len(out):
            yield out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.video.clear()
        self.tracks.clear()
        yield from ()

    def restored(self, tracker: Tracker) -> dict[int, tuple]:
        """Fills the tracker in the order that its tracks had; returns the rows by slot."""
        rows = {int(k[0]): tuple(v) for k, v in self.tracks.iterator()}
        for slot, (_, live, mean, cov, feature, votes, state, hits, seen, own, conf) in sorted(rows.items(), key=lambda x: (not x[1][1], x[1][0])):
            t = Track(np.array(mean, float), np.array(cov, float).reshape(8, 8), None if feature is None else np.array(feature, float), Counter(dict(votes)), state, hits, seen, own, conf)
            t.slot = slot
            (tracker.live if live else tracker.gallery).append(t)
        return rows

    def kept(self, tracker: Tracker, before: dict[int, tuple]) -> None:
        free = max(before, default=-1)
        gone = set(before)
        for live, tracks in ((True, tracker.live), (False, tracker.gallery)):
            for place, t in enumerate(tracks):
                slot = getattr(t, "slot", None)
                if slot is None:
                    free += 1
                    slot = free
                gone.discard(slot)
                feature = None if t.feature is None else t.feature.tolist()
                self.tracks.updateValue((slot,), (place, live, t.mean.tolist(), t.cov.ravel().tolist(), feature, {k: float(v) for k, v in t.votes.items()}, t.state, t.hits, t.last, t.id, float(t.conf)))
        for slot in gone:
            self.tracks.removeKey((slot,))

    def close(self) -> None:
        pass


def tracked_stream(detections: DataFrame, time: str = "event_time", keep_s: float = 60.0, size: tuple[int, int] | None = None) -> DataFrame:
    """detections: a stream with a watermark on `time` and video_id, frame, x1..y2, conf, mode, where a video's frames arrive in order by micro-batch.

    Results are those of operators.tracker.tracked. Frames not after the last one seen are left out, so a replayed batch adds nothing. A video of which
    nothing has come for keep_s of event time is forgotten when the watermark passes; what comes later still is late. Timers and maps need
    Spark's RocksDB state store, which the session is set to.
    """
    detections.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return detections.groupBy("video_id").transformWithStateInPandas(VideoTracks(time, keep_s, size), OUT, "Append", "EventTime")
