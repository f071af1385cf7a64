"""State of streams, by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


class Reuse(StatefulProcessor):
    """When a key was asked for last, and what still waits for the watermark."""

    def __init__(self, ttl: int, memory: int):
        self.ttl, self.memory = ttl, memory

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "micros long")
        self.waiting = handle.getListState("waiting", "micros long, id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            new = [(int(t), i) for t, i in zip(batch["micros"], batch["id"]) if t // 1000 >= passed]
            if new:
                self.waiting.appendList(new)
                for at in {t // 1000 for t, _ in new}:
                    self.handle.registerTimer(at + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted((t, i) for t, i in self.waiting.get()) if self.waiting.exists() else []
        due, rest = [r for r in rows if r[0] // 1000 < passed], [r for r in rows if r[0] // 1000 >= passed]
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for t, i in due:
            age = None if last is None else t - last
            reason = "absent" if age is None or age > self.memory else "expired" if age > self.ttl else "fresh"
            out.append((key[0], t, i, reason, reason == "fresh"))
            last = t
        if due:
            self.last.update((last,))
            self.handle.registerTimer((last + self.memory) // 1000 + 1)
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        elif not rest and last is not None and (last + self.memory) // 1000 < passed:
            self.last.clear()
        if out:
            yield pd.DataFrame(out, columns=["key", "micros", "id", "reason", "hit"])

    def close(self) -> None:
        pass
