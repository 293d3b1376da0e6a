"""Progress reporters: what a run tells while it runs, from counters that tasks add to as they end, and at its end."""

from __future__ import annotations

import sys
import threading
from typing import Any

from recordmill.model import ProgressSnapshot


class ProgressReporter:
    """Does nothing; the base of others. ``update`` gets how many records are new, and all counts."""

    def start(self, total: int | None = None) -> None:
        pass

    def update(self, n: int = 1, snapshot: ProgressSnapshot | None = None, **stats: Any) -> None:
        pass

    def close(self) -> None:
        pass


class NullProgress(ProgressReporter):
    pass


class TqdmReporter(ProgressReporter):
    """A bar if tqdm is there, else lines."""

    def __init__(self, **options: Any) -> None:
        try:
            from tqdm import tqdm
        except ImportError:
            tqdm = None
        self.make, self.options, self.bar = tqdm, options, None

    def start(self, total: int | None = None) -> None:
        self.bar = self.make(total=total, unit="rec", **self.options) if self.make else None

    def update(self, n: int = 1, snapshot: ProgressSnapshot | None = None, **stats: Any) -> None:
        said = {"dropped": snapshot.dropped, "failed": snapshot.failed} if snapshot else {}
        if self.bar is not None:
            self.bar.update(n)
            self.bar.set_postfix(**said, **stats)
        else:
            print(" ".join(f"{k}={v}" for k, v in ({"processed": snapshot.processed if snapshot else n} | said | stats).items()), file=sys.stderr)

    def close(self) -> None:
        if self.bar is not None:
            self.bar.close()


class Watch:
    """Tells a reporter about a run's counters until it is left. Tasks that run again count again, but for the last snapshot.

    Nothing is known of records between tasks' ends, so none is in flight or buffered in a snapshot.
    """

    def __init__(self, reporter: ProgressReporter, tally: tuple[Any, Any, Any], total: int | None, seconds: float = 0.5) -> None:
        self.reporter, self.tally, self.total, self.seconds = reporter, tally, total, seconds
        self.told, self.stop = 0, threading.Event()

    def tell(self, snapshot: ProgressSnapshot) -> None:
        if snapshot.processed > self.told or not self.stop.is_set():
            self.reporter.update(max(0, snapshot.processed - self.told), snapshot)
            self.told = max(self.told, snapshot.processed)

    def _poll(self) -> None:
        while not self.stop.wait(self.seconds):
            done, dropped, failed = (c.value for c in self.tally)
            if done > self.told:
                self.tell(ProgressSnapshot(done, 0, dropped, 0, 0, failed, done))

    def __enter__(self) -> Watch:
        self.reporter.start(self.total)
        self.thread = threading.Thread(target=self._poll, daemon=True)
        self.thread.start()
        return self

    def end(self) -> None:
        self.stop.set()
        self.thread.join()

    def __exit__(self, *_: object) -> None:
        self.end()
