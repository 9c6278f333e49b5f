"""Keyed state of the streams: the files of a bundle, and the first file of a form kind."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows that a processor hands on at once.
FRAME_ROWS = 1000
#: Files of a bundle that are one entry of its state.
PAGE_ROWS = 256
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """Streams started from now on hold their state in RocksDB, which keyed processors need."""
    if spark.conf.get(_PROVIDER, None) != _ROCKSDB:
        spark.conf.set(_PROVIDER, _ROCKSDB)


class BundleFiles(StatefulProcessor):
    """The file rows of the bundles of one group; hands on all rows of a bundle whenever one of it arrives.

    Only the bundles of a batch are looked up.  A call of a processor and its
    frames take far longer than a look at its state, so bundles come in groups,
    and a bundle is one entry of up to ``PAGE_ROWS`` files, or several pages of
    which all but the last are full.  A file that is sent again replaces its
    row; of several rows for one position in a batch the greatest text counts.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "bundle string, page int", "files string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str | None, dict[str | None, str]] = {}
        for frame in rows:
            # a frame may hold NaN for null
            for bundle, idx, row in frame[["bundle", "file_idx", "row"]].itertuples(index=False, name=None):
                own = new.setdefault(bundle if isinstance(bundle, str) else None, {})
                at = idx if isinstance(idx, str) else None
                own[at] = max(own.get(at, ""), row)
        first = not self.pages.exists()
        out: list[str] = []
        for bundle, own in new.items():
            for files in self._updated(bundle, own, first):
                out += files
                while len(out) >= FRAME_ROWS:
                    yield pd.DataFrame({"row": out[:FRAME_ROWS]})
                    out = out[FRAME_ROWS:]
        if out:
            yield pd.DataFrame({"row": out})

    def _updated(self, bundle: str | None, new: dict[str | None, str], first: bool) -> Iterator[list[str]]:
        """Rows of a bundle page by page, with the new ones put into its state; ``first``: its group has none yet."""
        page, full = 0, True
        while full:
            kept = None if first else self.pages.getValue((bundle, page))
            files = dict(json.loads(kept[0])) if kept else {}
            known = len(files)
            full = known == PAGE_ROWS
            again = [idx for idx in files if idx in new] if known <= len(new) else [idx for idx in new if idx in files]
            for idx in again:
                files[idx] = new.pop(idx)
            while not full and new and len(files) < PAGE_ROWS:
                idx, row = new.popitem()
                files[idx] = row
            # new files that do not fit go on to the next page
            full = full or bool(new)
            if again or len(files) > known:
                self.pages.updateValue((bundle, page), (json.dumps(list(files.items())),))
            if files:
                yield list(files.values())
            page += 1

    def close(self) -> None:
        pass


class FirstFile(StatefulProcessor):
    """The smallest file position of one (bundle, kind); hands on a row whenever it becomes smaller.

    The state goes once the watermark has passed the last arrival by ``keep_ms``.
    """

    def __init__(self, key_names: list[str], keep_ms: int):
        self.key_names, self.keep_ms = key_names, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "file_idx long, filename string, version int, last_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.first.get() if self.first.exists() else None
        best = (known[0], known[1]) if known else None
        version, last = (known[2], known[3]) if known else (0, 0)
        for frame in rows:
            at = frame["file_idx"].idxmin()
            found = (int(frame["file_idx"][at]), frame["filename"][at])
            best = found if best is None or found[0] < best[0] else best
            last = max(last, int(frame["arrived_ms"].max()))
        changed = known is None or best[0] != known[0]
        version += changed
        self.first.update((best[0], best[1], version, last))
        if known is None:
            self.handle.registerTimer(last + self.keep_ms)
        if changed:
            names = {name: [value] for name, value in zip(self.key_names, key)}
            yield pd.DataFrame({**names, "winner_idx": [best[0]], "winner_filename": [best[1]], "version": [version]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.first.get()[3] if self.first.exists() else None
        if last is not None and last + self.keep_ms > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(last + self.keep_ms)  # a file has arrived since
        else:
            self.first.clear()
        return iter(())

    def close(self) -> None:
        pass
