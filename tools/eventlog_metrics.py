"""Per-query metrics from a Spark event log (no UI needed).

Jobs are attributed to queries by ``spark.job.description``; task metrics
are summed per query: input records read by scans, shuffle bytes written
and the number of tasks.
"""

from __future__ import annotations

import glob
import json
import os
from collections import defaultdict


def _lines(path: str):
    if path.endswith(".zstd"):
        import io
        import zstandard
        with open(path, "rb") as fh:
            reader = zstandard.ZstdDecompressor().stream_reader(fh)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(path) as fh:
            yield from fh


def metrics(log_dir: str) -> dict[str, dict[str, int]]:
    files = sorted(f for f in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)
                   if os.path.isfile(f) and not os.path.basename(f).startswith((".", "appstatus")))
    stage_query: dict[int, str] = {}
    out: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for path in files:
        for line in _lines(path):
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                desc = (ev.get("Properties") or {}).get("spark.job.description")
                if desc:
                    for sid in ev.get("Stage IDs", []):
                        stage_query[sid] = desc
            elif kind == "SparkListenerTaskEnd":
                q = stage_query.get(ev.get("Stage ID"))
                tm = ev.get("Task Metrics") or {}
                if q is None or not tm:
                    continue
                out[q]["input_records"] += (tm.get("Input Metrics") or {}).get("Records Read", 0)
                out[q]["shuffle_bytes"] += (tm.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                out[q]["tasks"] += 1
    return {k: dict(v) for k, v in out.items()}
