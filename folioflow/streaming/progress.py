"""Live progress of jobs: events folded into state, as a stream and as a batch with the same result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

EVENT = "job_id LONG, seq LONG, kind STRING, page_number INT, page_count INT, provenance STRING, failed BOOLEAN, detail STRING, done INT, total INT, stage STRING"
STATE = "job_id LONG, status STRING, page_count INT, done_pages LONG, failed_pages LONG, stage STRING, stage_done INT, stage_total INT, marks MAP<INT, STRING>, reviews MAP<INT, STRING>"
#: Review reasons kept for a job.
MOST_REVIEWS = 500
#: The mark of a failed page and of one that nothing read.
NO_MARK = "x"


def empty(job: int) -> dict:
    return {"job_id": job, "status": "waiting", "page_count": 0, "done_pages": 0, "failed_pages": 0, "stage": None, "stage_done": None, "stage_total": None, "marks": {}, "reviews": {}}


def apply(state: dict, e: dict) -> dict:
    """One event. A page read again replaces its mark, and failed_pages never falls; a page that recovers loses its review reason; after the end nothing changes."""
    s, get = state, lambda k: None if e.get(k) is None or e.get(k) != e.get(k) else e[k]
    if s["status"] in ("done", "failed"):
        return s
    kind = e["kind"]
    if kind == "opened":
        s.update(status="running", page_count=int(get("page_count") or 0), marks={}, reviews={}, done_pages=0, failed_pages=0)
    elif kind == "page":
        page = get("page_number")
        if page is not None and 1 <= page <= max(s["page_count"], 0):
            page, failed = int(page), bool(get("failed"))
            mark = NO_MARK if failed or get("provenance") in (None, "none") else get("provenance")
            if page not in s["marks"]:
                s["done_pages"] += 1
            s["marks"][page] = mark
            s["failed_pages"] += failed
            if not failed:
                s["reviews"].pop(page, None)
            elif page in s["reviews"] or len(s["reviews"]) < MOST_REVIEWS:
                s["reviews"][page] = get("detail") or ""
    elif kind == "stage":
        name = get("stage")
        if name != s["stage"]:
            s.update(stage=name, stage_done=None, stage_total=None)
        for field, key in (("stage_done", "done"), ("stage_total", "total")):
            if get(key) is not None:
                s[field] = int(get(key))
    elif kind in ("done", "failed"):
        s["status"] = kind
    return s


def fold(events: DataFrame) -> DataFrame:
    """The state of each job after all its events, in order of seq."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state = empty(int(pdf["job_id"].iloc[0]))
        for e in pdf.sort_values("seq").to_dict("records"):
            state = apply(state, e)
        return pd.DataFrame([state])

    return events.groupBy("job_id").applyInPandas(run, STATE)


class _Folder(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "json STRING")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        import json

        held = self.state.get() if self.state.exists() else None
        s = json.loads(held[0]) if held else empty(int(key[0]))
        s["marks"], s["reviews"] = ({int(k): v for k, v in s[f].items()} for f in ("marks", "reviews"))
        for e in pd.concat(list(rows)).sort_values("seq").to_dict("records"):
            s = apply(s, e)
        self.state.update((json.dumps(s),))
        yield pd.DataFrame([s])

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame) -> DataFrame:
    """A streaming table of the jobs that each batch changed, with their new state."""
    return events.groupBy("job_id").transformWithStateInPandas(statefulProcessor=_Folder(), outputStructType=StructType.fromDDL(STATE), outputMode="Update", timeMode="None")


def stalled(states: DataFrame, last_seen: DataFrame, now: float, limit_s: float) -> DataFrame:
    """Jobs that run and have been silent for longer than the limit."""
    return states.filter("status = 'running'").join(last_seen, "job_id").filter(F.lit(now) - F.col("last_s") > limit_s).select("job_id", (F.lit(now) - F.col("last_s")).alias("silent_s"))


def not_delivered(found: DataFrame, receipts: DataFrame) -> DataFrame:
    """Files (path, size, modified) without a receipt of the same file: what a watch has still to do."""
    return found.join(receipts.select("path", "size", "modified").distinct(), ["path", "size", "modified"], "left_anti")


def recent_speed(spans: DataFrame, most: int = 30) -> DataFrame:
    """Bytes for each second that some copy was running, over a job's last `most` copies."""
    from pyspark.sql import Window

    from ..operators.sequence import busy_time

    last = spans.withColumn("_r", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("end_s"), F.desc("start_s")))).filter((F.col("_r") <= most))
    busy = busy_time(last, ["job_id"])
    return last.groupBy("job_id").agg(F.sum("bytes").alias("bytes")).join(busy, "job_id").select("job_id", F.try_divide(F.col("bytes").cast("double"), F.col("busy_s")).alias("bytes_per_s"))


def events_of(table: DataFrame) -> DataFrame:
    """Progress events from a table of plain events (user_id, ts, event_id, event_type, value): each user's job, its opening first."""
    page = (F.floor(F.col("value")) % 40 + 1).cast("int")
    body = table.select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "stage").otherwise("page").alias("kind"), page.alias("page_number"), F.lit(None).cast("int").alias("page_count"),
        F.when(F.col("event_type") == "click", "ocr_region").when(F.col("event_type") == "purchase", "vision_model").when(F.col("event_type") == "view", "text_layer").alias("provenance"), (F.col("event_type") == "error").alias("failed"), F.when(F.col("event_type") == "error", F.lit("unreadable")).alias("detail"),
        F.when(F.col("event_type") == "signup", page).alias("done"), F.lit(40).alias("total"), F.when(F.col("event_type") == "signup", "reading").alias("stage"),
    )
    opened = table.select(F.col("user_id").alias("job_id")).distinct().select("job_id", F.lit(-1).cast("long").alias("seq"), F.lit("opened").alias("kind"), F.lit(None).cast("int").alias("page_number"), F.lit(40).alias("page_count"), *[F.lit(None).cast(t).alias(n) for n, t in (("provenance", "string"), ("failed", "boolean"), ("detail", "string"), ("done", "int"), ("total", "int"), ("stage", "string"))])
    return opened.unionByName(body)
