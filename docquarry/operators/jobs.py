"""Job events: life cycles, repeats and delivery."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Which status may follow which.
TRANSITIONS = [("queued", "processing"), ("queued", "failed"), ("processing", "completed"), ("processing", "failed")]


def without_repeats(events: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """Events that are not the same as the one before them of the same key."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("_before", F.lag(status).over(w)).filter(~F.col(status).eqNullSafe(F.col("_before"))).drop("_before")


def violations(events: DataFrame, key: str, order: list[str], status: str, allowed: list[tuple[str, str]] = TRANSITIONS) -> DataFrame:
    """Events whose status may not follow the one before it; the first event of a key is none. allowed is a fixed list."""
    w = Window.partitionBy(key).orderBy(*order)
    pairs = F.array(*(F.lit(f"{a}>{b}") for a, b in allowed))
    before = events.withColumn("before", F.lag(status).over(w))
    return before.filter(F.col("before").isNotNull() & ~F.array_contains(pairs, F.concat_ws(">", "before", status)))


def last_status(events: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """The key, status and n of its events."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"), F.count("*").alias("n"))


def work(requests: DataFrame, finished: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, finished, rejected) of a batch of requests (job_id, session_id, question).

    finished: job_id, status, result, error of the jobs that are done: one that is delivered again is not run, and its final
    event is told again. answer: job_id, session_id, question -> job_id, result, error (null for a job that went well). A
    request without a job is rejected; one without a question fails. Events (job_id, seq, status, result, error): processing
    and the final one, or the final one alone.
    """
    rejected = requests.filter("job_id IS NULL")
    once = requests.filter("job_id IS NOT NULL").dropDuplicates(["job_id"])
    done = once.select("job_id").join(finished, "job_id")
    new = once.join(finished.select("job_id"), "job_id", "left_anti")
    bad = F.coalesce(F.trim("question"), F.lit("")) == ""
    invalid = new.filter(bad).select("job_id", F.lit("failed").alias("status"), F.lit(None).cast("string").alias("result"), F.lit("invalid request").alias("error"))
    asked = new.filter(~bad)
    made = answer(asked.select("job_id", "session_id", "question")).select("job_id", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), F.when(F.col("error").isNull(), F.col("result")).alias("result"), "error")
    final = made.unionByName(invalid)
    nothing = F.lit(None).cast("string")
    began = asked.select("job_id", F.lit(0).alias("seq"), F.lit("processing").alias("status"), nothing.alias("result"), nothing.alias("error"))
    told = final.unionByName(done.select("job_id", "status", "result", "error")).select("job_id", F.lit(1).alias("seq"), "status", "result", "error")
    return began.unionByName(told), finished.select("job_id", "status", "result", "error").unionByName(final), rejected


def deliver(messages: DataFrame, handle: Callable[[dict], str | None], key: str = "queue") -> DataFrame:
    """queue, seq, outcome, error of messages (queue, seq, body) that a handler is given in order, queue by queue: handled, or
    rejected where it raises; a rejected message is not delivered again, and the next ones still are."""
    from docquarry.operators.ordered import scan_documents

    def scan(rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            error = None
            try:
                handle(r)
            except Exception as e:  # any failure of a handler is the message's
                error = f"{type(e).__name__}: {e}"
            out.append({key: r[key], "seq": r["seq"], "outcome": "rejected" if error else "handled", "error": error})
        return out

    return scan_documents(messages, scan, f"{key} string, seq long, outcome string, error string", key=key)


def wait(read: Callable[[], DataFrame], job_id: str, seconds: float, pause: float = 0.2) -> str | None:
    """The final status of a job, read again and again from the table of last statuses (job_id, status) that read() gives,
    for so many seconds at most; None if it has none by then."""
    import time

    until = time.monotonic() + seconds
    while True:
        row = read().filter(F.col("job_id") == job_id).filter(F.col("status").isin("completed", "failed")).select("status").first()
        if row is not None or time.monotonic() >= until:
            return None if row is None else row.status
        time.sleep(min(pause, max(0.0, until - time.monotonic())))
