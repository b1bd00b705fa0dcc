"""A grader that runs as a process of its own: one for each task of Spark, asked in framed messages.

A frame is four bytes of length (big-endian) and as many of JSON. The first frame comes from the grader and names the commit it was built from; another
one than the required fails the job before any row is sent. A grader that crashes or doesn't answer in time costs the row that it was
asked about: that row has an error, and the next one meets a fresh process.
"""

import json
import queue
import struct
import subprocess
import threading
from collections import deque
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bounded_batches
from .records import RECORDS, with_faults

VERDICT = RECORDS["official_report_verdict"]
STDERR_LINES = 20


class WrongVersion(RuntimeError):
    """The grader is not the required one."""


class Lost(RuntimeError):
    """The grader has ended, or doesn't answer."""


class Grader:
    """A running grader; use as a context manager."""

    def __init__(self, command: Sequence[str], commit: str, timeout: float, start_timeout: float = 60):
        self.command, self.commit, self.timeout, self.start_timeout, self.process = list(command), commit, timeout, start_timeout, None

    def __enter__(self):
        self.start()
        return self

    def __exit__(self, *_):
        self.stop()

    def start(self) -> None:
        self.process = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE)
        self.frames, self.said = queue.Queue(), deque(maxlen=STDERR_LINES)
        for target in (self._read_frames, self._read_errors):
            threading.Thread(target=target, args=(self.process, self.frames, self.said), daemon=True).start()
        found = self._next(self.start_timeout).get("commit")
        if found != self.commit:
            self.stop()
            raise WrongVersion(f"the grader is of commit {found}, {self.commit} is required")

    def stop(self) -> None:
        if self.process:
            self.process.kill()
            self.process.wait()
            self.process = None

    @staticmethod
    def _read_frames(process, frames, _) -> None:
        while len(head := process.stdout.read(4)) == 4:
            size = struct.unpack(">I", head)[0]
            if len(body := process.stdout.read(size)) < size:
                break
            frames.put(body)
        frames.put(None)

    @staticmethod
    def _read_errors(process, _, said) -> None:
        for line in process.stderr:
            said.append(line.decode(errors="replace").rstrip())

    def _next(self, timeout: float) -> dict:
        try:
            body = self.frames.get(timeout=timeout)
        except queue.Empty:
            raise Lost(f"no answer within {timeout:g} s") from None
        if body is None:
            code = self.process.wait()
            raise Lost(f"the grader ended with {code}: {' '.join(self.said)[:2000]}")
        try:
            return json.loads(body)
        except ValueError:
            raise Lost("the grader's frame is not JSON") from None

    def ask(self, request: dict) -> dict:
        if self.process is None:
            self.start()
        try:
            body = json.dumps(request).encode()
            self.process.stdin.write(struct.pack(">I", len(body)) + body)
            self.process.stdin.flush()
            return self._next(self.timeout)
        except (Lost, OSError) as error:
            if isinstance(error, OSError):  # it ended before it was asked
                error = Lost(f"the grader ended with {self.process.wait()}: {' '.join(self.said)[:2000]}")
            self.stop()  # the next row gets a fresh one
            raise error from None


def official_judge(command: Sequence[str], commit: str, timeout: float = 1800, start_timeout: float = 60):
    """A judge over rows (task_id, prompt, final_answer): judge_text is the grader's verdict as JSON, null with an error in judge_error."""

    def judge(rows: DataFrame) -> DataFrame:
        bounded_batches(rows.sparkSession)

        def run(frames):
            with Grader(command, commit, timeout, start_timeout) as grader:
                for frame in frames:
                    texts, errors = [], []
                    for row in frame.to_dict("records"):
                        request = {"task_id": row["task_id"], "query": row["prompt"], "response": row["final_answer"], "required_upstream_commit": commit}
                        try:
                            texts.append(json.dumps(grader.ask(request), ensure_ascii=False))
                            errors.append(None)
                        except Lost as error:
                            texts.append(None)
                            errors.append(str(error))
                    yield frame.assign(judge_text=texts, judge_error=errors)

        schema = T.StructType([*rows.schema.fields, T.StructField("judge_text", T.StringType()), T.StructField("judge_error", T.StringType())])
        return rows.mapInPandas(run, schema)

    return judge


def official_scores(judged: DataFrame, commit: str, key: str = "task_id") -> DataFrame:
    """(key, metric_id, status, value, detail, error): two scores for each verdict. A fact ratio of null is not observable; what is no valid verdict, or of another commit, has failed."""
    checked = with_faults(judged, "judge_text", VERDICT)
    found = F.try_parse_json("judge_text")
    get = lambda name, kind: F.try_variant_get(found, f"$.{name}", kind)
    other = F.when(get("upstream_commit", "string") != commit, F.concat(F.lit("unexpected upstream commit: "), get("upstream_commit", "string")))
    error = F.coalesce("judge_error", F.when(F.size("faults") > 0, F.array_join("faults", "; ")), other)
    counts = F.to_json(F.struct(*[get(c, "long").alias(c) for c in ("right_count", "wrong_count", "unknown_count")]))
    both = F.array(
        F.struct(F.lit("official.quality_score").alias("metric_id"), get("quality_score", "double").alias("value"), F.to_json(get("quality_dimensions", "variant")).alias("detail")),
        F.struct(F.lit("official.fact_ratio").alias("metric_id"), get("fact_ratio", "double").alias("value"), counts.alias("detail")),
    )
    rows = checked.select(key, error.alias("error"), F.explode(both).alias("s")).select(key, "s.*", "error")
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("value").isNull(), "not_observable").otherwise("scored")
    keep = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    return rows.select(key, "metric_id", status.alias("status"), keep("value"), keep("detail"), "error")
