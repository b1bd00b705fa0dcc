"""Systems under test and judges outside Spark, as functions over pandas frames for workflow.once and as judges for graders.

Each row is one call. Only public fields of a task are sent. Failures become statuses of
the row, never of the job, except for a judge whose tries are used up: then nothing was graded.
"""

import json
import os
import subprocess
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import bounded_batches

RESULT_COLUMNS = ["task_id", "status", "answer", "error"]
#: The wait before a repeated judge call, in milliseconds.
FIRST_WAIT_MS, LONGEST_WAIT_MS = 250, 2000

Call = Callable[[dict], tuple[str, str | None, str | None]]


def over_rows(call: Call) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(r["task_id"], *call(r)) for r in frame.to_dict("records")]
            yield pd.DataFrame(rows, columns=RESULT_COLUMNS)

    return run


def post(url: str, body: dict, headers: dict, timeout: float) -> tuple[int, str]:
    """(status code, text) of a JSON request; HTTP errors are answers too."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode()
    except urllib.error.HTTPError as error:
        return error.code, error.read().decode(errors="replace")


def with_key(headers: dict, key_variable: str | None) -> dict:
    """Headers with the key that an environment variable holds; keys never stand in a manifest."""
    if not key_variable:
        return headers
    if not os.environ.get(key_variable):
        raise ValueError(f"environment variable {key_variable} is not set")
    return {**headers, "authorization": f"Bearer {os.environ[key_variable]}"}


def http_system(url: str, headers: dict | None = None, key_variable: str | None = None) -> Callable:
    """A system behind an HTTP endpoint: timeout before all else, collection_failed once it has accepted, else provider_error."""

    def call(row: dict):
        accepted, limit = False, float(row.get("timeout_seconds") or 900)
        try:
            body = {k: row.get(k) for k in ("task_id", "prompt", "language", "as_of")} | {"timeout_seconds": limit}
            code, text = post(url, body, with_key(headers or {}, key_variable), limit)
            answer = json.loads(text)
            if not 200 <= code < 300:
                raise ValueError(f"HTTP {code}: {text[:500]}")
            accepted = True
            if not isinstance(answer.get("answer"), str):
                raise ValueError("the answer is no text")
            return "completed", answer["answer"], None
        except Exception as error:  # the boundary to a foreign system: whatever goes wrong is the row's result
            late = isinstance(error, TimeoutError) or isinstance(getattr(error, "reason", None), TimeoutError)
            return ("timeout" if late else "collection_failed" if accepted else "provider_error"), None, f"{'TIMEOUT' if late else 'HTTP_SUT_ERROR'}: {error}"

    return over_rows(call)


def read_events(output: str) -> tuple[int, dict | None]:
    """(number of confirmed submissions, last result) of a process's event lines."""
    confirmed, result = 0, None
    for line in output.splitlines():
        if line.strip():
            event = json.loads(line)
            confirmed += event.get("event") == "submission_confirmed"
            result = event if event.get("event") == "result" else result
    return confirmed, result


def process_system(command: Sequence[str]) -> Callable:
    """A system behind a process: the request in JSON on its input, event lines on its output, exactly one confirmed submission."""

    def call(row: dict):
        request = {"task_id": row["task_id"], "prompt": row.get("prompt"), "language": row.get("language"), "as_of": row.get("as_of")}
        try:
            done = subprocess.run(list(command), input=json.dumps(request), capture_output=True, text=True, timeout=float(row.get("timeout_seconds") or 900))
        except subprocess.TimeoutExpired as error:
            return "timeout", None, f"TIMEOUT: {error}"
        except OSError as error:
            return "provider_error", None, f"PROCESS_SPAWN_FAILED: {error}"
        try:
            confirmed, result = read_events(done.stdout)
            if confirmed > 1:
                raise ValueError("submission confirmed more than once")
        except (ValueError, AttributeError) as error:
            return "collection_failed", None, f"PROCESS_PROTOCOL_ERROR: {error}"
        if done.returncode:
            return "provider_error", None, f"PROCESS_EXIT_NONZERO: {done.stderr[:2000]}"
        if not confirmed:
            return "submission_unconfirmed", None, "SUBMISSION_UNCONFIRMED"
        if result is None or not isinstance(result.get("answer"), str):
            return "collection_failed", None, "PROCESS_RESULT_INVALID"
        return "completed", result["answer"], None

    return over_rows(call)


def ask_http(url: str, model: str, system: str, user: str, headers: dict, retries: int, timeout: float, temperature: float = 0.0) -> str:
    """Text of a chat completion. 429 and server errors are tried again after a growing wait; other refusals are not."""
    body = {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "temperature": temperature}
    for attempt in range(retries + 1):
        try:
            code, text = post(url, body, headers, timeout)
        except OSError as error:
            code, text = 503, str(error)
        if 200 <= code < 300:
            content = json.loads(text)["choices"][0]["message"]["content"]
            return content if isinstance(content, str) else "".join(x.get("text", "") for x in content)
        if code != 429 and code < 500 or attempt == retries:
            raise RuntimeError(f"judge HTTP {code}: {text[:500]}")
        time.sleep(min(LONGEST_WAIT_MS, FIRST_WAIT_MS * 2**attempt) / 1000)
    raise AssertionError("unreachable")


def judge(ask: Callable[[str, str], str], system: str, user_column: str) -> Callable[[DataFrame], DataFrame]:
    """A judge for graders: rows come back with judge_text. Its result should be written before it is used twice."""

    def grade(rows: DataFrame) -> DataFrame:
        bounded_batches(rows.sparkSession)
        names = rows.columns

        def run(frames):
            for frame in frames:
                yield frame[names].assign(judge_text=[ask(system, u) for u in frame[user_column]])

        return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("judge_text", T.StringType())]))

    return grade


def ask_process(command: Sequence[str], system: str, user: str, timeout: float) -> str:
    """What a judge process answers to {system, user} on its input."""
    done = subprocess.run(list(command), input=json.dumps({"system": system, "user": user}), capture_output=True, text=True, timeout=timeout)
    if done.returncode:
        raise RuntimeError(f"judge process failed: {done.stderr[:2000]}")
    return done.stdout
