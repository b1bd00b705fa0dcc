"""Line numbers and ordinals over files that are read in many splits."""

import json

import pytest

from verdigris.sources import positions, readers
from verdigris.storage import setting

CUT = {"spark__sql__files__maxPartitionBytes": "64", "spark__sql__files__openCostInBytes": "1"}


def found(spark, path):
    lines = positions.numbered_lines(spark, str(path))
    assert lines.rdd.getNumPartitions() >= 1
    return sorted((r.ordinal, r.file.rsplit("/", 1)[1], r.line_no, r.line) for r in lines.collect())


def expected(files):
    out, ordinal = [], 0
    for name, text in sorted(files.items()):
        for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if line.strip(" "):
                out.append((ordinal, name, i + 1, line))
                ordinal += 1
    return out


def test_numbers_over_splits(spark, tmp_path):
    files = {"a.txt": "".join(f"line {i} of the first file\n" + "\n" * (i % 3) for i in range(60)), "b.txt": "\n\n  \nonly one\n", "c.txt": "", "d.txt": "\r\n".join(f"{'x' * (i % 150)}{i}" for i in range(40)), "e.txt": "y" * 500}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    assert found(spark, tmp_path) == expected(files)
    with setting(spark, **CUT):
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        assert found(spark, tmp_path) == expected(files)


def test_small_splits_share_tasks(spark, tmp_path):
    files = {f"{i:03d}.txt": "".join(f"line {j} of file {i}\n" + "\n" * (j % 2) for j in range(9)) for i in range(120)}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    context, group = spark.sparkContext, f"small-splits-{tmp_path.name}"
    with setting(spark, **CUT):
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 300
        context.setJobGroup(group, group)
        try:
            rows = positions.numbered_lines(spark, str(tmp_path)).collect()
        finally:
            context._jsc.clearJobGroup()
    assert sorted((r.ordinal, r.file.rsplit("/", 1)[1], r.line_no, r.line) for r in rows) == expected(files)
    status = context.statusTracker()
    stages = {k for job in status.getJobIdsForGroup(group) for k in status.getJobInfo(job).stageIds}
    sizes = [info.numTasks for k in stages if (info := status.getStageInfo(k))]
    assert sizes and max(sizes) <= max(120, 2 * context.defaultParallelism)  # a listing of files has a task for each


def test_sizes_of_settings():
    assert [positions._bytes(x) for x in ("64", "1k", "2KB", "128MB", "134217728b", " 3g ")] == [64, 1024, 2048, 128 << 20, 128 << 20, 3 << 30]


def task(i, **more):
    base = {"task_id": f"t{i}", "benchmark_id": "b", "split": "s", "input": {"prompt": "p"}, "constraints": {"timeout_seconds": 9}}
    return json.dumps({**base, **more})


def test_errors_name_file_and_line(spark, tmp_path):
    good = [task(i) for i in range(30)]
    cases = {"broken": [*good, "", "{not json", *good], "invalid": [*good, "", task(99, input={"prompt": ""}), "{not json"]}
    for name, lines in cases.items():
        path = tmp_path / f"{name}.jsonl"
        path.write_text("\n".join(lines))
        with setting(spark, **CUT), pytest.raises(ValueError, match=rf"{name}\.jsonl:32: {'not a task' if name == 'broken' else 'task t99: input.prompt is empty'}"):
            readers.tasks(spark, str(path), "s")
    (tmp_path / "good.jsonl").write_text("\n".join(good))
    with setting(spark, **CUT):
        assert readers.tasks(spark, str(tmp_path / "good.jsonl"), "s").count() == 30


def pair(spark, tmp_path, left, right):
    (tmp_path / "l.jsonl").write_text("\n".join(left))
    (tmp_path / "r.jsonl").write_text("\n\n".join(right))
    return readers.json_lines(spark, str(tmp_path / "l.jsonl"), "id string, x int")[0], readers.json_lines(spark, str(tmp_path / "r.jsonl"), "key string, y int")[0].withColumnRenamed("key", "id")


def test_order_mismatches_and_zip(spark, tmp_path):
    left, right = [json.dumps({"id": f"q{i}", "x": i}) for i in range(50)], [json.dumps({"key": f"q{i}", "y": i * i}) for i in range(50)]
    with setting(spark, **CUT):
        a, b = pair(spark, tmp_path, left, right)
        assert positions.ordered_parity(a, b, "id").count() == 0
        assert sorted((r.left.x, r.right.y) for r in positions.zipped(a, b, "id", "id").collect()) == [(i, i * i) for i in range(50)]
        right[3], right[4] = right[4], right[3]
        a, b = pair(spark, tmp_path, left, right[:-1])
        wrong = {r.ordinal: (r.left_key, r.right_key, r.problem, (r.left_at or "").rsplit("/", 1)[-1], (r.right_at or "").rsplit("/", 1)[-1]) for r in positions.ordered_parity(a, b, "id").collect()}
        assert wrong == {3: ("q3", "q4", "order_mismatch", "l.jsonl:4", "r.jsonl:7"), 4: ("q4", "q3", "order_mismatch", "l.jsonl:5", "r.jsonl:9"), 49: ("q49", None, "missing_right", "l.jsonl:50", "")}
        with pytest.raises(Exception, match=r"rows don't belong together: .*l\.jsonl:(4|5|50) and (.*r\.jsonl:(7|9)|nothing)"):
            positions.zipped(a, b, "id", "id").collect()
        empty, _ = readers.json_lines(spark, str(tmp_path / "l.jsonl"), "id string, x int")
        assert positions.ordered_parity(empty.limit(0), empty.limit(0), "id").count() == 0
