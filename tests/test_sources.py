import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F


from lineaudit.operators import corpus as C
from lineaudit.sources import corpora as K
from lineaudit.sources import records as R
from lineaudit.sources import sinks as W
from lineaudit.sources import blocks as TF
from lineaudit.sources.arrays import elements
from lineaudit.streaming import records as SR


def write(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_records_scan_and_last_wins(spark, tmp_path):
    p = write(tmp_path / "r.jsonl", [
        {"impl_id": "a", "status": "Status.fail", "per_line_energies": [1.0], "buggy_line_indices": []}, "",
        {"impl_id": "b", "status": "pass"}, {"impl_id": "a", "status": "pass", "whole_impl_energy": 2}])
    assert sorted(r["status"] for r in R.read_records(spark, p).collect()) == ["FAIL", "PASS", "PASS"]
    got = {r["impl_id"]: (r["status"], r["whole_impl_energy"]) for r in R.read_keyed_records(spark, p).collect()}
    assert got == {"a": ("PASS", 2.0), "b": ("PASS", None)}
    assert {r["key"]: r["n"] for r in R.key_census(spark, write(tmp_path / "k.jsonl", [{"x": 1}, {"x": 2, "y": 3}])).collect()} == {"x": 2, "y": 1}


def test_history_order(spark, tmp_path):
    p = write(tmp_path / "h.jsonl", [{"_step": 7, "train/step": 0}, {"_step": 1, "train/step": 3}, {"train/loss": 1.0}])
    assert [r["step"] for r in R.read_history(spark, p).collect()] == [0, 3, 7]


CODE = "use a;\nfn f(x: u64)\n    requires x > 0,\n{\n%s\n}"


def test_trajectories(spark, tmp_path):
    fenced = "```rust\n" + CODE % "bad" + "\n```"
    p = write(tmp_path / "t.jsonl", [
        {"status": "success", "verified_code": CODE % "good", "original_index": 4, "repetition": 1},
        {"status": "error", "original_item": json.dumps({"output": fenced}), "original_index": 4, "repetition": 2, "log": ""},
        {"status": "timeout", "original_item": json.dumps({"output": "no code", "input": fenced})},
        {"status": "error", "original_item": "{broken", "original_index": 9},
        {"status": "other", "verified_code": CODE % "x"}, {"status": "success", "verified_code": "fn f() {"}])
    got = {r["impl_id"]: r for r in K.read_trajectories(spark, p).collect()}
    assert set(got) == {"traj-4-rep1", "traj-4-rep2", "traj-NA-repNA"}
    assert got["traj-4-rep1"]["impl_text"] == "good\n}" and got["traj-4-rep2"]["status"] == "FAIL"
    assert got["traj-4-rep1"]["spec_text"] == "fn f(x: u64)\n    requires x > 0,\n{"


def pair(bad, good, err=True):
    tail = "\nThe error messages are:\n```\noops\n```" if err else ""
    return {"input": "Fix:\n```rust\n" + CODE % bad + "\n```" + tail, "output": CODE % good}


def test_repair_pairs_numbering_and_truncation(spark, tmp_path):
    rows = [pair("a\nb\nc", "a\nB\nc"), pair("a", "a"), {"input": "no code", "output": "x"}, pair("x\ny", "x\nz", False),
            pair("1\n2\n3\n4\n5", "q\nw\ne\nr\nt")]
    whole = tmp_path / "p.json"
    whole.write_text(json.dumps(rows))
    out = {r["impl_id"].split("-", 2)[2]: r for r in K.read_repair_pairs(spark, str(whole)).collect()}
    assert set(out) == {"broken-0", "fixed-0", "broken-1", "fixed-1"}
    assert out["broken-0"]["buggy_lines"] == [1] and out["broken-0"]["verifier_log"] == "oops"
    assert out["fixed-0"]["sibling_impl_id"] == out["broken-0"]["impl_id"] and out["broken-1"]["verifier_log"] is None
    cut = tmp_path / "cut.json"
    cut.write_text(json.dumps(rows)[:-40])
    assert len(list(elements(str(cut)))) == 4
    assert K.read_repair_pairs(spark, str(cut), tolerate_truncation=True).count() == 4
    scan = C.pair_scan(spark.createDataFrame([(r["input"], r["output"]) for r in rows], "input string, output string")).first()
    assert (scan["n_seen"], scan["n_with_code"], scan["n_with_error"], scan["n_candidates"]) == (5, 4, 3, 3)


def test_elements_across_chunks(tmp_path, monkeypatch):
    import lineaudit.sources.arrays as arr
    monkeypatch.setattr(arr, "_CHUNK", 3)
    p = tmp_path / "a.json"
    items = [{"a": "]},{["}, 12345, "x", {"b": [1, 2, {"c": None}]}]
    p.write_text(json.dumps(items, indent=1))
    assert list(elements(str(p))) == items


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_arrays_by_ranges_equal_the_sequential_reader(spark, tmp_path, monkeypatch, size):
    """Odd escapes, brackets in strings, wide characters, all ways to cut a file off, ranges down to one byte."""
    import lineaudit.sources.arrays as arr
    monkeypatch.setattr(arr, "_CHUNK", 16)
    items = [{"input": 'a]},{[ " \\', "output": 'x\\\\" ['}, {"input": "", "output": None}, {"input": "\\" * 9 + '"', "status": "é😀"}, {},
             {"input": "n" * 50, "more": [{"deep": ["]", {"k": "[,"}]}]}, {"output": "last, one"}]
    text = json.dumps(items)
    wide = json.dumps(items, indent=1, ensure_ascii=False)
    cuts = [text, wide, "[]", "[ ]\n", "[", text[:-1], text[:-2], wide[:-2], text[:60], text[:151]] + ([text[:i] for i in range(20, 60, 3)] if size == 7 else [])
    for i, t in enumerate(cuts):
        (tmp_path / f"c{i:03d}.json").write_text(t, encoding="utf-8")
    (tmp_path / "empty.json").write_text("")
    got = {}
    for r in arr.read_arrays(spark, str(tmp_path), "input string, output string, status string", size).orderBy("_path", "_pos").collect():
        got.setdefault(r["_path"].rsplit("/", 1)[1], []).append((r["input"], r["output"], r["status"]))
    for p in sorted(tmp_path.iterdir()):
        assert got.get(p.name, []) == [tuple(x.get(c) for c in ("input", "output", "status")) for x in elements(str(p))], p.read_text()


FILE = """
test_verify_one_file! {
    #[test] foo_fails verus_code! {
        spec fn s() {}
        fn foo() { if a { b } // FAILS
        }
    } => Err(err) => assert_one_fails(err)
}
test_verify_one_file! { #[test] foo verus_code! { fn foo() { } } => Ok(()) }
test_verify_one_file! { #[test] lone verus_code! { fn lone() { } } => Ok(()) }
test_verify_one_file! { #[test] cut verus_code! { fn cut() {
"""


def test_test_files(spark, tmp_path):
    (tmp_path / "x.rs").write_text(FILE)
    got = {r["test_name"]: r for r in TF.examples(TF.read_test_files(spark, str(tmp_path))).collect()}
    assert set(got) == {"foo_fails", "foo"}
    bad = got["foo_fails"]
    assert bad["buggy_lines"] == [0] and bad["status"] == "FAIL" and bad["impl_text"].lstrip().startswith("fn foo()")
    assert got["foo"]["spec_id"] == bad["spec_id"] and bad["impl_id"].endswith("-fail-foo_fails-0")


def test_tasks(spark):
    rows = [("Rust/0", "f", "fn f() {\n", "Doc\n\nmore", "  a\n  b\n", "  a\n  c\n", "bug", None), ("Rust/1", "g", "d", "", " ", "x", None, None)]
    df = spark.createDataFrame(rows, "task_id string, entry_point string, declaration string, docstring string, canonical_solution string, buggy_solution string, bug_type string, failure_symptoms string")
    out = {r["status"]: r for r in K.parse_tasks(df).collect()}
    assert out["FAIL"]["buggy_lines"] == [1] and out["PASS"]["buggy_lines"] == []
    assert out["PASS"]["spec_text"] == "// Doc\n//\n// more\nfn f() {"


def test_trajectory_diff_and_classes(spark):
    rows = [("s", 0, 0, "a\nb\nc"), ("s", 1, 1, "a\nx\nc"), ("t", 0, 2, "a"), ("u", 0, 3, "q"), ("u", 0, 4, "q")]
    df = spark.createDataFrame(rows, "spec string, repetition int, ord int, code string")
    got = {r["spec"]: (r["n_lines"], r["n_changed"]) for r in C.first_and_last(df).collect()}
    assert got == {"s": (3, 1), "u": (1, 0)}
    raw = spark.createDataFrame([("a", "success", 0, None), ("a", "error", 1, None), ("b", "error", None, None), ("b", "error", 1, None), ("c", "error", 1, None)],
                                "spec string, status string, return_code int, original_item string")
    out = {r["kind"]: (r["n"], r["n_differential"]) for r in C.trajectory_classes(raw).collect()}
    assert out == {"mixed": (1, 0), "all_fail": (2, 1)}


def test_sinks(spark, records, tmp_path):
    df = records(("s", "FAIL", 1.5, [1, 2], [1]))
    W.write_records(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    assert set(json.loads(text.splitlines()[0])) == set(W.RECORD_COLUMNS)
    nums = [0.0, 1.0, 123456.7, 1234567.0, 0.00001234, -2.5, 1e-4, 100000.0, 999999.6, float("nan"), 0.1 + 0.2]
    got = [r[0] for r in W.csv_table(spark.createDataFrame([(v,) for v in nums], "v double").coalesce(1)).collect()]
    assert got == ["%.6g" % v for v in nums]
    lines = spark.createDataFrame([("a/b", 0, "x", 1.0, True)], "impl_id string, line_idx int, line_text string, energy double, is_buggy boolean")
    impls = spark.createDataFrame([("a/b", "PASS")], "impl_id string, status string")
    made = W.write_payloads(W.impl_payloads(impls, lines), str(tmp_path / "files")).collect()
    assert [tuple(r) for r in made] == [("a/b", "a__b.json")]
    assert json.loads((tmp_path / "files" / "a__b.json").read_text())["lines"][0]["energy"] == 1.0


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src / "1.json", [{"impl_id": "a", "status": "fail", "per_line_energies": [1.0, 2.0], "buggy_line_indices": [1]}])
    rows = SR.read_stream(spark, str(src))
    q = SR.append_json(rows, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    write(src / "2.json", [{"impl_id": "b", "status": "pass"}])
    q = SR.append_json(SR.read_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(r["impl_id"] for r in R.read_records(spark, str(tmp_path / "out")).collect()) == ["a", "b"]
    assert SR.running_recall(R.read_records(spark, str(src)), (1,)).first()["recall"] == 1.0


EVENT = "id string, n bigint, at timestamp, extra array<double>"


def test_stream_of_last_records_survives_a_failed_batch(spark, tmp_path):
    """Late, repeated and null rows over several micro-batches; one batch fails after it has written, and is run again."""
    rng = random.Random(2)
    start = datetime.datetime(2024, 1, 1)
    rows = [(rng.choice(["a", "b", "c", "d"]), i, start + datetime.timedelta(minutes=i + rng.randrange(-20, 20)), [float(i)]) for i in range(60)]
    rows = rows[:20] + rows[5:10] + rows[30:45] + rows[20:30] + rows[45:] + [(None, 99, start, None), ("a", None, start, None), rows[50]]
    src, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    src.mkdir()
    batches = [rows[i:i + 16] for i in range(0, len(rows), 16)]

    def stream():
        raw = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(src))
        return SR.latest_updates(raw, "id", "n", "at", "2 hours")

    def add(i):
        (src / f"{i}.json").write_text("".join(json.dumps({"id": a, "n": n, "at": t.isoformat(), "extra": x}) + "\n" for a, n, t, x in batches[i]))
    for i in (0, 1):
        add(i)
    SR.upsert(stream(), out, marks).awaitTermination(120)
    add(2)

    def broken(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:012d}")
        raise RuntimeError("lost after writing")
    q = stream().writeStream.foreachBatch(broken).outputMode("update").option("checkpointLocation", marks).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost after writing"):
        q.awaitTermination(120)
    for i in range(3, len(batches)):
        add(i)
    SR.upsert(stream(), out, marks).awaitTermination(120)
    every = spark.createDataFrame(rows, EVENT).where("id is not null and n is not null")
    want = {tuple(map(str, r)) for r in R.last_per_key(every, "id", F.col("n")).select("id", "n", "at", "extra").collect()}
    got = SR.read_latest(spark, out, "id", "n").select("id", "n", "at", "extra")
    assert {tuple(map(str, r)) for r in got.collect()} == want
    written = spark.read.option("basePath", out).parquet(out)
    assert written.groupBy("id", "n").count().where("count > 1").count() == 0
    # Far behind the watermark: dropped, the state of silent keys is gone, and nothing that was written changes.
    (src / "late.json").write_text(json.dumps({"id": "new", "n": 7, "at": "2023-01-01T00:00:00", "extra": None}) + "\n")
    SR.upsert(stream(), out, marks).awaitTermination(120)
    assert {tuple(map(str, r)) for r in SR.read_latest(spark, out, "id", "n").select("id", "n", "at", "extra").collect()} == want


@pytest.mark.parametrize("kind, states", [("bigint", 1), ("double", 4)])
def test_keys_of_a_stream_share_states(spark, tmp_path, kind, states):
    """Integer keys lie in as many states as there are buckets; each key's order is still forgotten behind the watermark."""
    start = datetime.datetime(2024, 1, 1)
    batches = [
        [(1, 10, 0), (1, 9, 1), (2, 3, 0), (2, 3, 2), (3, 1, 0)],
        [(2, 2, 599), (2, 4, 600), (3, 7, 600), (3, 6, 601)],
        [(2, 5, 601), (3, 5, 602), (4, 9, 60)],
        [(1, 5, 601), (1, 6, 602), (3, 7, 603), (2, 99, 60), (4, 8, 603)]]
    # The watermark is 8 h after the second batch: the third forgets key 1, the fourth drops the row of 1 h.
    want = [[(1, 10, 0), (2, 3, 0), (3, 1, 0)], [(2, 4, 600), (3, 7, 600)], [(2, 5, 601), (4, 9, 60)], [(1, 6, 602)]]
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for i, rows in enumerate(batches):
        (src / f"{i}.json").write_text("".join(json.dumps(
            {"id": a, "n": n, "at": (start + datetime.timedelta(minutes=t)).isoformat()}) + "\n" for a, n, t in rows))
        os.utime(src / f"{i}.json", (1e9 + i, 1e9 + i))
    raw = spark.readStream.schema(f"id {kind}, n bigint, at timestamp").option("maxFilesPerTrigger", 1).json(str(src))
    q = SR.upsert(SR.latest_updates(raw, "id", "n", "at", "2 hours", buckets=1), out, str(tmp_path / "marks"))
    q.awaitTermination(120)
    got = [[] for _ in batches]
    for r in spark.read.option("basePath", out).parquet(out).collect():
        got[r["batch"]].append((r["id"], r["n"], int((r["at"] - start).total_seconds() // 60)))
    assert [sorted(b) for b in got] == want
    assert q.lastProgress.stateOperators[0].numRowsTotal == states


def test_corpus_size(spark, tmp_path):
    for repo, name, text in (("r1", "a.rs", "verus! {"), ("r1", "b.rs", "  x verus!"), ("r2", "c.rs", "a\n\tverus! é")):
        (tmp_path / repo).mkdir(exist_ok=True)
        (tmp_path / repo / name).write_text(text, encoding="utf-8")
    got = {r["repo"]: (r["n_files"], r["n_bytes"]) for r in K.corpus_size(K.read_source_files(spark, f"file:{tmp_path}")).collect()}
    assert got == {"r1": (1, 8), "r2": (1, len("a\n\tverus! é".encode()))}


def test_outcome_is_found_at_any_distance_but_not_in_the_next_block(spark):
    def block(name, gap, outcome):
        return f"test_verify_one_file! {{ #[test] {name} verus_code! {{ fn f() {{}} }} {gap}{outcome} }}\n"

    text = block("far", "// " + "x" * 5000 + "\n", "=> Err(e)") + block("none", "", "") + block("near", "", "=> Ok(())")
    got = TF.parse_blocks(spark.createDataFrame([("a.rs", text)], "source_file string, content string")).collect()
    assert {r["name"]: r["outcome"] for r in got} == {"far": "Err", "near": "Ok"}


def test_key_census_reads_all_rows_unless_told(spark, tmp_path):
    path = write(tmp_path / "k.jsonl", [{"x": 1}] * 150)
    assert [r["n"] for r in R.key_census(spark, path).collect()] == [150]
    assert [r["n"] for r in R.key_census(spark, path, 100).collect()] == [100]


def test_named_files_of_a_repeated_task_and_a_failed_job(spark, tmp_path):
    """A task that fails half-way and runs again leaves each file once; a job that fails leaves none."""
    from lineaudit.sources import named_files
    folder = tmp_path / "files"
    payloads = {f"f{i}.json": "".join(f"ä{i} " for _ in range(i)) for i in range(40)}

    rows = spark.createDataFrame([(k, v, 1) for k, v in payloads.items()], "file_name string, payload string, other int").repartition(3)
    named_files.register(spark)
    writer = named_files._Writer(str(folder), False)
    parts = [[r for i, r in enumerate(rows.collect()) if i % 3 == p] for p in range(3)]

    def broken(rows):
        yield from rows[:5]
        raise RuntimeError("a lost task")
    with pytest.raises(RuntimeError):
        writer.write(broken(parts[1]))
    first, again, other, third = writer.write(iter(parts[0])), writer.write(iter(parts[0])), writer.write(iter(parts[1])), writer.write(iter(parts[2]))
    assert first.attempt != again.attempt and sorted(p.name for p in folder.iterdir()) == ["_staging"]
    writer.commit([again, other, third])
    assert {p.name: p.read_text("utf-8") for p in folder.iterdir()} == payloads

    with pytest.raises(Exception, match="not a file name"):
        spark.createDataFrame([("a", "x"), ("../b", "y")], "file_name string, payload string").write.format("named_files").mode("append").save(str(folder))
    assert {p.name for p in folder.iterdir()} == set(payloads)
    spark.createDataFrame([("a", None)], "file_name string, payload string").write.format("named_files").mode("append").save(folder.as_uri())
    assert (folder / "a").read_bytes() == b"" and len(list(folder.iterdir())) == 41
    rows.write.format("named_files").mode("overwrite").save(str(folder))
    assert {p.name: p.read_text("utf-8") for p in folder.iterdir()} == payloads


def test_csv_numbers_round_by_binary_value(spark):
    import random

    from lineaudit.sources.sinks import csv_table

    rng = random.Random(1)
    values = [1.5, -18518.55, 18518.55, 8024705.0, 123456.5, 123457.5, 999999.5, 9999995.0, 0.0001234565, float("nan"), float("inf"), -float("inf")]
    for _ in range(400):
        values.append(float(f"{rng.randrange(10 ** 5, 10 ** 6) * 10 + 5}e{rng.randint(-22, 16)}") * rng.choice([1, -1]))
        values.append(rng.gauss(0, 1) * 10 ** rng.randint(-20, 20))
    rows = csv_table(spark.createDataFrame(list(enumerate(values)), "i int, v double")).collect()
    assert [(r["i"], r["v"]) for r in rows if r["v"] != f"{values[r['i']]:.6g}"] == []


def test_named_files_are_listed_and_read_some_at_a_time(spark, tmp_path, monkeypatch):
    """The driver lists no more names at once than a staging subfolder has; files are opened by name, each once."""
    from lineaudit.sources import named_files

    folder = tmp_path / "files"
    monkeypatch.setattr(named_files, "LISTED", 4)
    opened, seen = named_files.opened, []

    class Listed:
        def __init__(self, system):
            self.system = system

        def __getattr__(self, name):
            return getattr(self.system, name)

        def get_file_info(self, what):
            found = self.system.get_file_info(what)
            seen.append(len(found) if isinstance(found, list) else 1)
            return found

    def watched(uri):
        system, root = opened(uri)
        return Listed(system), root

    monkeypatch.setattr(named_files, "opened", watched)
    writer = named_files._Writer(str(folder), False)
    rows = [{"file_name": f"f{i}.json", "payload": f"{i}"} for i in range(30)] + [{"file_name": "f1.json", "payload": "last"}]
    writer.commit([writer.write(iter(rows[:21])), None, writer.write(iter(())), writer.write(iter(rows[21:]))])
    want = {r["file_name"]: r["payload"] for r in rows}
    assert {p.name: p.read_text() for p in folder.iterdir()} == want and max(seen) <= 4

    names = spark.createDataFrame([(n,) for n in want] * 2, "file_name string")
    back = named_files.read(names, str(folder))
    assert sorted((r["file_name"], r["content"].decode()) for r in back.collect()) == sorted(want.items())
    assert "FileScan" not in back._jdf.queryExecution().executedPlan().toString()


def test_payload_files_are_not_listed_by_the_driver(spark, tmp_path):
    """The query reads its files back without a table of all of them in the driver."""
    from lineaudit.catalog import surfaces

    root = tmp_path / "sf"
    spark.createDataFrame([(i, f"line {i}\nother {i}", "en", "s") for i in range(6)], "doc_id long, text string, lang string, source string") \
        .coalesce(1).write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int").coalesce(1).write.parquet(str(root / "labels.parquet"))
    out = surfaces.QUERIES["payload_files"](spark, str(root))
    assert not [f for f in out.inputFiles() if f.endswith(".json")]
    assert out.select("file_name").distinct().count() == out.count() > 0
