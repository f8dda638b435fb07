"""Readers and writers: round trips and refusals."""

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import files


def test_lines_are_counted_with_blank_ones(spark, tmp_path):
    (tmp_path / "a.txt").write_text("zero\n\ntwo\n" + "x" * 200 + "\nfour")
    (tmp_path / "b.txt").write_text("\n\nonly")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        got = {(r.file, r.line_no): r.text for r in files.read_lines(spark, f"{tmp_path}/*.txt").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {("a.txt", 0): "zero", ("a.txt", 2): "two", ("a.txt", 3): "x" * 200, ("a.txt", 4): "four", ("b.txt", 2): "only"}


def test_line_sink_and_listing(spark, tmp_path):
    df = spark.createDataFrame([("s", "a\nb"), ("s", None), ("t", " c ")], "source string, text string")
    files.write_lines(df, f"{tmp_path}/out")
    back = spark.read.text(f"{tmp_path}/out/source=s").collect()
    assert sorted(r.value for r in back) == ["", "a b"]
    assert files.shards(spark, f"{tmp_path}/out/*/*.txt").count() >= 2


def test_jsonl_drops_unknown_keys(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "é", "n": 1, "more": 2}\n\nno json\n{"id": "b"}\n')
    got = sorted((r.id, r.n) for r in files.read_jsonl(spark, f"{tmp_path}/x.jsonl", "id string, n int").collect())
    assert got == [("b", None), ("é", 1)]
    files.write_jsonl(spark.createDataFrame([("é", None)], "id string, n int"), f"{tmp_path}/out")
    assert '"id":"é"' in spark.read.text(f"{tmp_path}/out").first()[0]


def test_windows_round_trip(spark, tmp_path):
    rows = [("s", 0, w, "train" if w else "val", [w * 10 + k for k in range(8)]) for w in range(5)]
    df = spark.createDataFrame(rows, "source string, shard int, window_id long, split string, tokens array<int>")
    assert files.write_windows(df, str(tmp_path)) == 40
    got = files.read_windows(spark, f"{tmp_path}/train/*.bin", length=8).orderBy("window_id").collect()
    assert [w.tokens for w in got] == [r[4] for r in rows[1:]]
    with pytest.raises(Exception, match="outside"):
        files.write_windows(df.withColumn("tokens", F.array(F.lit(70_000))), str(tmp_path))


def test_examples_are_checked(spark):
    good = spark.createDataFrame([([1, 2], [0, 1], [1, 1])], "tokens array<int>, loss_mask array<int>, attn_mask array<int>")
    files.check_examples(good, 2, 3)
    with pytest.raises(ValueError):
        files.check_examples(good, 2, 2)


def test_artifacts_of_another_maker_are_refused(spark, tmp_path):
    files.save_artifact(spark.range(3), f"{tmp_path}/a", "grams-13")
    assert files.load_artifact(spark, f"{tmp_path}/a", "grams-13").count() == 3
    with pytest.raises(ValueError):
        files.load_artifact(spark, f"{tmp_path}/a", "grams-5")


def test_picked_lines(spark):
    lines = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], "file string, line_no long, text string")
    assert [r.text for r in files.pick_lines(lines, spark.createDataFrame([("a", 1), ("a", 1)], "file string, line_no long")).collect()] == ["y"]


def test_encode_round_trip(spark):
    pytest.importorskip("tokenizers")
    from corpusmill.functions import tokens

    path = "/opt/tokenizers/byte_bpe_50k.json"
    df = spark.createDataFrame([(1, "Héllo  wörld\n"), (2, None), (3, "")], "id int, text string")
    ids = tokens.encode(df, "id", "text", path)
    assert {r.id: r.text for r in tokens.decode(ids, "id", "ids", path).collect()} == {1: "Héllo  wörld\n", 2: "", 3: ""}


def test_truncation_and_examples(spark):
    tk = pytest.importorskip("tokenizers")
    from corpusmill.functions import tokens

    t = tk.Tokenizer.from_file(tokens.VOCABULARY)
    texts = ["One sentence here. " * 40 + "and no end", "short", "", None, "no end at all " * 60, "A. " + "endless " * 80]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").selectExpr("*", "1 AS k")
    got = {r.id: (r.text, r.n_tokens) for r in tokens.truncated(df, "id", "text", tokens.VOCABULARY, 50).collect()}
    assert got[0][0].endswith("here.") and got[0][1] == len(t.encode(got[0][0]).ids) <= 50
    assert got[1] == ("short", len(t.encode("short").ids)) and got[2] == ("", 0) and got[3] == (None, 0)
    assert 45 <= got[4][1] <= 50 and 45 <= got[5][1] <= 50  # an end that leaves less than half isn't cut at
    pairs = spark.createDataFrame([(1, "ask ", "answer"), (2, "long " * 60, "answer"), (3, None, None)], "id int, p string, c string")
    ex = {r.id: (r.ids, r.boundary) for r in tokens.examples(pairs, "id", "p", "c", tokens.VOCABULARY, 20).collect()}
    assert t.decode(ex[1][0]) == "ask answer" and ex[1][1] == len(t.encode("ask ").ids) and ex[2] == (None, None) and ex[3] == ([], 0)


def test_reports_and_example_tables(spark, tmp_path):
    files.write_report(spark.createDataFrame([("a", None)], "s string, n int"), f"{tmp_path}/r")
    assert [tuple(r) for r in files.read_jsonl(spark, f"{tmp_path}/r", "s string, n int").collect()] == [("a", None)]
    good = spark.createDataFrame([(1, [1, 2], [0, 1], [1, 1])], "id int, tokens array<int>, loss_mask array<int>, attn_mask array<int>")
    files.write_examples(good, f"{tmp_path}/e", 2, 3)
    assert files.read_examples(spark, f"{tmp_path}/e", 2, 3).count() == 1
    with pytest.raises(ValueError):
        files.read_examples(spark, f"{tmp_path}/e", 3, 3)


def test_shards_of_many_files(spark, tmp_path):
    rows = [("s", 0, w, "train", [w, w]) for w in range(7)]
    df = spark.createDataFrame(rows, "source string, shard int, window_id long, split string, tokens array<int>")
    files.write_windows(df, f"file:{tmp_path}", per_file=3)
    assert sorted(p.name for p in (tmp_path / "train").iterdir()) == ["s-0-000000.bin", "s-0-000001.bin", "s-0-000002.bin"]
    assert files.read_windows(spark, f"{tmp_path}/train/*.bin", length=2).count() == 7


def test_reading_ends_when_budgets_are_spent(spark, tmp_path):
    from corpusmill.streaming import metrics

    for k in range(4):
        spark.createDataFrame([("a", 10 * k + i, 40) for i in range(3)] + [("b", k, 400)], "s string, at int, n int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("s string, at int, n int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = metrics.read_until(s, "s", "at", "n", 50, str(tmp_path)).groupBy("s").agg(F.count("*").alias("c")).collect()
    assert {r.s: r.c for r in got} == {"a": 5, "b": 1}
    assert len([p for p in (tmp_path / "spent").iterdir() if p.is_dir()]) == 2  # the other files aren't read
