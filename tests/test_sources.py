import gzip
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quillweave.operators import gate, masking
from quillweave.sources import readers, schemas, writers
from quillweave.streaming import rows as streams


@pytest.fixture
def published(spark, tmp_path):
    data = [(i, f"t{i}", ["a", "b"][i % 2], "test" if i < 4 else "train") for i in range(20)]
    df = spark.createDataFrame(data, "row_id bigint, text string, subset string, split string")
    return writers.publish(df, str(tmp_path / "pub"))


def test_read_subset_prunes_partitions(spark, published, plan_of):
    one = readers.read_subset(spark, published, "a", "test", "row_id bigint, text string")
    assert sorted(r["row_id"] for r in one.collect()) == [0, 2]
    assert "subset" in plan_of(one).split("PartitionFilters: [")[1].split("]")[0]
    both = readers.read_subset(spark, published, "a")
    assert both.groupBy("split").count().count() == 2 and both.count() == 10
    with pytest.raises(FileNotFoundError):
        readers.read_subset(spark, published, "missing")


def test_rebalanced_publish(spark, tmp_path):
    df = spark.range(0, 400, 1, 8).select(
        F.col("id").alias("row_id"), F.when(F.col("id") < 300, "hot").otherwise("b").alias("subset"), F.lit("train").alias("split")
    )
    root = writers.publish(df, str(tmp_path / "r"), rebalance=True)
    assert spark.read.parquet(root).count() == 400
    assert len(list((tmp_path / "r").rglob("*.parquet"))) < 8


def test_split_shards(spark, tmp_path):
    root = tmp_path / "repo"
    spark.range(3).coalesce(1).write.parquet(str(root / "data"))
    spark.range(3, 9).coalesce(1).write.parquet(str(root / "other"))
    for folder, name in (("data", "train-00000.parquet"), ("other", "test-00000.parquet")):
        (part,) = (root / folder).glob("part-*.parquet")
        part.rename(root / folder / name)
    assert readers.read_split_shards(spark, str(root), "train").count() == 3
    assert readers.read_split_shards(spark, str(root), "test", "id bigint").count() == 6
    for schema in (None, "id bigint"):
        with pytest.raises(FileNotFoundError):
            readers.read_split_shards(spark, str(root), "dev", schema)


def test_jsonl_tree_of_plain_files(spark, tmp_path):
    for subset, split, ids in (("a", "train", [1, 2]), ("a", "test", [3]), ("b.c", "train", [4]), ("d e+ü", "train", [5])):
        folder = tmp_path / subset
        folder.mkdir(exist_ok=True)
        (folder / f"{split}.jsonl").write_text("".join(json.dumps({"row_id": i, "q": "é", "a": None}) + "\n" for i in ids))
    rows = readers.read_jsonl_tree(spark, str(tmp_path), schemas.QA).collect()
    assert sorted((r["row_id"], r["q"], r["a"], r["subset"], r["split"]) for r in rows) == [
        (1, "é", None, "a", "train"), (2, "é", None, "a", "train"), (3, "é", None, "a", "test"), (4, "é", None, "b.c", "train"),
        (5, "é", None, "d e+ü", "train"),
    ]


def test_jsonl_tree_missing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_jsonl_tree(spark, str(tmp_path / "none"), schemas.QA)
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.read_jsonl_tree(spark, str(tmp_path / "empty"), schemas.QA)


def test_written_jsonl_is_raw_utf8_with_nulls(spark, tmp_path):
    df = spark.createDataFrame([("中é", None)], "query string, response string")
    path = writers.save_pairs(df, str(tmp_path), "lima")
    assert path.endswith("lima/train.jsonl")
    parts = (tmp_path / "lima" / "train.jsonl").glob("part-*")
    assert "".join(p.read_text(encoding="utf8") for p in parts) == '{"query":"中é","response":null}\n'
    back = readers.read_jsonl_tree(spark, str(tmp_path), "query string, response string").collect()
    assert [tuple(r) for r in back] == [("中é", None, "lima", "train")]
    with pytest.raises(ValueError):
        writers.save_pairs(df.withColumn("x", F.lit(1)), str(tmp_path), "other")


def test_tree_written_in_one_job_reads_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "q", "a", "s 1:+", "train"), (2, "q", None, "7", "test")], schemas.QA + ", subset string, split string")
    root = writers.write_jsonl_tree(df, str(tmp_path / "tree"))
    back = readers.read_jsonl_tree(spark, root, schemas.QA)
    assert sorted(map(tuple, back.collect())) == [(1, "q", "a", "s 1:+", "train"), (2, "q", None, "7", "test")]
    writers.write_jsonl(df.drop("subset", "split"), f"{root}/more/dev.jsonl")
    assert readers.read_jsonl_tree(spark, root, schemas.QA).count() == 4


def test_tolerant_reader(spark, tmp_path):
    lines = ['{"row_id": 1, "q": "x"}', "", "  null ", "{broken", '  {"row_id": 2, "q": "ü", "more": 1} ', "[1]x", '{"row_id": "no"}']
    path = tmp_path / "f.jsonl"
    path.write_text("\n".join(lines), encoding="utf8")
    good, bad = readers.read_jsonl_tolerant(spark, str(path), "row_id bigint, q string")
    assert sorted(map(tuple, good.collect())) == [(1, "x"), (2, "ü")]
    assert {r["line"] for r in bad.collect()} == {"{broken", "[1]x", '{"row_id": "no"}'}


def test_scratch_follows_the_cluster(spark, tmp_path):
    class Session:
        def __init__(self, folder, master="local[4]"):
            self.conf = {"spark.checkpoint.dir": folder} if folder else {}
            self.sparkContext = SimpleNamespace(master=master)

    assert writers.scratch_root(Session(f"{tmp_path}/")) == str(tmp_path)
    assert writers.scratch_root(Session(None)) != writers.scratch_root(Session(None))
    with pytest.raises(ValueError):
        writers.scratch_root(Session(None, "yarn"))


def test_check_columns(spark):
    gate.check_columns(spark.createDataFrame([("a", "b")], "response string, query string"), gate.PAIR_COLUMNS)
    with pytest.raises(ValueError):
        gate.check_columns(spark.range(1), gate.PAIR_COLUMNS)


def test_spread_leaves_enough_partitions_alone(spark):
    many, few = spark.range(0, 100, 1, 16), spark.range(0, 100, 1, 1)
    assert readers.spread(many) is many
    assert readers.spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_schemas_parse(spark):
    for text in schemas.SCHEMAS.values():
        assert spark.createDataFrame([], text).columns[0] == "row_id"


def test_masking_a_stream_equals_the_batch(spark, tmp_path):
    schema = "row_id bigint, article string"
    df = spark.createDataFrame([(i, f"text number {i} " * (i % 7 + 1)) for i in range(60)], schema)
    df.repartition(5).write.json(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), schema, files_per_batch=2)
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        job = streams.run_available(stream, masking.mask_cnn_daily_mail, out, str(tmp_path / "cp"))
        job.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == sorted(map(tuple, masking.mask_cnn_daily_mail(df).collect()))


def test_missing_shard_is_an_error(spark, tmp_path):
    root = str(tmp_path / "shards")
    writers.write_split_shards(spark.range(2), root, "train", 3)  # one shard has no rows
    writers.write_split_shards(spark.range(100), root, "test", 2)
    assert readers.read_split_shards(spark, root, "train", "id bigint").count() == 2
    assert sorted(p.name for p in tmp_path.glob("shards/*.parquet")) == [f"test-0000{i}-of-00002.parquet" for i in (0, 1)] + [f"train-0000{i}-of-00003.parquet" for i in (0, 1, 2)]
    index = spark.read.json(f"{root}/_shards/test").collect()
    assert sum(r["rows"] for r in index) == 100 and max(r["rows"] for r in index) <= 51
    (tmp_path / "shards" / "train-00001-of-00003.parquet").unlink()
    with pytest.raises(FileNotFoundError, match="2 of 3"):
        readers.read_split_shards(spark, root, "train", "id bigint")
    assert readers.read_split_shards(spark, root, "test", "id bigint").count() == 100


def test_failed_republish_leaves_the_old_rows(spark, tmp_path):
    root = str(tmp_path / "published")
    rows = spark.range(90).select("id", F.concat(F.lit("s"), F.col("id") % 3).alias("subset"), F.lit("train").alias("split"))
    writers.write_manifest(rows, writers.republish(rows, root))
    bad = rows.filter("subset = 's1'").withColumn("id", F.when(F.col("id") > 50, F.raise_error(F.lit("no"))).otherwise(F.col("id") + 1000).cast("bigint"))
    with pytest.raises(Exception):
        writers.republish(bad, root)
    read = lambda: spark.read.schema("id bigint, subset string, split string").parquet(root)
    assert sorted(map(tuple, read().collect())) == sorted(map(tuple, rows.collect()))
    assert writers.unlike_manifest(spark, root).isEmpty()
    writers.republish(rows.filter("subset = 's2' and id > 60"), root)
    assert [tuple(r) for r in writers.unlike_manifest(spark, root).collect()] == [("s2", "train", 30, 10)]
    assert read().filter("subset <> 's2'").count() == 60


def test_byte_order_mark_at_the_start_of_a_file(spark, tmp_path):
    mark = b"\xef\xbb\xbf"
    folder = tmp_path / "in put+ü%41"
    folder.mkdir()
    (folder / "a b.jsonl").write_bytes(mark + b'{"id": 1}\n' + mark + b'{"id": 2}\n{"id": 3}\nx\xff\n')
    (folder / "c.jsonl").write_bytes(b'{"id": 4}\n' + mark + b'{"id": 5}\n')
    (folder / "d.jsonl").write_bytes(mark)  # no line at all
    (folder / "e.jsonl").write_bytes(b"")
    (folder / "f.jsonl.gz").write_bytes(gzip.compress(mark + b'{"id": 6}\n{"id": 7}\n'))
    lines = [mark + b'{"id": %d}' % i + b" " * 90 for i in range(10, 20)]  # read in several parts
    (folder / "g.jsonl").write_bytes(b"\n".join([lines[0], *[x[3:] for x in lines[1:]]]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        got = spark.read.parquet(writers.sort_jsonl(spark, str(folder), "id int", str(tmp_path / "out"))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r["row"]["id"] for r in got if r["status"] == "row") == [3, 4, 7, *range(11, 20)]
    raw = sorted((r["file"], bytes(r["line"])) for r in got if r["status"] == "byte_order_mark")
    assert raw == sorted([
        ("a%20b.jsonl", mark + b'{"id": 1}'), ("a%20b.jsonl", mark + b'{"id": 2}'), ("c.jsonl", mark + b'{"id": 5}'),
        ("f.jsonl.gz", mark + b'{"id": 6}'), ("g.jsonl", lines[0]),
    ])
    assert [bytes(r["line"]) for r in got if r["status"] == "not_utf8"] == [b"x\xff"]


def test_shards_are_cut_by_bytes(spark, tmp_path):
    root = str(tmp_path / "shards")
    rows = spark.range(2000, numPartitions=3).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
    writers.write_split_shards(rows, root, "test", 2, shard_bytes=20_000)  # some 80 bytes a row
    index = [r.asDict() for r in spark.read.json(f"{root}/_shards/test").collect()]
    assert len(index) > 5 and {r["shards"] for r in index} == {len(index)} and sum(r["rows"] for r in index) == 2000
    assert max(r["rows"] for r in index) <= 2000 / len(index) + 20
    assert sorted(p.name for p in tmp_path.glob("shards/*.parquet")) == sorted(r["file"] for r in index)
    assert sorted(p.name for p in tmp_path.glob("shards/_staging*")) == []
    assert sorted(map(tuple, readers.read_split_shards(spark, root, "test").collect())) == sorted(map(tuple, rows.collect()))
