"""Readers and text rules on small files with known content."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeflow import Params
from nodeflow.functions import texts as X
from nodeflow.operators import provenance
from nodeflow.sources import texts as S
from nodeflow.sources import vectors as V

P = Params(dim=3)


def test_wide_csv_keeps_numbers_and_marks_gaps(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,z\n1,2,3\n4,oops,6\n7,8,9\n")
    (tmp_path / "b.csv").write_text("x,y,z\n0.5,0,-1\n")
    got = V.read_wide_csv(spark, str(tmp_path), P).orderBy("row_id").collect()
    assert [r.row_id for r in got] == [0, 1, 2, 3]
    assert [r.valid for r in got] == [True, False, True, True]
    assert got[3].embedding == [0.5, 0.0, -1.0]
    bare = tmp_path / "bare.txt"
    bare.write_text("1,2,3\n4,5,6\n")
    assert V.read_wide_csv(spark, str(bare), P, header=False).count() == 2


def test_wide_csv_of_another_width_is_invalid(spark, tmp_path):
    (tmp_path / "a.csv").write_text("u,v,w,x\n1,2,3,4\n1,2,3\n1,2\n1,2,3,\n")
    got = V.read_wide_csv(spark, str(tmp_path), P).orderBy("row_id").collect()
    assert [r.valid for r in got] == [False, True, False, False]


def test_numpy_files(spark, tmp_path):
    a = np.random.default_rng(0).normal(size=(9000, 3)).astype(np.float32)
    np.save(tmp_path / "a.npy", a)
    np.savez(tmp_path / "b.npz", other=a[:2], embeddings=a[:5])
    np.savez(tmp_path / "c.npz", first=a[:4])
    got = V.read_numpy(spark, str(tmp_path)).toPandas()
    by = {k.split("/")[-1]: v.sort_values("row_idx") for k, v in got.groupby("file")}
    assert {k: len(v) for k, v in by.items()} == {"a.npy": 9000, "b.npz": 5, "c.npz": 4}
    assert np.array_equal(np.stack(by["a.npy"].embedding.to_numpy()), a)


def test_one_matrix_is_read_by_many_tasks(spark, tmp_path):
    a = np.random.default_rng(1).normal(size=(1000, 6))
    kinds = {"c.npy": a, "f.npy": np.asfortranarray(a), "big.npy": a.astype(">f4"), "whole.npy": (a * 9).astype(np.int16), "none.npy": a[:0], "line.npy": a[0]}
    for name, m in kinds.items():
        np.save(tmp_path / name, m)
    np.savez(tmp_path / "stored.npz", x=a[:3], embeddings=a)
    np.savez_compressed(tmp_path / "packed.npz", embeddings=np.asfortranarray(a), y=a[:2])
    (tmp_path / "_SUCCESS").write_text("")
    for file, m in [*kinds.items(), ("stored.npz", a), ("packed.npz", a)]:
        step = 100 * 6 * m.itemsize
        got = V.read_numpy(spark, str(tmp_path / file), range_bytes=step)
        tasks = got.rdd.getNumPartitions()
        rows = got.toPandas().sort_values("row_idx")
        want = m.reshape(-1, 6).astype(np.float32)
        assert len(rows) == len(want) and rows.row_idx.tolist() == list(range(len(want)))
        assert not len(want) or np.array_equal(np.stack(rows.embedding.to_numpy()), want)
        assert tasks == {"packed.npz": 1, "line.npy": 1}.get(file, tasks) and (tasks == 10 or file in ("packed.npz", "line.npy", "none.npy")), (file, tasks)
    assert V.read_numpy(spark, f"file:{tmp_path}").count() == 6 * 1000 + 1
    with pytest.raises(Exception, match="dimensions"):
        np.save(tmp_path / "cube.npy", np.zeros((2, 2, 2)))
        V.read_numpy(spark, str(tmp_path / "cube.npy")).count()


def test_matrices_round_trip(spark, tmp_path):
    rows = [(f"n{k % 3}", k, [float(k), 0.5, -1.0]) for k in range(50)]
    df = spark.createDataFrame(rows, "name string, k long, embedding array<float>").repartition(4)
    V.write_numpy(df, str(tmp_path / "a"), rows_per_file=10, name="name", order="k")
    names = sorted(p.name for p in (tmp_path / "a").iterdir())
    assert names == sorted(f"n{k}{s}.npy" for k in range(3) for s in ("", "-1"))
    assert np.load(tmp_path / "a" / "n1-1.npy")[:, 0].tolist() == [float(k) for k in range(50) if k % 3 == 1][10:]
    V.write_numpy(df, str(tmp_path / "b"))
    assert V.read_numpy(spark, str(tmp_path / "b")).count() == 50
    V.write_numpy(df.limit(0), str(tmp_path / "c"))
    assert V.read_numpy(spark, str(tmp_path / "c")).count() == 0


def test_validation(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1.0],), ([1.0, None, 3.0],), (None,), ([1.0, float("nan"), 2.0],)],
                                 "embedding array<double>")
    good, bad = V.validated(rows, P)
    assert good.count() == 1 and bad.count() == 4
    with pytest.raises(Exception, match="wrong size"):
        V.validated(rows, P, strict=True)[0].collect()


def test_csv_texts(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text('id,abstract,text\n1,a,"two\nlines, ""quoted"""\n2,b,  \n3,c,plain\n4,only two\n5,x, last \n')
    got = {r.source_id: r.text for r in S.read_csv_texts(spark, str(f)).collect()}
    assert got["0"] == 'two\nlines, "quoted"' and "plain" in got.values() and "last" in got.values()
    assert all(t.strip() == t and t for t in got.values())
    assert X.csv_text_field(["q", "r"]) == "q" and X.csv_text_field(["body", "titles", "z"]) == "titles"


def test_json_lines_skip_what_is_no_object(spark, tmp_path):
    lines = ['{"id": 7, "text": " a "}', "not json", "[1]", '{"text": "b"}', '{"id": null, "_id": "k", "abstract": ["x", "", "y"]}',
             '{"id": 9, "abstract": "", "summary": null, "title": {"note": 1, "text": "deep"}}', '{"id": 10, "text": 5}']
    f = tmp_path / "r.jsonl"
    f.write_text("\n".join(lines) + "\n")
    got = {r.source_id: r.text for r in S.read_jsonl(spark, str(f)).collect()}
    assert got == {"7": "a", "3": "b", "k": "x y", "9": "deep"}


def test_json_documents(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"id": "l1", "text": "one"}, {"text": "two"}]))
    (tmp_path / "w.json").write_text(json.dumps({"data": [{"doc_id": 5, "content": "three"}], "n": 1}, indent=1))
    (tmp_path / "o.json").write_text(json.dumps({"id": "o1", "title": "four"}))
    (tmp_path / "m.json").write_text(json.dumps([{"text": "zero"}, {"text": "two again"}]))
    got = {(r.source_id, r.text) for r in S.read_json(spark, str(tmp_path)).collect()}
    assert got == {("l1", "one"), ("l.json:1", "two"), ("5", "three"), ("o1", "four"), ("m.json:0", "zero"), ("m.json:1", "two again")}


def test_csv_files_with_another_header_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title,text\nt1,one\n")
    assert S.read_csv_texts(spark, str(tmp_path)).count() == 1
    (tmp_path / "b.csv").write_text("text,title\ntwo,t2\n")
    with pytest.raises(Exception, match="(?i)header"):
        S.read_csv_texts(spark, str(tmp_path)).collect()


def test_folder(spark, tmp_path):
    (tmp_path / "x" / "y z").mkdir(parents=True)
    (tmp_path / "a.txt").write_text(" alpha\nbeta ")
    (tmp_path / "x" / "y z" / "b+c.txt").write_text("gamma")
    (tmp_path / "x" / "empty.txt").write_text(" \n")
    (tmp_path / "x" / "skip.md").write_text("no")
    got = {r.source_id: r.text for r in S.read_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "alpha\nbeta", "x/y z/b+c.txt": "gamma"}


def test_source_ids(spark):
    rows = spark.createDataFrame([("arxiv", 3, "s"), (None, 4, "s"), (None, 5, None)], "d string, i bigint, s string")
    got = [r[0] for r in rows.select(X.source_id(F.col("d"), F.col("i"), F.col("s"))).collect()]
    assert got == ["arxiv:3", "s:4", "5"]


@pytest.mark.parametrize("automaton_bytes", [0, 1_000_000])
def test_dataset_names(spark, automaton_bytes):
    # repeated names, a tie, null orders and names, a repeated session and a null id neither add rows nor change them
    datasets = spark.createDataFrame([("News", 0), ("News", 7), ("arxiv", 1), ("new", 2), ("nex", 2), ("42", None), (None, 0)],
                                     "dataset_name string, dataset_order int").where("dataset_name IS NULL OR dataset_name <> '42'")
    sessions = spark.createDataFrame([("s1", "arxiv"), ("s1", "arxiv"), ("news", "other")], "session_id string, dataset_name string")
    ids = ["arxiv:1", "s1:2", "my-NEWS-7", "renewal:9", "42", "news:5", "zz:arxiv:3"]
    rows = spark.createDataFrame([(i,) for i in [*ids, ids[0], None, None]], "source_id string")
    assert provenance.resolve_dataset(rows, datasets, sessions, automaton_bytes).count() == len(ids) + 3
    frame = spark.createDataFrame([(i,) for i in ids], "source_id string")
    got = {r.source_id: r.dataset for r in provenance.resolve_dataset(frame, datasets, sessions, automaton_bytes).collect()}
    assert got == {"arxiv:1": "arxiv", "s1:2": "arxiv", "my-NEWS-7": "News", "renewal:9": "new", "42": None,
                   "news:5": "other", "zz:arxiv:3": "arxiv"}


@pytest.mark.parametrize("automaton_bytes", [0, 1_000_000])
def test_ten_thousand_dataset_names(spark, automaton_bytes):
    rng = random.Random(5)
    word = lambda a, b: "".join(rng.choice("abAÉß\u4e2d") for _ in range(rng.randint(a, b)))
    names = sorted({word(5, 9) for _ in range(13_000)})[:10_000] + ["B\u4e2dB"]
    order = {n: rng.choice([None, *range(300)]) for n in names}
    ids = sorted({word(0, 40) for _ in range(300)})
    datasets = spark.createDataFrame(list(order.items()), "dataset_name string, dataset_order int")
    sessions = spark.createDataFrame([], "session_id string, dataset_name string")
    frame = spark.createDataFrame([(i,) for i in ids], "source_id string")
    got = {r.source_id: r.dataset for r in provenance.resolve_dataset(frame, datasets, sessions, automaton_bytes).collect()}
    ranked = sorted(names, key=lambda n: (order[n] is None, order[n] or 0, n.encode()))
    assert got == {i: next((n for n in ranked if n.lower() in i.lower()), None) for i in ids}
    assert sum(v is not None for v in got.values()) > 100


def test_the_only_dataset_takes_what_is_left(spark):
    datasets = spark.createDataFrame([("one", 0)], "dataset_name string, dataset_order int")
    sessions = spark.createDataFrame([], "session_id string, dataset_name string")
    frame = spark.createDataFrame([("42",), ("x:1",)], "source_id string")
    assert {r.dataset for r in provenance.resolve_dataset(frame, datasets, sessions).collect()} == {"one"}


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _csv_by_one_task(spark, path):
    """The reader that gives a file to one task."""
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "mode": "DROPMALFORMED"}
    rows = spark.read.options(**options).csv(path).select("text").collect()
    return {str(k): r.text.strip() for k, r in enumerate(rows) if (r.text or "").strip()}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_is_cut_at_the_same_places(spark, tmp_path, small_splits, end):
    r = random.Random(len(end))
    values = ['plain', '"two' + end + 'lines"', '"a ""quoted"" b"', '""', '', 'x"y', ' "z"', '"' + ('long, ' + end) * 60 + '"', '"é,日本"', '"tail"x', '"""', "5\\"]
    lines = ["id,text,rest"] + [",".join([str(k), r.choice(values[:-2]), r.choice(values[:6])][: r.choice([3, 3, 3, 3, 2])]) + r.choice(["", "", "", "," if k % 9 == 0 else ""]) for k in range(400)]
    lines.insert(7, "")
    f = tmp_path / "a.csv"
    f.write_text(end.join(lines) + end, newline="")
    got = {x.source_id: x.text for x in S.read_csv_texts(spark, str(f)).collect()}
    assert got == _csv_by_one_task(spark, str(f)) and len(got) > 200
    from nodeflow.sources import records
    assert records._scan(spark, str(f), "\n").rdd.getNumPartitions() > 50


@pytest.mark.parametrize("text", ["", "text\n", "text", "text\na", 'text\n"open\nfor ever\n', '\n\ntext\n\n"a"\n', 'text\n"' + "\n" * 500 + 'x"\nlast'])
def test_odd_csv_files(spark, tmp_path, small_splits, text):
    f = tmp_path / "a.csv"
    f.write_text(text)
    if text:
        assert {x.source_id: x.text for x in S.read_csv_texts(spark, str(f)).collect()} == _csv_by_one_task(spark, str(f))


def test_csv_of_several_files(spark, tmp_path, small_splits):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("a,text\n" + "".join(f'{i},"f{k}\n{i}"\n' for i in range(40)))
    got = {x.source_id: x.text for x in S.read_csv_texts(spark, str(tmp_path)).collect()}
    assert got == {str(40 * k + i): f"f{k}\n{i}" for k in range(3) for i in range(40)}
    (tmp_path / "z.csv").write_text("text,a\nx,y\n")
    with pytest.raises(Exception, match="another CSV header"):
        S.read_csv_texts(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("indent", [None, 2])
def test_json_lists_are_cut_at_the_same_places(spark, tmp_path, small_splits, indent):
    r = random.Random(indent)
    says = ["a", "br}ack{et", "[x], [y", 'quo"te', "back\\\\slash\\", "\\", "é日本", "comma, comma", "long " * 90, "\n\t"]
    listed = [r.choice([{"text": r.choice(says) + str(k)}, {"id": f"k{k}", "abstract": [r.choice(says), {"deep": [1, {"x": "}"}]}]}, "text", 7, None, ["a", {"text": "inner"}], {}, {"text": r.choice(says)}]) for k in range(300)]
    (tmp_path / "list.json").write_text(json.dumps(listed, indent=indent, ensure_ascii=bool(indent)), encoding="utf-8")
    (tmp_path / "wrapped.json").write_text(json.dumps({"meta": [1], "papers": listed[:20]}))
    (tmp_path / "one.json").write_text(json.dumps({"id": "single", "text": "one"}))
    (tmp_path / "empty.json").write_text(" [ ] ")
    (tmp_path / "blank.json").write_text("")
    whole = spark.read.text(str(tmp_path), wholetext=True).select(F.col("value").alias("document"), F.col("_metadata.file_name").alias("file"))
    want = S.extract_records(S.records_of(whole).withColumn("idx", F.concat_ws(":", "file", "idx")).drop("file")).collect()
    got = S.read_json(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 80
    from nodeflow.sources import records
    assert records._scan(spark, str(tmp_path / "list.json"), "}").rdd.getNumPartitions() > 50


def test_a_list_that_breaks_off_keeps_its_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "text": "x"}, {"id": "2", "text": "y"}, {"id": "3", "te')
    assert {x.source_id: x.text for x in S.read_json(spark, str(tmp_path)).collect()} == {"1": "x", "2": "y"}


def test_files_in_key_order_are_written_by_all_parts_of_a_shuffle(spark):
    from nodeflow.queries.sources import _spread

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _spread(spark.range(10_000).select((F.lit(9_999) - F.col("id")).alias("key")), "key")
    placed = rows.withColumn("part", F.spark_partition_id()).collect()
    sizes = [sum(r.part == p for r in placed) for p in range(parts)]
    assert parts > 4 and max(sizes) < 10_000 // 4
    assert [r.key for r in placed] == list(range(10_000))


def test_json_layouts_share_one_grouping(spark, sf, monkeypatch):
    """Texts are shuffled once for lists and wrapped lists together."""
    from pyspark.sql.classic.dataframe import DataFrame

    from nodeflow.queries import sources

    groupings = []
    grouped = DataFrame.groupBy
    monkeypatch.setattr(DataFrame, "groupBy", lambda self, *c: (groupings.append(self.columns), grouped(self, *c))[1])
    rows = sources.src_json_records(spark, sf).groupBy("layout").count().collect()
    assert len(rows) == 3 and len({r["count"] for r in rows}) == 1
    assert sum("text" in columns and "doc_id" in columns for columns in groupings) == 1
