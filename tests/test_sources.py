import os
import random

import pytest
from pyspark.sql import functions as F

from mirepoix import sources


def text_of(folder):
    return "".join(
        open(os.path.join(folder, f), encoding="utf-8").read() for f in sorted(os.listdir(folder)) if f.startswith("part-")
    )


def test_delimited_path():
    assert sources.delimited_path("/d/", "recipes") == "/d/recipes.csv"
    assert sources.delimited_path("/d", "recipes.csv") == "/d/recipes.csv"


def test_delimited_round_trip_untyped_and_typed(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b", None), (2, "ñ", 2.5)], "id int, name string, x double")
    sources.write_delimited(df, str(tmp_path), "t")
    back = sources.read_delimited(spark, str(tmp_path), "t")
    assert [t for _, t in back.dtypes] == ["string"] * 3
    assert sorted(map(tuple, back.collect())) == [("1", "a|b", None), ("2", "ñ", "2.5")]
    typed = sources.read_delimited(spark, str(tmp_path), "t", schema=df.schema)
    assert sorted(map(tuple, typed.collect())) == [(1, "a|b", None), (2, "ñ", 2.5)]


def test_overwrite_does_not_append(spark, tmp_path):
    for n in (5, 3):
        sources.write_delimited(spark.range(n), str(tmp_path), "t")
    assert sources.read_delimited(spark, str(tmp_path), "t").count() == 3


def test_unquoted_read_keeps_quote_character(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id|name\n1|"two" words\n2|5" pan\n')
    back = sources.read_delimited(spark, str(tmp_path), "q", quoted=False)
    assert [r.name for r in back.orderBy("id").collect()] == ['"two" words', '5" pan']


def test_tab_sink_with_and_without_header(spark, tmp_path):
    df = spark.createDataFrame([(1, 2)], "ORIGIN int, DESTINATION int")
    path = sources.write_delimited(df, str(tmp_path), "a", sources.TAB, header=False, single_file=True)
    assert text_of(path) == "1\t2\n"
    path = sources.write_delimited(df, str(tmp_path), "b", sources.TAB, single_file=True)
    assert text_of(path) == "ORIGIN\tDESTINATION\n1\t2\n"


def test_report_has_fixed_decimals(spark, tmp_path):
    df = spark.createDataFrame([("propR", 0.5, 3, None)], "score string, mse double, tp int, x double")
    assert text_of(sources.write_report(df, str(tmp_path), "r")).splitlines()[1] == 'propR|0.500|3|'


def test_columnar_and_stage(spark, tmp_path):
    df = spark.range(10).withColumn("k", F.col("id") % 2)
    sources.write_columnar(df, str(tmp_path / "p"), ["k"])
    assert sources.read_columnar(spark, str(tmp_path / "p")).filter("k = 1").count() == 5
    staged = sources.stage(df, "numbers")
    assert staged.count() == 10
    folder = sources.shared_folder(spark)
    assert all(folder in f for f in staged.inputFiles())


def test_shared_folder_is_the_configured_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert sources.shared_folder(spark) == named.rstrip("/")
    assert sources.fresh_path(spark, "x") != sources.fresh_path(spark, "x")


def test_cast_except_turns_text_into_null(spark):
    df = spark.createDataFrame([("1", "2.5", "n/a"), ("x", "", "7")], "RECIPE_ID string, FAT string, IRON string")
    got = sources.cast_except(df, ["RECIPE_ID"], "double", key_type="int")
    assert dict(got.dtypes) == {"RECIPE_ID": "int", "FAT": "double", "IRON": "double"}
    assert set(map(tuple, got.collect())) == {(1, 2.5, None), (None, None, 7.0)}


def test_libsvm(spark, tmp_path):
    (tmp_path / "d.txt").write_text("1 1:0.5 3:2\n0 2:1\n")
    rows = sources.read_libsvm(spark, str(tmp_path / "d.txt"), 3).orderBy("label").collect()
    assert [list(r.features.toArray()) for r in rows] == [[0.0, 1.0, 0.0], [0.5, 0.0, 2.0]]


def test_libsvm_round_trip(spark, tmp_path):
    rows = [(1.0, [0.5, 0.0, -2.25]), (0.0, [0.0, 0.0, 0.0]), (7.0, None), (None, [None, 1e-7, 3.0])]
    df = spark.createDataFrame(rows, "label double, features array<double>")
    path = sources.write_libsvm(df, str(tmp_path / "x"))
    got = sorted((r.label, list(r.features.toArray())) for r in sources.read_libsvm(spark, path, 3).collect())
    assert got == [(0.0, [0.0, 0.0, 0.0]), (0.0, [0.0, 1e-7, 3.0]), (1.0, [0.5, 0.0, -2.25]), (7.0, [0.0, 0.0, 0.0])]


def test_values_as_they_stand(spark, tmp_path):
    rows = [(1, ' "two" words '), (2, "back\\slash \\\" here"), (3, "#hash 'single'")]
    df = spark.createDataFrame(rows, "id int, name string")
    options = {**sources.PIPE, **sources.AS_IS}
    sources.write_delimited(df, str(tmp_path), "t", options)
    back = sources.read_delimited(spark, str(tmp_path), "t", options, "id int, name string", quoted=False)
    assert sorted(map(tuple, back.collect())) == rows


def written(out, name):
    folder = os.path.join(out, f"source_file={name}")
    parts = sorted(os.listdir(folder), key=lambda p: int(p.partition("=")[2]))
    return b"".join(
        open(os.path.join(folder, p, f), "rb").read() for p in parts for f in sorted(os.listdir(os.path.join(folder, p))) if f.startswith("part-")
    ).decode("utf-8")


def test_transcode(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = {"a.txt": ["ñandú", "", "tres"], "b.txt": ["uno"], "c.txt": ["x", "", ""]}
    for name, content in lines.items():
        (tmp_path / "in" / name).write_bytes("\r\n".join(content + [""]).encode("utf-16"))
    got = sources.read_encoded_lines(spark, str(tmp_path / "in"))
    assert got.count() == 7
    out = sources.transcode(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    for name, content in lines.items():
        assert written(out, name) == "".join(x + "\r\n" for x in content)


@pytest.fixture
def small_ranges(spark):
    options = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "100"}
    before = {k: spark.conf.get(k) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\r\n", "\n", "\r", "mixed"])
def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_ranges, end):
    """Little- and big-endian files with and without a mark. Some characters hold the bytes of a line feed between
    them (U+0A15 before U+4E00 in one order, U+4E00 before U+0A15 in the other)."""
    rng = random.Random(end)
    lines = ["".join(rng.choices("abñ漢\u0a15\u4e00\u0a00\u0100 ", k=rng.randrange(30))) for _ in range(400)] + ["last"]
    ends = [rng.choice(["\r\n", "\n", "\r"]) if end == "mixed" else end for _ in lines]
    # CR and LF of two lines without text between them would be one line end
    lines = [line or "x" for line in lines] if end == "mixed" else lines
    text = "".join(x + e for x, e in zip(lines, ends, strict=True))
    (tmp_path / "in").mkdir()
    files = {"le.txt": b"\xff\xfe" + text.encode("utf-16-le"), "be.txt": b"\xfe\xff" + text.encode("utf-16-be"), "bare.txt": text.encode("utf-16-be")}
    files["open.txt"] = files["le.txt"] + "no end".encode("utf-16-le")
    files["none.txt"] = b""
    for name, content in files.items():
        (tmp_path / "in" / name).write_bytes(content)
    got = {}
    for r in sources.read_encoded_lines(spark, str(tmp_path / "in")).collect():
        got.setdefault(os.path.basename(r.path), {})[r.line_no] = r.line
    assert set(got) == set(files) - {"none.txt"}
    for name, found in got.items():
        want = lines + (["no end"] if name == "open.txt" else [])
        assert [found[i] for i in range(len(found))] == want, name
    ranges = spark.read.text(str(tmp_path / "in" / "le.txt")).select(F.spark_partition_id()).distinct().count()
    assert ranges > 3


def test_long_files_are_written_in_parts(spark, tmp_path, small_ranges):
    (tmp_path / "in").mkdir()
    lines = [f"línea {i}" for i in range(700)]
    (tmp_path / "in" / "a.txt").write_bytes(("\n".join(lines) + "\n").encode("utf-16"))
    (tmp_path / "in8").mkdir()
    (tmp_path / "in8" / "a.txt").write_bytes(("\r\n".join(lines)).encode("latin-1"))
    out = sources.transcode(spark, str(tmp_path / "in"), str(tmp_path / "out"), lines_per_file=200, line_end="\n")
    assert len(os.listdir(os.path.join(out, "source_file=a.txt"))) == 4
    assert written(out, "a.txt") == "\n".join(lines) + "\n"
    back = sources.read_encoded_lines(spark, str(tmp_path / "in8"), "ISO-8859-1")
    assert [r.line for r in back.orderBy("line_no").collect()] == lines
