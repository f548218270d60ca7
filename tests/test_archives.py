import pytest

from temporalis.sources import archives


def test_archive_round_trip(spark, tmp_path):
    rows = [(5, "a b", "TRAIN", [[1.5, None, -2e-7], [0.1, 2.0, 3.0]]), (6, "c", "TEST", [[1e300, 0.0, -0.0], [4.0, 5.0]]), (7, "c", "TRAIN", [[1.0], [2.0]])]
    panel = spark.createDataFrame(rows, "series_id long, label string, split string, vars array<array<double>>")
    archives.write_archive(panel, str(tmp_path / "out"), "small")
    told = archives.header(spark, str(tmp_path / "out" / "*"))
    assert told["problemname"] == "small" and told["missing"] == "true" and told["univariate"] == "false" and told["classlabel"] == "true a b c"
    got = archives.read_archive(spark, str(tmp_path / "out" / "*")).collect()
    assert sorted((r.label, r.split, str(r.vars)) for r in got) == sorted((k, s, str(v)) for _, k, s, v in rows) and len({r.series_id for r in got}) == 3
    archives.write_archive(panel.where("false"), str(tmp_path / "none"), "none")
    assert archives.read_archive(spark, str(tmp_path / "none" / "*")).count() == 0
    with pytest.raises(ValueError):
        archives.write_archive(spark.createDataFrame([(1, "a:b", "TRAIN", [[1.0]])], panel.schema), str(tmp_path / "odd"), "odd")


def test_single_files_and_errors(spark, tmp_path):
    text = "# a comment\n@problemName p\n@timeStamps false\n@classLabel true x y\n@data\n1, 2,?:3,4,5:x\n\n6,7,8:9,10,11:y\n"
    (tmp_path / "p_TEST.ts").write_text(text)
    got = archives.read_archive(spark, str(tmp_path / "p_TEST.ts")).orderBy("series_id").collect()
    assert [(r.label, r.split, r.vars) for r in got] == [("x", "TEST", [[1.0, 2.0, None], [3.0, 4.0, 5.0]]), ("y", "TEST", [[6.0, 7.0, 8.0], [9.0, 10.0, 11.0]])]
    for old, new in (("@timeStamps false", "@timeStamps true"), ("@classLabel true x y", "@classLabel false")):
        (tmp_path / "bad.ts").write_text(text.replace(old, new))
        with pytest.raises(ValueError):
            archives.read_archive(spark, str(tmp_path / "bad.ts"))
    (tmp_path / "word.ts").write_text(text.replace("6,7", "six,7"))
    with pytest.raises(Exception, match="six"):
        archives.read_archive(spark, str(tmp_path / "word.ts")).collect()
