from pyspark.sql import functions as F

from strayfinder.sources.datasets import (
    read_arff,
    read_csv,
    read_manifest,
    read_performance,
    validate_labels,
)

HEAD = """% made for this test
@relation t
@attribute 'a b' numeric
@ATTRIBUTE c real
@attribute id numeric
@attribute outlier {'yes','no'}
@data
"""


def test_arff(spark, tmp_path):
    (tmp_path / "Plain_01.arff").write_text(HEAD + "1.5,2,1,'yes'\n-3,4e2,2,'no'\n")
    (tmp_path / "Hepatitis_01.arff").write_text(HEAD + "1.5, 2, yes, 1\n-3,4e2,no,2\n")
    found, attributes = read_arff(spark, str(tmp_path))
    rows = {(r.dataset_id, tuple(r.features), r.label) for r in found.collect()}
    want = {((1.5, 2.0), 1), ((-3.0, 400.0), 0)}
    assert rows == {(d, f, y) for d in ("Plain_01", "Hepatitis_01") for f, y in want}
    names = [r.name for r in attributes.where("dataset_id = 'Plain_01'").collect()]
    assert names == ["'a b'", "c", "id", "outlier"]
    validate_labels(found)


def test_labels_are_checked(spark):
    df = spark.createDataFrame([("a", 2)], "dataset_id string, label int")
    try:
        validate_labels(df)
    except ValueError:
        return
    raise AssertionError("label 2 passed")


def test_csv_and_manifest(spark, tmp_path):
    lead = "p1,p2,p3,p4,p5,p6"
    (tmp_path / "one.csv").write_text(f"{lead},x,y\n0,0,0,0,0,0,1,2\n0,0,0,0,0,0,3,4\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "two.csv").write_text(f"{lead},x\n0,0,0,0,0,0,5\n")
    (tmp_path / "three.csv").write_text(f"{lead},x\n0,0,0,0,0,0,9\n")
    got = read_csv(spark, str(tmp_path / "one.csv")).collect()
    assert sorted((r.dataset_id, tuple(r.features)) for r in got) == [
        ("one", (1.0, 2.0)), ("one", (3.0, 4.0)),
    ]
    (tmp_path / "manifest.txt").write_text("bench.id,location\nb1,one.csv\nb2,sub/two.csv\n")
    got = read_manifest(spark, str(tmp_path / "manifest.txt"), str(tmp_path)).collect()
    assert sorted((r.dataset_id, tuple(r.features)) for r in got) == [
        ("b1", (1.0, 2.0)), ("b1", (3.0, 4.0)), ("b2", (5.0,)),
    ]


def test_performance(spark, tmp_path):
    (tmp_path / "ap.csv").write_text(
        "data,a,b,c,M 1,M.2\nskip,,,,x,y\nskip,,,,x,y\nd1,,,,0.5,\nd2,,,,0.25,1\n"
    )
    got = read_performance(spark, str(tmp_path / "ap.csv"))
    rows = {(r.dataset_id, r.model): r.ap for r in got.collect()}
    assert rows == {
        ("d1", "M 1"): 0.5, ("d1", "M.2"): None, ("d2", "M 1"): 0.25, ("d2", "M.2"): 1.0,
    }
    assert got.where(F.col("ap").isNull()).count() == 1


def test_arff_rows_can_be_exploded(spark, tmp_path):
    import random

    from strayfinder.plans.profile import profile
    from strayfinder.sources.datasets import cells

    rng = random.Random(1)
    lines = [",".join(f"{rng.gauss(0, 1):.6f}" for _ in range(4)) + f",{k},{'yes' if k % 9 == 0 else 'no'}" for k in range(60)]
    (tmp_path / "a b.arff").write_text(HEAD + "\n".join(lines))
    found, _ = read_arff(spark, str(tmp_path))
    assert cells(found).count() == 240 and found.select("row_id").distinct().count() == 60
    meta = profile(found).collect()
    assert {r.dataset_id for r in meta} == {"a b"} and sorted(r.idx for r in meta) == list(range(200))


def test_bad_labels_raise_on_read(spark, tmp_path):
    (tmp_path / "x.arff").write_text(HEAD + "1,2,3,maybe\n")
    try:
        read_arff(spark, str(tmp_path))[0].collect()
    except Exception as error:
        assert "label must be 0 or 1: maybe" in str(error)
    else:
        raise AssertionError("label maybe passed")
    assert read_arff(spark, str(tmp_path), check_labels=False)[0].first().label is None


def test_csv_widths_headers_and_quotes(spark, tmp_path):
    lead = "p1,p2,p3,p4,p5,p6"
    (tmp_path / "a.csv").write_text(f'{lead},x,y\n"0,0",0,0,0,0,0,1,2\n0,0,0,0,0,0,?,?\n')
    (tmp_path / "b c.csv").write_text(f"{lead},x,y,z\n0,0,0,0,0,0,5,6,7\n")
    (tmp_path / "d+e.csv").write_text(f"{lead},x\r\n0,0,0,0,0,0,9\r\n")
    rows = read_csv(spark, [str(tmp_path / n) for n in ("a.csv", "b c.csv", "d+e.csv")]).collect()
    assert sorted(((r.dataset_id, tuple(r.features)) for r in rows), key=str) == [
        ("a", (1.0, 2.0)), ("a", (None, None)), ("b c", (5.0, 6.0, 7.0)), ("d+e", (9.0,)),
    ]
    assert len({r.row_id for r in rows}) == 4


def test_manifest_paths(spark, tmp_path):
    (tmp_path / "two x.csv").write_text("p1,p2,p3,p4,p5,p6,x\n0,0,0,0,0,0,5\n")
    (tmp_path / "m.txt").write_text("bench.id,location\nb1,two x.csv\n")
    got = read_manifest(spark, str(tmp_path / "m.txt"), str(tmp_path)).collect()
    assert [(r.dataset_id, r.features) for r in got] == [("b1", [5.0])]
