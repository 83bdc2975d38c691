import pytest

from salience.sources import tables


def test_folder_with_different_headers(spark, tmp_path):
    (tmp_path / "chunk_1.csv").write_text("sampleID,label,a,b\ns1,0,1.5,2\ns2,1,,4\n")
    (tmp_path / "chunk_2.csv").write_text("sampleID,label,b,c\ns3,1,6,7\n")
    rows, names = tables.read_csv_folder(spark, str(tmp_path))
    order = [r.feature_name for r in names.orderBy("feature_id").collect()]
    assert order == ["a", "b", "c"]
    got = {r.sample_id: (r.output, list(r.features)) for r in rows.collect()}
    assert got == {
        "s1": (0, [1.5, 2.0, None]), "s2": (1, [None, 4.0, None]), "s3": (1, [None, 6.0, 7.0]),
    }


def test_wide_csv(spark, tmp_path):
    path = tmp_path / "one.csv"
    path.write_text("id,y,g1,g2\nx,1,0.5,-1e-3\n")
    rows, names = tables.read_wide_csv(spark, str(path))
    assert rows.collect() == [("x", 1, [0.5, -0.001])]
    assert names.count() == 2


def test_quoted_fields(spark, tmp_path):
    path = tmp_path / "quoted.csv"
    path.write_text('id,y,"g,1","say ""g2"""\n"x, ""1""",1,"0.5",\n,0,,"2"\n')
    rows, names = tables.read_wide_csv(spark, str(path))
    assert [(r.sample_id, r.output, r.features) for r in rows.collect()] == [
        ('x, "1"', 1, [0.5, None]), ("", 0, [None, 2.0])]
    assert [r.feature_name for r in names.orderBy("feature_id").collect()] == ["g,1", 'say "g2"']


def test_commas_in_ids_survive_writing(spark, tmp_path):
    rows = spark.createDataFrame([('a,"b"', 1, [1.0, 2.0])], "sample_id string, output int, features array<double>")
    path = str(tmp_path / "wide")
    tables.write_wide_csv(rows, ["g1", "g2"], path)
    back, _ = tables.read_csv_folder(spark, path)
    assert back.collect() == [('a,"b"', 1, [1.0, 2.0])]


def test_run_store_numbers_runs(spark, tmp_path):
    store = str(tmp_path / "runs")
    assert tables.next_run_id(spark, store, "m") == 1
    rows = [("m", 1, "accuracy", 0, 0.5), ("m", 1, "r2", 0, 0.25)]
    df = spark.createDataFrame(rows, "model string, run_id int, metric string, feature_id int, diff double")
    tables.append_runs(df, store)
    assert tables.next_run_id(spark, store, "m") == 2
    assert tables.next_run_id(spark, store, "other") == 1
    assert sorted(map(tuple, tables.read_runs(spark, store).collect())) == rows


def test_writers_claim_different_runs(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = str(tmp_path / "runs")
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda _: tables.claim_run(spark, store, "a/b"), range(16)))
    assert sorted(got) == list(range(1, 17))
    assert tables.claim_run(spark, store, "other") == 1
    rows = spark.createDataFrame(
        [("a/b", 40, "r2", 0, 0.25)], "model string, run_id int, metric string, feature_id int, diff double")
    tables.append_runs(rows, store)
    assert tables.claim_run(spark, store, "a/b") == 41
    assert [tuple(r) for r in tables.read_runs(spark, store).collect()] == [("a/b", 40, "r2", 0, 0.25)]


def test_counts_are_observed_while_writing(spark, tmp_path):
    rows = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(7)], "sample_id int, features array<double>")
    table, seen = tables.store_observed(rows, str(tmp_path / "a"))
    assert seen == {"n_rows": 7, "n_columns": 2} and table.count() == 7
    _, none = tables.store_observed(rows.limit(0), str(tmp_path / "b"))
    assert none == {"n_rows": 0, "n_columns": 0}


def test_records_go_on_over_lines_and_blocks(spark, tmp_path, monkeypatch):
    import csv
    import random

    rng = random.Random(3)
    rows = [[rng.choice(["x", "a\nb", 'q"\n\n"q', ",\n,"]) + str(i), str(i % 2), "0.5", ""] for i in range(3000)]
    for part in range(2):
        with open(tmp_path / f"{part}.csv", "w", newline="") as file:
            writer = csv.writer(file, lineterminator="\n")
            writer.writerow(["id", "y", "one\nline", "two"])
            writer.writerows(rows[part::2])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        table, names = tables.read_csv_folder(spark, str(tmp_path))
        got = {r.sample_id: (r.output, r.features) for r in table.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {r[0]: (int(r[1]), [0.5, None]) for r in rows}
    assert [r.feature_name for r in names.orderBy("feature_id").collect()] == ["one\nline", "two"]
    monkeypatch.setattr(tables, "RECORD_CHARACTERS", 40)
    (tmp_path / "open.csv").write_text('id,y,"one\n' + "never closed\n" * 9)
    with pytest.raises(Exception, match="a quote is not closed in .*open.csv"):
        tables.read_csv_folder(spark, str(tmp_path))
