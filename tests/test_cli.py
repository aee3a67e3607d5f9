import json

import pytest

from tidewharf.__main__ import main


def test_sql_prints_header_and_rows(spark, capsys):
    main(["sql"], spark)
    assert capsys.readouterr().out.splitlines()[0] == "namespace"
    main(["sql", "-s", "SELECT id, id * 2 AS twice FROM range(3) ORDER BY id"], spark)
    assert capsys.readouterr().out.splitlines() == ["id\ttwice", "0\t0", "1\t2", "2\t4"]


def test_etl_runs_a_job_file(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr("tidewharf.__main__.clear_scratch", lambda spark: None)
    spark.range(10).write.parquet(f"{tmp_path}/in")
    job = {
        "source": {"cli_in": {"kind": "parquet", "path": f"{tmp_path}/in"}},
        "transform": {"t": {"source_table": "cli_in", "result_table": "cli_out",
                            "query": "SELECT sum(id) AS s FROM cli_in"}},
        "sink": {"f": {"kind": "file", "path": f"{tmp_path}/out", "options": {"fmt": "json"}}},
    }
    (tmp_path / "job.json").write_text(json.dumps(job))
    main(["etl", str(tmp_path / "job.json")], spark)
    assert capsys.readouterr().out == f"f\t{tmp_path}/out\n"
    assert spark.read.json(f"{tmp_path}/out").first().s == 45

    job["sink"]["f"]["kind"] = "ftp"
    (tmp_path / "job.json").write_text(json.dumps(job))
    with pytest.raises(ValueError, match="unknown kind"):
        main(["etl", str(tmp_path / "job.json")], spark)


def test_generate_then_benchmark(spark, db, tmp_path, capsys):
    main(["generate", "-d", db, "-s", "0.002", "-p", "3"], spark)
    main(["benchmark", "-d", db, "-i", "2", "-q", "cube_counts,star_brand_year",
          "-r", f"{tmp_path}/results"], spark)
    header, *lines = capsys.readouterr().out.splitlines()
    assert header.split("\t") == ["query", "runs", "failed_runs", "min_ms", "avg_ms", "max_ms", "p50_ms"]
    assert [line.split("\t")[:2] for line in lines] == [["cube_counts", "2"], ["star_brand_year", "2"]]
    kept = spark.read.json(f"{tmp_path}/results")
    assert {(r.query, r.row_count) for r in kept.collect()} == {
        ("cube_counts", 24), ("star_brand_year", 10)
    }
