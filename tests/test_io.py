import json

import pytest

from hushframe import cli
from hushframe.sources.files import load, write_csv, write_json
from hushframe.streaming.ingest import drop_named_pii, ingest


@pytest.fixture
def csv(tmp_path):
    p = tmp_path / "people.csv"
    p.write_text("region,email,amount\nN,a@b.co,5\nS,c@d.co,7\n")
    return str(p)


def test_load_by_extension(spark, tmp_path, csv):
    assert load(spark, csv).schema["amount"].dataType.simpleString() == "int"
    (tmp_path / "x.tsv").write_text("a\tb\n1\t2\n")
    assert load(spark, str(tmp_path / "x.tsv")).collect()[0]["b"] == 2
    for name, text in (("r", '[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]'), ("c", '{"a": [1, 2], "b": ["x", "y"]}'), ("i", '{"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": "y"}}')):
        (tmp_path / f"{name}.json").write_text(text)
        assert sorted((r["a"], r["b"]) for r in load(spark, str(tmp_path / f"{name}.json")).collect()) == [(1, "x"), (2, "y")]
    for name, text in (("lines", '{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n'), ("wide", '[\n {"a": 1, "b": "x"},\n {"a": 2,\n "b": "y"}\n]')):
        (tmp_path / f"{name}.json").write_text(text)
        assert sorted((r["a"], r["b"]) for r in load(spark, str(tmp_path / f"{name}.json")).collect()) == [(1, "x"), (2, "y")]
    load(spark, csv).write.parquet(str(tmp_path / "p.parquet"))
    assert load(spark, str(tmp_path / "p.parquet")).count() == 2
    with pytest.raises(FileNotFoundError):
        load(spark, str(tmp_path / "none.csv"))
    for bad in ("x.foo", "bad.parquet"):
        (tmp_path / bad).write_text("junk")
        with pytest.raises(ValueError):
            load(spark, str(tmp_path / bad))


def test_sinks(spark, tmp_path, csv):
    out = tmp_path / "one.csv"
    write_csv(load(spark, csv), str(out), single_file=True)
    assert out.read_text().splitlines()[0] == "region,email,amount" and len(out.read_text().splitlines()) == 3
    write_csv(load(spark, csv), str(tmp_path / "many"))
    write_json({"a": 1}, str(tmp_path / "a.json"))
    assert json.loads((tmp_path / "a.json").read_text()) == {"a": 1}


def test_cli_exit_codes(spark, capsys, tmp_path, csv):
    assert cli.main(["scan", csv]) == 0
    assert cli.main(["scan", csv, "--fail-on", "medium"]) == 2
    assert cli.main(["scan", "nothing.csv"]) == 1
    assert cli.main(["protect", csv, "--question", "amount by region", "--out", str(tmp_path / "safe.csv")]) == 0
    plan = '{"operation": "aggregate", "metrics": [{"column": "amount", "agg": "sum"}]}'
    assert cli.main(["ask", csv, "total amount", "--receipt-out", str(tmp_path / "r.json")], model=lambda p: plan) == 0
    assert cli.main(["ask", csv, "total amount", "--mode", "plan"], model=lambda p: "no") == 2
    assert cli.main(["advanced", "inspect-policy", "--profile", "banking"]) == 0
    assert cli.main(["advanced", "shadow", csv, "--rows", "3"]) == 0
    assert cli.main(["advanced", "leak-test", csv], model=lambda p: plan) == 0
    assert "a@b.co" not in capsys.readouterr().out and "email" not in (tmp_path / "safe.csv").read_text()


def test_streams_are_ingested_before_they_are_queried(spark, tmp_path, csv):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text("region,email,amount\nN,a@b.co,5\n")
    stream = drop_named_pii(spark.readStream.schema("region string, email string, amount int").option("header", True).csv(str(src)))
    for _ in range(2):
        ingest(stream, str(tmp_path / "t"), str(tmp_path / "c"))
    (src / "b.csv").write_text("region,email,amount\nS,c@d.co,7\n")
    ingest(stream, str(tmp_path / "t"), str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "t"))
    assert got.columns == ["region", "amount"] and got.count() == 2
