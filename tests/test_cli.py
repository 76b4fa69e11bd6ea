"""Verbs of the command line, on small tables."""

import json

from casequarry import cli


def lines(capsys):
    return [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]


def test_verbs(spark, small, tmp_path, capsys):
    cli.main(["run", "q12_store_stats", small])
    assert lines(capsys)[0]["total_entries"] > 0
    cli.main(["batch", f"{small}/documents.parquet", "--column", "text", "--output", str(tmp_path / "out")])
    assert lines(capsys)[0]["total"] == spark.read.json(str(tmp_path / "out")).count()
    (tmp_path / "answer.txt").write_text("answer: yes\nreason: seen\nconfidence: high")
    cli.main(["ask", str(tmp_path / "answer.txt")])
    assert lines(capsys) == [{"answer": True, "reason": "seen", "confidence": "high"}]
    spark.createDataFrame([("d", 0, 0, 0, 5, 5)], "drawing string, number int, x int, y int, w int, h int").write.parquet(str(tmp_path / "boxes"))
    cli.main(["crop", str(tmp_path / "boxes")])
    assert lines(capsys)[0]["file_name"] == "d-01_Unknown.png"
    spark.createDataFrame([(1, ["A"], ["B"])], "seq int, predicted array<string>, truth array<string>").write.parquet(str(tmp_path / "records"))
    cli.main(["shadow", str(tmp_path / "log"), "--record", str(tmp_path / "records"), "--stats"])
    out = lines(capsys)
    assert out[0]["missing"] == ["B"] and out[1]["avg_missing_rate"] == 1.0 and out[2]["most_missing"] == "B（1次）"
