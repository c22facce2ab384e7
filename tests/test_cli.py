"""Commands end to end on small files."""

import json

import pytest

from matrixloom.__main__ import main
from matrixloom.sources.sinks import dump_json
from tests.test_policy import matrix, policy


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    from matrixloom.sources.sinks import jsonl_rows

    path = tmp_path_factory.mktemp("cli") / "rows.jsonl"
    path.write_text("\n".join(r.value for r in jsonl_rows(matrix(spark, 60, 3)).collect()) + "\n")
    return path


def test_validate_and_errors(spark, rows, tmp_path, capsys):
    assert main(["validate", str(rows)], spark) == 0 and "trace_complete=True" in capsys.readouterr().out
    (tmp_path / "bad.jsonl").write_text("{}\n")
    assert main(["validate", str(tmp_path / "bad.jsonl")], spark) == 2 and "missing_field" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        main(["audit"], spark)


def test_compile_route_and_export(spark, rows, tmp_path, capsys):
    out = tmp_path / "policy.json"
    assert main(["compile", str(rows), str(out), "--objective", "cost"], spark) == 0
    capsys.readouterr()
    assert main(["route", str(out), "please add numbers", "--task", "sum"], spark) == 0
    assert json.loads(capsys.readouterr().out)["model"] == "thrifty"
    assert main(["export", str(out), str(tmp_path / "chat.json"), "--format", "chat"], spark) == 0
    assert json.loads((tmp_path / "chat.json").read_text())[0]["primary_model"] == "best"
    assert main(["export", str(out), str(tmp_path / "policy.txt")], spark) == 0 and "feature_counts" not in (tmp_path / "policy.txt").read_text()
    assert main(["export", str(tmp_path / "absent.json"), str(tmp_path / "x")], spark) == 2


def test_audit_and_gate(spark, rows, tmp_path, capsys):
    out = tmp_path / "audit"
    assert main(["audit", str(rows), str(out)], spark) == 0 and "Held-out loss" in capsys.readouterr().out
    assert {p.name for p in out.iterdir()} == {"report.html", "summary.json", "policy.json", "policy.txt"}
    assert "add the numbers" not in "".join(p.read_text() for p in out.iterdir())
    assert main(["ci", str(rows), str(out / "summary.json"), "--output", str(tmp_path / "now.json")], spark) in (0, 1)
    before = json.loads((out / "summary.json").read_text())
    dump_json(before | {"seed": 7}, tmp_path / "other.json")
    assert main(["ci", str(rows), str(tmp_path / "other.json")], spark) == 2 and "seed" in capsys.readouterr().err


def test_matrix_of_trials(spark, tmp_path):
    suite = [{"id": f"q{i}", "task": "k", "prompt": "p", "expected": "1", "grader": "exact_number"} for i in range(3)]
    (tmp_path / "suite.jsonl").write_text("\n".join(map(json.dumps, suite)))
    (tmp_path / "trials.jsonl").write_text("\n".join(json.dumps({"task_id": f"q{i}", "model": m, "quality": 1.0, "generation_ms": 5.0}) for i in range(3) for m in "mn"))
    assert main(["matrix", str(tmp_path / "trials.jsonl"), str(tmp_path / "suite.jsonl"), str(tmp_path / "out")], spark) == 0
    assert spark.read.json(str(tmp_path / "out")).count() == 6


def test_policy_fixture_is_sound():
    assert policy().metrics_for("none", "best").quality == 0.95
