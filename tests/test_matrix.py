"""Validation of lines and tables, round trips, repairs and single decisions on the synthetic matrix."""

import json

import pytest

from matrixloom.operators.classify import TaskClassifier
from matrixloom.operators.route import GLOBAL, Metrics, Policy, Rule, decide
from matrixloom.operators.split import repairs
from matrixloom.operators.validate import validate
from matrixloom.schema import ValidationError
from matrixloom.sources import jsonl, sinks
from matrixloom.sources.demo import demo_observations

LINE = {"prompt_id": "p1", "prompt": "Add 2 and 3", "task": "sum", "model": "m", "quality": 0.5, "latency_ms": 3, "cost_usd": 0}


@pytest.fixture(scope="module")
def demo(spark):
    return demo_observations(spark, 6).cache()


def test_demo_is_complete(demo):
    assert demo.count() == 8 * 6 * 3
    validate(demo)


@pytest.mark.parametrize(
    ("line", "code"),
    [
        ("", "blank_line"),
        ('{"a":1,"a":2}', "json"),
        ("[1]", "json"),
        (json.dumps(LINE | {"quality": "x"}), "type"),
        (json.dumps(LINE | {"quality": True}), "type"),
        (json.dumps(LINE | {"odd": 1}), "unknown_field"),
        (json.dumps({k: v for k, v in LINE.items() if k != "model"}), "missing_field"),
        (json.dumps(LINE | {"trace_id": "t"}), "trace_pair"),
        (json.dumps(LINE | {"cost_usd": float("nan")}), "json"),
    ],
)
def test_bad_lines_are_named(spark, line, code):
    rows = jsonl.text_lines(spark, json.dumps(LINE) + "\n" + line + "\n")
    assert [(r.line_no, r.code) for r in jsonl.line_violations(rows).collect()] == [(2, code)]


@pytest.mark.parametrize("more", [{}, {"model": "n", "quality": 1.5}, {"prompt_id": "p2", "model": "n"}, {"model": "n", "prompt": "Another"}])
def test_bad_tables_are_refused(spark, more):
    with pytest.raises(ValidationError):
        jsonl.parse_jsonl(spark, json.dumps(LINE) + "\n" + json.dumps(LINE | more))


def test_round_trip(spark, demo, tmp_path):
    path = sinks.dump_jsonl(demo, str(tmp_path / "rows"))
    again = jsonl.load_jsonl(spark, path + "/*.txt")
    measures = ["prompt_id", "model", "quality", "latency_ms", "cost_usd", "load_ms", "trace_id", "sequence_index"]
    assert sorted(map(tuple, again.select(measures).collect())) == sorted(map(tuple, demo.select(measures).collect()))


def test_repairs_take_from_the_largest():
    moved = repairs({"train": ["a", "b", "c"], "dev": [], "test": []}, {"train": 3, "dev": 0, "test": 0}, {"train": 1, "dev": 1, "test": 1})
    assert moved == {"a": "dev", "b": "test"}


def test_decisions():
    metrics = {"big": Metrics(0.9, 100, 1, 50), "small": Metrics(0.89, 40, 0.1, 30)}
    p = Policy("big", "cost", 0.02, ("big", "small"), {"t": Rule("small", 0.89, 0.01, "cheapest")}, {"t": metrics, GLOBAL: metrics}, TaskClassifier({"t": 2}, {"t": {1: 2}}))
    assert decide(p, "t", 1.0, False, "", None)[0] == "small"
    assert decide(p, "t", 0.1, True, "weak", "small")[0] == "big"  # abstained
    assert decide(p, "t", 1.0, False, "", "big")[0] == "small"  # 60 ms gained for 30 ms of loading
    assert decide(p, "t", 1.0, False, "", "big", switch_cost=30)[:5] == ("big", "t", 1.0, False, True)
    assert decide(p, "t", 1.0, False, "", "elsewhere")[0] == "small"
    assert Policy.from_dict(p.to_dict()) == p
