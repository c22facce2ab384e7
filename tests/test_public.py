"""What leaves the engine: reports, policies as text, chat routes; and what must not."""

import json
import math

import pytest

from matrixloom.operators.classify import TaskClassifier
from matrixloom.operators.trials import duration_text, estimated_seconds
from matrixloom.plans import report

WORD, IDENT, KEY = "zyzzyvaword", "ident-4711", "sk-canary-0815"


def document():
    return {
        "objective": "cost", "prompt": f"{WORD} text", "train_prompt_ids": [IDENT], "api_key": KEY, "policy": {"classifier": TaskClassifier({"t": 2}, {"t": {3: 1}}).to_dict(), "routes": {"<b>": {"model": "<script>", "reason": "&"}}},
        "nested": {"responses": [WORD], "messages": [{"content": WORD}], "model_response": WORD, "Chat-Messages": [WORD], "per_prompt_metrics": {IDENT: 1}, "query": WORD, "instruction": WORD, "n_prompts": 7, "held_prompts": [WORD], "auth": {"access_token": KEY, "Authorization": KEY, "session_cookie": KEY, "Client-Secret": KEY}, "public_metric": 0.9},
        "baselines": [{"name": "compiled", "quality": 0.9, "quality_loss": 0.01, "latency_ms": 12.0, "coverage": 1.0}], "held_out_constraint": {"observed_quality_loss": None, "satisfied": True},
    }


def test_nothing_private_is_published(tmp_path):
    page, doc = report.write_report(document(), tmp_path / "out")
    text = page.read_text()
    assert not any(x in doc.read_text() for x in (WORD, IDENT, KEY, "feature_counts"))
    out = report.summary(document())
    for artifact in (text, json.dumps(out)):
        assert not any(x in artifact for x in (WORD, IDENT, KEY, "feature_counts"))
    assert out["nested"] == {"n_prompts": 7, "auth": {}, "public_metric": 0.9}
    assert "<script>" not in text and "&lt;script&gt;" in text and "&lt;b&gt;" in text


def test_page_escapes_everything_and_has_its_blocks():
    doc = report.summary({"objective": "<cost & more>", "models": ["a", "b"], "synthetic": True, "split": {"prompt_counts": {"train": 6, "test": 2}}, "baselines": [{"name": "<compiled>", "latency_ms": 12.5}], "policy": {"fallback_model": "<m>", "pool": ["<m>"], "routes": {"<t>": {"model": "m", "reason": "<img src=x onerror=\"y\">"}}}, "display": "<script>bad()</script>"})
    page = report.page(doc, "<A & B>")
    assert page.startswith("<!doctype html>") and "<script" not in page and "<img" not in page
    for shown in ("&lt;A &amp; B&gt;", "&lt;cost &amp; more&gt;", "&lt;compiled&gt;", "&lt;t&gt;", "&lt;script&gt;bad()", "train 6, test 2", "Models compared</dt><dd>2<", "12.5", "SYNTHETIC"):
        assert shown in page, shown
    assert "as was asked for" not in page and "as was asked for" in report.page(report.summary({"prompt": "x"}, True))
    source = {"a": {"prompt": "x"}}
    report.summary(source)
    assert source == {"a": {"prompt": "x"}}


def test_numbers_on_the_page():
    page = report.page({"max_quality_loss": 0.02, "held_out_constraint": {"observed_quality_loss": math.nan, "satisfied": True}})
    assert "0.02" in page and "n/a" in page and "yes" in page


def test_prompts_go_out_only_when_asked_for():
    out = json.dumps(report.summary(document(), include_prompts=True))
    assert WORD in out and IDENT in out and KEY not in out and "feature_counts" not in out


def test_private_columns():
    assert report.private_columns(["prompt", "Prompt-ID", "task", "quality", "db_password", "token_counts", "n_prompts"]) == ["prompt", "Prompt-ID", "db_password", "token_counts", "n_prompts"]


@pytest.mark.parametrize("doc,said", [({"a": 1}, "PROVENANCE"), ({"synthetic": True}, "SYNTHETIC"), ({"notes": ["an Illustrative case"]}, "SYNTHETIC"), ({"name": "oracle"}, "ORACLE"), ({"x": "non-evidence"}, "NOT EVIDENCE")])
def test_labels(doc, said):
    assert any(said in x for x in report.labels(doc))


def test_console_lines():
    got = report.console(document() | {"max_quality_loss": 0.02, "recommended_pool": ["a", "b"]}, "/out").splitlines()
    assert got[0].split() == ["Objective", "cost"] and any(x.startswith("Pool") and x.endswith("a, b") for x in got) and any("100.0%" in x for x in got) and got[-1].endswith("/out")


def test_policy_text_is_for_reading():
    out = report.policy_text({"fallback_model": "m", "pool": ["m", "n"], "prompt": WORD, "auth_token": KEY, "train_prompt_ids": [IDENT], "classifier": {"feature_counts": {"1": 2}, "min_margin": 0.1}, "empty": []})
    assert "fallback_model" in out and "min_margin" in out and not any(x in out for x in (WORD, KEY, IDENT, "feature_counts"))
    for bad in ({"x": math.inf}, [1]):
        with pytest.raises(report.ExportError):
            report.policy_text(bad)


GOOD = {"name": "agentic", "description": "tools", "primary_model": "m", "fallback_models": ["n"]}


def test_chat_routes():
    both = [GOOD, {"name": "default", "description": "d", "primary_model": "x"}]
    assert [r["name"] for r in report.chat_routes(both)] == ["default", "agentic"]
    assert report.chat_routes({"chat_ui_routes": both}) == report.chat_routes({"routes": both}) == report.chat_routes(both)
    assert report.chat_routes({"routes": {"default": "m"}})[0]["primary_model"] == "m"
    assert report.chat_routes({"strong_model": "s"})[0]["primary_model"] == "s"
    compiled = {"schema_version": report.POLICY_VERSION, "fallback_model": "m", "pool": ["a", "m"], "routes": {"t": {}}}
    assert report.chat_routes(compiled) == [{"name": "default", "description": report.chat_routes(compiled)[0]["description"], "primary_model": "m", "fallback_models": ["a"]}]


@pytest.mark.parametrize("bad", [[], "x", [1], [{k: v for k, v in GOOD.items() if k != "description"}], [GOOD | {"more": 1}], [GOOD, GOOD], [GOOD | {"name": "other"}], [GOOD | {"primary_model": " "}], [GOOD | {"fallback_models": ["m"]}], [GOOD | {"fallback_models": ["n", "n"]}], [GOOD | {"fallback_models": "n"}], {"routes": {"sum": "m"}}, {}])
def test_chat_routes_that_are_refused(bad):
    with pytest.raises(report.ExportError):
        report.chat_routes(bad)


def test_durations():
    assert estimated_seconds(4, 38) == 4 * (10 + 15 * 38)
    assert [duration_text(s) for s in (5, 89.4, 90, 5399, 5400)] == ["5 s", "89 s", "2 min", "90 min", "1.5 h"]
