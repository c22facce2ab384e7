"""Commands: demo, validate, audit, compile, route, export, ci, matrix."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from matrixloom.operators.route import route_batch
from matrixloom.operators.trials import last_write, to_matrix
from matrixloom.operators.validate import trace_coverage
from matrixloom.plans.audit import audit, compile_policy, gate
from matrixloom.plans.report import chat_routes, console, policy_text, write_chat_routes, write_policy_text, write_report
from matrixloom.sources.demo import MANIFEST, demo_observations
from matrixloom.sources.jsonl import load_jsonl, load_policy, load_tasks, load_trials
from matrixloom.sources.sinks import dump_json, dump_jsonl, dump_policy, single_writer


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="matrixloom")
    sub = p.add_subparsers(dest="command", required=True)
    opts = argparse.ArgumentParser(add_help=False)
    opts.add_argument("--max-quality-loss", type=float, default=0.02)
    opts.add_argument("--objective", choices=["balanced", "cost", "latency"], default="balanced")
    opts.add_argument("--seed", type=int, default=42)
    for name, args in {"demo": ["output"], "validate": ["input"], "audit": ["input", "output"], "compile": ["input", "output"], "route": ["policy", "prompt"], "export": ["policy", "output"], "ci": ["input", "baseline"], "matrix": ["trials", "suite", "output"]}.items():
        s = sub.add_parser(name, parents=[opts])
        for a in args:
            s.add_argument(a)
        if name == "route":
            s.add_argument("--task")
            s.add_argument("--warm-model")
            s.add_argument("--switch-cost-ms", type=float, default=0.0)
        if name == "export":
            s.add_argument("--format", choices=["chat", "text"], default="text")
        if name == "ci":
            s.add_argument("--output")
            s.add_argument("--max-latency-regression", type=float, default=0.05)
            s.add_argument("--max-cost-regression", type=float, default=0.05)
    a = p.parse_args(argv)
    how = {"max_quality_loss": a.max_quality_loss, "objective": a.objective, "seed": a.seed}
    try:
        if a.command == "export":
            d = load_policy(a.policy).to_dict()
            (write_chat_routes if a.format == "chat" else write_policy_text)(d, a.output)
            print(json.dumps(chat_routes(d)) if a.format == "chat" else policy_text(d))
            return 0
        spark = spark or SparkSession.builder.getOrCreate()
        if a.command == "demo":
            doc = audit(demo_observations(spark), **how).document | {"provenance": MANIFEST}
            dump_jsonl(demo_observations(spark), f"{a.output}/observations")
            write_report(doc, a.output)
            print(console(doc, a.output))
        elif a.command == "validate":
            print(trace_coverage(load_jsonl(spark, a.input)).first())
        elif a.command == "audit":
            got = audit(load_jsonl(spark, a.input, require_signal=True), **how)
            write_report(got.document, a.output)
            dump_policy(got.policy, Path(a.output) / "policy.json")
            write_policy_text(got.policy.to_dict(), Path(a.output) / "policy.txt")
            print(console(got.document, a.output))
        elif a.command == "compile":
            dump_policy(compile_policy(load_jsonl(spark, a.input, require_signal=True), **how), a.output)
        elif a.command == "route":
            row = spark.createDataFrame([("prompt", a.prompt, a.task, a.warm_model)], "prompt_id string, prompt string, task string, warm_model string")
            print(json.dumps(route_batch(row, load_policy(a.policy), a.switch_cost_ms).first().asDict()))
        elif a.command == "matrix":
            trials = last_write(load_trials(spark, a.trials))
            models = sorted(r.model for r in trials.select("model").distinct().collect())
            with single_writer(a.output):
                dump_jsonl(to_matrix(trials, load_tasks(spark, a.suite), models), a.output)
        else:
            before = json.loads(Path(a.baseline).read_text("utf-8"))
            doc = audit(load_jsonl(spark, a.input, require_signal=True), **how).document
            failures = gate(before, doc, a.max_latency_regression, a.max_cost_regression)
            if a.output:
                dump_json(doc, a.output)
            print("\n".join(failures) or "within the allowances")
            return int(bool(failures))
    except (ValueError, OSError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
