"""The command surface: ``python -m probator COMMAND``."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from . import autoprobe, discovery, evaluation
from .contract import case_fingerprint, load_case, save_case, unconfirmed_roles, write_document
from .sources import adapters, sinks, synthetic
from .sources.io import read_table, to_text


def session() -> SparkSession:
    return SparkSession.builder.appName("probator").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def validate(path: str) -> dict:
    """Whether a case can be audited: READY_FOR_AUDIT, or NOT_ASSESSABLE while roles are unconfirmed. A case that does not hold together is an error."""
    case = load_case(path)
    open_roles = unconfirmed_roles(case)
    return {"valid": True, "schema_version": case.schema_version, "case_id": case.case_id, "case_fingerprint": case_fingerprint(case), "unconfirmed_roles": open_roles, "status": "NOT_ASSESSABLE" if open_roles else "READY_FOR_AUDIT"}


def init_case(spark: SparkSession, data: str, output: str) -> dict:
    """Writes a provisional case beside the data and returns the guesses it rests on."""
    df = read_table(spark, data)
    case_id = os.path.splitext(os.path.basename(data.rstrip("/")))[0]
    relative = data if "://" in data else os.path.relpath(data, os.path.dirname(os.path.abspath(output)))
    save_case(discovery.provisional_case(df, case_id, data), output, relative)
    return {"case": output, "guesses": discovery.guesses(discovery.column_evidence(df))}


def discover(spark: SparkSession, data: str, output: str) -> dict:
    """Writes the guesses and a file for each question that a table allows."""
    df = read_table(spark, data)
    found = discovery.guesses(discovery.column_evidence(df))
    cards = discovery.claim_cards(df.columns, found)
    result = {"mode": "task_discovery", "guesses": found, "cards": cards}
    write_document(result, os.path.join(output, "discovery.yaml"))
    for i, card in enumerate(cards, 1):
        write_document(card, os.path.join(output, f"claim-card-{i:02d}.yaml"))
    return result


#: Public tables that come with the files that are handed over; those with a holdout also need the table that it is held against.
ADAPTERS = {"davis": adapters.davis, "bbb": adapters.barrier, "parkinsons": adapters.voice}
HELD_OUT = {"bbb-external": adapters.barrier_external, "bbb-petbd": adapters.tracer_external}


def demo(spark: SparkSession, kind: str, output: str, budget: str, raw: str | None, protected: str | None = None) -> dict:
    """A synthetic table from start to end; or a public table that ``raw`` names, made ready and kept. Tables with a holdout need the ``protected`` table, and RDKit to tell structures apart."""
    if kind in synthetic.SHAPES:
        path = f"{output}/{kind}.parquet"
        sinks.write_table(synthetic.synthetic(spark, kind), path)
        return evaluation.evaluate_case(spark, synthetic.synthetic_case(kind, path), f"{output}/{kind}", budget=budget)
    if raw is None or kind in HELD_OUT and protected is None:
        raise ValueError(f"{kind} needs the raw table{' and the protected one: --protected FILE' if kind in HELD_OUT else ''}: --raw FILE")
    if kind in HELD_OUT:
        build = lambda: HELD_OUT[kind](read_table(spark, protected), read_table(spark, raw), adapters.structure_key())
    else:
        build = lambda: ADAPTERS[kind](read_table(spark, raw))
    return adapters.cached(spark, f"{output}/{kind}", build)[1]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="probator", description="Audits what a table can support.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple, **options) -> None:
        one = commands.add_parser(name)
        for words, settings in arguments:
            one.add_argument(*words, **settings)
        one.set_defaults(**options)

    out = lambda default: (("-o", "--output"), {"default": default})
    budget = (("--budget",), {"choices": ["smoke", "standard"], "default": "smoke"})
    command("init-case", (("data",), {}), out("case.yaml"))
    command("validate-case", (("case",), {}))
    command("run", (("case",), {}), budget, out("results"), (("--holdout-override-reason",), {"default": ""}))
    command("eda", (("case",), {}), out("eda"))
    command("discover", (("data",), {}), out("discovery"))
    command("assess-graph-readiness", (("development",), {}), (("--external-report",), {"default": None}))
    command("demo", (("kind",), {"choices": [*synthetic.SHAPES, *ADAPTERS, *HELD_OUT]}), budget, out("demo"), (("--raw",), {"default": None}), (("--protected",), {"default": None}))
    command("autoprobe", (("action",), {"choices": ["prepare", "evaluate"]}), (("path",), {}), out("autoprobe"))
    return top


def main(words: list[str] | None = None) -> dict:
    a = parser().parse_args(words)
    if a.command == "validate-case":
        result = validate(a.case)
    else:
        spark = session()
        calls = {
            "init-case": lambda: init_case(spark, a.data, a.output), "run": lambda: evaluation.evaluate_case(spark, load_case(a.case), a.output, budget=a.budget, holdout_reason=a.holdout_override_reason), "eda": lambda: evaluation.profile_case(spark, load_case(a.case), a.output),
            "discover": lambda: discover(spark, a.data, a.output), "assess-graph-readiness": lambda: evaluation.assess_graphs(spark, a.development, a.external_report), "demo": lambda: demo(spark, a.kind, a.output, a.budget, a.raw, a.protected),
            "autoprobe": lambda: autoprobe.prepare(spark, load_case(a.path), a.output) if a.action == "prepare" else autoprobe.trial(spark, a.path),
        }
        result = calls[a.command]()
    print(evaluation.status_line(result) if "capability_matrix" in result else to_text(result, indent=2))
    return result
