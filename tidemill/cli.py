"""profile, suggest, clean, validate and run-pipeline for CSV files. Exit 0: fine, 1: rules broken, 2: unusable input."""

from __future__ import annotations

import argparse
import contextlib
import os
import sys

import yaml
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from tidemill.config import setting
from tidemill.operators.profiling import profile
from tidemill.operators.validation import load_rules, validate
from tidemill.plans.pipeline import Result, load_pipeline, run_pipeline
from tidemill.plans.suggest import suggest
from tidemill.sources.tables import read_csv, read_csv_and_lines, record_lines, write_csv, write_json, write_review

SKIPS = {"no_coerce": ("coerce_types",), "no_categoricals": ("standardize_categoricals",), "no_contacts": ("standardize_emails", "standardize_phones", "standardize_names", "clean_addresses")}


def _session() -> SparkSession:
    return SparkSession.builder.appName("tidemill").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _write(path: str, content: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(content)
    print(f"Wrote {path}")


def _profile(spark: SparkSession, a: argparse.Namespace) -> int:
    report = profile(read_csv(spark, a.input, a.sep, a.encoding))
    named = {".html": "html", ".htm": "html", ".json": "json"}.get(os.path.splitext(a.out or "")[1].lower(), "md")
    content = {"md": report.to_markdown, "html": report.to_html, "json": report.to_json}[a.format or named]()
    if a.out:
        _write(a.out, content)
    else:
        print(content)
    print(f"{report.n_rows} rows x {report.n_cols} columns, {report.n_duplicate_rows} duplicate row(s), {report.n_issues} suspected issue(s).")
    return 0


def _suggest(spark: SparkSession, a: argparse.Namespace) -> int:
    for path in (a.steps_out, a.rules_out):
        if os.path.exists(path) and not a.force:
            raise FileExistsError(f"{path} exists; use --force to overwrite it")
    s = suggest(read_csv(spark, a.input, a.sep, a.encoding), a.region, a.name, os.path.basename(a.input))
    if not s.round_trips():
        raise ValueError("the suggestion can't be written as YAML")
    _write(a.steps_out, s.steps_yaml())
    _write(a.rules_out, s.rules_yaml())
    return 0


def _output(a: argparse.Namespace) -> str:
    """--out, or a name made of the input's, which must be free then."""
    path = a.out or f"{os.path.splitext(a.input)[0]}_{'clean' if a.command == 'clean' else 'out'}.csv"
    if not a.out and os.path.exists(path):
        raise FileExistsError(f"{path} exists; name another file with --out")
    return path


def _report(spark: SparkSession, result: Result, a: argparse.Namespace) -> int:
    path = _output(a)
    write_csv(result.df, path)
    print(f"Wrote pipeline output to {path}")
    b, c = result.before, result.after
    print(f"Rows {b['rows']} -> {c['rows']}, missing cells {b['missing_cells']} -> {c['missing_cells']}, duplicate rows {b['duplicate_rows']} -> {c['duplicate_rows']}.")
    print(f"Input hash {b['hash']} -> output hash {c['hash']}")
    for i, e in enumerate(result.audit_log, 1):
        print(f"  {i}. {e['op']}: {e['message']}")
    if getattr(a, "report", None):
        _write(a.report, result.to_markdown())
    if a.audit:
        write_json(result.as_dict(), a.audit)
        print(f"Wrote audit JSON to {a.audit}")
    if a.review_out:
        n = write_review(result.reviews, a.review_out, record_lines(spark, a.input, a.sep, a.encoding))
        print(f"Wrote {n} duplicate pair(s) to {a.review_out}")
    return 0


def _clean(spark: SparkSession, a: argparse.Namespace) -> int:
    df = read_csv(spark, a.input, a.sep, a.encoding)
    config = suggest(df, a.region, "clean", os.path.basename(a.input)).core_pipeline()
    skipped = {op for flag, ops in SKIPS.items() if getattr(a, flag) for op in ops} | {"deduplicate"}
    config["steps"] = [s for s in config["steps"] if s["op"] not in skipped]
    listed = lambda v: [x.strip() for x in v.split(",") if x.strip()] if v else None
    if not a.keep_duplicates:
        step = {"op": "deduplicate", "subset": listed(a.dedupe_on), "keep": a.keep}
        if a.fuzzy_keys:
            step |= {"fuzzy": True, "fuzzy_keys": listed(a.fuzzy_keys), "threshold": a.threshold, "block_on": listed(a.block_on)}
        config["steps"].append(step)
    return _report(spark, run_pipeline(df, config), a)


def _validate(spark: SparkSession, a: argparse.Namespace) -> int:
    df, lines = read_csv_and_lines(spark, a.input, a.sep, a.encoding)
    report = validate(df, load_rules(a.rules), lines)
    for f in report.first(a.max_show):
        where = f"row {f['row']} (line {f['line']})" if f["row"] is not None else ""
        print(f"  {f['rule']}: {where} {f['message']}".rstrip())
    print(f"{'PASS' if report.ok else 'FAIL'}: {report.n_failures} failure(s), {report.n_rules} rule(s), {report.n_rows} row(s).")
    if a.report:
        _write(a.report, report.to_markdown())
    if a.json:
        write_json(report.as_dict(), a.json)
    return 0 if report.ok else 1


def _run(spark: SparkSession, a: argparse.Namespace) -> int:
    return _report(spark, run_pipeline(read_csv(spark, a.input, a.sep, a.encoding), load_pipeline(a.steps)), a)


def parser(env_file: str | None = ".env") -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidemill", description=__doc__)
    out.add_argument("--version", action="version", version="tidemill 0.1.0")
    out.add_argument("--env-file", default=".env")
    out.add_argument("--debug", action="store_true")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, run, *options: tuple) -> None:
        p = commands.add_parser(name)
        p.add_argument("input")
        p.add_argument("--sep", default=setting("TIDEMILL_SEP", env_file))
        p.add_argument("--encoding", default="utf-8-sig")
        for flag, extra in options:
            p.add_argument(flag, **extra)
        p.set_defaults(run=run)

    region = ("--region", {"default": setting("TIDEMILL_REGION", env_file)})
    files = [(f, {"default": None}) for f in ("--audit", "--review-out")]
    command("profile", _profile, ("--out", {}), ("--format", {"choices": ["md", "html", "json"], "default": None}))
    command("suggest", _suggest, region, ("--steps-out", {"default": "steps.yaml"}), ("--rules-out", {"default": "rules.yaml"}), ("--name", {"default": "suggested"}), ("--force", {"action": "store_true"}))
    flags = [(f, {"action": "store_true"}) for f in ("--no-coerce", "--no-contacts", "--no-categoricals", "--keep-duplicates")]
    command("clean", _clean, region, ("--out", {"default": None}), *files, *flags, ("--keep", {"default": "first"}), *((f, {"default": None}) for f in ("--dedupe-on", "--fuzzy-keys", "--block-on")), ("--threshold", {"type": float, "default": 0.9}))
    command("validate", _validate, ("--rules", {"required": True}), ("--report", {}), ("--json", {}), ("--max-show", {"type": int, "default": 20}))
    command("run-pipeline", _run, ("--steps", {"required": True}), ("--out", {"default": None}), ("--report", {}), *files)
    return out


def _first_line(e: Exception) -> str:
    return (str(e).strip() or type(e).__name__).splitlines()[0]


#: What is told of unusable input, by the kind of error; others are faults of this program.
ERRORS = (
    (UnicodeError, lambda e, a: f"{a.input} can't be read as {a.encoding}; name its encoding with --encoding, such as latin-1"),
    (yaml.YAMLError, lambda e, a: f"not valid YAML: {' '.join(str(e).split())}"),
    (KeyError, lambda e, a: f"{e} is missing"),
    (PySparkException, lambda e, a: f"Spark could not do it: {_first_line(e)}"),
    ((OSError, ValueError, TypeError), lambda e, a: _first_line(e)),
)


def _utf8() -> None:
    """Names of any script can be printed, wherever the output goes."""
    for stream in (sys.stdout, sys.stderr):
        if hasattr(stream, "reconfigure"):
            with contextlib.suppress(ValueError, OSError):
                stream.reconfigure(encoding="utf-8", errors="replace")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    _utf8()
    argv = sys.argv[1:] if argv is None else argv
    first = argparse.ArgumentParser(add_help=False)
    first.add_argument("--env-file", default=".env")
    a = parser(first.parse_known_args(argv)[0].env_file).parse_args(argv)
    try:
        if not os.path.exists(a.input):
            raise FileNotFoundError(f"no such file: {a.input}")
        return a.run(spark or _session(), a)
    except Exception as e:
        if a.debug:
            raise
        told = next((say(e, a) for kind, say in ERRORS if isinstance(e, kind)), None)
        if told is None:
            raise
        print(f"error: {told}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
