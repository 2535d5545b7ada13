"""Command line: validate, diagnose, verify. Exit codes: 0 done, 2 wrong input or no match, 3 failure, 4 partial."""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
from collections.abc import Sequence
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sourcelens", description="How strongly labels are tied to their sources.")
    sub = top.add_subparsers(dest="command", required=True)
    for name, text in (("validate", "check a metadata table"), ("diagnose", "check and diagnose a metadata table")):
        p = sub.add_parser(name, help=text)
        p.add_argument("metadata")
        p.add_argument("--config", required=True)
        p.add_argument("--format", choices=("csv", "tsv"))
        p.add_argument("--output", help="file for the report; standard output without it")
        p.add_argument("--run-record", help="file for the run record")
        p.add_argument("--overwrite", action="store_true")
    v = sub.add_parser("verify", help="compare files with a run record")
    v.add_argument("record")
    v.add_argument("--metadata")
    v.add_argument("--config")
    v.add_argument("--report")
    return top


def check_targets(outputs: list[Path], inputs: list[Path], overwrite: bool) -> None:
    """Outputs must be new (or may be replaced), no links, in a folder that is there, and no file of the run."""
    seen = [p.resolve() for p in inputs]
    for out in outputs:
        if out.is_symlink():
            raise OSError(f"{out} is a symbolic link")
        if not out.parent.is_dir():
            raise OSError(f"{out.parent} is no folder")
        if out.exists() and (not overwrite or not out.is_file()):
            raise OSError(f"{out} is there already")
        if out.resolve() in seen or any(p.exists() and out.exists() and os.path.samefile(p, out) for p in inputs):
            raise OSError(f"{out} is another file of this run")
        seen.append(out.resolve())


def publish(path: Path, text: str, overwrite: bool) -> None:
    """The whole file or none: written beside, flushed to disk, then linked or renamed into place."""
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        if overwrite:
            os.replace(name, path)
        else:
            os.link(name, path)  # fails if the file has come meanwhile
    finally:
        if os.path.exists(name):
            os.unlink(name)


def _analyse(args: argparse.Namespace) -> int:
    outputs = [Path(p) for p in (args.output, args.run_record) if p]
    check_targets(outputs, [Path(args.metadata), Path(args.config)], args.overwrite)
    from pyspark.sql import SparkSession

    from sourcelens.api.run_record import run_analysis

    run = run_analysis(SparkSession.builder.getOrCreate(), args.metadata, config=args.config, command=args.command, format=args.format)
    text = json.dumps(run.report, ensure_ascii=False, allow_nan=False, indent=2) + "\n"
    if args.output:
        publish(Path(args.output), text, args.overwrite)
    else:
        sys.stdout.write(text)
    if args.run_record:
        publish(Path(args.run_record), run.record.to_json(), args.overwrite)
    print(f"{args.command}: {run.report['scope']}, exit code {run.exit_code}", file=sys.stderr)
    return run.exit_code


def _verify(args: argparse.Namespace) -> int:
    from sourcelens.api.run_record import verify_run

    out = verify_run(args.record, metadata=args.metadata, config=args.config, report=args.report)
    sys.stdout.write(json.dumps(out, indent=2) + "\n")
    for c in out["checks"]:
        print(f"{c['name']}: {c['status']}", file=sys.stderr)
    return 0 if out["verified"] else 2


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return _verify(args) if args.command == "verify" else _analyse(args)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except OSError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2 if isinstance(e, FileNotFoundError) else 3


if __name__ == "__main__":
    sys.exit(main())
