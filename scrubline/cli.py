"""The command line: report, clean, apply, suggest, infer-schema, detectors, ops."""

from __future__ import annotations

import argparse
import sys

from scrubline import api
from scrubline.errors import ScrublineError
from scrubline.plans.engine import diff_text
from scrubline.plans.registry import DETECTORS, OPS
from scrubline.session import local_session
from scrubline.sources import xlsx
from scrubline.sources.files import write_table, write_text


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="scrubline", description="Clean tables by readable recipes.")
    commands = parser.add_subparsers(dest="command", required=True)

    def add(name: str, help_text: str, *more: str) -> argparse.ArgumentParser:
        made = commands.add_parser(name, help=help_text)
        made.add_argument("input")
        for x in more:
            made.add_argument(x)
        made.add_argument("-o", "--out")
        made.add_argument("--sheet")
        made.add_argument("--columns", type=lambda s: s.split(","))
        made.add_argument("--nrows", type=int)
        made.add_argument("--skiprows", type=int, help="rows left out behind the header")
        return made

    add("report", "show what may be wrong").add_argument("--schema")
    made = add("clean", "plan and clean")
    made.add_argument("--schema")
    made.add_argument("--mode", default="review", choices=("review", "auto", "strict"))
    made.add_argument("--recipe-out")
    made.add_argument("--diff", action="store_true")
    made = add("apply", "replay a recipe", "recipe")
    made.add_argument("--mode", default="review", choices=("review", "auto", "strict"))
    made.add_argument("--on-drift", default="warn", choices=("warn", "error", "ignore"))
    made.add_argument("--stream", action="store_true")
    add("suggest", "fit a recipe to a changed input", "recipe")
    add("infer-schema", "the schema that an input fits")
    commands.add_parser("detectors", help="list the detectors")
    commands.add_parser("ops", help="list the operations")
    return parser


def run(args: argparse.Namespace) -> None:
    if args.command == "detectors":
        print(*(f"{p:3} {scope:6} {name}" for p, name, scope in sorted((p, n, s) for n, (p, s, _, _) in DETECTORS.items())), sep="\n")
        return
    if args.command == "ops":
        print(*(f"{spec.scope:8} {name}" for name, spec in sorted(OPS.items())), sep="\n")
        return
    spark = local_session("*")
    how = {"sheet": args.sheet, "columns": args.columns, "nrows": args.nrows, "skiprows": list(range(1, args.skiprows + 1)) if args.skiprows else None}
    book = args.input.lower().endswith((".xlsx", ".xlsm")) and args.sheet is None and len(xlsx.sheet_names(args.input)) > 1
    if args.command == "report":
        known, issues, score = api.report(spark, args.input, args.out, args.schema, **how)
        print(f"{known.n_rows} rows, quality {score}")
        print(*(f"{i.severity:8} {i.column or '-'}: {i.message}" for i in issues), sep="\n")
    elif args.command == "clean" and book:
        done = api.clean_workbook(spark, args.input, mode=args.mode)
        if args.out:
            api.save_workbook(done, args.out, args.input)
    elif args.command == "clean":
        made = api.clean(spark, args.input, schema=args.schema, mode=args.mode, **how)
        if args.recipe_out:
            made.recipe.save(args.recipe_out)
        if args.out:
            write_table(made.result.cleaned, args.out)
            write_table(made.result.quarantine, f"{args.out}.quarantine.csv")
        print(diff_text(made.result.diff) if args.diff else made.recipe.to_yaml())
    elif args.command == "apply" and args.stream:
        from scrubline.plans.recipe import Recipe
        from scrubline.streaming.replay import replay_file

        print(replay_file(spark, Recipe.load(args.recipe), args.input, args.out, args.mode, on_drift=args.on_drift))
    elif args.command == "apply":
        made = api.apply_recipe(spark, args.input, args.recipe, mode=args.mode, on_drift=args.on_drift, **how)
        if args.out:
            write_table(made.result.cleaned, args.out)
            write_table(made.result.quarantine, f"{args.out}.quarantine.csv")
        print(*(f"{f.severity}: {f.message}" for f in made.drift), made.result.summary(), sep="\n")
    elif args.command == "suggest":
        recipe, found = api.update(spark, args.input, args.recipe, **how)
        print(*(f"{f.severity}: {f.message}" for f in found), sep="\n")
        write_text(args.out, recipe.to_yaml()) if args.out else print(recipe.to_yaml())
    elif args.command == "infer-schema":
        text = api.schema_of(spark, args.input, **how).to_yaml()
        write_text(args.out, text) if args.out else print(text)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        run(args)
        return 0
    except ScrublineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
