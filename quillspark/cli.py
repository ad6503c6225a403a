"""Command line: `python -m quillspark.cli COMMAND ...`, one text or a folder of texts at a time.

detect, academic, style, replace, rewrite, compare, watermark and doctor run offline. Texts come from files, folders or standard
input (-); a missing or blank input ends with status 1.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.session import prepare
from quillspark.operators import academic, detector, guards, hygiene, rewriting
from quillspark.sources import lexicons, readers

ALIASES = {"d": "detect", "r": "rewrite", "s": "style", "c": "compare", "w": "watermark"}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *flags: tuple) -> None:
        c = sub.add_parser(name, aliases=[a for a, n in ALIASES.items() if n == name])
        c.set_defaults(command=name)
        if name != "doctor":
            c.add_argument("input", nargs="?", default="-")
            c.add_argument("-o", "--output")
            c.add_argument("--config", help="JSON file of lexicons")
        for names, more in flags:
            c.add_argument(*names, **more)

    as_json, as_score = (("-j", "--json"), {"action": "store_true"}), (("-s", "--score"), {"action": "store_true"})
    seed = (("--seed",), {"type": int, "default": 42})
    add("detect", as_json, as_score, (("-v", "--verbose"), {"action": "store_true"}), (("--sentences",), {"type": int, "default": 5}))
    add("academic", as_json, as_score)
    add("style", (("--style",), {"required": True, "choices": sorted(rewriting.STYLES)}), seed, (("--first",), {"action": "store_true"}))
    add("replace", (("--scene",), {"default": "auto", "choices": ["auto", "general", "academic", "social", "novel"]}), seed, (("--no-rhythm",), {"action": "store_true"}))
    add("rewrite", (("--passes",), {"help": "comma-separated; rhythm only without"}), seed)
    add("compare", seed)
    add("watermark", (("--clean",), {"action": "store_true"}), (("--against",), {"help": "an edited version: how much of the input survives in it"}))
    add("doctor", (("assets",), {"nargs": "*", "help": "path:least_bytes"}))
    return p


def _texts(spark: SparkSession, path: str) -> DataFrame:
    rows = readers.read_stdin(spark) if path == "-" else readers.read_texts(spark, path)
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def _lines(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """(value) of what the command prints."""
    if args.command == "doctor":
        assets = dict((a.rsplit(":", 1)[0], int(a.rsplit(":", 1)[1])) for a in args.assets)
        return readers.check_assets(spark, assets).select(F.concat_ws(" ", "status", "path", F.col("bytes").cast("string")).alias("value"))
    docs, lex = _texts(spark, args.input), lexicons.load(args.config)
    if docs.isEmpty():
        raise ValueError("the input is empty")
    if args.command in ("detect", "academic"):
        ruled = detector.rules(docs, lex) if args.command == "detect" else academic.dimensions(docs, lex)
        scored = detector.scores(ruled, None, lex) if args.command == "detect" else academic.scores(ruled, None, lex)
        if args.score:
            return detector.score_line(scored).select(F.col("line").alias("value"))
        worst = detector.worst_sentences(docs, args.sentences, lex) if args.command == "detect" and (args.json or args.verbose) else None
        out = detector.report(ruled, scored, worst)
        return out.select(F.col("json").alias("value")) if args.json else out.join(detector.score_line(scored), "doc_id").select(F.concat_ws("\n", "line", "json").alias("value"))
    if args.command == "style":
        out = rewriting.styled(docs, args.style, args.seed, args.first)
    elif args.command == "replace":
        out = guards.replace_guarded(docs, args.scene, args.seed, not args.no_rhythm, lex)
    elif args.command == "rewrite":
        out = rewriting.guarded_rewrite(docs, tuple(args.passes.split(",")), args.seed) if args.passes else rewriting.offline(docs)
    elif args.command == "compare":
        after = guards.replace_guarded(docs, seed=args.seed, lex=lex)
        sides = [detector.scores(detector.rules(d, lex), None, lex).select("doc_id", F.col("score").alias(n)) for d, n in ((docs, "before"), (after, "after"))]
        return sides[0].join(sides[1], "doc_id").select(F.concat(F.col("before").cast("string"), F.lit(" -> "), F.col("after").cast("string")).alias("value"))
    elif args.against:
        other = _texts(spark, args.against).select(F.col("text").alias("after"))
        pairs = docs.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("before")).limit(1).crossJoin(other.limit(1))
        return hygiene.survival(pairs).select(F.to_json(F.struct("width", "total", "kept", "survival", "z_ratio")).alias("value"))
    elif args.clean:
        out = hygiene.clean(docs)
    else:
        return hygiene.inspect(docs).select(F.to_json(F.struct("*")).alias("value"))
    return out.select(F.col("text").alias("value"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = prepare(spark or SparkSession.builder.appName("quillspark").getOrCreate())
    try:
        rows = _lines(spark, args)
    except (ValueError, AnalysisException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if getattr(args, "output", None):
        rows.write.mode("overwrite").text(args.output, lineSep="\n")
        return 0
    for r in rows.toLocalIterator():
        print(r.value)
    return 0


if __name__ == "__main__":
    sys.exit(main())
