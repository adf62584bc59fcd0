"""Commands over files, for spark-submit or ``python -m arborq.cli``.

    parse [--validate] [--schema FORMAT|FILE] [--tokens] PATH [OUT]    verdicts, typed values or tokens of documents
    generate PATH [OUT]                                                documents, parsed and written again
    packages [--schema FORMAT] PATH [OUT]                              parts of packages with their verdicts

PATH may hold wildcards; OUT is a folder for JSON lines (text for ``generate``), else rows are shown."""

from __future__ import annotations

import argparse
import pathlib

from arborq import api


def schema_of(name: str):
    """A schema by format name, or compiled from a file by its ending."""
    path = pathlib.Path(name)
    if not path.suffix:
        return api.format_schema(name)
    if path.suffix not in (".xsd", ".dtd", ".ebnf"):
        return api.format_schema(name)
    more = {"resolver": api.file_resolver(str(path.parent))} if path.suffix == ".xsd" else {}
    return api.compile_source(path.read_text(), path.suffix[1:], **more)


def run(spark, args: list[str]):
    """The rows that a command gives."""
    parser = argparse.ArgumentParser(prog="arborq", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("parse", "generate", "packages"):
        command = commands.add_parser(name)
        command.add_argument("path")
        command.add_argument("out", nargs="?")
        command.add_argument("--schema")
        command.add_argument("--validate", action="store_true")
        command.add_argument("--tokens", action="store_true")
    given = parser.parse_args(args)
    schema = schema_of(given.schema) if given.schema else None
    if given.command == "packages":
        rows = api.process_packages(api.read_packages(spark, given.path), {given.schema: schema} if schema else None)
    else:
        docs = api.read_documents(spark, given.path)
        if given.command == "generate":
            rows = api.generate(api.parse(docs))
        elif given.tokens:
            rows = api.tokens(docs)
        elif schema:
            rows = api.project(docs, schema).docs.select("doc_id", "verdict", "reason", "root", "value")
        else:
            rows = api.process(docs, validating=given.validate)
    if given.out and given.command == "generate":
        rows.select("source").write.text(given.out, lineSep="\n")
    elif given.out:
        rows.write.json(given.out)
    return rows, given.out


def main():
    import sys

    from pyspark.sql import SparkSession

    rows, out = run(SparkSession.builder.getOrCreate(), sys.argv[1:])
    if not out:
        rows.show(truncate=False)


if __name__ == "__main__":
    main()
