"""Command line: ``python -m kbspark COMMAND``; every command prints JSON."""

from __future__ import annotations

import argparse
import datetime
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession

from kbspark.base import KbError, KnowledgeBase
from kbspark.operators.merge import Op
from kbspark.policy import PolicyError
from kbspark.services import dumps, http_server, tool_service
from kbspark.sources.snapshots import StoreError


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kbspark")
    top.add_argument("--kb", default="", help="folder of the knowledge base; else the nearest above")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *flags: tuple, **about):
        p = sub.add_parser(name, **about)
        for names, more in flags:
            p.add_argument(*names.split(), **more)

    dry, mode = ("--dry-run", {"action": "store_true"}), ("--mode", {"default": ""})
    add("init", ("root", {"nargs": "?", "default": "."}))
    add("scan", dry)
    add("find", ("query", {"nargs": "+"}), mode, ("--limit", {"type": int, "default": 20}))
    add("recall", ("query", {"nargs": "+"}), mode, ("--budget", {"type": int, "default": 4000}))
    add("retain", ("file", {"nargs": "?"}), ("--as", {"dest": "path", "default": ""}), ("--date", {"type": datetime.date.fromisoformat}), ("--transcript", {"action": "store_true"}))
    add("export", ("--filter", {"default": ""}), ("--at", {"default": ""}), ("--to", {"default": ""}))
    for name in ("log", "undo", "embed", "drift", "mcp", "policy", "views"):
        add(name)
    for name in ("org", "dedup", "reconcile"):
        add(name, dry)
    add("watch", ("--interval", {"default": "2 seconds"}))
    add("serve", ("--addr", {"default": "127.0.0.1:3978"}))
    for name in ("work-create", "work-abort", "merge"):
        add(name, ("name", {}))
    add("work-stage", ("name", {}), ("path", {}), ("--to", {"default": ""}), ("--label", {"action": "append", "default": []}), ("--rule", {"default": ""}))
    add("work-resolve", ("name", {}), ("--mine", {"action": "store_true"}), ("--theirs", {"action": "store_true"}))
    return top


def run(spark: SparkSession, a: argparse.Namespace):
    if a.command == "init":
        return {"root": KnowledgeBase.init(spark, a.root).root}
    open_kb = lambda root: KnowledgeBase.resolve(spark, root or a.kb or None)
    if a.command == "mcp":
        return tool_service(open_kb, sys.stdin, lambda x: (sys.stdout.write(x), sys.stdout.flush()))
    if a.command == "serve":
        host, _, port = a.addr.rpartition(":")
        return http_server(open_kb, host, int(port)).serve_forever()
    kb = open_kb("")
    match a.command:
        case "scan":
            return kb.scan(a.dry_run)
        case "find":
            return kb.find(" ".join(a.query), a.mode, a.limit)
        case "recall":
            return kb.recall(" ".join(a.query), a.mode, a.budget)
        case "retain":
            if a.file:
                with open(a.file, "rb") as f:
                    data = f.read()
            else:
                data = sys.stdin.buffer.read()
            return kb.retain(data, a.path, a.date, a.transcript)
        case "export":
            return kb.export(a.filter, a.at, a.to)
        case "org" | "dedup" | "reconcile":
            return getattr(kb, a.command)(not a.dry_run)
        case "policy":
            return kb.rules()
        case "views":
            return [asdict(v) for v in kb.views()]
        case "watch":
            from kbspark.streaming.watch import rendered

            return kb.watch(lambda s: print("\n".join(rendered(s)), flush=True), a.interval).awaitTermination()
        case "work-create":
            return asdict(kb.work_create(a.name))
        case "work-abort":
            return asdict(kb.work_abort(a.name))
        case "work-stage":
            return asdict(kb.work_stage(a.name, [Op(a.path, a.to, tuple(a.label), a.rule)]))
        case "merge":
            view, out = kb.work_merge(a.name)
            return {"view": asdict(view), "outcome": asdict(out)}
        case "work-resolve":
            if a.mine == a.theirs:
                raise KbError("one of --mine and --theirs")
            return asdict(kb.work_resolve(a.name, a.mine))
    return getattr(kb, a.command)()  # log, undo, embed, drift


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("kbspark").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        out = run(spark, a)
    except (KbError, StoreError, PolicyError, ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    if out is not None:
        print(dumps(out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
