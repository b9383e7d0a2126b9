"""Stages from the command line: python -m attestor STAGE ..."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="attestor")
    sub = p.add_subparsers(dest="stage", required=True)
    m = sub.add_parser("manifest", help="raw files to a deduplicated manifest")
    m.add_argument("root"), m.add_argument("out"), m.add_argument("--force", action="store_true")
    s = sub.add_parser("splits", help="manifest to splits")
    s.add_argument("manifest"), s.add_argument("out"), s.add_argument("--force", action="store_true"), s.add_argument("--verify", action="store_true")
    f = sub.add_parser("signals", help="images to the signal store")
    f.add_argument("root"), f.add_argument("manifest"), f.add_argument("out")
    q = sub.add_parser("query", help="a registered query over the tables of a folder, to Parquet")
    q.add_argument("name"), q.add_argument("sf_dir"), q.add_argument("out")
    a = p.parse_args(argv)

    from attestor.plans import queries, stages
    from attestor.session import build_session

    spark = build_session()
    if a.stage == "manifest":
        print(json.dumps(stages.build_manifest(spark, a.root, a.out, a.force) or "unchanged"))
    elif a.stage == "splits" and a.verify:
        return 0 if stages.verify_splits(spark, a.manifest, a.out) else 1
    elif a.stage == "splits":
        print(json.dumps(stages.build_splits(spark, a.manifest, a.out, force=a.force) or "unchanged"))
    elif a.stage == "signals":
        print(json.dumps(stages.build_signals(spark, a.root, a.manifest, a.out)))
    else:
        queries.QUERIES[a.name](spark, a.sf_dir).write.mode("overwrite").parquet(a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
