"""Command line over one store: python -m millrace STORE index|ask|sites|delete|stats|reindex|check ..."""

from __future__ import annotations

import argparse

from .plans.engine import Engine
from .session import local_session


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="millrace")
    parser.add_argument("store", help="folder of the store")
    what = parser.add_subparsers(dest="what", required=True)
    for name, words in (("index", ("url", "pages")), ("reindex", ("pages",)), ("ask", ("question",)), ("delete", ("url",)), ("sites", ()), ("stats", ()), ("check", ())):
        command = what.add_parser(name)
        for word in words:
            command.add_argument(word, nargs="+" if word == "question" else None, help={"pages": "Parquet of page_id, url, html"}.get(word))
        if name == "index":
            command.add_argument("--max-pages", type=int)
    given = parser.parse_args(argv)
    spark = local_session()
    engine = Engine(spark, given.store)
    engine.open()
    match given.what:
        case "index":
            print(engine.index_stored(given.url, spark.read.parquet(given.pages), given.max_pages))
        case "reindex":
            raw = spark.read.parquet(given.pages)
            for row in engine.sites().collect():
                print(row.site_url, engine.index_stored(row.site_url, raw, use_cache=False, resume=True))
        case "ask":
            rows = spark.createDataFrame([(1, " ".join(given.question))], "question_id int, question string")
            for row in engine.ask(rows).collect():
                print(row.answer, *[f"{s.score:.3f} {s.url} {s.title or ''}" for s in row.sources], sep="\n")
        case "delete":
            engine.delete(given.url)
        case "sites":
            engine.sites().show(truncate=False)
        case "stats":
            engine.stats().show()
        case "check":
            print(engine.check())


if __name__ == "__main__":
    main()
