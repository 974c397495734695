"""Batch command line: ``python -m semsift {prepare,ingest,stream,search} ...``.

* ``prepare DUMP OUT``        bz2 XML dump -> cleaned JSON lines (10,000 per file)
* ``ingest ARTICLES INDEX``   JSON-lines folder -> Parquet index (append)
* ``stream ARTICLES INDEX``   the same as an incremental Structured Streaming load
* ``build-ivf INDEX IVF``     approximate index, kept up by later loads that name it
* ``search INDEX QUERIES OUT`` a file of queries (one per line) -> ranked results (Parquet)

The interactive menu of the original is replaced by whole files of queries.
"""
from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from semsift import constants as C


def _encoder(args):
    from semsift.operators.embed import HashingEncoder, OnnxEncoder
    if args.model:
        return OnnxEncoder(model_path=args.model, vocab_path=args.vocab, max_len=args.max_len)
    return HashingEncoder(dim=args.dim)


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="semsift")
    p.add_argument("--master", default=None)
    p.add_argument("--dim", type=int, default=384, help="hashing encoder dimension")
    p.add_argument("--model", default=None, help="ONNX model path (else hashing encoder)")
    p.add_argument("--vocab", default=None, help="vocabulary file for the ONNX model")
    p.add_argument("--max-len", type=int, default=C.MAX_SEQ_LEN, help="sequence length of the ONNX model")
    sub = p.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("prepare")
    a.add_argument("dump")
    a.add_argument("out")
    a.add_argument("--max-pages", type=int, default=None)
    a = sub.add_parser("ingest")
    a.add_argument("articles")
    a.add_argument("index")
    a.add_argument("--max-lines", type=int, default=None, help="plain cap on raw lines")
    a.add_argument("--exact-cap", type=int, default=None,
                   help="cap with the original rule (every line counts, checked after a kept line)")
    a.add_argument("--rejects", default=None, help="folder for rows without a vector")
    a.add_argument("--ivf", default=None, help="IVF index folder to keep up")
    a.add_argument("--skip-unreadable", action="store_true", help="leave out files that cannot be opened")
    a = sub.add_parser("stream")
    a.add_argument("articles")
    a.add_argument("index")
    a.add_argument("--checkpoint", required=True)
    a.add_argument("--files-per-trigger", type=int, default=100)
    a.add_argument("--rejects", default=None)
    a.add_argument("--ivf", default=None)
    a = sub.add_parser("build-ivf", help="approximate index over a stored table")
    a.add_argument("index")
    a.add_argument("ivf")
    a.add_argument("--cells", type=int, required=True)
    a.add_argument("--train-fraction", type=float, default=None)
    a = sub.add_parser("search")
    a.add_argument("index")
    a.add_argument("queries")
    a.add_argument("out")
    a.add_argument("-k", type=int, default=C.DEFAULT_K)
    a.add_argument("--ivf", default=None, help="search this IVF index instead of all rows")
    a.add_argument("--nprobe", type=int, default=8)
    args = p.parse_args(argv)

    from semsift.session import get_session
    spark = get_session(args.master)
    if args.cmd == "prepare":
        from semsift.plans.prepare import prepare_dump
        from semsift.sources.jsonl import write_articles
        write_articles(prepare_dump(spark, args.dump, args.max_pages), args.out)
    elif args.cmd == "ingest":
        from semsift.plans.ingest import load_articles
        from semsift.sources.jsonl import read_articles, read_articles_exact_cap, unreadable_files
        arts = (read_articles_exact_cap(spark, args.articles, args.exact_cap)
                if args.exact_cap is not None else
                read_articles(spark, args.articles, args.max_lines, args.skip_unreadable))
        if args.skip_unreadable:
            for name in unreadable_files(spark, args.articles):
                print("left out:", name)
        load_articles(arts, args.index, encoder=_encoder(args), rejects_path=args.rejects, ivf_path=args.ivf)
    elif args.cmd == "stream":
        from semsift.streaming.ingest_stream import ingest_stream
        ingest_stream(spark, args.articles, args.index, args.checkpoint, encoder=_encoder(args),
                      files_per_trigger=args.files_per_trigger, rejects_path=args.rejects, ivf_path=args.ivf)
    elif args.cmd == "build-ivf":
        from semsift.operators.ann import build_ivf, write_ivf
        from semsift.plans.ingest import read_index
        write_ivf(build_ivf(read_index(spark, args.index), args.cells, train_fraction=args.train_fraction), args.ivf)
    elif args.cmd == "search":
        from semsift.operators.search import hybrid_search
        lines = spark.read.text(args.queries).filter(F.trim("value") != "")
        queries = lines.select(F.monotonically_increasing_id().alias("query_id"),
                               F.col("value").alias("query"))
        from semsift.operators.ann import read_ivf
        from semsift.plans.ingest import read_index
        (hybrid_search(queries, read_index(spark, args.index), args.k, encoder=_encoder(args), keep_parts=False,
                       ivf=read_ivf(spark, args.ivf) if args.ivf else None, nprobe=args.nprobe)
         .write.mode("overwrite").parquet(args.out))


if __name__ == "__main__":
    main()
