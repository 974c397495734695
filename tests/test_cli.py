"""The batch CLI end to end: prepare -> ingest -> search (subprocess-free, same JVM)."""
import bz2

from semsift.__main__ import main

from test_sources import DUMP


def test_cli_end_to_end(spark, tmp_path):
    dump = tmp_path / "d.xml.bz2"
    dump.write_bytes(bz2.compress(DUMP.encode()))
    main(["--dim", "16", "prepare", str(dump), str(tmp_path / "json")])
    main(["--dim", "16", "ingest", str(tmp_path / "json"), str(tmp_path / "index")])
    (tmp_path / "q.txt").write_text("What is the end?\nsingle line page\n\n")
    main(["--dim", "16", "search", str(tmp_path / "index"), str(tmp_path / "q.txt"),
          str(tmp_path / "out"), "-k", "2"])
    res = spark.read.parquet(str(tmp_path / "out")).orderBy("query_id", "rank").collect()
    assert len(res) == 4
    assert spark.read.parquet(str(tmp_path / "index")).count() == 4
    top = sorted(r["title"] for r in res if r["rank"] == 1)
    # keyword + title overlap decide: "end" -> the page "Last" ("the end"),
    # "single line page" -> the page titled "One line"
    assert top == ["last", "one line"]


def test_cli_exact_cap(spark, tmp_path):
    src = tmp_path / "a"
    src.mkdir()
    (src / "f.json").write_text('{"title": "a", "text": "x"}\nbad\n{"title": "b", "text": "y"}\n'
                                '{"title": "c", "text": "z"}\n')
    main(["--dim", "8", "ingest", str(src), str(tmp_path / "ix"), "--exact-cap", "2"])
    # line 2 is malformed, so the cap is checked at the next kept line (3): a and b
    got = sorted(r["title"] for r in spark.read.parquet(str(tmp_path / "ix")).collect())
    assert got == ["a", "b"]
