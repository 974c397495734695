"""Dump and JSON-lines robustness."""
import bz2

from semsift.plans.ingest import build_index, rejected_rows
from semsift.plans.prepare import prepare_dump
from semsift.sources.jsonl import read_articles, read_json_lines, write_articles
from semsift.sources.xml_dump import read_dump

DUMP = """<mediawiki>
  <page>
    <title>Good</title>
    <revision><text>Hello [[World]] &amp;nbsp; x</text></revision>
  </page>
  <page>
    <title>Broken</titl>
    <revision><text>bad</text></revision>
  </page>
  <page>
    <title>Empty</title>
    <revision><text/></revision>
  </page>
  <page>
    <title>Two</title>
    <revision><text>first rev</text></revision>
    <revision><text>second rev</text></revision>
  </page>
  <page><title>One line</title><revision><text>single line page</text></revision></page>
  <page>
    <title>Redir</title>
    <revision><text>  #ReDirect [[Good]]</text></revision>
  </page>
  <page>
    <title>Last</title>
    <revision><text>the end</text></revision>
  </page>
</mediawiki>
"""


def test_dump_scan(spark, tmp_path):
    p = tmp_path / "dump.xml.bz2"
    p.write_bytes(bz2.compress(DUMP.encode()))
    raw = {r["title"]: r["raw"] for r in read_dump(spark, str(p)).collect()}
    assert "Broken" not in raw and raw["Empty"] is None and raw["Two"] == "first rev"
    out = {r["title"]: r["text"] for r in prepare_dump(spark, str(p)).collect()}
    # XML decodes &amp;nbsp; to &nbsp;, the entity decode (C1) then gives U+00A0 -> space
    assert out == {"Good": "hello world x", "Two": "first rev",
                   "One line": "single line page", "Last": "the end"}
    assert read_dump(spark, str(p), max_pages=2).count() == 1      # cap counts malformed pages


JSONL = [
    '{"title": "A", "text": "alpha"}',
    '',
    'not json',
    '{"title": "B", "text": "tru',
    '[1,2]',
    '"str"',
    '{"title": null, "text": "nulltitle"}',
    '{"title": 5, "text": "numtitle"}',
    '{"text": "notitle"}',
    '{"title": "R", "text": "x #REDIRECT y"}',
]


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(JSONL) + "\n")
    (tmp_path / "b.jsonl").write_text('{"title": "ignored", "text": "x"}\n')
    got = sorted((r["title"], r["text"], r["link"]) for r in read_articles(spark, str(tmp_path)).collect())
    assert got == [("", "notitle", "https://en.wikipedia.org/wiki/"),
                   ("", "nulltitle", "https://en.wikipedia.org/wiki/"),
                   ("5", "numtitle", "https://en.wikipedia.org/wiki/5"),
                   ("A", "alpha", "https://en.wikipedia.org/wiki/A")]
    assert read_json_lines(spark, str(tmp_path), max_lines=3).select("title").count() == 3


def test_json_sink_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(f"t{i}", f"x{i}") for i in range(25)] + [(None, "n")],
                               "title string, text string")
    write_articles(df, str(tmp_path / "out"), records_per_file=10)
    files = [f for f in (tmp_path / "out").iterdir() if f.name.endswith(".json")]
    assert len(files) >= 3
    assert any('"title":null' in f.read_text() for f in files)          # nulls kept
    assert read_articles(spark, str(tmp_path / "out")).count() == 26


def test_empty_embedding_rejected(spark):
    arts = spark.createDataFrame([(1, "a", "x", [1.0]), (2, "b", "y", [])],
                                 "id long, title string, text string, emb array<float>")
    assert [r["id"] for r in build_index(arts, id_col="id", embedding_col="emb").collect()] == [1]
    assert rejected_rows(arts.withColumnRenamed("emb", "embedding")).count() == 1


REAL_SHAPE = """<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/" version="0.10" xml:lang="en">
  <siteinfo>
    <sitename>Wikipedia</sitename>
  </siteinfo>
  <page>
    <title>Attr &amp; Co</title>
    <ns>0</ns>
    <id>12</id>
    <revision>
      <id>1</id>
      <text bytes="27" xml:space="preserve">Some ''text'' with {{cite}} it</text>
    </revision>
  </page>
</mediawiki>
"""


def test_dump_real_shape(spark, tmp_path):
    p = tmp_path / "real.xml.bz2"
    p.write_bytes(bz2.compress(REAL_SHAPE.encode()))
    out = [(r["title"], r["text"]) for r in prepare_dump(spark, str(p)).collect()]
    assert out == [("Attr & Co", "some ''text'' with it")]


def _simulate_cap(files, max_pages):
    import json
    kept, count = [], 0
    for lines in files:
        for line in lines:
            count += 1
            try:
                j = json.loads(line)
            except Exception:
                continue
            if not isinstance(j, dict):
                continue
            t = j.get("text") or ""
            if not isinstance(t, str) or "#REDIRECT" in t:
                continue
            kept.append((str(j.get("title") or ""), t))
            if count >= max_pages:
                return kept
    return kept


def test_exact_ingest_cap(spark, tmp_path):
    from semsift.sources.jsonl import read_articles_exact_cap
    files = [['{"title": "a", "text": "x1"}', '', 'bad', '{"title": "b", "text": "#REDIRECT y"}'],
             ['{"title": "c", "text": "x2"}', '{"title": "d", "text": "x3"}', 'nope',
              '{"title": "e", "text": "x4"}']]
    for i, lines in enumerate(files):
        (tmp_path / f"f{i}.json").write_text("\n".join(lines) + "\n")
    for cap in range(1, 10):
        got = sorted((r["title"], r["text"]) for r in read_articles_exact_cap(spark, str(tmp_path), cap).collect())
        assert got == sorted(_simulate_cap(files, cap)), cap


def test_files_behind_the_cap_are_not_opened(spark, tmp_path, monkeypatch):
    import functools
    from semsift.sources import jsonl, lines, xml_dump
    from semsift.sources.jsonl import read_articles_exact_cap
    once = functools.partial(lines.capped_runs, first=1)
    monkeypatch.setattr(jsonl, "capped_runs", once)
    monkeypatch.setattr(xml_dump, "capped_runs", once)
    for i in range(9):
        (tmp_path / f"f{i}.json").write_text('{"title": "t%d", "text": "x"}\n' % i * 2)
        (tmp_path / f"d{i}.xml").write_text(f"<page><title>t{i}</title><revision><text>x</text></revision></page>\n" * 2)
    out = read_articles_exact_cap(spark, str(tmp_path), 3)
    assert out.count() == 3 and {f.rsplit("/", 1)[1] for f in out.inputFiles()} == {"f0.json", "f1.json", "f2.json"}
    (tmp_path / "dump").mkdir()
    for i in range(9):
        (tmp_path / f"d{i}.xml").rename(tmp_path / "dump" / f"d{i}.xml")
    pages = read_dump(spark, str(tmp_path / "dump"), max_pages=7)
    assert pages.count() == 7 and len(pages.inputFiles()) == 7
    assert read_dump(spark, str(tmp_path / "dump"), max_pages=0).count() == 0
    assert read_dump(spark, str(tmp_path / "dump"), max_pages=100).count() == 18


def test_text_files_grow_and_lines_are_not_shuffled(spark, tmp_path, monkeypatch):
    from semsift.plans import catalog as CT
    from semsift.sources.lines import numbered_lines
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "doc_id long, text string")
    assert CT._text_files(docs) == 4
    monkeypatch.setattr(CT, "TEXT_FILE_BYTES", 500)
    assert CT._text_files(docs) == 10
    docs.select("text").write.text(str(tmp_path / "lines"))
    plan = numbered_lines(spark.read.text(str(tmp_path / "lines")))._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
