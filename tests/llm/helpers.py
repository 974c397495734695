"""Small fixtures: whole sf0.001 documents plus planted and awkward rows."""
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Names that the operators could use inside; extra columns must not disturb them.
CLASHING = ("row", "id", "key", "n", "h", "node", "region", "tokens", "rate", "words", "kept", "digest", "keep_id",
            "domain", "posterior", "host", "failures", "found", "held", "seg")


def documents(spark, sf="/root/testdata/sf0.001"):
    return spark.read.parquet(f"{sf}/documents.parquet")


def awkward(spark):
    """Nulls in every column, empty and blank texts, a long text, ties and repeated rows."""
    line = " ".join(f"word{i}" for i in range(60))
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", "en", "b", 4),
            (4, line, "en", "a", 1), (4, line, "en", "a", 1), (5, line, "en", None, 1), (None, line, "en", "a", 1),
            (6, line + "\nextra tail words here", "de", "b", 1), (7, "one", "en", "b", 3), (8, "One", "en", "b", 3),
            (9, "x " * 30_000 + "end", "en", "a", 1), (10, "é ü   日本 <|endoftext|> \x1c y", "fr", "c", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def with_clashes(df):
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    """Words with A-Z lowered, other letters as they are."""
    return [w.encode().lower().decode() for w in words(text)]


def planted(spark):
    """Documents with exact and near copies, shared passages and repeated rows."""
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in documents(spark).collect()]
    base = sorted(rows)[:40]
    passage = " ".join(f"shared{i}" for i in range(55))
    more = []
    for k, r in enumerate(base):
        t = r[1].split(" ")
        more.append((1000 + k, r[1], *r[2:]))                                             # exact copy
        more.append((2000 + k, " ".join(t[: len(t) // 2] + ["changed"] + t[len(t) // 2 + 1:]), *r[2:]))
        more.append((3000 + k, r[1].replace(" ", "  ", 3), *r[2:]))                         # same but for spaces
        more.append((4000 + k, f"own{k} start\n{passage}\nown{k} end", *r[2:]))
    return spark.createDataFrame(rows + more, SCHEMA)
