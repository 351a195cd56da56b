import gzip
import re

import pytest
from pyspark.sql import functions as F

from lexmend import kernel
from lexmend.functions import sql
from lexmend.sources import read_lines, read_table, read_texts, read_warc, write_texts
from lexmend.streaming import fix_stream, start_fixed

TEXTS = ["plain", "l’étÃ©\r\nÃ  la", "", None, "&lt;b&gt; “x”"]


def fixed(texts):
    return sorted(str(t if t is None else kernel.fix_text(t)) for t in texts)


def test_tables_and_writer(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(t,) for t in TEXTS], "text string").write.parquet(path)
    write_texts(read_table(spark, path, "text"), str(tmp_path / "out"), column="text")
    assert sorted(str(r["text"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == fixed(TEXTS)
    with pytest.raises(ValueError):
        read_table(spark, path, "html")


def test_lines_and_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\r\ntwo\n\nthree".encode())
    assert [r["text"] for r in read_lines(spark, str(tmp_path)).collect()] == ["one\r", "two", "", "three"]
    assert [r["text"] for r in read_texts(spark, str(tmp_path)).collect()] == ["one\r\ntwo\n\nthree"]


def record(kind, uri, body, version="1.0"):
    return f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_warc(spark, tmp_path, packed):
    bodies = {
        "http://a/": "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>Ã©tÃ©</p>\r\n\r\nend\r\n\r\n\n".encode(),
        "http://b/": "plain\ntext about the mark WARC/1.0\r\nwhich WARC-Type: response lines follow".encode(),
        "http://c/": b"caf\xe9 \x81",
        "http://d/": b"",
        "http://e/": "ten records é".encode() + b"\r\n\r\nWARC/1.0\r\nrest",
    }
    data = record("warcinfo", "", b"software: x") + b"".join(record("response" if u == "http://a/" else "conversion", u, b) for u, b in bodies.items())
    path = tmp_path / ("x.warc.gz" if packed else "x.warc")
    path.write_bytes(gzip.compress(data) if packed else data)
    got = read_warc(spark, str(path)).orderBy("uri").collect()
    assert [r["uri"] for r in got] == list(bodies) and [r["complete"] for r in got] == [True] * 4 + [False]
    assert [bytes(r["data"]) for r in got][1:4] == list(bodies.values())[1:4]
    assert [r["body"] for r in got][:4] == ["<p>Ã©tÃ©</p>\r\n\r\nend\r\n\r\n\n", bodies["http://b/"].decode(), "café \x81", ""]
    (tmp_path / "y.warc").write_bytes(record("resource", "http://f/", b"x", "1.1") * 2)
    assert read_warc(spark, str(tmp_path / "y.warc"), version="1.1").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    frame = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3)
    frame.write.parquet(path)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    start_fixed(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(str(r["text"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == fixed(TEXTS)
    with pytest.raises(ValueError):
        fix_stream(frame)


def test_sql_functions(spark):
    names = sql.register(spark, prefix="t_")
    frame = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    frame.createOrReplaceTempView("sql_texts")
    got = spark.sql("SELECT text, t_fix_text(text) AS a, t_badness(text) AS b, t_fix_and_explain(text).text AS c, t_possible_latin_1(text) AS d FROM sql_texts").collect()
    for r in got:
        t = r["text"]
        assert (r["a"], r["b"]) == ((None, None) if t is None else (kernel.fix_text(t), kernel.badness(t)))
        assert r["c"] == (None if t is None else kernel.fix_and_explain(t)[0])
        assert r["d"] is None if t is None else r["d"] == kernel.possible_encoding(t, "latin-1")
    for name in names:
        frame.select(F.expr(f"{name}(text)")).collect()
    explained = {r["text"]: r["e"] for r in spark.sql("SELECT text, t_fix_and_explain(text) AS e FROM sql_texts").collect()}
    assert explained[None] is None
    assert {t: (e["text"], [s["transformation"] for s in e["steps"]]) for t, e in explained.items() if t is not None} == {t: kernel.fix_and_explain(t) for t in TEXTS if t is not None}
    assert {r["text"]: r["u"] for r in spark.sql("SELECT text, t_unescape_html(text) AS u FROM sql_texts").collect()} == {t: t if t is None else kernel.unescape_html(t) for t in TEXTS}


@pytest.mark.parametrize("name", ["fix_text", "fix_encoding", "unescape_html", "fix_and_explain"])
def test_sql_functions_pass_null_for_clean_texts(spark, name):
    """The Python function behind a name gets a masked argument, never the column itself."""
    sql.register(spark, prefix="m_")
    spark.createDataFrame([("x",)], "text string").createOrReplaceTempView("sql_masked")
    plan = spark.sql(f"SELECT m_{name}(text) AS x FROM sql_masked")._jdf.queryExecution().optimizedPlan().toString()
    calls = re.findall(rf"m_{name}_kernel\(([^\n]*)", plan)
    assert calls and all(c.lstrip().startswith(("CASE WHEN", "_", "if (")) for c in calls), plan[:800]
