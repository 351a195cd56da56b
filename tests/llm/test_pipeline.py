"""The stages one after the other, each against what it was given."""

from collections import Counter
from pathlib import Path

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from lexmend.llm import langid
from lexmend.llm.common import crc_bucket
from lexmend.llm.mixing import mix_plan
from lexmend.llm.queries import oracle_sql, queries
from lexmend.llm.tokens import PATTERN, VOCABULARY, encoder

pytestmark = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary")


def shingles(text, n=5):
    words = text.lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def brute_near(rows):
    """One row of each component of texts with similarity 0.8 or more: that with the smallest id, null last; the texts of which ties can't be told apart by id are returned as sets."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            shared = len(x & sets[j])
            if shared >= 0.8 * (len(x) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(find(i), []).append(row)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def test_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    known = [r["text"] for r in docs.orderBy("doc_id").limit(60).collect() if len(r["text"].split()) > 40]
    edited = lambda t: " ".join(["changed", *t.split()[1:]])
    turned = lambda t: " ".join(reversed(t.split()))
    long = " ".join(" ".join(known).split() * 40)
    odd = [
        (10**6, None, None, None, None), (None, None, "en", "src0", 1), (10**6 + 1, "123 !!", "en", "src0", 3), (10**6 + 2, known[0], "en", "src1", 1),
        (None, known[1], None, None, None), (None, edited(known[2]), "en", "src0", 1), (None, "one " + edited(known[2]), "en", "src0", 1), (None, known[3] + " " + known[4], "en", "src2", 1),
        (None, turned(known[8]), "en", "src2", 1), (None, turned(known[9]), None, "src2", 1), (5, known[5] + " " + known[6], "en", "src2", 1), (10**6 + 3, edited(known[7]), "en", None, None), (10**6 + 4, long, "en", "src3", 1), (10**6 + 5, "Пример русского текста для проверки", "ru", "src3", 1),
    ]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("id", F.lit("clash")).withColumn("r1", F.lit("clash"))
    held = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held[-1], folder).write.parquet(path := str(tmp_path / str(i)))
        held.append(spark.read.parquet(path))
    assert all(d.columns == docs.columns for d in held[:5])
    rows = [[(r["doc_id"], r["text"]) for r in d.collect()] for d in held[:5]]
    kept = [Counter(r) for r in rows]
    model = langid.fit(langid.training_rows(docs, crc_bucket(F.col("doc_id")) == 0))
    ready = [langid.prepared(t) for _, t in rows[0]]
    assert kept[1] == Counter(r for r, b, f in zip(rows[0], ready, model.fits(ready), strict=True) if b and f >= corpus_pipeline.LEAST_FIT)
    assert len(rows[0]) - len(rows[1]) == 3 and not {10**6, 10**6 + 1} & {i for i, _ in rows[1]}, kept[0] - kept[1]
    least = {}
    for i, t in rows[1]:
        least[t] = min((i is None, i or 0), least.get(t, (True, 0)))
    assert kept[2] == Counter((None if last else i, t) for t, (last, i) in least.items())
    assert kept[3] == Counter(brute_near(rows[2]))
    assert len(rows[3]) < len(rows[2]) and not {edited(known[7]), edited(known[2])} & {t for _, t in rows[3]}
    assert any(t == long for _, t in rows[3]) and {(None, turned(known[8])), (None, turned(known[9]))} <= set(kept[3])
    plan = Counter()
    for r in mix_plan(held[3]).collect():
        plan[r["doc_id"], r["size"]] += r["copies"]
    mixed = Counter(rows[4])
    assert set(mixed) <= set(kept[3]) and max(mixed.values()) <= 3
    assert Counter((i, len(t.split())) for i, t in rows[4]) == Counter({k: n for k, n in plan.items() if n})
    packed = Counter()
    for r in held[5].collect():
        packed[r["doc_id"]] += r["length"]
    encode = encoder(Path(VOCABULARY).read_bytes(), PATTERN).encode_ordinary
    tokens = Counter()
    for i, t in rows[4]:
        tokens[i] += len(encode(t))
    assert packed == tokens


def test_run_leaves_one_table(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100
    stages = {Path(f.removeprefix("file:")).parent for f in out.inputFiles()}
    assert len(stages) == 1 and [p.name for p in next(iter(stages)).parent.iterdir()] == ["4-packing"]


def test_stages_of_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").count() == 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    frame = queries()[name](spark, "/root/testdata/sf0.001")
    columns = sorted(frame.columns)
    cursor = con.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert sorted(tuple(str(r[c]) for c in columns) for r in frame.collect()) == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
