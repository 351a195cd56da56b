"""Mixing and packing against plain Python."""

import math
from collections import Counter, defaultdict
from hashlib import md5
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmend.llm import mixing
from lexmend.llm.common import n_words, read
from lexmend.llm.mixing import mix, mix_plan
from lexmend.llm.packing import choose_boundaries, pack
from lexmend.llm.tokens import PATTERN, VOCABULARY, encoder, token_counts

SCHEMA = "doc_id long, text string, source string"
ROWS = [(i, " ".join(["w"] * (i * 7 % 60)), ("a", "b", "c", "d", None)[i % 5] if i % 3 else "a") for i in range(400)] + [(None, "x y", "b"), (7, None, "c"), (8, "", "z"), (9, "one", "z"), (9, "one", "z"), (11, "only here", "é")]


def plan_by_hand(rows, prefer=None):
    """Targets by repeated resharing, and the sample by going through all ranks: (id, source, size, copies) of every row."""
    size = lambda t: len((t or "").split())
    preference = prefer or (lambda r: 512 * 1024 // (512 + len((r[1] or "").encode())))
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += size(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, fixed = {}, {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = sum(sizes.values()) - sum(fixed.values())
        target = fixed | {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            break
        fixed |= {s: 3.0 * sizes[s] for s in over}
    taken = []
    for s in order:
        own = [r for r in rows if r[2] == s]
        ratio = min(target[s] / sizes[s], 3.0) if sizes[s] else 0.0
        whole, f = math.floor(ratio), ratio - math.floor(ratio)
        left = target[s] - whole * sizes[s]
        mean = sum(size(r[1]) * preference(r) for r in own) / max(sizes[s], 1)
        ranked = []
        for r in own:
            if size(r[1]) and f > 0:
                p = max(1e-9, min(1 - 1e-9, f + (preference(r) - mean) / 1024 * min(f, 1 - f)))
                text = md5((r[1] or "").encode()).hexdigest()
                u = (int(md5(f"{'' if r[0] is None else r[0]}/{text}/7".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
                ranked.append((u / (1 - u) / (p / (1 - p)), r[0] is not None, r[0] or 0, size(r[1])))
            else:
                taken.append((r[0], s, size(r[1]), whole))
        for _, known, i, n in sorted(ranked):
            fits = n <= left
            left -= n * fits
            taken.append((i if known else None, s, n, whole + fits))
        if ranked:
            drawn = Counter()
            for i, own_source, n, copies in taken:
                if own_source == s and n and copies == whole:
                    drawn[n] += 1
            assert not drawn or min(drawn) > left
    return target, Counter(taken), sizes


def check_plan(df, rows, **more):
    target, taken, sizes = plan_by_hand(rows, **more)
    got = mix_plan(df, prefer_col="x" if more else None).collect()
    words = Counter()
    for r in got:
        words[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
    assert Counter((r["doc_id"], r["source"], r["size"], r["copies"]) for r in got) == taken
    return target, words


def test_mix_plan(spark):
    target, words = check_plan(spark.createDataFrame(ROWS, SCHEMA), ROWS)
    # Documents of one word fit every gap of a word.
    assert all(target[s] - 60 < words[s] <= target[s] for s in target)
    assert sum(target.values()) == pytest.approx(sum(plan_by_hand(ROWS)[2].values()))


def test_mix_without_ids_and_with_repeated_rows(spark):
    """Rows are drawn one by one: equal rows and null ids don't go together."""
    rows = [(None if i % 2 else i % 40, "w " * 20, "ab"[i // 2 % 2]) for i in range(1200)] + [(None, "w " * 7, "c") for _ in range(400)]
    target, words = check_plan(spark.createDataFrame(rows, SCHEMA), rows)
    assert all(target[s] - 20 < words[s] <= target[s] for s in target)


def test_mix_closes_the_gap_of_a_huge_document(spark, monkeypatch):
    from lexmend.llm import mixing

    monkeypatch.setattr(mixing, "MOST", 50)
    monkeypatch.setattr(mixing, "REACH", 1)
    rows = [(i, "w " * (3 + i % 9), "a" if i % 3 else "b") for i in range(900)] + [(9000 + i, "w " * 1500, "ab"[i % 2]) for i in range(2)]
    target, words = check_plan(spark.createDataFrame(rows, SCHEMA), rows)
    assert all(words[s] <= target[s] for s in target)


def test_mix_repeats_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("u", F.lit("clash")).withColumn("target", F.lit(1)).withColumn("_row_key", F.lit("clash"))
    plan = Counter()
    for r in mix_plan(df).collect():
        plan[r["doc_id"], r["source"], r["size"]] += r["copies"]
    got = Counter((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in mix(df).collect())
    assert got == Counter({k: n for k, n in plan.items() if n}) and mix(df).columns == df.columns
    assert mix(df.limit(0)).count() == 0 and mix_plan(df.limit(0)).count() == 0


def test_mix_of_files_and_of_frames_agree(spark, tmp_path):
    """A scan of files has row numbers; other frames are written first."""
    spark.createDataFrame(ROWS, SCHEMA).repartition(5).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    names = ["doc_id", "source", "size", "copies"]
    assert Counter(mix_plan(stored).select(*names).collect()) == Counter(mix_plan(stored.repartition(3)).select(*names).collect())
    assert Counter(mix(stored).select("doc_id", "text").collect()) == Counter(mix(stored.repartition(3)).select("doc_id", "text").collect())


def test_mix_joins_rows_with_their_targets_once(spark, monkeypatch):
    joins, staged = Counter(), mixing.staged

    def counted(df, name):
        joins[name] += df._jdf.queryExecution().analyzed().toString().count("Join ")
        return staged(df, name)

    monkeypatch.setattr(mixing, "staged", counted)
    assert mix_plan(read(spark, "/root/testdata/sf0.001", "documents")).count() == 200
    # Each is a broadcast table in the driver: targets, coarse and fine ranges, cuts.
    assert sum(joins[f"mix-{x}"] for x in ("scored", "coarse", "fine", "first", "cuts")) <= 4


def test_mix_preferences(spark):
    """Inclusion odds differ inside a source: shorter documents are drawn more often, or those with a higher preference."""
    rows = [(i, "a b c d" if i % 2 else "word " * 400, "s" if i % 4 < 2 else "big") for i in range(3000)] + [(9999, "w " * 40000, "huge")]
    copies = defaultdict(list)
    for r in mix_plan(spark.createDataFrame(rows, SCHEMA)).collect():
        copies[r["source"], r["size"]].append(r["copies"])
    assert np.mean(copies["big", 4]) > 1.2 * np.mean(copies["big", 400])
    rows = [(i, "a b c d", "s" if i % 2 else "big", (0.0, 1.0, None, 7.0)[i % 4]) for i in range(800)]
    check_plan(spark.createDataFrame(rows, SCHEMA + ", x double"), rows, prefer=lambda r: int(1024 * min(max(0.5 if r[3] is None else r[3], 0), 1)))


def test_mix_of_a_long_text(spark):
    rows = [(1, "word " * 6_000_000, "a"), (2, "b " * 1000, "b"), (3, None, None)]
    got = {r["doc_id"]: r for r in mix_plan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1]["size"] == 6_000_000 and got[2]["taken"] == 3000 and got[3]["taken"] == 0


def test_boundaries_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        lengths = rng.choice(30, size=int(rng.integers(1, 9)), replace=False) + 1
        histogram = {int(x): int(rng.integers(1, 20)) for x in lengths}
        k = int(rng.integers(1, 5))

        def waste(ends):
            return sum(n * (min(e for e in ends if e >= x) - x) for x, n in histogram.items())

        top = max(histogram)
        best = min(waste([*c, top]) for n in range(min(k, len(histogram))) for c in combinations(sorted(histogram)[:-1], n))
        ends = choose_boundaries(histogram, k)
        assert ends[-1] == top and len(ends) <= k and waste(ends) == best
    assert choose_boundaries({}, 4) == []


@pytest.mark.parametrize("range_rows", [7, 20_000])
def test_pack(spark, monkeypatch, range_rows):
    from lexmend.llm import packing

    monkeypatch.setattr(packing, "RANGE_ROWS", range_rows)
    rows = [(i, "w " * (i * 13 % 90)) for i in range(300)] + [(None, "a b"), (1, None), (5, ""), (6, "x " * 1000), (6, "x " * 1000)]
    words_of = n_words(F.col("text"))
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), words_of, max_length=64, n_buckets=4, token_budget=256).collect()
    # No word is lost, and no batch is over its budget.
    words = Counter()
    for r in got:
        words[r["doc_id"]] += r["length"]
    want = Counter()
    for i, t in rows:
        want[i] += len((t or "").split())
    assert words == Counter({i: n for i, n in want.items() if n})
    assert all(0 < r["length"] <= r["bucket"] <= 64 for r in got)
    ends = sorted({r["bucket"] for r in got})
    assert all(min(e for e in ends if e >= r["length"]) == r["bucket"] for r in got)
    batches = defaultdict(list)
    for r in got:
        batches[r["bucket"], r["batch"]].append(r["slot"])
    for bucket in ends:
        held = 256 // bucket
        own = [batches[bucket, b] for b in range(len([k for k in batches if k[0] == bucket]))]
        assert all(sorted(x) == list(range(held)) for x in own[:-1]) and sorted(own[-1]) == list(range(len(own[-1])))
    assert pack(spark.createDataFrame([], "doc_id long, text string"), words_of).count() == 0
    again = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("clash")).withColumn("bucket", F.lit("clash")).withColumn("piece", F.lit("clash"))
    assert Counter((r["doc_id"], r["length"], r["bucket"]) for r in pack(again, words_of, max_length=64, n_buckets=4, token_budget=256).collect()) == Counter((r["doc_id"], r["length"], r["bucket"]) for r in got)
    with pytest.raises(ValueError):
        pack(spark.createDataFrame(rows, "doc_id long, text string"), words_of, token_budget=10)


@pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary")
def test_token_counts(spark):
    rows = [(1, "The quick brown fox, naïve café 😀\n\nx"), (2, None), (3, ""), (None, "<|endoftext|>"), (4, "word " * 5000), (4, "word " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.lit("clash"))
    encode = encoder(Path(VOCABULARY).read_bytes(), PATTERN)
    got = Counter((r["doc_id"], r["tokens"]) for r in token_counts(df).collect())
    assert got == Counter((i, len(encode.encode_ordinary(t or ""))) for i, t in rows)
    assert all(encode.decode(encode.encode_ordinary(t)) == t for _, t in rows if t)
    assert token_counts(df.limit(0)).count() == 0


@pytest.mark.parametrize("row_col", [None, "n"])
def test_rows_without_ids_are_spread(spark, monkeypatch, row_col):
    """A third of the rows have no id and one text: each has its own place in the order, none lies in one range with all the others."""
    from lexmend.llm import packing

    held = {}
    monkeypatch.setattr(packing, "staged", lambda df, name, f=packing.staged: held.setdefault(name, f(df, name)))
    monkeypatch.setattr(packing, "RANGE_ROWS", 20)
    rows = [(None if i % 3 == 0 else i, "a b c", i) for i in range(600)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, n long"), n_words(F.col("text")), row_col=row_col, max_length=8, token_budget=12).collect()
    assert len(got) == 600 and len({(r["bucket"], r["batch"], r["slot"]) for r in got}) == 600
    assert held["pack-pieces"].select("h").distinct().count() == 600
    counts = [b - a for a, b in zip(sorted(r["ahead"] for r in held["pack-ranges"].collect()), sorted(r["ahead"] for r in held["pack-ranges"].collect())[1:], strict=False)]
    assert max(counts) < 60


@pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary")
def test_long_texts_are_counted_in_pieces(spark, monkeypatch):
    from lexmend.llm import tokens

    encode = encoder(Path(VOCABULARY).read_bytes(), PATTERN).encode_ordinary
    monkeypatch.setattr(tokens, "PIECE", 50)
    rng = np.random.default_rng(2)
    for _ in range(200):
        text = "".join(rng.choice(list("ab é1!\n ' "), int(rng.integers(0, 400))))
        assert tokens.count(text, encode) == len(encode(text))
    with pytest.raises(FileNotFoundError, match="LEXMEND_VOCABULARY"):
        token_counts(spark.createDataFrame([(1, "x")], "doc_id long, text string"), vocabulary="/nowhere")
