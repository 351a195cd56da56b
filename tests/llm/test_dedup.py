"""Exact, line, span and SimHash deduplication against plain Python."""

import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexmend.llm import line_dedup, simhash, span_dedup
from lexmend.llm.exact_dedup import drop_exact_copies, exact_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, "a b"), (4, "a b"), (4, "a b"), (None, "a b"), (None, "x"), (5, "x\n" * 2000), (6, "ÄB c d"), (7, " "), (8, "x\n" * 2000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(spark, keep):
    got = exact_groups(frame(spark, ODD), keep=keep).collect()
    groups = defaultdict(list)
    for i, t in ODD:
        groups[t or ""].append(i)
    assert len(got) == len(ODD)
    by = defaultdict(list)
    for r in got:
        by[r["text_sha256"]].append(r)
    for text, ids in groups.items():
        rows = by[hashlib.sha256(text.encode()).hexdigest()]
        known = [i for i in ids if i is not None]
        want = (min if keep == "smallest" else max)(known) if known else None
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(map(str, ids))
        assert {r["keep_id"] for r in rows} == {want} and {r["group_size"] for r in rows} == {len(ids)}
        assert [r["doc_id"] for r in rows if r["kept"]] == [want]


def test_drop_exact_copies(spark):
    df = frame(spark, ODD).withColumn("_text", F.lit("clash")).withColumn("_hash", F.lit(1)).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    got = drop_exact_copies(df)
    assert got.columns == df.columns
    rows = got.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(["1", "3", "None", "5", "6", "7"])
    assert {r["_text"] for r in rows} == {"clash"}
    assert drop_exact_copies(df.limit(0)).count() == 0 and exact_groups(df.limit(0)).count() == 0


def brute_components(pairs):
    prints = sorted({f for _, f in pairs})
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for i, f in pairs:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return {f: least.get(find(f)) for f in prints}


def test_fingerprint_by_hand():
    import xxhash

    text = "The quick\tbrown Fox\n jumps Éh over the quick brown fox"
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), seed=42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One Two") == xxhash.xxh64_intdigest(b"one two", seed=42)


@pytest.mark.parametrize("n", [1, 3, 5])
def test_shingles_of_long_texts_in_blocks(monkeypatch, n):
    import xxhash

    rng = random.Random(3)
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 7)
    for _ in range(300):
        text = "".join(rng.choice("abÄ \n\t") for _ in range(rng.randint(0, 60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        want = [" ".join(words[i : i + n]) for i in range(max(len(words) - n + 1, bool(words)))]
        assert simhash.shingle_hashes(text, n).tolist() == [xxhash.xxh64_intdigest(x.encode(), 42) for x in want]


def test_simhash_components(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = list(ODD)
    for g in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((100 + len(rows), " ".join(copy)))
    got = simhash.simhash_components(frame(spark, rows)).collect()
    pairs = [(i, simhash.fingerprint(t)) for i, t in rows]
    want = brute_components(pairs)
    assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64), r["component_id"]) for r in got) == sorted((str(i), f, want[f]) for i, f in pairs)
    assert simhash.simhash_components(frame(spark, rows[:0] or []).limit(0)).count() == 0


@pytest.mark.parametrize("parts", [None, [simhash.Part(tuple(range(32)), 1), simhash.Part(tuple(range(32, 64)), 1)], [simhash.Part(tuple(range(20)), 2), simhash.Part(tuple(range(20, 64)), 0)]])
def test_links_find_every_near_pair(spark, parts, monkeypatch):
    """Dense clusters, chains and blocks: the same components as all pairs."""
    monkeypatch.setattr(simhash, "BLOCK", 40)
    rng = random.Random(9)
    prints = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(80):
            prints.add(x)
            y = x
            for _ in range(rng.randint(1, 3)):
                y ^= 1 << rng.randrange(64)
            x = y if rng.random() < 0.4 else x
            prints.add(y)
    prints |= {rng.getrandbits(64) for _ in range(200)}
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in prints]
    fps = spark.createDataFrame(signed, "fp long")
    edges = simhash.links(fps, 3, parts)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    got = {f: roots.get(f, f) for (f,) in signed}
    want = brute_components([(f, f % (1 << 64)) for (f,) in signed])
    assert got == {f: want[f % (1 << 64)] for (f,) in signed}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1001: 1000}


def test_drop_near_copies(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(9, text), (3, text), (5, text + " tail"), (11, "else entirely different words here"), (12, None), (13, " "), (14, "")]
    df = frame(spark, rows).withColumn("fp", F.lit("clash")).withColumn("r1", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("node", F.lit(2))
    got = simhash.drop_near_copies(df)
    assert got.columns == df.columns and {r["r1"] for r in got.collect()} == {"clash"}
    want = brute_components([(i, simhash.fingerprint(t)) for i, t in rows])
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({want[simhash.fingerprint(t)] for _, t in rows})
    assert (simhash.fingerprint(text) ^ simhash.fingerprint(text + " tail")).bit_count() <= 3


def in_order(rows):
    """Rows in the order of the corpus; copies of a row are marked."""
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        out.append((*r, r in seen))
        seen.add(r)
    return out


def brute_lines(rows):
    """Chunk after chunk in the order of the corpus, every match grown line by line."""
    seen, out = {}, []
    for i, t, copy in in_order(rows):
        if copy:
            out.append((i, *line_dedup.without(t, line_dedup.whole(t))))
            continue
        lines = (t or "").split("\n")
        cut = []
        for a, b, _, _, _, body in line_dedup.chunks(t):
            first, at = seen.setdefault(body, (lines, a))
            if first is lines and at == a:
                continue
            up = down = 0
            while up < line_dedup.REACH and min(a, at) > up and lines[a - up - 1].strip() == first[at - up - 1].strip() and (lines[a - up - 1] == first[at - up - 1] or not lines[a - up - 1].strip()):
                up += 1
            end = at + b - a
            while down < line_dedup.REACH and b + down < len(lines) and end + down < len(first) and (lines[b + down] == first[end + down] or not (lines[b + down] + first[end + down]).strip()):
                down += 1
            if sum(1 for x in lines[a - up : b + down] if x.strip()) > 1:
                cut.append((a - up, b + down))
        out.append((i, *line_dedup.without(t, sorted(cut))))
    return out


def line_results(spark, rows, **more):
    df = frame(spark, rows)
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    got = line_dedup.drop_repeated_lines(df).collect()
    return sorted(map(str, ((r["doc_id"], r["text"], r["n_lines"], r["removed_lines"]) for r in got)))


def test_line_dedup(spark):
    rng = random.Random(2)
    lines = [f"line {rng.random()}" for _ in range(400)]
    block = lines[:30]
    rows = [(1, None), (2, ""), (3, "one line"), (4, "\n\n\n"), (5, "x\ny\n" * 1000), (6, "one line"), (7, "é\n\nü"), (8, "ö\né\n \nü\n")]
    for i in range(10, 40):
        own = [rng.choice(lines[30:]) for _ in range(rng.randint(1, 20))]
        at = rng.randint(0, len(own))
        rows.append((i, "\n".join(own[:at] + (block if i % 3 else []) + own[at:])))
    # A row again, two texts under one id, and texts without one.
    rows += [rows[-1], rows[-1], (12, "\n".join(lines[100:110])), (None, "\n".join(lines[200:206])), (None, "\n".join(lines[203:208])), (None, "\n".join(lines[200:206]))]
    want = sorted(str((i, t, n, sum(b - a for a, b in gone))) for i, t, n, gone in brute_lines(rows))
    assert line_results(spark, rows, hash="clash", start=1, cut="x", key=2) == want
    got = {(r["doc_id"], r["text"]) for r in line_dedup.drop_repeated_lines(frame(spark, rows)).collect()}
    # A block of 30 lines is gone from all documents but the first with it.
    assert all(not set(t.split("\n")) & set(block) for i, t in got if i is not None and 10 < i < 39 and i % 3 and i != 12)
    assert (3, "one line") in got and (6, "one line") in got
    assert line_dedup.drop_repeated_lines(frame(spark, rows).limit(0)).count() == 0


def test_repeated_rows_are_repetitions(spark):
    rng = random.Random(7)
    text = "\n".join(" ".join(rng.choice("abcdef") * rng.randint(1, 9) for _ in range(12)) + "." for _ in range(30))
    for drop, gone in ((line_dedup.drop_repeated_lines, "removed_lines"), (span_dedup.drop_repeated_spans, "removed_sentences")):
        for rows in ([(1, text), (1, text), (2, text)], [(None, text)] * 3):
            assert sorted(r[gone] for r in drop(frame(spark, rows)).collect()) == [0, 30, 30]


def test_lines_of_one_hash(spark, monkeypatch):
    """Chunks whose first hash is the same are told apart, and copies among them go."""
    class Same:
        def __init__(self, *_, **__):
            pass

        def digest(self):
            return b"same"

    blocks = ["\n".join(f"{c} {i}" for i in range(5)) for c in "abcd"]
    rows = [(i, blocks[i % 4] + f"\nown {i}") for i in range(8)]
    monkeypatch.setattr(line_dedup, "blake2b", lambda *_, **__: Same())
    assert line_results(spark, rows) == sorted(str((i, t if i < 4 else f"own {i}", 6, 0 if i < 4 else 5)) for i, t in rows)


def test_short_blocks_are_found():
    """Of repeated blocks in unlike surroundings nearly all hold a whole chunk, from which the match grows."""
    rng = random.Random(5)
    for size, least in ((2, 0.7), (3, 0.85), (4, 0.95), (6, 0.99)):
        held = 0
        for _ in range(600):
            block = [f"b{rng.random()}" for _ in range(size)]
            a, b = ({x[5] for x in line_dedup.chunks("\n".join([f"{rng.random()}", f"{rng.random()}", *block, f"{rng.random()}"]))} for _ in range(2))
            held += bool(a & b)
        assert held > least * 600


def test_line_boundaries_resist_shifts():
    rng = random.Random(1)
    hashes = [rng.getrandbits(64) for _ in range(200)]
    a, b = line_dedup.boundaries(hashes), line_dedup.boundaries([5, *hashes])
    assert len({x + 1 for x in a} & set(b)) > 0.98 * len(a)
    assert max(np.diff([0, *line_dedup.boundaries([7] * 500)])) <= line_dedup.MOST


def brute_spans(rows):
    """Every run of several sentences with enough words, of any length."""
    seen, out = {}, []
    for i, t, copy in in_order(rows):
        if t is None:
            out.append((i, None))
            continue
        spans = span_dedup.sentences(t)
        bodies = [t[a:b].lower().split() for a, b in spans]
        cut = []
        for a in range(len(spans)):
            for b in range(a + 2, min(a + 12, len(spans)) + 1):
                run = [w for x in bodies[a:b] for w in x]
                if len(run) >= span_dedup.LEAST_WORDS and (copy or seen.setdefault(" ".join(run), (i, t, a)) != (i, t, a)):
                    cut.append((a, b))
        out.append((i, span_dedup.without(t, cut)[0]))
    return out


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)).capitalize() + "."


def test_span_dedup(spark):
    rng = random.Random(3)
    passage = " ".join(sentence(rng, rng.randint(5, 14)) for _ in range(7))
    short = " ".join(sentence(rng, n) for n in (4, 5, 5))
    rows = [(1, None), (2, ""), (3, "Short."), (4, passage + " " + passage), (5, "Yes. No. " * 3)]
    for i in range(10, 30):
        own = [sentence(rng, rng.randint(2, 15)) for _ in range(6)]
        own.insert(rng.randint(0, 6), passage if i % 2 else short)
        rows.append((i, ("\n" if i % 3 else " ").join(own)))
    # A row again, two texts under one id, and texts without one.
    rows += [rows[-1], (12, passage), (None, short), (None, "Alone here. " + short), (None, short)]
    df = frame(spark, rows).withColumn("hash", F.lit("clash")).withColumn("r1", F.lit(1)).withColumn("cut", F.lit("x"))
    got = span_dedup.drop_repeated_spans(df).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in got) == sorted(map(str, brute_spans(rows)))
    held = [(r["doc_id"], r["text"]) for r in got]
    assert ([t for i, t in held if i == 4][0]).strip() == passage and (3, "Short.") in held
    for i, t in held:
        if i is not None and 10 < i < 29:
            assert not [s for s in (passage if i % 2 else short).split(". ") if s.strip(".") in t]
    assert span_dedup.drop_repeated_spans(df.limit(0)).count() == 0


def test_sentences_take_linear_time():
    for text in ("." * 200_000 + "x", ".)" * 100_000 + "x", "a. " * 70_000, "\n" * 200_000, "x" * 200_000):
        began = time.perf_counter()
        span_dedup.sentences(text)
        assert time.perf_counter() - began < 1


def test_sentences_tile():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("ab .!?\n\"'") for _ in range(rng.randint(0, 40)))
        spans = span_dedup.sentences(text)
        assert "".join(text[a:b] for a, b in spans) == text.lstrip()


def jaccard(a, b, n=5):
    x, y = ({tuple(t.split()[i : i + n]) for i in range(max(1, len(t.split()) - n + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_with_edited_phrases_go(spark):
    """Similarity decides, far beyond 3 bits; texts of one fingerprint's reach that aren't similar stay."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    rows = []
    for g in range(60):
        base = [rng.choice(vocabulary) for _ in range(150)]
        copy = list(base)
        at, width = rng.randrange(10, 120), rng.randint(1, 14)
        copy[at : at + width] = [rng.choice(vocabulary) for _ in range(width)]
        rows += [(2 * g + 1, " ".join(base)), (2 * g, " ".join(copy))]
    near = {i for (i, a), (_, b) in zip(rows[::2], rows[1::2], strict=True) if jaccard(a, b) >= 0.8}
    wide = [i for (i, a), (_, b) in zip(rows[::2], rows[1::2], strict=True) if i in near and (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 3]
    assert len(wide) > 20
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()}
    assert got <= {i for i, _ in rows} and not got & set(wide)
    assert got == {i for i, _ in rows} - near


@pytest.mark.parametrize("settings", [{}, {"distance": 14, "n": 5, "least_similarity": 0.8}])
def test_near_copies_go_by_row(spark, settings):
    """Null and shared ids neither take clean texts along nor keep copies."""
    text = " ".join(f"w{i}" for i in range(400))
    own = [" ".join(f"{c}{i * 7 % 31}{i}" for i in range(60)) for c in "defgh"]
    rows = [(7, text), (None, text + " tail"), (7, text + " end"), (None, own[0]), (None, own[1]), (9, text + " more"), (9, own[2]), (12, own[3]), (12, own[3])]
    got = sorted(r["text"] for r in simhash.drop_near_copies(frame(spark, rows), **settings).collect())
    assert len([t for t in got if t.startswith("w0 ")]) == 1
    assert [t for t in got if not t.startswith("w0 ")] == sorted(own[:4])
    nulls = [(None, text), (None, text + " tail"), (None, own[4])]
    assert len(simhash.drop_near_copies(frame(spark, nulls), **settings).collect()) == 2
    assert simhash.drop_near_copies(frame(spark, rows).limit(0), **settings).count() == 0


def test_groups_of_near_copies_are_not_paired_off(spark, monkeypatch):
    """A group of copies is joined by about as many pairs as it has members; links between groups are all looked at."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    rows = []
    for size in (150, 40, 1, 1, 3):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    # A chain, each text like the next one alone.
    words = [f"w{i}" for i in range(300)]
    rows += [(1000 - i, " ".join(words[i * 8 : i * 8 + 150])) for i in range(10)]
    made = {}

    def counted(df, name, f=simhash.staged):
        out = f(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(simhash, "staged", counted)
    monkeypatch.setattr(simhash, "BLOCK", 30)
    monkeypatch.setattr(simhash, "SET_BLOCK", 20)
    got = simhash.drop_near_copies(frame(spark, rows), distance=14, n=5, least_similarity=0.8)
    assert {r["doc_id"] for r in got.collect()} == brute_similar(rows)
    assert made["simhash-pairs"][0] < 3000 and made["simhash-keys"][0] <= 205 and made["simhash-more"][0] < 1000


def test_similar_forest():
    """Edges that join what all similar pairs join, and no others."""
    rng = np.random.default_rng(5)
    for _ in range(40):
        sets = [np.unique(rng.integers(0, 30, int(rng.integers(1, 25)))) for _ in range(int(rng.integers(2, 25)))]
        groups = rng.integers(0, 8, len(sets))
        edges = simhash.similar_forest(np.arange(len(sets)), groups, sets, 0.6)
        alike = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.6 * len(np.union1d(sets[i], sets[j]))
        assert all(alike(i, j) for i, j in edges)

        def joined(pairs, groups=groups):
            root = {int(g): int(g) for g in groups}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for i, j in pairs:
                root[find(int(groups[i]))] = find(int(groups[j]))
            return [[find(int(a)) == find(int(b)) for b in groups] for a in groups]

        every = [(i, j) for i in range(len(sets)) for j in range(i) if alike(i, j)]
        assert joined(edges) == joined(every) and len(edges) < len(set(groups.tolist()))


def test_nearest_forest():
    """As many edges as components ask for, and of least total distance."""
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(2, 30))
        base = rng.integers(0, 2**63, 2, dtype=np.uint64)
        flips = lambda: np.array([sum(1 << int(b) for b in set(rng.integers(0, 64, int(rng.integers(0, 7))))) for _ in range(n)], dtype=np.uint64)
        fps, more = base[0] ^ flips(), base[1] ^ flips()
        weight = {(i, j): int(np.bitwise_count(fps[i] ^ fps[j])) + int(np.bitwise_count(more[i] ^ more[j])) for i in range(n) for j in range(i) if np.bitwise_count(fps[i] ^ fps[j]) <= 5 and np.bitwise_count(more[i] ^ more[j]) <= 6}
        root, want = list(range(n)), []

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for (i, j), w in sorted(weight.items(), key=lambda x: x[1]):
            if find(i) != find(j):
                root[find(i)] = find(j)
                want.append(w)
        a, b = simhash.nearest_forest(fps, more, np.arange(n), 5, 6)
        assert sorted(weight[max(i, j), min(i, j)] for i, j in zip(a.tolist(), b.tolist(), strict=True)) == sorted(want)


def brute_similar(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if jaccard(a, b) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {find(i) for i, _ in rows}


def test_prefixes_of_similar_sets_meet():
    """Whatever shingles count as common, two sets of that similarity share a hash of their prefixes; a set of s gives a fifth of s and one."""
    rng = np.random.default_rng(8)
    met = 0
    for _ in range(3000):
        a = np.unique(rng.integers(0, 2**64, int(rng.integers(1, 60)), dtype=np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) > 0.1], rng.integers(0, 2**64, int(rng.integers(0, 8)), dtype=np.uint64))))
        common = np.sort(rng.permutation(np.concatenate((a, b)))[: int(rng.integers(0, 40))])
        shared = len(np.intersect1d(a, b))
        one, two = simhash.prefix(a, common, 0.8), simhash.prefix(b, common, 0.8)
        assert len(one) <= len(a) / 5 + 1
        if len(b) and shared >= 0.8 * (len(a) + len(b) - shared):
            met += 1
            assert len(np.intersect1d(one, two)), (a, b, common)
    assert met > 300 and not len(simhash.prefix(np.zeros(0, "<u8"), common, 0.8))


def unrelated(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(f"{rng.randrange(10**6)}" for _ in range(40))) for i in range(n)]


def test_search_for_near_copies_in_proportion(spark, monkeypatch):
    """Unrelated texts are hardly ever looked at as pairs, and a group of copies or a passage that many have changes no result."""
    looked = []

    def counted(rows, block, salt, *more, f=simhash.dealt):
        c = F.col("count").cast("double")
        looked.append(rows.groupBy("key").count().agg(F.sum(c * (c - 1) / 2)).collect()[0][0] or 0.0)
        return f(rows, block, salt, *more)

    monkeypatch.setattr(simhash, "dealt", counted)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = unrelated(1200, 1)
    rows = [(i, f"{t} {passage}") if i % 3 == 0 else (i, t) for i, t in rows]
    got = simhash.drop_near_copies(frame(spark, rows), distance=14, n=5, least_similarity=0.8)
    assert got.count() == len(rows)
    # The first search is for half the distance; the others look for all that is left.
    assert sum(looked[1:]) < 5 * len(rows), looked


def test_links_beyond_the_fingerprints_are_found(spark):
    """Small sets whose similarity is 0.8 though each of the two fingerprints is further apart than the distance."""
    rng, rows = random.Random(4), []
    while len(rows) < 40:
        words = [f"{rng.randrange(10**6)}" for _ in range(9)]
        a, b = " ".join(words[:8]), " ".join(words)
        (f, g, _), (h, k, _) = simhash.sketch(a, 5), simhash.sketch(b, 5)
        if min((f ^ h).bit_count(), (g ^ k).bit_count()) > 14 and (f ^ h).bit_count() + (g ^ k).bit_count() <= simhash.WIDE:
            rows += [(len(rows), a), (len(rows) + 1, b)]
    assert all(jaccard(a, b) == 0.8 for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True))
    got = simhash.drop_near_copies(frame(spark, rows), distance=14, n=5, least_similarity=0.8)
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(0, 40, 2))


def test_components_at_once(spark):
    """One task joins as the rounds do, and asks for fewer jobs."""
    rng = random.Random(2)
    pairs = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(280)] + [(7, 7), (500, 501), (501, 500)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    jobs, found = [], []
    for at_once in (0, 1000, 10):
        spark.sparkContext.setJobGroup(f"components {at_once}", "")
        found.append({r["node"]: r["root"] for r in simhash.components(edges, at_once=at_once).collect()})
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components {at_once}")))
    spark.sparkContext.setJobGroup("", "")
    assert found[0] == found[1] == found[2] and found[0][501] == 500 and 7 not in set(found[0]) - {x for p in pairs for x in p}
    assert 3 * jobs[1] < jobs[0], jobs
