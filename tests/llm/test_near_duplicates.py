import os
import random
import time

import numpy as np
from cohortal.llm import near_duplicates as N


def shingles(text):
    w = (text or "").encode().lower().split()
    return set(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows) if d is not None}


def check(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id is not None}
    assert got == brute(rows)


def test_awkward(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = N.near_duplicates(docs).collect()
    assert len(found) == len(rows) and N.near_duplicates(no_docs).count() == 0
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.doc_id is not None)


def test_chains_and_borderline_families(spark):
    rng, rows = random.Random(3), []
    for family in range(6):
        words = [f"f{family}w{i}" for i in range(120)]
        for _ in range(18):  # chains: each a changed copy of the one before
            k = rng.choice([0, 1, 2, 3, 5, 8])
            words = list(words)
            for _ in range(k):
                words[rng.randrange(len(words))] = f"n{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(len(rows) + i, passage + " " + " ".join(f"r{i}x{j}" for j in range(100))) for i in range(60)]
    rng.shuffle(rows)
    check(spark, rows)


def test_sketch_counts_differences():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, (1, N.BANDS * N.ROWS), dtype=np.uint64)
    b = a.copy()
    b[0, :10] = rng.integers(0, 1 << 63, 10, dtype=np.uint64)
    one, two = N.odd_sketches(a), N.odd_sketches(b)
    assert 8 <= np.bitwise_count(one ^ two).sum() <= 20 and np.bitwise_count(one ^ one).sum() == 0


def test_forest_connects_what_pairs_connect():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2, (5, N.SKETCH_BITS), dtype=np.uint8)
    rows = np.array([np.where(rng.random(N.SKETCH_BITS) < rng.uniform(0, 0.3), 1 - base[i % 5], base[i % 5]) for i in range(80)], np.uint8)
    sketches = np.packbits(rows, axis=1).view(np.uint64)
    parent = {"all": list(range(80)), "forest": list(range(80))}

    def find(p, x):
        while p[x] != x:
            x = p[x]
        return x

    for i in range(80):
        for j in range(i):
            if np.bitwise_count(sketches[i] ^ sketches[j]).sum() <= N.ALIKE:
                parent["all"][find(parent["all"], i)] = find(parent["all"], j)
    for i, j in N.bucket_forest(sketches):
        parent["forest"][find(parent["forest"], i)] = find(parent["forest"], j)
    groups = {k: {tuple(i for i in range(80) if find(p, i) == find(p, j)) for j in range(80)} for k, p in parent.items()}
    assert groups["all"] == groups["forest"]


def test_links_between_components():
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 1 << 60, 100, dtype=np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, 90, replace=False), rng.integers(0, 1 << 60, rng.integers(0, 30), dtype=np.uint64)])) for _ in range(40)]
    part = rng.integers(0, 6, 40)
    part[:20] = 0
    want = {(part[i], part[j]) for i in range(40) for j in range(40) if part[i] != part[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    links = N.bucket_links(sets, part)
    got = {(part[i], part[j]) for i, j in links} | {(part[j], part[i]) for i, j in links}
    assert got == want | {(b, a) for a, b in want} and want


def test_components(spark, monkeypatch):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 5), (5, 9), (4, 4)], "a long, b long")
    assert {r.node: r.component for r in N.components(links).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 7: 5, 8: 5, 9: 5}
    assert N.components(links.where("false")).count() == 0
    monkeypatch.setattr(N, "SMALL_GRAPH", -1)  # as for a large graph
    assert {r.node: r.component for r in N.components(links).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 7: 5, 8: 5, 9: 5}
    assert N.components(links.where("false")).count() == 0


def test_long_texts_and_graphs_in_rounds(spark, monkeypatch):
    """A text longer than a block, blocks of one text each, and components by rounds: the same rows."""
    rng = random.Random(6)
    long = [f"w{rng.randrange(5000)}" for _ in range(40000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:39000])), (3, " ".join(long[:25000])), (4, None), (5, "a b"), (6, "A  B")]
    rows += [(10 + i, " ".join(long[i * 100 : i * 100 + 100 + i % 2])) for i in range(40)] + [(100 + i, " ".join(long[i * 100 : i * 100 + 100])) for i in range(40)]
    monkeypatch.setattr(N, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(N, "SMALL_GRAPH", -1)
    check(spark, rows)


def test_shuffled_rows_of_finished_steps_are_deleted(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, folders = spark.conf.get(setting, None), [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    for _ in range(8):
        before = files()
        rows = N.written(spark.range(1000).repartition(3, "id"))
        until = time.time() + 1
        while files() - before and time.time() < until:
            time.sleep(0.02)
        assert not files() - before and rows.count() == 1000
    assert spark.conf.get(setting, None) == was


def test_second_look_spares_pairs_that_failed(spark):
    """Pairs just under the threshold share buckets, alone; their sets are not dealt out once more for each of these."""
    rng, rows = random.Random(11), []
    for pair in range(60):
        words = [f"p{pair}w{rng.random()}" for i in range(3000)]
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(words[:2460] + [f"{w}x" for w in words[2460:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = shuffled()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(docs).collect()}
    assert got == brute(rows) and len({c for _, c in got.values()}) == len(rows)
    assert shuffled() - before < 7 * 8 * sum(n for n, _ in got.values())


def test_buckets_looked_at_again(spark):
    lists = {1: "ab", 2: "abc", 3: "cba", 4: "abd", 5: "abcd", 6: "dbca", 7: "cd"}
    members = spark.createDataFrame([(b, k.encode()) for b, keys in lists.items() for k in keys], "bucket long, key binary")
    found = {}
    for r in N._looked_at(members).collect():
        found.setdefault(r.bucket, set()).add(bytes(r.key).decode())
    assert found == {2: set("abc"), 4: set("abd"), 5: set("abcd")}


def test_classes_that_share_an_id(spark, monkeypatch):
    real, rng, rows = N.F.xxhash64, random.Random(12), []
    monkeypatch.setattr(N.F, "xxhash64", lambda *c: real(*c) % 5 if len(c) == 1 else real(*c))
    for family in range(8):
        words = [f"f{family}w{i}" for i in range(100)]
        for _ in range(6):
            words = list(words)
            words[rng.randrange(100)] = f"n{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    check(spark, rows)
