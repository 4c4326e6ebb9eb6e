import re
import zlib

from cohortal.llm import mixing as M
from cohortal.llm import sharding as H


def test_targets(spark):
    def brute(sizes):
        names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
        total, capped = 1.5 * sum(sizes.values()), {}
        while True:
            rest = {s for s in names if s not in capped}
            level = (total - sum(capped.values())) / max(1, sum(weight[s] for s in rest))
            over = {s for s in rest if weight[s] * level >= 2 * sizes[s]}
            if not over:
                return {s: capped.get(s, weight[s] * level if s in rest else 0) for s in names}
            capped |= {s: 2 * sizes[s] for s in over}

    for sizes in ({"a": 100, "b": 900, "c": 50, "d": 10, None: 300}, {"a": 0, "b": 5}, {"a": 7}, {"é": 5, "z": 6, "Z": 80}):
        got = {r.source: r.target for r in M.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = brute(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes), (got, want)


def test_mix(spark, docs, no_docs):
    rows = M.mix(docs).collect()
    assert len(rows) == docs.count() and M.mix(no_docs).count() == 0
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    taken, target = {}, {}
    for r in rows:
        assert r.size == sizes[r.doc_id] and r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in taken)
    again = M.mix(docs.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    near = M.mix(docs, boundary="nearest").collect()
    assert all(r.taken % r.size == 0 for r in near if r.size)


def test_good_documents_come_first(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "s") for i in range(2000)] + [(5000, "w " * 60000, "t")], "doc_id long, text string, source string")
    weights = spark.createDataFrame([(i, 4.0 if i < 1000 else 0.25) for i in range(2000)], "doc_id long, quality_weight double")
    rows = [r for r in M.mix(docs, weights, weights=(1, 19)).collect() if r.source == "s"]
    extra = [r.doc_id for r in rows if r.taken > r.epochs * r.size]
    assert len(extra) == 600 and sum(i < 1000 for i in extra) > 500


def test_curve_visits_neighbours(spark):
    from pyspark.sql import functions as F

    for n, bits in ((2, 3), (3, 2)):
        side = range(1 << bits)
        cells = spark.createDataFrame([tuple((i >> (bits * k)) % (1 << bits) for k in range(n)) for i in range(1 << (bits * n))], ", ".join(f"c{k} int" for k in range(n)))
        order = cells.withColumn("h", H.hilbert_index([F.col(f"c{k}") for k in range(n)], bits)).orderBy("h").collect()
        assert [r.h for r in order] == list(range(len(side) ** n))
        assert all(sum(abs(a[k] - b[k]) for k in range(n)) == 1 for a, b in zip(order, order[1:]))


def test_shard(spark, docs, no_docs, tmp_path):
    rows = H.shard(docs).collect()
    assert len(rows) == docs.count() and H.shard(no_docs).count() == 0
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r["size"] == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and 0 <= r.shard < 8 for r in rows)
    # Texts are all different, as equal ones lie in one shard; sizes are 6 to 55 bytes.
    even = spark.createDataFrame([(i, f"{i:05d}" + "x" * (i % 50), "en", f"s{i % 7}") for i in range(3000)], "doc_id long, text string, lang string, source string")
    size = {}
    for r in H.shard(even).collect():
        size[r.shard] = size.get(r.shard, 0) + r["size"]
    assert len(size) == 8
    assert max(size.values()) - min(size.values()) <= 112
    H.write_shards(even, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 3000


def test_shards_against_a_plain_sort(spark):
    """Equal texts lie in one shard, a group larger than a share is cut, sizes are near equal, and slots follow the curve."""
    rows = [(i, f"text {i // 3} " + "y" * (i // 3 % 40), ["en", "de", None][i % 3], f"s{i % 5}") for i in range(1500)]
    rows += [(2000 + i, "copy of one text, often", "en", f"s{i % 4}") for i in range(40)] + [(5000, None, None, None), (5001, "", "en", "s1")]
    for most in (0, 1800):
        table = rows + [(10000 + i, "a group that fills more than a shard", "en", "s0") for i in range(most)]
        got = H.shard(spark.createDataFrame(table, "doc_id long, text string, lang string, source string").repartition(5)).collect()
        texts = {r[0]: r[1] or "" for r in table}
        assert len(got) == len(table)
        homes, size = {}, {}
        for r in got:
            homes.setdefault(texts[r.doc_id], set()).add(r.shard)
            size[r.shard] = size.get(r.shard, 0) + r["size"]
        cut = [t for t, h in homes.items() if len(h) > 1]
        assert cut == (["a group that fills more than a shard"] if most else [])
        groups = {t: sum(len(texts[i]) + 1 for i in texts if texts[i] == t) for t in homes if t not in cut}
        share = sum(size.values()) / 8
        assert len(size) == 8 and all(abs(v - share) < 2 * max(groups.values()) for v in size.values())
        order = sorted(got, key=lambda r: (r.shard, r.slot))
        assert [r.hilbert for r in order] == sorted(r.hilbert for r in got)
        for k in range(8):
            assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_carried_columns_may_have_any_name(docs):
    from pyspark.sql import functions as F

    names = ("text_hash", "key", "slice", "part", "left", "words", "carried_0")
    named = docs.drop(*names).withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in names})
    rows, plain = M.mix(named, carry=names).collect(), M.mix(docs).collect()
    assert all(r[c] == f"{c}{'' if r.doc_id is None else r.doc_id}" for r in rows for c in names)
    assert sorted((r.doc_id or -1, r.taken) for r in rows) == sorted((r.doc_id or -1, r.taken) for r in plain)
