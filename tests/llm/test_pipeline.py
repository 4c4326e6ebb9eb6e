import corpus_pipeline as P
import pytest
from samples import BASE

from cohortal.llm import registry


@pytest.fixture()
def folder(spark, tmp_path):
    clean = [(i, f"{BASE[i % 2]} Story {i} " + " ".join(f"w{i}x{j}" for j in range(40)) + ".", "en", f"s{i % 4}") for i in range(200)]
    copies = [(300 + i, clean[i][1], "en", "s9") for i in range(10)]
    junk = [(400 + i, " ".join(["Und"] * 60), "de", "s1") for i in range(5)] + [(410, None, None, None), (411, "", "en", None)]
    secret = [(500, clean[0][1][::-1] + " token = 'abcdefghijklmnop1234'", "en", "s0")]
    rows = [(i, t, a, s, len(t or "")) for i, t, a, s in clean + copies + junk + secret]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in P.STAGES[:4]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(docs.collect())
    assert {r.doc_id for r in seen[0]} == set(range(200)) | set(range(300, 310)) | {500}
    assert {r.doc_id for r in seen[1]} == set(range(200)) | {500}
    assert len(seen[2]) == 201 and all("abcdefghijklmnop1234" not in r.text for r in seen[2])
    assert any("[SECRET]" in r.text and r.n_chars == len(r.text) for r in seen[2])
    assert {r.doc_id for r in seen[3]} <= {r.doc_id for r in seen[2]} and len(seen[3]) > 200


def test_run(spark, folder):
    rows = P.run(spark, folder).collect()
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert rows and max(fill.values()) <= 2048


def test_registered():
    names = registry.queries()
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_duplicates", "secret_scans", "source_mixing", "best_fit_packing"]


def test_stages_on_awkward_tables(spark, docs, no_docs, folder):
    """Columns named like those that stages make, repeated rows, nulls and empty tables."""
    from pyspark.sql import functions as F

    names = ("text_hash", "first_id", "copies", "n_rows", "times", "copy", "t_id", "t_hash", "t_source", "known_hash", "component", "_text", "_in_text", "taken", "kept", "row")
    long = " ".join(f"story{i} goes on," for i in range(3000))
    more = spark.createDataFrame([(900, long, "en", "s1", len(long)), (901, None, None, None, None)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    base = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more)
    table = base.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in names})
    for name, stage in P.STAGES:
        none = stage(spark, table.where("false"), folder)
        assert none.count() == 0
        out = stage(spark, table, folder)
        if name != "best_fit_packing":
            assert out.columns == table.columns == none.columns
            for r in out.collect():
                assert all(r[c] == f"{c}{'none' if r.doc_id is None else r.doc_id}" for c in names)
        known = {(r.doc_id, r.text) for r in table.collect()}
        got = out.collect()
        if name == "quality_rules":
            assert sum(r.doc_id == 900 for r in got) == 2 and all(r.text for r in got) and {(r.doc_id, r.text) for r in got} <= known
        if name == "near_duplicates":
            assert sum(r.doc_id == 900 for r in got) == 1 and sum(r.doc_id == 901 for r in got) == 1 and {(r.doc_id, r.text) for r in got} <= known
        if name == "secret_scans":
            assert len(got) == table.count() and sum(r.text is None for r in got) == sum(t is None for _, t in known) + 1
        if name == "source_mixing":
            assert all(r.text and r.text.split() for r in got) and {(r.doc_id, r.text) for r in got} <= known
        if name == "best_fit_packing":
            assert sum(r.piece == 0 for r in got) == table.count()
