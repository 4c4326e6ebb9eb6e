import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cohortal.llm import packing
from cohortal.llm import token_store as S
from cohortal.llm import tokens as T
from cohortal.llm.packing import best_fit, crossover, evolve, fitness, pack


_TOKENIZERS = {}


def reference(name, text):
    from tokenizers import Tokenizer

    if name not in _TOKENIZERS:
        _TOKENIZERS[name] = Tokenizer.from_file(T.vocabulary_path(name))
    return _TOKENIZERS[name].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name,space", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_equals_library(texts, name, space, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_BYTES", 200)
    more = [*texts, "a ,b.,c. d'x,", "Σας ΣΑΣ İx K", "é ́x", "tab\t\n c", "x \n y\n", "word.Word,word", "1,2 a1,b"]
    rng = random.Random(11)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "|>", " ", "\n", "a", "Word", ".", ",", "  ", "é", "<|endoftext|>x"]
    more += ["".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(300)]
    got = [x.tolist() for x in T.Encoder(T.vocabulary_path(name), space).encode(pa.array(more))]
    assert got == [reference(name, t) for t in more]


@pytest.mark.parametrize("name,space", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_pieces_are_looked_up_once(name, space):
    class Memo(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

    letters = [chr(c) for c in range(0xA0, 0x260)]
    more = [f"{c}x A{c} {c}{c}, n{c}. {c}!?' {c}'s" for c in letters] + [f"end{m} {m}of E{m}x' y{m}{m}'" for m in map(chr, range(33, 127))]
    more += ["\u0f5c, x", "\u0a59.", "\u0958,y", "\ufb2a. z"]  # letters that are a letter and a mark in normal form
    enc = T.Encoder(T.vocabulary_path(name), space)
    enc._memo = Memo()
    got = [x.tolist() for x in enc.encode(pa.array(more))]
    assert got == [reference(name, t) for t in more]
    assert enc._memo.asked == len(enc._memo)


def test_store_round_trip(spark, docs, texts, tmp_path):
    path = str(tmp_path / "store")
    S.write_store(docs, path, T.vocabulary_path("word_bpe_49k.json"))
    rows = S.read_store(spark, path).collect()
    assert len(rows) == docs.count()
    want = sorted(zlib.crc32(np.array([*reference("word_bpe_49k.json", r.text), 2], "<u4").tobytes()) for r in docs.collect())
    assert sorted(r.ids_crc32 for r in rows) == want
    order = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0, *(r.n_tokens for r in order[:-1])]).tolist()
    known = [r.doc_id for r in order if r.doc_id is not None]
    assert known == sorted(known)
    stored = spark.read.parquet(path + "/documents").collect()
    owned = [(r.digests[16 * i : 16 * i + 16]) for r in stored for i, f in enumerate(r.flags) if f != S.FOREIGN]
    assert len(owned) == len(set(owned))  # each chunk once


def test_store_damage_is_seen(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    S.write_store(docs.limit(9), good, T.vocabulary_path("word_bpe_49k.json"))
    spark.read.parquet(good + "/manifest").write.parquet(bad + "/manifest")
    spark.read.parquet(good + "/documents").withColumn("root", F.unhex(F.lit("00" * 16))).write.parquet(bad + "/documents")
    with pytest.raises(Exception, match="does not match"):
        S.read_store(spark, bad).collect()


def test_store_knows_what_it_lost(spark, docs, tmp_path):
    good = str(tmp_path / "good")
    S.write_store(docs, good, T.vocabulary_path("word_bpe_49k.json"))
    rows, parts = spark.read.parquet(good + "/documents"), spark.read.parquet(good + "/manifest")
    part = rows.first()["part"]
    for k, (some, manifest) in enumerate(((rows.where("doc_id <> 8 OR doc_id IS NULL"), parts), (rows.where(f"part <> {part}"), parts), (rows, parts.where(f"part <> {part}")))):
        bad = str(tmp_path / f"bad{k}")
        some.write.parquet(bad + "/documents")
        manifest.write.parquet(bad + "/manifest")
        with pytest.raises(Exception, match="does not match its manifest"):
            S.read_store(spark, bad).collect()


def test_ids_wider_than_the_store_are_refused(docs, tmp_path):
    with pytest.raises(Exception, match="wider than"):
        S.write_store(docs.where("doc_id = 3"), str(tmp_path / "s"), T.vocabulary_path("word_bpe_49k.json"), width=1)


def test_store_empty(spark, no_docs, tmp_path):
    S.write_store(no_docs, str(tmp_path / "s"), T.vocabulary_path("word_bpe_49k.json"))
    assert S.read_store(spark, str(tmp_path / "s")).count() == 0


def test_chunks_depend_on_content_only():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 40000, 20000).astype(np.uint32)
    one, two = S.chunk_lengths(ids), S.chunk_lengths(np.concatenate([ids[:5000], ids[5003:]]))
    assert sum(one) == 20000 and max(one) <= S.MOST and len(set(np.cumsum(one[::-1])) & set(np.cumsum(two[::-1]))) > len(one) // 3


def test_pack(docs, no_docs):
    rows = pack(docs, T.vocabulary_path("byte_bpe_50k.json")).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i in (0, 2, 13, 14):
        ids = np.array([*reference("byte_bpe_50k.json", texts[i]), 0], "<u4")
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert sum(p.length for p in parts) == len(ids) and all(p.length == 2048 for p in parts[1:])
        for p in parts:
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    total = sum(r.length for r in rows)
    assert len(by_seq) == -(-total // 2048)
    assert pack(no_docs, T.vocabulary_path("byte_bpe_50k.json")).count() == 0


def test_genetic_steps_keep_every_piece():
    rng = random.Random(5)
    sizes = [rng.randint(300, 1200) for _ in range(200)]
    one = [[i] for i in range(200)]
    best = evolve(sizes, [one], 2048, rng)
    child = crossover(sizes, one, best, 2048, rng)
    for groups in (best, child):
        assert sorted(i for g in groups for i in g) == list(range(200))
        assert max(sum(sizes[i] for i in g) for g in groups) <= 2048
    assert fitness(sizes, best, 2048) >= fitness(sizes, one, 2048)


def test_crossover_closes_what_best_fit_leaves_open(monkeypatch):
    """Best fit decreasing needs three sequences; a full one injected from the other parent leaves what fits into one."""
    sizes = [5, 4, 3, 3, 3, 2]
    by_size = best_fit(sizes, sorted(range(6), key=lambda i: -sizes[i]), [], 10)
    other = [[0, 2, 5], [1], [3, 4]]
    assert len(by_size) == 3
    children = [crossover(sizes, by_size, other, 10, random.Random(k)) for k in range(10)]
    assert min(map(len, children)) == 2
    monkeypatch.setattr(packing, "mutated", lambda sizes, groups, *_: groups)  # crossover alone
    assert min(len(evolve(sizes, [by_size, other], 10, random.Random(k), population=2)) for k in range(5)) == 2


def test_every_block_is_bred(monkeypatch):
    """A generation runs even where a seed is at the least possible number already."""
    calls = []
    monkeypatch.setattr(packing, "crossover", lambda *a: calls.append(1) or crossover(*a))
    assert len(evolve([1024] * 8, [], 2048, random.Random(1))) == 4 and calls


def test_breeding_beats_best_fit_decreasing():
    """Pieces cut from full sequences in threes: best fit decreasing wastes some, breeding less."""
    rng, won = random.Random(3), 0
    for k in range(4):
        sizes = []
        for _ in range(60):
            a, b = sorted(rng.sample(range(300, 1500), 2))
            sizes += [a, b - a, 2048 - b] if b - a > 0 else [1024, 1024]
        by_size = best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), [], 2048)
        bred = evolve(sizes, [], 2048, random.Random(k), generations=60)
        assert len(bred) <= len(by_size)
        won += fitness(sizes, bred, 2048) > fitness(sizes, by_size, 2048)
    assert won >= 3
