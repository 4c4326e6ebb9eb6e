import hashlib
import math
import random
import re
import time
from collections import Counter

from cohortal.llm import quality as Q
from cohortal.llm import secrets as X


def test_window_entropy_by_brute_force():
    import random

    rng = random.Random(2)
    for _ in range(30):
        s = "".join(rng.choice("abcdef0123") if rng.random() < 0.6 else "a" for _ in range(rng.randint(10, 90)))
        w, least = 12, 2.2
        want = set()
        for i in range(len(s) - w + 1):
            h = -sum(c / w * math.log2(c / w) for c in Counter(s[i : i + w]).values())
            if h >= least - 1e-9:
                want |= set(range(i, i + w))
        assert {k for a, b in X.window_spans(s, w, least) for k in range(a, b)} == want


def test_spans(docs, no_docs):
    rows = {r.doc_id: r for r in X.scan(docs).collect()}
    assert X.scan(docs).count() == docs.count() and X.scan(no_docs).count() == 0
    text = next(r.text for r in docs.collect() if r.text and r.text.startswith("token"))
    r = next(r for r in rows.values() if r.n_assign)
    want = [("assign", *re.search(r"token = 'abcdefghijkl0123", text).span()), ("access", *re.search(r"AKIA[A-Z0-9]+", text).span()), ("hex", *re.search("0123456789abcdef0123", text).span())]
    shown = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(want, key=lambda x: x[1]))
    assert (r.n_assign, r.n_access, r.n_hex) == (1, 1, 1) and r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
    assert rows[0].spans == "" and rows[0].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_entropy_finds_and_allows():
    key = "x9Qm2Lk8Zr4Tn6Vb1Wc3Yd5Fg7Hj0Ps"
    assert [k for k, _, _ in X.find_secrets(f"see {key} here")] == ["entropy"]
    for harmless in ("a" * 60, "https://example.com/some/long/path/with/words/only", "1234567890" * 4, "ThisIsAVeryLongCamelCaseIdentifierName", "aB3aB3aB3aB3aB3aB3aB3aB3aB3"):
        assert all(k != "entropy" for k, _, _ in X.find_secrets(f"see {harmless} here")), harmless
    assert X.redacted("a token=abcdefghijklmnop b", X.find_secrets("a token=abcdefghijklmnop b")) == "a [SECRET] b"


def test_marks_take_away_only_themselves():
    key, hexa = "x9Qm2Lk8Zr4Tn6Vb1Wc3Yd5Fg7Hj0Psq8Bt2Nv4Cz6Xa1", "9F3A7C1E5B8D2046E7A1C93B5F0D8264"
    for text in (key + "xxxx", key + "/example", "example-" + key, hexa + "1234567", key + "XXXXXX" + key):
        spans = [(a, b) for k, a, b in X.find_secrets(text) if k == "entropy"]
        assert spans and any(key[2:30] in text[a:b] or hexa[2:30] in text[a:b] for a, b in spans), text
    assert not X.find_secrets("key wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY here")
    assert all(k != "entropy" for k, *_ in X.find_secrets("123e4567-e89b-12d3-a456-426614174000"))


def test_covered_spans_by_brute_force():
    rng, kinds = random.Random(8), "abcdefABCDEF0123456789+/ghijkXYZ"
    for _ in range(60):
        text = " ".join("".join(rng.choice(kinds[: rng.choice((16, 32))]) for _ in range(rng.randint(5, 70))) for _ in range(6))
        spans = X.find_secrets(text)
        for k, a, b in spans:
            others = [(x, y) for kind, x, y in spans if (kind, x, y) != (k, a, b)]
            assert k != "entropy" or not any(x <= a and b <= y for x, y in others)


def test_many_keys_in_one_text():
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(32)) for _ in range(20000))
    began = time.time()
    assert len(X.find_secrets(text)) > 15000 and time.time() - began < 30


def test_case_folding_is_ascii():
    assert not X.find_secrets("ſecret = abcdefghijklmnop") or all(k != "assign" for k, *_ in X.find_secrets("ſecret = abcdefghijklmnop"))
    assert X.find_secrets("API_KEY: zzzzzzzzzzzz")[0][0] == "assign"


def brute_features(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_features(texts):
    for t in [*texts, "a b c d e f " * 7, "x # y\nx # y\nz", "\x1cq \x85w"]:
        assert Q.text_features(t)[:5] == brute_features(t)


def test_judge(spark, docs, no_docs):
    rows = Q.judge(docs).collect()
    assert len(rows) == docs.count() and Q.judge(no_docs).count() == 0
    assert all(not r.kept for r in rows if r.n_words < 10)
    good = [(i, f"Clean text number {i} tells a short story about people, places and plain things that happen.", "en", f"s{i % 3}") for i in range(600)]
    junk = [(1000 + i, " ".join(f"w{j}### $$$" for j in range(20)), "en", "s1") for i in range(40)]
    mixed = spark.createDataFrame(good + junk, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in Q.judge(mixed).collect() if r.kept}
    assert kept == set(range(600))
    assert sorted(r.doc_id for r in Q.kept_documents(mixed).collect()) == list(range(600))
    assert Q.kept_documents(docs).columns == docs.columns


def test_cutoffs_against_exact_quartiles(spark):
    """Cutoffs are fences about the exact quartiles, to the sketch's accuracy, and the same on each run and layout."""
    import numpy as np

    rng = np.random.default_rng(4)
    groups = [("en", "a", 3000), ("en", "b", 40), ("de", "a", 500), ("fr", None, 30), (None, "c", 20)]
    rows = [(g[0], g[1], *np.where(rng.random(len(Q.FENCES)) < 0.3, 0.0, rng.gamma(2, 0.1, len(Q.FENCES))).tolist()) for g in groups for _ in range(g[2])]
    df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{c} double" for c in Q.FENCES))
    runs = [{(r.cut_lang, r.cut_source): r for r in Q.cutoffs(df.repartition(n)).collect()} for n in (1, 5)]
    assert runs[0] == runs[1] and set(runs[0]) == {(a, b) for a, b, _ in groups}
    for a, b, n in groups:
        pool = [r for r in rows if r[:2] == (a, b)] if n >= 100 else [r for r in rows if r[0] == a]
        pool = pool if len(pool) >= 100 else rows
        for k, (c, (times, least)) in enumerate(Q.FENCES.items()):
            v = sorted(r[2 + k] for r in pool)
            low, high = (v[math.floor(q * (len(v) - 1))] for q in (0.25, 0.75))
            want = high + times * max(high - low, least)
            assert abs(runs[0][a, b][f"{c}_most"] - want) <= Q.ACCURACY * (high + times * (high + low)) + 1e-9


def test_verdicts_by_brute_force(spark, docs):
    """kept is not base_failed and no share above its cutoff, whatever else the row holds."""
    rows = Q.features(docs)
    cut = {(r.cut_lang, r.cut_source): r for r in Q.cutoffs(rows).collect()}
    shares = {(r.doc_id, r.lang, r.source, r.n_words): r for r in rows.collect()}
    for r in Q.judge(docs).collect():
        s = shares[r.doc_id, r.lang, r.source, r.n_words]
        reasons = [c for c in Q.FENCES if s[c] > cut[r.lang, r.source][f"{c}_most"]]
        failed = s.n_words < 10 or 100 * s.n_repeat_words > 20 * s.n_words
        assert (r.base_failed, r.reasons, r.kept) == (failed, reasons, not failed and not reasons)
