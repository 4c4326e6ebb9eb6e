import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cohortal.llm import html_text as W
from cohortal.llm import neighbours as V
from cohortal.llm import scoring as S


def words(t):
    return [*(t or "").encode().lower().split(), None]


def brute_ppm(train, order):
    levels = [{} for _ in range(order + 1)]
    for t in train:
        b = b"\0" * order + (t or "").encode()
        for j in range(order, len(b)):
            for k in range(order + 1):
                levels[k].setdefault(b[j - k : j], Counter())[b[j]] += 1

    def score(t):
        b, total = b"\0" * order + (t or "").encode(), 0.0
        for j in range(order, len(b)):
            gone = set()
            for k in range(order, -1, -1):
                seen = {x: n for x, n in levels[k].get(b[j - k : j], {}).items() if x not in gone}
                if seen:
                    n = sum(seen.values()) + len(seen)
                    if b[j] in seen:
                        total += math.log10(seen[b[j]] / n)
                        break
                    gone |= seen.keys()
                    if len(gone) < 256:
                        total += math.log10(len(seen) / n)
            else:
                total -= math.log10(256 - len(gone))
        return total

    return score


def test_scores(spark, docs, no_docs, monkeypatch):
    rows = docs.collect()
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(20)}
    train = [r.text for r in rows if not (r.doc_id is not None and out[r.doc_id])]
    counts = Counter(w for t in train for w in words(t))
    n, v = sum(counts.values()), len(counts)
    ppm = brute_ppm(train, S.ORDER)
    for frequent in (1 << 20, 5):
        monkeypatch.setattr(S, "FREQUENT_WORDS", frequent)
        trained = S.train(docs.where(~S.held_out(F.col("doc_id"))).select("text"))
        got = S.score(docs, trained).collect()
        assert len(got) == len(rows) and S.score(no_docs, trained).count() == 0
        by_id = {r.doc_id: r.text for r in rows}
        for r in got:
            w = words(by_id[r.doc_id])
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
            assert math.isclose(r.base_score, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
            if len(w) < 100:
                assert math.isclose(r.score, ppm(by_id[r.doc_id]), rel_tol=1e-9, abs_tol=1e-9)
    untrained = S.score(docs.where("doc_id = 4"), S.train(no_docs.select("text"))).first()
    assert untrained.n_known == 0 and math.isclose(untrained.score, -len("two words") * math.log10(256), rel_tol=1e-9)


def test_adaptive():
    assert S.adaptive_digits("") == S.adaptive_digits(None) == 0
    assert math.isclose(S.adaptive_digits("a"), math.log10(256))
    assert S.adaptive_digits("abcabcabc" * 20) < S.adaptive_digits("".join(random.Random(1).choices("abcdefghij", k=180)))


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 16))
    x[7] = x[8]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [1.0, None] + [0.0] * 14), (2400, [1.0, 2.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("pivots", F.lit(1))
    got = V.search(df, F.col("vec_id") % 100 == 0).collect()
    hits = total = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and all(abs(r.score - d[r.vec_id]) < 1e-12 for r in mine)
        hits += len({r.vec_id for r in mine} & set(want.tolist()))
        total += 10
    assert {r.query_id for r in got} == set(range(0, 1500, 100)) and hits / total >= 0.9
    few = V.search(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r["rank"])] == [int(i) for i in np.argsort(((x[:4] - x[0]) ** 2).sum(1))[1:]]
    assert V.search(df.where("false"), F.col("vec_id") == 0).count() == V.search(df, F.col("vec_id") < 0).count() == 0


def test_footrule():
    rng = np.random.default_rng(7)
    orders = np.array([rng.permutation(20)[:6] for _ in range(30)], np.int16)
    places = [{int(p): k for k, p in enumerate(o)} for o in orders]
    files = V.inverted_files(orders, 20)
    assert all(places[r][p] == k for p, (rows, at) in enumerate(files) for r, k in zip(rows.tolist(), at.tolist()))
    for read in (2, 6):
        want = [sum(abs(places[0][p] - q.get(p, 6)) for p in orders[0][:read].tolist()) for q in places]
        assert V.footrule(files, orders[0][:read], 30, 6).tolist() == want


def test_neighbours_among_copies_and_other_spaces(spark, monkeypatch):
    """A vector that makes up most rows crowds nobody out; layouts and segments change nothing but the sample they measure."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(600, 8))
    x[200:500] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, [float(i + 1), 1.0]) for i in range(30)] + [(3, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(V, "SEGMENT", 50)
    seen = set()
    for parts in (1, 7):
        got = V.search(df.repartition(parts), F.col("vec_id") % 100 == 0, measured=1.0).collect()
        seen.add(tuple(sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got)))
    assert len(seen) == 1
    for q in (0, 100, 200, 300, 1000):
        ids, space = (list(range(600)), x) if q < 1000 else (list(range(1000, 1030)), np.array([[i + 1.0, 1.0] for i in range(30)]))
        d = np.sqrt(((space - space[ids.index(q)]) ** 2).sum(1))
        want = sorted((round(float(e), 9), i) for e, i in zip(d, ids) if i != q)[:10]
        assert [(e, i) for k, _, i, e in sorted(next(iter(seen))) if k == q] == want


def test_held_out_pages_are_extracted_whole():
    rng, model = random.Random(99), W.trained()
    for _ in range(120):
        page, marks = W.training_page(rng)
        assert set(re.findall(r"\bm\d+x\b", W.extract([page], model)[0])) == marks


def test_pages(spark):
    page = "<html><head><title>T</title><script>x='</p>'</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><article><h1>Head &amp; line</h1><p><b>One  two\n three<br><p>Caf&eacute; &#65; end.</p></article><footer>&copy; me</footer>"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "plain"), (1, "u", page)], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    rows = W.main_text(df).collect()
    assert sorted((r.text for r in rows if r.page_id == 1)) == ["Head & line\nOne two three\nCafé A end."] * 2
    assert all(r.n_chars == len(r.text) for r in rows) and {r.text for r in rows if r.page_id in (2, 3)} == {""}
    assert len(rows) == 5 and W.main_text(df.where("false")).count() == 0


def test_decoding_never_keeps_below_a_dropped_block():
    rng, model = random.Random(4), W.trained()
    for _ in range(30):
        order = W.nodes_of(W.parse(W.training_page(rng)[0]))
        W.decode(order, model.log_odds(W.node_features(order)) * rng.choice([-1, 1, 0.1]))
        assert all(n.keep <= n.parent.keep for n in order if n.parent)


def test_scores_do_not_depend_on_the_leaves_that_workers_hold(spark, docs, monkeypatch):
    rows = docs.collect()
    train = docs.where(~S.held_out(F.col("doc_id"))).select("text")
    ppm = brute_ppm([r.text for r in train.collect()], S.ORDER)
    new = [(100, "Ωmega 中文 zebra quartz"), (101, "The quick brown fish"), (102, "é" * 9)]
    scored = docs.select("doc_id", "text").unionByName(spark.createDataFrame(new, "doc_id long, text string"))
    trained = S.train(train)
    whole = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in S.score(scored, trained).collect())
    for most in (200, 0):
        monkeypatch.setattr(S, "TRIE_NODES", most)
        got = S.score(scored, trained).collect()
        part = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in got)
        assert [x[:2] for x in part] == [x[:2] for x in whole] and np.allclose([x[2] for x in part], [x[2] for x in whole], rtol=1e-9, atol=1e-9)
        text = {r.doc_id: r.text for r in rows} | dict(new)
        assert all(math.isclose(r.score, ppm(text[r.doc_id]), rel_tol=1e-9, abs_tol=1e-9) for r in got if len((text[r.doc_id] or "")) < 1000)


def test_sibling_features_of_many_children():
    order = W.nodes_of(W.parse("<body><div>" + "<p>x</p><b>y</b>" * 100 + "</div></body>"))
    rows = W.node_features(order)
    siblings = [(n, r) for n, r in zip(order, rows) if n.parent and n.parent.tag == "div"]
    assert len(siblings) == 200 and all(r[2] == 200 and r[3] == 100 for _, r in siblings)
    assert [round(r[1] * 200) for _, r in siblings] == list(range(200))


LONG = "The council met on Tuesday evening to decide about the old bridge, which has been closed since the flood of last spring. Engineers said that repairs will take two years, and that a ferry could serve until then."


def extracted(body):
    return W.extract([f"<html><head><title>t</title></head><body>{body}</body></html>"], W.trained())[0]


def test_what_has_no_end_tag_swallows_nothing():
    article = f"<article><h1>Bridge stays closed</h1><p>{LONG}</p><p>{LONG}</p></article>"
    want = f"Bridge stays closed\n{LONG}\n{LONG}"
    for before in ("<svg class='i'/>", "<svg class=i>", "<button class=menu>", "<video src=x>", "<select name=a>", "<script src=x />", "<style>", "<title/>"):
        assert extracted(before + article) == want, before
    assert extracted("<svg><path d='M0 0'/><title>icon</title></svg><button>Menu</button><script>if (a < b) document.write('<p>x</p>')</script>" + article) == want


def test_formulas_stay():
    assert "is mc2 as all of us know" in extracted(f"<article><p>{LONG}</p><p>Energy is <math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> as all of us know, {LONG}</p></article>")


def test_broken_attributes_are_no_text():
    for tag in ("<p title=it's>", '<p title=5">', "<p title='a > b'>", '<p data-x="<p>">', "<p a=b'c d='e>"):
        text = extracted(f"<article><h1>Bridge stays closed</h1>{tag}{LONG}</p><p>{LONG}</p></article>")
        assert text == f"Bridge stays closed\n{LONG}\n{LONG}", tag
    assert extracted(f"<article><p>{LONG}</p><p>{LONG}</p></article><p class='x") == f"{LONG}\n{LONG}"


def test_tokens_are_learned():
    weights = W.trained().weights
    of = lambda word: weights[W.attribute_tokens(f'class="{word}"')[0]]
    assert of("article") > 1 and of("sidebar") < -1 and of("comments") < -1 and of("never-seen"[:5]) == 0 and len(weights) == W.BUCKETS


def test_pages_of_another_kind():
    """Pages written by hand in styles that the composed ones do not have."""
    side = "<li><a href=/a>Sports today</a></li><li><a href=/b>Weather</a></li><li><a href=/c>Traffic news</a></li>"
    shell = f"<div id=masthead class='site-header js'><a href=/>The Herald</a></div><div class='navbar navbar-expand'><ul>{side}</ul></div>"
    foot = "<div class='site-footer'><p>&copy; 2024 The Herald. All rights reserved. <a href=/i>Imprint</a></p></div>"
    want = ["Bridge stays closed", LONG, LONG + " More follows.", LONG + " End."]
    parts = lambda tag: "".join(f"<{tag}>{t}</{tag}>" for t in want[1:])
    pages = {
        "divs": f"{shell}<div class='container'><div class='row'><div class='col-8 post-content'><h1>{want[0]}</h1>{parts('p')}</div><div class='col-4 sidebar'><h3>Most read</h3><ul>{side}</ul></div></div></div>{foot}",
        "main": f"{shell}<main role=main><h1>{want[0]}</h1>{parts('p')}</main><div id=comments><h3>Comments</h3><div class=comment><p>Nice one, I walked there as a child.</p></div></div>{foot}",
        "advert": f"{shell}<article class=story><h1>{want[0]}</h1><p>{want[1]}</p><div class='advert box'><p>Buy two, pay one!</p></div><p>{want[2]}</p><p>{want[3]}</p></article>{foot}",
        "cookies": f"<div class='cookie-banner'><p>We use cookies to improve this site. By going on you agree.</p><button>OK</button></div>{shell}<section class='article-body'><h1>{want[0]}</h1>{parts('p')}</section><form action=/s><label>Search</label><input></form>{foot}",
        "plain": f"<nav><ul>{side}</ul></nav><article><h1>{want[0]}</h1>{parts('p')}</article><footer>&copy; Herald</footer>",
    }
    right = sum(extracted(body).split("\n") == want for body in pages.values())
    assert right >= 4, {k: extracted(v)[:300] for k, v in pages.items()}
