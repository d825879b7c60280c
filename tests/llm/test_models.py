import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from redline.llm import langid, topk, urlfilter

# --- exact top-k -------------------------------------------------------------------------


def best(queries, rows, k):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * x) for x in v]

    rows = [(i, whole(v)) for i, v in rows]
    asked = {}
    for i, v in ((i, whole(v)) for i, v in queries):
        if i is not None and v is not None:
            asked[i] = max(asked.get(i, v), v)
    out = {}
    for q, v in asked.items():
        scored = sorted(
            (-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i is not None and w is not None and i != q
        )
        out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return {q: r for q, r in out.items() if r}


@pytest.mark.parametrize("shape", ["random", "clustered", "ties", "few"])
def test_top_k_equals_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "GROUP", 4)
    monkeypatch.setattr(topk, "QUERIES", 7)
    r = random.Random(shape)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(4 if shape == "few" else 250):
        c = centres[i // 50]
        v = {"random": [r.gauss(0, 0.5) for _ in range(6)], "few": [r.gauss(0, 0.5) for _ in range(6)],
             "clustered": [x + r.gauss(0, 0.05) for x in c], "ties": [r.choice([-0.5, 0.25]) for _ in range(6)]}[shape]
        rows.append((i * 3 % 257 if shape != "few" else i, v))
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(304, []), (305, [0.5]), (306, [3e7, -2e9, 0.0, 0.0, 0.0, 0.0]), (310, [1.5e5]), (rows[0][0], rows[0][1]), (rows[1][0], [9.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS v", "1 AS score", "2 AS first")
    queries = [x for x in rows if x[0] is not None and x[0] % 5 == 0]
    got = collections.defaultdict(list)
    for x in topk.top_k(df.where("vec_id % 5 = 0"), df, 5).collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    exact_q = [x for x in exact if x in exact and x[0] is not None and x[0] % 5 == 0]
    assert {q: sorted(x) for q, x in got.items()} == best(exact_q, exact, 5)
    assert len(queries) == len(exact_q)


def test_components_of_any_finite_size_take_part(spark):
    r = random.Random(5)
    sizes = [0.5, 3.0, 1e8, 2.0**53 + 2, 1e17, -1e17, 1e300, -1.7e308, 0.0]
    rows = [(i, [r.choice(sizes) for _ in range(3)]) for i in range(40)] + [(50, [1e17, 0.0]), (100, [0.0, 1.0])]
    rows += [(i, [r.gauss(0, 1) for _ in range(3)]) for i in range(101, 160)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for x in topk.top_k(df.where("vec_id % 5 = 0"), df, 4).collect():
        got[x.query_id].append((-x.score, x.vec_id))
    most = float(np.finfo(float).max)
    whole = {i: [math.floor(max(min(256 * c, most), -most)) for c in v] for i, v in rows}
    for q in (i for i in whole if i % 5 == 0):
        scores = [(sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q]
        assert sorted(got[q]) == sorted((-max(min(s, 2**63 - 1), -(2**63)), i) for s, i in scores)[:4]


def test_top_k_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, df, 5).collect() == []


def test_blocks_below_the_kth_score_are_not_scored():
    d = np.concatenate([np.full((128, 2), 100), np.full((128, 2), 1)]).astype(np.int64)
    ids = np.arange(256)
    q = np.array([[1, 1]])
    (_, found, scores), = topk.search_unit(np.array([-1]), q, ids, d, 3, np.array([-(1 << 62)]))
    assert found.tolist() == [0, 1, 2] and scores.tolist() == [200, 200, 200]
    (_, found, _), = topk.search_unit(np.array([-1]), q, ids, d, 3, np.array([201]))
    assert not len(found)  # no bound reaches what another group gave already


# --- language identification -------------------------------------------------------------------

SOUNDS = {"aa": "aeiou", "bb": "xyzkw", "cc": "äöüßs"}


@pytest.fixture(scope="module")
def languages():
    r = random.Random(31)

    def text(lang, n):
        own = SOUNDS[lang] + "ntr"
        return " ".join("".join(r.choice(own) for _ in range(r.randint(2, 7))) for _ in range(n)).capitalize() + "."

    rows = [(i, text(lang, r.randint(3, 60)), lang) for i, lang in enumerate(r.choices(list(SOUNDS), [6, 3, 1], k=600))]
    return rows


def test_language_is_learnt_and_held_out(spark, make_docs, languages):
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !!", "bb"), (1003, "aeio " * 40_000, None), (None, "xyz kwx", "bb")]
    got = {r.doc_id: r for r in langid.report(make_docs(languages + odd)).collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items() if d is not None)
    test = [(r, lang) for d, _, lang in languages if (r := got[d]).held_out]
    assert sum(r.lang_pred == lang for r, lang in test) >= 0.98 * len(test) and len(test) > 100
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (1000, 1001, 1002))
    assert got[1003].lang_pred == "aa" and got[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_prediction_uses_text_alone(make_docs, languages):
    model = langid.train(make_docs(languages))
    names, scores = model.predict(pa.array([t for _, t, _ in languages]))
    assert 0.3 < (model.weights == 0).mean() < 1  # the penalty leaves most weights at zero
    moved = [(d + 5000, t, "zz") for d, t, _ in languages]
    again = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(make_docs(moved), model).collect()}
    assert all(again[d + 5000] == (n, pytest.approx(s)) for (d, _, _), n, s in zip(languages, names, scores))


def test_temperature_follows_the_errors():
    r = np.random.default_rng(1)
    labels = r.integers(0, 3, 4000)
    logits = np.log(np.full((4000, 3), 0.1) + 0.7 * np.eye(3)[labels])
    wrong = r.random(4000) < 0.2
    logits[wrong] = np.roll(logits[wrong], 1, axis=1)
    t = langid.fit_temperature(5 * logits, labels)
    assert 4 < t < 6.5
    assert langid.fit_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_unclear_documents_go(make_docs, languages):
    docs = make_docs(languages + [(1000, None), (1001, "123 !!")])
    got = langid.apply(docs)
    assert got.columns == docs.columns
    ids = {r.doc_id for r in got.collect()}
    assert not ids & {1000, 1001} and len(ids) >= 0.99 * len(languages)
    assert langid.report(make_docs([])).collect() == []
    nothing = langid.report(make_docs([(4, "some text", None)])).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]


# --- url filter --------------------------------------------------------------------------------

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def by_hand(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def test_rules_hosts_and_paths(spark):
    urls = [
        None, "", "no scheme", "http://", "http://a.NET/x", "http://a.net", "http://net/", "https://example.net/en/a?b#c",
        "http://www.Example.net/EN/", "http://notexample.com/de/1", "http://example.com/de/1", "http://x.example.com?de",
        "http://x.org/fr/", "http://org#fr", "ftp://u:p@h.org:80/fr/é", "http://a/b://c/d", "x://É.org/fr/1", "http://" + "a" * 5000 + ".net/",
    ]
    pages = spark.createDataFrame([(i % 15, u, "<p>x</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    pages = pages.selectExpr("*", "'x' AS host", "1 AS label", "'y' AS word", "2 AS score")
    got = urlfilter.verdicts(pages, RULES).collect()
    want = sorted(((i % 15, *by_hand(u)) for i, u in enumerate(urls)), key=repr)
    assert sorted(((r.page_id, r.host, r.path, (r.rule, r.verdict) if r.rule else None) for r in got), key=repr) == want
    assert all(r.verdict == "allow" for r in got if r.host == "")
    assert urlfilter.verdicts(pages.limit(0), RULES).collect() == []


def all_splits(label):
    for k in range(2 ** (len(label) - 1)):
        cuts = [0, *(i + 1 for i in range(len(label) - 1) if k >> i & 1), len(label)]
        yield [label[a:b] for a, b in zip(cuts, cuts[1:])]


def test_segmentation_equals_all_splits():
    counts = {"cheap": 40, "pills": 10, "che": 3, "a": 50, "apps": 5, "ill": 30, "s": 60, "online": 7, "on": 90, "line": 20}
    total = float(sum(counts.values()))
    log_p = {w: math.log(n / total) for w, n in counts.items()}
    for label in ("cheappills", "onlineapps", "cheapxyz", "ssa", "q", "pillsonline"):
        def score(words):
            return sum(log_p.get(w, -math.log(total) - len(w) * math.log(10)) for w in words)
        got = urlfilter.viterbi(label, log_p, total)
        assert "".join(got) == label
        assert score(got) == pytest.approx(max(map(score, all_splits(label))))
    assert urlfilter.viterbi("cheappills", log_p, total) == ["cheap", "pills"]
    long = "donaudampfschifffahrtsgesellschaftskapitaen"  # a word of the corpus stays whole however long it is
    assert urlfilter.viterbi(long, {long: math.log(2 / total), "donau": math.log(5 / total)}, total) == [long]
    assert urlfilter.viterbi("q" * 300 + "spam", {"spam": math.log(5 / total)}, total) == ["q" * 300, "spam"]
    assert urlfilter.viterbi("", {}, 0.0) == []


def test_words_beside_seeds_are_learnt(spark):
    r = random.Random(3)
    text = "<p>" + "cheap pills market garden news river sport daily farm spam " * 50 + "</p><script>evil()</script>"
    good = ["gardennews.example.org", "daily-sport.example.org", "river.example.com", "newsmarket.example.com"]
    bad = ["cheappills.example.org", "pillsmarket.example.com", "cheap-pills.example.com", "spamfarm.example.org"]
    rows = [(i, f"http://{r.choice(good)}/{r.choice(['en', 'a1'])}/{i}", text) for i in range(300)]
    rows += [(1000 + i, f"http://{r.choice(bad)}/{r.choice(['buy', 'en'])}/{i}", text) for i in range(100)]
    rows += [(2000, "http://www.cheapfarm.example.com/buy/1", None), (2001, "http://m.newsgarden.example.com/en/1", "")]
    got = {x.page_id: x for x in urlfilter.verdicts(
        spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    assert len(got) == len(rows)
    assert all(got[i].verdict == ("block" if i >= 1000 else "allow") for i in got if i < 2000)
    assert got[2000].verdict == "block" and "cheap farm" in got[2000].host_words  # no seed word in it
    assert got[2001].verdict == "allow" and "news garden" in got[2001].host_words
