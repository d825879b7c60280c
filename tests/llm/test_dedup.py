import hashlib
import itertools
import random
import re
import time

import pytest
import xxhash
from pyspark.sql import functions as F

from redline.llm import components, decontaminate, linededup, neardup, substrings

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return BLANK.findall(text or "")


def unique(rows):
    """One row for each doc_id, as the operators judge equal rows alike."""
    return {d: t for d, t in rows if d is not None}


# --- repeated passages ---------------------------------------------------------------


def passages(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(unique(rows).items()):
        w = words_of(text)
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            window = tuple(w[i:i + 20])
            if window in seen:
                gone[i:i + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[doc_id] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def shared_passages(word_list):
    r = random.Random(11)
    base = [" ".join(r.choices(word_list, k=60)) for _ in range(6)]
    few = word_list[:2]
    rows = []
    for i in range(120):
        parts = [" ".join(r.choices(word_list, k=r.randint(0, 80)))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(base).split()
            a = r.randint(0, 30)
            parts += [" ".join(p[a:a + r.randint(15, 30)]), " ".join(r.choices(word_list, k=r.randint(0, 9)))]
        rows.append((i * 3, (" " if i % 2 else "\n").join(parts)))
    rows += [(401, base[0]), (400, base[0]), (402, base[0] + "\t" + base[0]), (403, " ".join(r.choices(few, k=300)))]
    rows += [(404, " ".join(["again"] * 70)), (405, " ".join(["again"] * 70)), (406, " ".join(["again"] * 19))]
    return rows


@pytest.mark.parametrize("group", [3, 4096])
def test_passages_equal_brute_force(make_docs, shared_passages, awkward, group):
    rows = shared_passages + [(d + 1000 if d else d, t) for d, t in awkward]
    got = substrings.report(make_docs(rows), group).collect()
    want = passages(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    assert len(got) == sum(d is not None for d, _ in rows)


def test_clean_gives_texts_and_spans(make_docs, shared_passages):
    want = passages(shared_passages)
    for r in substrings.clean(make_docs(shared_passages)).collect():
        text = dict(shared_passages)[r.doc_id]
        w = words_of(text)
        gone = {i for a, b in r.spans for i in range(a, b)}
        assert r.text == " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (len(w), len(gone), hashlib.sha256(r.text.encode()).hexdigest()) == want[r.doc_id]


def test_passages_of_an_empty_table(make_docs):
    assert substrings.report(make_docs([])).collect() == []
    assert substrings.clean(make_docs([(1, None)])).collect()[0].spans == []


def test_rows_of_one_doc_id_with_different_texts(make_docs, word_list):
    """A long and a short text with the same doc_id, in either order, beside others that share nothing."""
    long, short = " ".join(word_list[:90]), " ".join(word_list[60:85])
    rows = [(1, long), (1, short), (2, " ".join(word_list[100:300])), (3, " ".join(word_list[40:70])), (4, short), (4, long), (5, "x")]
    for order in (rows, rows[::-1]):
        got = {(x.doc_id, x.n_words): x.n_removed for x in substrings.report(make_docs(order).coalesce(1)).collect()}
        first = sorted([long, short], key=lambda t: xxhash.xxh64(t.encode(), seed=42).intdigest() - (1 << 64) * (xxhash.xxh64(t.encode(), seed=42).intdigest() >> 63))[0]
        assert got == {
            (1, 90): 0 if first == long else 25, (1, 25): 25 if first == long else 0, (2, 200): 0, (3, 30): 30, (4, 25): 25, (4, 90): 90, (5, 1): 0,
        }


def test_lines_of_one_doc_id_with_different_texts(make_docs, word_list):
    a, b, c = (" ".join(word_list[i:i + 10]) for i in (0, 20, 40))
    rows = [(1, a), (1, "\n".join([b, "", c, b])), (2, a + " more"), (2, "\n".join([c, a])), (3, None), (3, "new")]
    for order in (rows, rows[::-1]):
        got = {(x.doc_id, x.n_lines): x.kept_lines for x in linededup.report(make_docs(order)).collect()}
        assert got == {(1, 1): "0", (1, 3): "0,2", (2, 1): "", (2, 2): "", (3, 0): "", (3, 1): "0"}
        kept = linededup.apply(make_docs(order)).collect()
        assert sorted((x.doc_id, x.text or "") for x in kept) == [(1, a), (1, "\n".join([b, "", c])), (3, ""), (3, "new")]


# --- near-duplicate documents -----------------------------------------------------------


def near(rows, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for d, t in unique(rows).items():
        w = words_of((t or "").translate(lower))
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.fixture(scope="module")
def families(word_list):
    r = random.Random(13)
    rows, doc_id = [], 0
    for size in (1, 2, 3, 30, 90):
        base = r.choices(word_list, k=200)
        for _ in range(size):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 4])):
                w[r.randrange(len(w))] = r.choice(word_list)
            rows.append((doc_id * 7 % 1009, " ".join(w).capitalize()))
            doc_id += 1
    rows += [(2000, "just four words here"), (2001, "JUST four\nwords here"), (2002, "three words here"), (2003, "")]
    return rows


@pytest.mark.parametrize("options", [{"percent": 85}, {"percent": 80}, {"percent": 85, "small": 4}])
def test_components_equal_brute_force(make_docs, families, awkward, options):
    rows = families + [(d + 3000 if d else d, t) for d, t in awkward]
    got = neardup.report(make_docs(rows), **options).collect()
    want = near(rows, options["percent"])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)


def test_small_blocks_compare_all_pairs(make_docs, families, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    got = neardup.report(make_docs(families)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near(families, 85)


def test_first_of_each_component_stays(make_docs, families):
    docs = make_docs(families + [(None, "x"), (None, None)])
    got = neardup.apply(docs, percent=85)
    assert got.columns == docs.columns
    want = sorted(d for d, (_, c) in near(families, 85).items() if d == c)
    ids = [r.doc_id for r in got.collect()]
    assert sorted(d for d in ids if d is not None) == want and ids.count(None) == 2
    assert neardup.report(make_docs([])).collect() == []


def test_large_unlinked_node_is_one_unit_until_its_memory_is_full(spark, monkeypatch):
    """Rows of the comparison grow with the sets of a node, not with the square of their number."""
    named = spark.range(1500).selectExpr("1L AS path", "id AS set_id", "100L AS n", "id AS component")
    units = neardup._units(named)
    assert (units.count(), units.select("unit").distinct().count()) == (1500, 1)
    monkeypatch.setattr(neardup, "ROOM", 100 * 800)  # two blocks
    units = neardup._units(named)
    assert (units.count(), units.select("unit").distinct().count()) == (3000, 3)
    met = units.alias("a").join(units.alias("b"), "unit").where("a.set_id < b.set_id").select("a.set_id", "b.set_id").distinct()
    assert met.count() == 1500 * 1499 // 2


def test_components_of_long_chains(spark):
    r = random.Random(2)
    order = r.sample(range(1000), 200)
    links = list(zip(order, order[1:])) + [(5000, 5001), (5001, 5001), (5001, 5000)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: min(order) for x in order if x != min(order)} | {5001: 5000}


# --- near-duplicate lines ------------------------------------------------------------------


def one_edit(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def lines(rows):
    all_lines = [
        (d, i, words_of(line)) for d, t in unique(rows).items() for i, line in enumerate((t or "").split("\n")) if words_of(line)
    ]
    all_lines.sort(key=lambda x: x[:2])
    kept = {}
    for n, (d, i, w) in enumerate(all_lines):
        kept.setdefault(d, [])
        if not any(one_edit(w, v) for *_, v in all_lines[:n]):
            kept[d].append(i)
    return kept


@pytest.fixture(scope="module")
def many_lines(word_list):
    r = random.Random(17)
    few = word_list[:30]
    bases = [r.choices(few, k=r.randint(1, 14)) for _ in range(40)]
    rows = []
    for d in range(60):
        out = []
        for _ in range(r.randint(0, 9)):
            w = list(r.choice(bases))
            for _ in range(r.choice([0, 1, 1, 2])):
                at = r.randrange(len(w) + 1)
                kind = r.choice("ids")
                if kind == "i":
                    w.insert(at, r.choice(few))
                elif at < len(w):
                    w[at:at + 1] = [] if kind == "d" else [r.choice(few)]
            out.append(r.choice(["", " "]) + r.choice([" ", "  ", "\t"]).join(w) + r.choice(["", "\r"]))
        rows.append((d * 5 % 61, "\n".join(out)))
    return rows


def test_lines_equal_brute_force(make_docs, many_lines, awkward):
    rows = many_lines + [(d + 100 if d else d, t) for d, t in awkward if d != 4 and d != 6]
    want = lines(rows)
    got = linededup.report(make_docs(rows)).collect()
    assert len(got) == sum(d is not None for d, _ in rows)
    for r in got:
        text = unique(rows)[r.doc_id]
        n = sum(bool(words_of(x)) for x in (text or "").split("\n"))
        kept = want.get(r.doc_id, [])
        assert (r.n_lines, r.n_removed, r.kept_lines) == (n, n - len(kept), ",".join(map(str, kept)))


def test_documents_lose_their_lines(make_docs, many_lines, awkward):
    rows = many_lines + [(d + 100 if d else d, t) for d, t in awkward]
    docs = make_docs(rows)
    got = linededup.apply(docs)
    assert got.columns == docs.columns
    want = lines(rows)
    texts = {}
    for d, t in unique(rows).items():
        parts = (t or "").split("\n")
        if t is None or not any(map(words_of, parts)):
            texts[d] = t
        elif want[d]:
            texts[d] = "\n".join(x for i, x in enumerate(parts) if i in set(want[d]) or not words_of(x))
    assert {r.doc_id: r.text for r in got.collect() if r.doc_id is not None} == texts
    assert [r.text for r in got.collect() if r.doc_id is None] == [t for d, t in rows if d is None]
    assert linededup.report(make_docs([])).collect() == []


# --- benchmark decontamination -----------------------------------------------------------


@pytest.mark.parametrize("length", range(8, 21))
def test_masks_miss_no_exchange(length):
    places = [([i for i, x in enumerate(m) if x == "1"], len(m)) for m in decontaminate.MASKS]
    for bad in itertools.combinations(range(length), length // 5):
        assert any(
            not any(o + p in bad for p in marks) for marks, n in places for o in range(length - n + 1)
        ), bad


def contaminated(docs, items):
    token = re.compile("[^\x00-/:-@\\[-`{-\x7f]+")

    def split(t):
        return token.findall((t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))

    out = {}
    tests = [(i, split(t)) for i, t in items]
    for d, t in docs:
        w = split(t)
        found = set()
        for i, x in tests:
            n = min(13, len(x))
            if not x:
                continue
            for shift in range(-len(x), len(w)):
                same = [a == w[shift + k] if 0 <= shift + k < len(w) else None for k, a in enumerate(x)]
                for a in range(len(x) - n + 1):
                    part = same[a:a + n]
                    if None not in part and (all(part) if len(x) < 8 else 5 * sum(part) >= 4 * n):
                        found.add(i)
        out[d] = found
    return out


@pytest.mark.parametrize("block", [60, 1_000_000])
def test_decontamination_equals_brute_force(spark, make_docs, word_list, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    r = random.Random(23)
    few = word_list[:40]
    items = [(i, " ".join(r.choices(few, k=r.choice([3, 8, 9, 12, 20, 30])))) for i in range(25)]
    items += [(30, None), (31, ""), (None, " ".join(word_list[50:70])), (5, items[5][1]), (None, word_list[90])]
    items += [(40 + n, " ".join(word_list[100 + 10 * n:100 + 11 * n])) for n in range(1, 8)]  # shorter than most masks
    docs = []
    for d in range(60):
        x = r.choice(items[:25])[1].split()
        for _ in range(r.randint(0, 6)):
            x[r.randrange(len(x))] = r.choice(few)
        x = x[r.choice([0, 0, 3]):]
        docs.append((d, " ".join(r.choices(few, k=r.randint(0, 9))) + " " + ", ".join(x).upper() + "! " + " ".join(r.choices(few, k=9))))
    docs += [(100, None), (101, ""), (102, "..."), (103, " ".join(word_list[45:75])), (104, "Ä " * 5000)]
    docs += [(110, f"x {word_list[90]}"), (111, " ".join(word_list[88:92] + word_list[55:70]))]
    for n in range(1, 8):
        x = word_list[100 + 10 * n:100 + 11 * n]
        docs += [(120 + n, " ".join(x)), (130 + n, " ".join(["a", *x, "b"])), (140 + n, " ".join(["a", *x[:-1], "b"]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contaminated(docs, items)
    assert 10 < sum(map(bool, want.values())) < 80
    assert all(want[120 + n] == want[130 + n] == {40 + n} and not want[140 + n] for n in range(1, 8))
    got = {x.doc_id: x for x in decontaminate.report(make_docs(docs), bench).collect()}
    assert set(got) == set(want)
    for d, found in want.items():
        assert (got[d].contaminated, got[d].n_items) == (bool(found), len(found))
        assert got[d].item_id == min(found - {None}, default=None)
    clean = decontaminate.apply(make_docs(docs), bench)
    assert clean.columns == make_docs(docs).columns
    assert sorted(x.doc_id for x in clean.collect()) == sorted(d for d, f in want.items() if not f)
    assert decontaminate.report(make_docs([]), bench).collect() == []
    assert not any(x.contaminated for x in decontaminate.report(make_docs(docs), bench.limit(0)).collect())


def test_hashes_without_each_word(spark):
    r = random.Random(3)
    rows = [(i, r.choices("abc", k=i % 40)) for i in range(120)]
    d = spark.createDataFrame(rows, "id long, w array<string>")
    both = d.select("id", "w", linededup._without_each(F.col("w"), 1).alias("h")).collect()
    seen = {}
    for r in both:
        assert len(r.h) == len(r.w) + 1
        for i, h in enumerate(r.h):
            left = tuple(r.w) if i == 0 else tuple(r.w[:i - 1] + r.w[i:])
            assert seen.setdefault(left, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_lines_alike(spark, make_docs, word_list):
    r = random.Random(23)
    line = r.choices(word_list, k=60_000)
    at = 41_234
    rows = [
        (1, " ".join(line)), (2, " ".join(line[:at] + line[at + 1:])), (3, " ".join(line[:at] + ["other"] + line[at + 1:])),
        (4, " ".join(line[:at] + ["other"] + line[at:])), (5, " ".join(line[:at] + ["other", "words"] + line[at + 2:])),
    ]
    start = time.monotonic()
    got = {x.doc_id: (x.n_removed, x.n_near) for x in linededup.report(make_docs(rows)).collect()}
    assert got == {1: (0, 0), 2: (1, 1), 3: (1, 1), 4: (1, 1), 5: (1, 1)}
    assert time.monotonic() - start < 120  # no cost that grows with the square of the length
