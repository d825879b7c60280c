"""License scan against brute force."""

import random
import re
import string
from collections import defaultdict

import pytest

from redline.llm import licensescan as scan

WORD = re.compile(scan.WORD)
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    known = [(label, t.split(), True) for label, t in scan.PHRASES] + [(label, t.split(), False) for label, t in scan.NOTICES]
    out = []
    for doc_id, text in rows:
        w = WORD.findall((text or "").translate(FOLD))
        starts, base, labels, score = [], set(), set(), 0.0
        for label, t, phrase in known:
            if phrase:
                found = [i for i in range(len(w) - len(t) + 1) if w[i:i + len(t)] == t]
                starts += found
                if found:
                    base.add(label)
                    score = 1.0
                continue
            pairs = defaultdict(set)
            for i in range(len(w) - 1):
                for j in range(len(t) - 1):
                    if w[i:i + 2] == t[j:j + 2]:
                        pairs[i - j].add(j)
            equal = {d: {j for j in range(len(t)) if 0 <= d + j < len(w) and w[d + j] == t[j]} for d in pairs}
            for d in pairs:
                near = [e for e in pairs if abs(e - d) <= scan.SLACK]
                if len(set().union(*(pairs[e] for e in near))) >= scan.VOTES * (len(t) - 1):
                    share = len(set().union(*(equal[e] for e in near))) / len(t)
                    score = max(score, share)
                    if share >= scan.SHARE:
                        labels.add(label)
        out.append((
            doc_id, len(w), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(base | labels)), score,
        ))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def texts(word_list, awkward):
    r = random.Random(13)
    rows = []
    for i in range(150):
        parts = [" ".join(r.choices(word_list[:300], k=r.randint(0, 30)))]
        for _ in range(r.randint(0, 3)):
            w = r.choice(scan.PHRASES + scan.NOTICES)[1].split()
            for _ in range(r.choice([0, 0, 1, 2, 9])):  # words exchanged, put in or left out
                at = r.randrange(len(w))
                w[at:at + r.choice([0, 1, 1, 2])] = r.choices(word_list, k=r.choice([0, 1]))
                w = w or ["none"]
            parts.append(r.choice([" ", "\n", "-"]).join(w).upper() if r.random() < 0.3 else ", ".join(w))
        rows.append((i, "\n".join(parts)))
    rows += [(500, "MIT License")] * 3 + [(500, "the mit license; CC BY-SA, cc\tby"), (None, "mit license"), (501, "mit"), (502, "license mit")]
    rows += [(503, "mit license " * 3000), (504, "of the terms " * 2000), (505, scan.NOTICES[0][1])]
    return rows + [(d + 1000 if d else d, t) for d, t in awkward]


def test_scan_equals_brute_force(make_docs, texts):
    got = scan.scan(make_docs(texts))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(texts)


def test_changed_notices_keep_their_label(make_docs):
    words = dict(scan.NOTICES)["bsd"].split()
    words[4:5] = ["machine", "code"]  # one word put in
    del words[12]
    got = scan.scan(make_docs([(1, " ".join(words)), (2, " ".join(reversed(words)))])).orderBy("doc_id").collect()
    assert [x.labels for x in got] == ["bsd", ""] and 0.7 <= got[0].score < 1 and got[1].score == 0


def test_no_python_worker_and_one_scan_of_the_texts(make_docs, texts):
    plan = scan.hits(make_docs(texts), scan.templates(make_docs([]).sparkSession, scan.PHRASES, scan.NOTICES))
    shown = plan._jdf.queryExecution().toString()
    assert "Python" not in shown.replace("PythonRDD", "").replace("applySchemaToPythonRDD", "") and "Arrow" not in shown


def test_empty_tables_and_short_templates(make_docs):
    assert scan.scan(make_docs([])).collect() == []
    with pytest.raises(ValueError, match="two words"):
        scan.scan(make_docs([]), phrases=[("x", "one")])
