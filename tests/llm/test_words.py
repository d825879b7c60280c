"""Word hashes on words made to collide under linear hashes."""

import itertools

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from redline.llm import neardup, wordmemo, words


def thue_morse(n, x="a", y="b"):
    return "".join(x if bin(i).count("1") % 2 == 0 else y for i in range(n))


CRAFTED = [thue_morse(n, *xy) for n in (8, 64, 65, 1024, 2048, 8192) for xy in ("ab", "ba")]


def test_different_words_have_different_hashes():
    short = ["".join(p) for k in range(1, 5) for p in itertools.product("abcdefghij", repeat=k)]
    some = short + ["q" * k for k in range(5, 200)] + ["z" * k + "a" for k in range(5, 100)] + CRAFTED
    (w,) = words.words(pa.array([" ".join(some)]))
    assert len(set(w.hash.tolist())) == len(some)
    for h in words.two_hashes(w.data, w.start, w.end):
        assert len(np.unique(h)) == len(some)


def test_ids_of_crafted_words_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [f"{w} and {w}" for w in CRAFTED]
    got = list(wordmemo.WordIds(path).encode(pa.array(texts)))
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_texts_of_crafted_words_are_no_near_duplicates(make_docs):
    a, b = thue_morse(2048), thue_morse(2048, "b", "a")
    rows = [(1, " ".join([a] * 9)), (2, " ".join([b] * 9)), (3, " ".join([a] * 12))]
    got = {x.doc_id: x.component_id for x in neardup.report(make_docs(rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
