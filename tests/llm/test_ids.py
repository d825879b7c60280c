import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyarrow import fs
from tokenizers import Tokenizer

from redline.llm import idfiles, pieces, tokencounts
from redline.llm.wordmemo import WordIds
from redline.sources.shared import new_folder

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def library_ids(texts):
    got = Tokenizer.from_file(WORDS).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [x.ids for x in got]


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 31, 32])
def test_packing_round_trips(bits):
    r = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = r.integers(0, 1 << bits, n, dtype=np.uint64)
        data = idfiles.pack(ids, bits)
        assert len(data) == -(-n // 64) * 8 * bits
        assert idfiles.unpack(data, bits, n).tolist() == ids.tolist()
    assert [idfiles.bits_for(v) for v in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_random_access(tmp_path):
    docs = [(i, np.arange(i * 7 % 40, dtype=np.uint32) + i) for i in range(50)] + [(None, np.arange(300, dtype=np.uint32))]
    with open(tmp_path / "f", "wb") as sink:
        w = idfiles.Writer(sink, 11, block=64)
        for d in docs:
            w.add(*d)
        w.close()
    reader = idfiles.Reader(fs.LocalFileSystem().open_input_file(str(tmp_path / "f")))
    for i, (doc_id, ids) in enumerate(docs):
        assert reader.docs[i] == doc_id and reader.doc(i).tolist() == ids.tolist()
    assert [x[2].tolist() for x in reader.all_docs()] == [d[1].tolist() for d in docs]
    everything = np.concatenate([d[1] for d in docs])
    assert reader.ids(100, 333).tolist() == everything[100:333].tolist()
    (tmp_path / "torn").write_bytes((tmp_path / "f").read_bytes()[:-20])
    with pytest.raises(ValueError):
        idfiles.Reader(fs.LocalFileSystem().open_input_file(str(tmp_path / "torn")))


@pytest.mark.parametrize("remembered", [10, 10_000])
def test_words_are_encoded_like_whole_texts(awkward, word_list, remembered):
    r = random.Random(1)
    texts = [t for _, t in awkward] + [" ".join(r.choices(word_list, k=50)) for _ in range(30)]
    own = WordIds(WORDS, remembered)
    want = library_ids(texts)
    assert [x.tolist() for x in own.encode(pa.array(texts))] == want
    assert own.counts(pa.array(texts)).tolist() == [len(x) for x in want]
    assert own.counts(pa.array([], pa.string())).tolist() == []


def test_id_files_hold_every_document_in_order(spark, make_docs, awkward):
    got = sorted((tuple(r) for r in idfiles.round_trip(make_docs(awkward), WORDS, 1).collect()), key=lambda r: r[1])
    start, want = 0, []
    for doc_id, text in sorted(awkward, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library_ids([text])[0], 1], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_id_files_of_an_empty_table(make_docs):
    assert idfiles.round_trip(make_docs([]), WORDS, 1).collect() == []


def unigram_library(own):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(PIECES, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        if p.type == 1:
            p.score = own.known[p.piece][0]
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def best_split(own, text):
    """Plain Viterbi over a whole text."""
    best, back = [0.0], [0]
    for end in range(1, len(text) + 1):
        options = []
        for a in range(max(0, end - own.longest), end):
            p = own.known.get(text[a:end], (own.unknown,) if a == end - 1 else None)
            if p:
                options.append((best[a] + p[0], -a))
        s, a = max(options)
        best.append(s)
        back.append(-a)
    cuts, end = [], len(text)
    while end:
        cuts.append(text[back[end]:end])
        end = back[end]
    return [i for c in cuts[::-1] for i in own.ids_of(c)]


def test_streaming_viterbi_equals_the_whole_lattice(word_list):
    own = pieces.Pieces(PIECES)
    r = random.Random(5)
    for _ in range(20):
        text = "▁" + "▁".join(r.choices(word_list, k=40)) + "深" * r.randint(0, 3) + "aaaaaaaaaaaa" * r.randint(0, 9)
        chunks = [text[i:i + 17] for i in range(0, len(text), 17)]
        got = list(pieces.viterbi(own, chunks, check=r.choice([1, 5, 64])))
        assert [i for ids in got for i in ids] == best_split(own, text)
        assert len(got) > 1  # something was committed before the end


def test_pieces_equal_the_library_and_decode(spark, make_docs, awkward, word_list):
    own = pieces.Pieces(PIECES)
    library = unigram_library(own)
    r = random.Random(9)
    rows = [(d, t if t is None or len(t) < 5000 else t[:5000]) for d, t in awkward if d is not None]
    rows += [(100 + i, " ".join(r.choices(word_list, k=30)).capitalize() + ".\n" * (i % 3)) for i in range(40)]
    encoded = pieces.encode(make_docs(rows), PIECES)
    got = {}
    for g in encoded.collect():
        got.setdefault(g.doc_id, g)
    back = {x.doc_id: x.text for x in pieces.decode(encoded, PIECES).collect()}
    for doc_id, text in rows:
        g = got[doc_id]
        if text is None:
            assert (g.ids, g.n_ids, g.round_trip, back[doc_id]) == (None, None, None, None)
            continue
        want = library.encode(text)
        assert (g.ids, g.n_ids) == (want, len(want))
        assert g.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        assert g.round_trip == ("▁" not in text) and (back[doc_id] == text) == g.round_trip
    assert pieces.encode(make_docs([]), PIECES).collect() == []


def test_rollup_commits_once_and_subtracts(spark, make_docs, awkward):
    a = tokencounts.measure(make_docs([(1, "a b"), (2, None), (3, "c"), (3, "c")]), WORDS, "v1").cache()
    b = tokencounts.measure(make_docs([(1, "a b")]), WORDS, "v2", added=1)
    totals = tokencounts.Rollup(spark, new_folder(spark, "rollup"))
    assert totals.totals().collect() == []
    assert totals.commit("first / 1", tokencounts.signed_rows(a, 1))
    assert not totals.commit("first / 1", tokencounts.signed_rows(a, 1))

    def now():
        return {r.version: (r.n_docs, r.n_tokens) for r in totals.totals().collect()}

    assert now() == {"v1": (4, 4)}
    assert totals.commit("moved", tokencounts.revision(a.where("doc_id = 1"), b))
    assert totals.commit("empty", tokencounts.signed_rows(a.where("false"), 1))
    assert now() == {"v1": (3, 2), "v2": (1, 3)}
    totals.compact()
    assert now() == {"v1": (3, 2), "v2": (1, 3)}
    assert not totals.commit("moved", tokencounts.revision(a.where("doc_id = 1"), b))
    assert totals.commit("gone", tokencounts.signed_rows(b, -1))
    assert now() == {"v1": (3, 2)}
    measured = tokencounts.measure(make_docs(awkward), WORDS, "v1").collect()
    want = dict(zip([d for d, _ in awkward], map(len, library_ids([t for _, t in awkward]))))
    assert {r.doc_id: r.n_tokens for r in measured} == want and len(measured) == len(awkward)


def test_a_second_writer_of_one_batch_fails(spark, make_docs):
    deltas = tokencounts.signed_rows(tokencounts.measure(make_docs([(1, "a b")]), WORDS, "v1"), 1).cache()
    totals = tokencounts.Rollup(spark, new_folder(spark, "rollup"))
    assert totals.commit("x", deltas)
    with pytest.raises(OSError):  # it looked before the first one was done
        totals._store("x", deltas, [])
    with pytest.raises(ValueError):
        totals.commit("compact y", deltas)
    assert [(r.n_docs, r.n_tokens) for r in totals.totals().collect()] == [(1, 2)]


def test_interrupted_commit_leaves_totals(spark, make_docs):
    a = tokencounts.measure(make_docs([(1, "a b")]), WORDS, "v1")
    totals = tokencounts.Rollup(spark, new_folder(spark, "rollup"))
    deltas = tokencounts.signed_rows(a, 1)
    deltas.write.parquet(f"{totals.folder}/aside/lost/rows")  # written aside, never renamed
    assert totals.commit("x", deltas)
    assert [(r.n_docs, r.n_tokens) for r in totals.totals().collect()] == [(1, 2)]
