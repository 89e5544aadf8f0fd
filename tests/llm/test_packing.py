import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quadrille.llm import packing
from quadrille.llm.queries import op5_packing
from tests.llm import cases

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check(rows, docs):
    """Every id in one piece, pieces gapless in sequences of at most 2048, ids as the library gives them."""
    want = {}
    for i, t in docs:
        want.setdefault(i, []).append([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 1])
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert pieces.keys() == want.keys()
    for i, texts in want.items():
        whole = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[i])
        assert sorted((s, min(2048, len(t) - s), zlib.crc32(np.array(t[s : s + 2048], "<u4").tobytes()), len(t)) for t in texts for s in range(0, len(t), 2048)) == whole
    padding = 0
    for of in sequences.values():
        at = 0
        for r in sorted(of, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding, sum(r.length for r in rows)


def test_query_is_an_exact_round_trip(spark, sf_dir):
    padding, tokens = check(op5_packing(spark, sf_dir).collect(), cases.documents(spark, sf_dir))
    assert padding < 0.03 * tokens


def test_awkward_rows(spark):
    docs = spark.createDataFrame([*cases.rows(), (900, "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b it's ÉCOLE é  x y", "en", None, None, None, None, None)], cases.SCHEMA)
    check(packing.pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark):
    assert packing.pack(cases.frame(spark).limit(0)).count() == 0


def test_patterns_hold_all_and_are_near_the_bound():
    rng = np.random.default_rng(1)
    sizes = np.arange(1, 257)
    counts = rng.integers(0, 400, 256)
    found = packing.patterns_for(counts[counts > 0], sizes[counts > 0], 256)
    assert (sum(p * n for p, n in found) == counts[counts > 0]).all()
    assert all((p * sizes[counts > 0]).sum() <= 256 for p, _ in found)
    big = counts[128:].sum()
    assert sum(n for _, n in found) <= max(big, -(-(counts * sizes).sum() // 256)) * 1.02 + 5


def test_ids_dont_depend_on_the_words_kept():
    import public_tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"Word{k} the, cat{k % 7} <b>{k}</b> sat\u00e9{k % 3}!".encode() for k in range(300)] + [b"", b" "]
    few, many = packing.Encoder(path, words=5), packing.Encoder(path)
    assert [few.encode([x])[0] for x in texts * 2] == many.encode(texts * 2)


def test_words_of_ascii_letters_skip_the_steps_they_do_not_need():
    """They go to the bare model, with the ids of the whole tokenizer; a text is one run of its kind in either case."""
    texts = ["Plain WORDS, and plain words; don't İstanbul ΣΑΣ", "<|endoftext|> <B>Plain</B> WORDS É x́, ſ K"]
    own = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    whole, seen = own.tokenizer, []

    class Watched:
        def encode(self, text, **more):
            return whole.encode(text, **more)

        def encode_batch_fast(self, batch, **more):
            seen.extend(batch)
            return whole.encode_batch_fast(batch, **more)

    own.tokenizer = Watched()
    for _ in range(2):
        for text, ids in zip(texts, own.encode([t.encode() for t in texts])):
            assert np.frombuffer(ids, "<u4").tolist() == [*TOKENIZER.encode(text, add_special_tokens=False).ids, 1]
        own.known, own.older = {}, own.known
    assert not [word for text in seen for word in text.split() if word.isascii()]
    assert b"plain" in own.older and b"Plain" not in own.older
