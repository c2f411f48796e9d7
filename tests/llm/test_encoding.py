"""Operators 1 and 6 against the libraries, and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from veridex.llm import sentencepiece_bpe as S
from veridex.llm import token_store as T

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def test_backtracking_equals_the_library(rows):
    own, library = S.encoder(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(3)
    alphabet, pieces = "ab é▁ \n\t.,!_²12日न्ा😀'", list(own.ids)
    some = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 8))) for _ in range(3000)]
    for text in [*some, *(r[1] for r in rows)]:
        assert own.encode(text) == library.encode(text or ""), repr(text)[:200]


def test_remerging_is_plain_bpe():
    own = S.encoder(PIECES)
    for word in ("▁international", "▁▁▁▁lead", "abracadabra", "▁" * 40):
        assert own.tokens(word) == own.remerge(word)


def test_digests(docs, no_docs, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = sorted((str(r[0]), len(i := library.encode(r[1] or "")), sha(",".join(map(str, i))), sha(library.decode(i))) for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in S.digests(docs, PIECES).collect()) == expected
    assert S.digests(no_docs, PIECES).count() == 0 and S.encode_column(docs, PIECES).count() == len(rows) and S.encoded(docs, PIECES).count() == len(rows)


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1001):
        values = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = T.pack(values)
        got, end = T.unpack(np.frombuffer(b"\x07" + control + data, np.uint8), 1, n)
        assert (got == values).all() and end == 1 + len(control) + len(data)
    docs, lengths, ranks = T.read_block(T.write_block([None, -5, 2**40], np.array([0, 2, 1]), np.array([1, 70000, 3])))
    assert docs == [None, -5, 2**40] and lengths.tolist() == [0, 2, 1] and ranks.tolist() == [1, 70000, 3]


def test_ids_equal_the_library(rows):
    own, library = T.Ids(BYTES), Tokenizer.from_file(BYTES)
    assert own.core is not None
    safe = [chr(c) for c in range(0x2100) if not T._OTHER(chr(c))]
    rng = random.Random(4)
    some = ["".join(rng.choice(safe) for _ in range(30)) for _ in range(2000)] + [x + c + y for c in safe for x in ("a", " ", "1", ".") for y in ("b", " ", "2", "!")]
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    assert added
    special = [form.format(t) for t in added for form in ("{0}", "a{0}b", " {0} ", "x {0}{0} y", "{0}\n", "<{0}>")] + [t[:-1] for t in added] + [t.upper() for t in added]
    for text in [*some, *special, *(r[1] for r in rows)]:
        assert own.encode(text).tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)[:200]


def test_store_round_trip(spark, docs, no_docs, rows, tmp_path):
    library = Tokenizer.from_file(BYTES)
    T.write(docs, BYTES, str(tmp_path / "ids"), block_tokens=500)
    got = sorted(T.read(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    ids = {r[0]: [*library.encode(r[1] or "", add_special_tokens=False).ids, T.END] for r in rows}
    at = 0
    for r in got:
        own = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert own == ids[r.doc_id] and r.start == at and r.n_tokens == len(own)
        at += len(own)
    order = [r.doc_id for r in got]
    assert order[0] is None and order[1:] == sorted(d for d in (r[0] for r in rows) if d is not None)
    report = {r.doc_id: r.ids_crc32 for r in T.report(docs, BYTES).collect()}
    assert report == {d: zlib.crc32(np.array(i, "<u4").tobytes()) for d, i in ids.items()}
    assert T.report(no_docs, BYTES).count() == 0
    ids = {1: "hello <|endoftext|> world", 2: "<|endoftext|>"}
    found = {r.doc_id: r.n_tokens for r in T.report(spark.createDataFrame(list(ids.items()), "doc_id bigint, text string"), BYTES).collect()}
    assert found == {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in ids.items()} and found[2] == 2


def test_rank_order_is_by_frequency(docs):
    order = T.ranks(T.tokenise(docs, BYTES), BYTES)
    assert sorted(order.tolist()) == list(range(len(order)))
