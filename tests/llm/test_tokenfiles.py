import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlume.llm import queries, tokenfiles
from ledgerlume.llm.shared import new_folder


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=30), max_size=12), st.integers(1, 20), st.booleans())
def test_exact_round_trip(ids, block, bits):
    assert tokenfiles.roundtrip(ids, block, bits) == ids


def test_random_access(tmp_path):
    ids = [random.Random(1).randrange(50_000) for _ in range(1000)]
    with open(tmp_path / "x", "wb") as sink:
        w = tokenfiles.ShardWriter(sink, 64, True)
        w.add(None, np.array(ids, "<u4").tobytes())
        w.close()
    with open(tmp_path / "x", "rb") as source:
        r = tokenfiles.ShardReader(source)
        assert r.names == [None] and r.ids(70, 400).tolist() == ids[70:400] and r.ids(5, 5).tolist() == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'sStTé́Σ　 \x1c\x010|<>")), st.characters(codec="utf-8")), max_size=60))
def test_pieces_encode_as_the_whole(text):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tool = Tokenizer.from_file(path)
    assert np.frombuffer(b"".join(tokenfiles.encoder(path, 1)([text])), "<u4").tolist() == [*tool.encode(text, add_special_tokens=False).ids, 1]


def test_generations_and_kind():
    e = tokenfiles.Encoder(queries.tokenizer_path(), 1)
    assert e.by_piece
    texts = [f"w{i % 50} x{i}" for i in range(300)]
    want = [tokenfiles.Encoder(queries.tokenizer_path(), 1)._ids(t).tobytes() + e.close for t in texts]
    e_remembered = tokenfiles.REMEMBERED
    try:
        tokenfiles.REMEMBERED = 40
        assert [x for i in range(0, 300, 20) for x in e(texts[i : i + 20])] == want
    finally:
        tokenfiles.REMEMBERED = e_remembered


def test_other_tokenizers_are_encoded_whole():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    tool = Tokenizer.from_file(path)
    text = "Two  words\n and <|endoftext|>"
    assert np.frombuffer(b"".join(tokenfiles.encoder(path, None)([text])), "<u4").tolist() == tool.encode(text, add_special_tokens=False).ids


def test_files_against_plain_encoding(spark, frame, odd):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(queries.tokenizer_path())
    docs = frame(odd)
    folder = new_folder(spark, "test")
    shards = tokenfiles.write_shards(docs, folder, queries.tokenizer_path(), shard_bytes=4000, block_ids=100)
    assert shards.count() > 3
    got = [tuple(r) for r in tokenfiles.read_shards(shards, folder, digest=True).orderBy("start").collect()]
    assert [g[0] for g in got] == sorted((i for i, _, _ in odd), key=lambda i: (i is not None, i or 0))
    start = 0
    want = {}
    for i, t, _ in odd:
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 1]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for i, at, n, crc in got:
        assert at == start and (n, crc) in want[i]
        start += n
    whole = tokenfiles.read_shards(shards, folder).where("doc_id = 2").first()
    assert whole["ids"] == [1]
    assert tokenfiles.token_digest(spark, docs.limit(0), queries.tokenizer_path()).count() == 0


def test_the_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(tokenfiles, "REMEMBERED_BYTES", 200_000)
    e, plain = tokenfiles.Encoder(queries.tokenizer_path(), 1), tokenfiles.Encoder(queries.tokenizer_path(), 1)
    r = random.Random(6)
    unspaced = ["".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(900)) for _ in range(60)] + ["".join(r.choice("abcXYZ019+/") for _ in range(3000)) for _ in range(60)]
    texts = [f"say {x} v{i} {'w' * (i % 60)}" for i, x in enumerate(unspaced)] + [" ".join(f"n{i}x{k}" for k in range(40)) for i in range(60)]
    for i in range(0, len(texts), 20):
        assert list(e(texts[i : i + 20])) == [plain._ids(t).tobytes() + plain.close for t in texts[i : i + 20]]
        own = [x for g in (e.known, e.older) for x in g]
        assert max(map(len, own)) <= tokenfiles.LONG_PIECE
        assert sum(160 + len(x) for x in own) < 3 * 200_000
