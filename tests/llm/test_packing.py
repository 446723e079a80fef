import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from granary.llm import packing
from tests.llm.conftest import prose

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def naive(sizes, capacity):
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    free, out = [], [None] * len(sizes)
    for k in order:
        b = next((b for b, f in enumerate(free) if f >= sizes[k]), None)
        if b is None:
            free.append(capacity)
            b = len(free) - 1
        out[k] = (b, capacity - free[b])
        free[b] -= sizes[k]
    return out


def test_tree_is_first_fit_decreasing():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 50, 300):
        sizes = [rng.choice([rng.randint(1, 64), rng.randint(1, 9), 64]) for _ in range(n)]
        which, offset = packing.first_fit_decreasing(np.array(sizes, dtype=np.int64), 64)
        assert list(zip(which.tolist(), offset.tolist())) == naive(sizes, 64)


def test_word_memory_equals_the_tokenizer(tokenizer, monkeypatch):
    rng = random.Random(2)
    texts = ["", " ", "ΣΟΦΟΣ x", "İstanbul", "Été é.", "it's 'll ' s", "...a..b, c,d ,e", "<|endoftext|> <|startoftext|>x", "<|ENDOFTEXT|> a<|endoftext|>B.", "İ. İ, aİ! x", "\u0958. क़,", "a\x01b \x01 c", "\x01", "a\x1cb\xa0c d", "日本語。 \U0001f389!"]
    texts += ["".join(rng.choice("aB .,;:'éÉΣİ1\n\t\x01́") for _ in range(rng.randint(1, 50))) for _ in range(400)]
    encoder = packing.WordEncoder(PATH)
    for limit in (600_000, 20):
        monkeypatch.setattr(packing, "REMEMBERED", limit)
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(texts)]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.WordEncoder(PATH, special=False).encode_all(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("group", [packing.GROUP_TOKENS, 3000])
def test_every_token_lies_in_one_place(spark, dirty, tokenizer, group):
    rows = [(r.doc_id, r.text) for r in dirty.collect()]
    extra = [(500 + k, prose(random.Random(k), random.Random(k).randint(1, 400))) for k in range(60)]
    docs = dirty.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    pieces = packing.pack(packing.tokenise(docs, PATH, length=512), 512, group).collect()
    sequences = defaultdict(list)
    found = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        found[p.doc_id, p.doc_tokens].append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    tokens = sum(p.length for p in pieces)
    assert len(sequences) <= tokens / 512 + 3 * max(1, -(-tokens // group)) + 1
    want = defaultdict(list)
    for i, t in rows + extra:
        ids = ids_of(tokenizer, t)
        want[i, len(ids)] += [(s, ids[s:s + 512]) for s in range(0, len(ids), 512)]
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}


def test_digests(dirty, nothing, tokenizer):
    texts = defaultdict(list)
    for r in dirty.collect():
        texts[r.doc_id].append(r.text)
    for p in packing.packed_digests(dirty, PATH).collect():
        crcs = [zlib.crc32(np.array(ids_of(tokenizer, t)[p.start:p.start + p.length], dtype="<u4").tobytes()) for t in texts[p.doc_id]]
        assert p.ids_crc32 in crcs
    assert packing.packed_digests(nothing, PATH).count() == 0
