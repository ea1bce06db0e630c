import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from findings_lake.llm import packing as P
from findings_lake.llm.token_counts import token_counts
from findings_lake.llm.words import WordIds

from .conftest import CLASHES, ODD_TEXTS

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


def mixed_texts():
    rng = random.Random(4)
    bits = ["alpha", "Beta", "gamma-ray", "x1y2", "  ", "\n\n", "\t", "été", "naïve", "!!", "'s", "don't", "<|endoftext|>", " ",
            "straße", "…", "日本", "\x00", "a" * 80, "9", "é"]
    return ODD_TEXTS + ["".join(rng.choice(bits) + rng.choice([" ", "", "  ", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(150)]


@pytest.mark.parametrize("table,cache", [(65_536, 100_000), (3, 2)])
def test_counts_equal_the_library(spark, documents, table, cache):
    texts = mixed_texts()
    lib = Tokenizer.from_file(BYTE)
    rows = token_counts(documents(texts, extra=CLASHES), BYTE, table_size=table, cache_size=cache, share=2).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        n = len(lib.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512), text


def test_counts_of_empty_table(documents):
    assert token_counts(documents(["a"]).limit(0), BYTE).collect() == []


def test_word_ids_equal_the_library():
    texts = [(t or "") for t in mixed_texts()]
    lib, own = Tokenizer.from_file(WORD), WordIds(WORD, limit=50)
    for k in range(0, len(texts), 7):
        for text, ids in zip(texts[k:k + 7], own.encode([t.encode() for t in texts[k:k + 7]])):
            want = lib.encode(text, add_special_tokens=False).ids
            assert ids == b"".join(i.to_bytes(4, "little") for i in want), text


def test_cuts_tile_a_document():
    for n in [1, 2, 255, 256, 257, 2047, 2048, 2049, 5000, 4096 + 1024 + 256 + 7]:
        parts = P.cuts(n)
        assert sum(parts) == n and all(p in P.TIERS or p < P.TIERS[-1] for p in parts)


def test_fill_uses_every_rest_once():
    rng = random.Random(2)
    lengths = [rng.randint(1, 255) for _ in range(3000)]
    placed = P.fill(lengths, 2048)
    bins = defaultdict(list)
    for (b, o), n in zip(placed, lengths):
        bins[b].append((o, n))
    for rows in bins.values():
        at = 0
        for o, n in sorted(rows):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= sum(lengths) / 2048 * 1.01 + 1


def test_packing(spark, documents):
    texts = mixed_texts() + ["word " * 3000, "word " * 3000]
    lib = Tokenizer.from_file(WORD)
    docs = documents(texts, extra=CLASHES).repartition(3)
    rows = P.pack(docs, WORD, with_ids=True, step_tokens=4096).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for k, text in enumerate(texts):
        want = lib.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(by_doc[k], key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == b"".join(i.to_bytes(4, "little") for i in want)
        assert [r.start for r in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        assert {r.doc_tokens for r in own} == {len(want)}
    groups = defaultdict(int)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= own[0].tier and (own[0].tier == 2048 or at == own[0].tier)
        assert len({(r.tier, r.step_group) for r in own}) == 1
        groups[own[0].tier, own[0].step_group] += 1
    for tier in P.TIERS:  # every group holds as many sequences of a tier as any other, or one less
        n = [v for (t, _), v in groups.items() if t == tier]
        assert not n or max(n) - min(n) <= 1


def test_packing_of_empty_table_and_repeated_rows(documents):
    assert P.pack(documents(["a"]).limit(0), WORD).collect() == []
    rows = P.pack(documents(["same text"] * 3, ids=[5, 5, 5]), WORD).collect()
    assert len(rows) == 3 and len({(r.sequence_id, r.offset) for r in rows}) == 3
