"""SentencePiece codec against the library; packing against the tokenizer and its own constraints."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from cloakroom.llm import packing, sentencepiece_codec

MODEL, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")


def _library(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for t in texts:
        ids = sp.encode(t, add_eos=True)
        yield ids, sp.decode(ids)


def test_segments_equal_the_library_on_odd_strings():
    codec = sentencepiece_codec.codec(MODEL)
    rng = random.Random(1)
    letters = "aab  \n\t▁éñ漢😀\x00the.ing12$² ‍"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(800)] + ["", " ", "a" * 5000, "ab" * 3000 + " x"]
    got = [x for lo in range(0, len(texts), 50) for x in codec.encode_texts(texts[lo : lo + 50])]
    for (n, ids, text), (want, shown) in zip(got, _library(texts)):
        assert (n, ids, text) == (len(want), " ".join(map(str, want)), shown)


def test_decode_equals_the_library_on_any_ids():
    codec = sentencepiece_codec.codec(MODEL)
    rng = random.Random(2)
    for _ in range(500):
        ids = [rng.choice([rng.randint(0, 300), rng.randint(0, 31_999)]) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == codec.sp.decode(ids)


def test_cover_steps_back_where_the_longest_match_is_wrong():
    codec = sentencepiece_codec.codec(MODEL)
    back = 0
    for word in ("erreedha", "thtionha", "onhationer", "ciónmentez"):
        longest = codec.longest("▁" + word)
        cover = codec.cover("▁" + word)
        assert cover == codec.merged("▁" + word)
        back += cover[0] != longest
    assert back


def test_codec_rows(spark, odd_documents, no_documents):
    rows = sentencepiece_codec.encode(odd_documents, MODEL, with_ids=True).collect()
    assert len(rows) == odd_documents.count()
    texts = Counter((r["doc_id"], r["text"] or "") for r in odd_documents.collect())
    for (doc, text), (want, shown) in zip(texts, _library([t for _, t in texts])):
        mine = [r for r in rows if r["doc_id"] == doc and r["decoded"] == shown]
        assert len(mine) >= texts[doc, text]
        assert mine[0]["ids"] == want and mine[0]["n_tokens"] == len(want)
        assert mine[0]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert sentencepiece_codec.encode(no_documents, MODEL).count() == 0


def test_word_ids_equal_the_tokenizer():
    words = packing.WordIds(WORDS)
    rng = random.Random(3)
    letters = [*"aabAÉéß  \n\t'sT.,#12ñ漢é İΣσ\x85\x1c ½²€", "<|endoftext|>", "'re", "<|"]
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(0, 6))) for _ in range(4)) for _ in range(1500)]
    for t, got in zip(texts, words.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == words.tok.encode(t, add_special_tokens=False).ids + [0]


def test_word_cache_grows_for_one_text_and_starts_anew():
    words = packing.WordIds(WORDS)
    words.CACHE = 64
    words._forget()
    texts = [" ".join(f"{a}{b}word {i}, 'tis" for i, (a, b) in enumerate((x, y) for x in "abcdefgh" for y in letters)) for letters in ("ijklmnop", "qrstuvwx", "ij")]
    for t in texts * 2:
        assert np.frombuffer(words.encode([t])[0], "<u4").tolist() == words.tok.encode(t, add_special_tokens=False).ids + [0]


def test_word_cache_is_as_large_as_its_strings():
    words = packing.WordIds(WORDS)
    words.encode(["a few words"])
    assert 24 * words.slots < 4 << 20  # 50 MB before
    texts = [" ".join(a + b + c + "z" * k for a in letters for b in letters for c in letters for k in range(5)) for letters in ("abcdefghijklmnopqrstu", "klmnopqrstuvwxyz")]
    first = words.encode(texts)
    held = words.n
    assert 50_000 < held and 3 * held <= 2 * words.slots
    assert words.encode(texts) == first and words.n == held
    for t, got in zip(texts, first):
        assert np.frombuffer(got, "<u4").tolist() == words.tok.encode(t, add_special_tokens=False).ids + [0]


def test_most_sequences_come_from_the_program(monkeypatch):
    rng = np.random.default_rng(8)
    counts = np.bincount(np.minimum(2048, rng.lognormal(5.5, 1.2, 200_000).astype(int) + 1), minlength=2049)
    histogram = {int(v): int(n) for v, n in enumerate(counts) if n}
    bound = -(-sum(v * n for v, n in histogram.items()) // 2048)
    rest, best_fit = [], packing._best_fit
    monkeypatch.setattr(packing, "_best_fit", lambda left, capacity: rest.append(best_fit(left, capacity)) or rest[-1])
    plan = packing.plan(histogram, 2048)
    made = sum(t for _, t in plan)
    by_rest = min(sum(t for _, t in r) for r in rest if plan[len(plan) - len(r) :] == r)
    assert made <= 1.002 * bound and made - by_rest > 0


def _check_plan(histogram, capacity):
    plan = packing.plan(histogram, capacity)
    used = Counter()
    for pattern, times in plan:
        assert times > 0 and sum(v * n for v, n in pattern.items()) <= capacity
        for v, n in pattern.items():
            used[v] += n * times
    assert used == Counter(histogram)
    return sum(t for _, t in plan)


@pytest.mark.parametrize(
    "histogram, best",
    [
        ({}, 0),
        ({10: 7}, 7),
        ({6: 50, 4: 50}, 50),
        ({6: 40, 4: 10, 1: 3}, 40),
        ({5: 101}, 51),
        ({7: 10, 3: 10, 2: 10, 8: 10}, 20),
        ({4: 3, 3: 6}, 3),
    ],
)
def test_plan_reaches_the_optimum_of_small_cases(histogram, best):
    assert _check_plan(histogram, 10) == best


def test_plan_stays_near_the_bound_on_large_histograms():
    rng = np.random.default_rng(4)
    for lengths in (rng.integers(1, 2049, 30_000), rng.integers(400, 800, 100_000), np.minimum(2048, rng.lognormal(5.5, 1.2, 50_000).astype(int) + 1)):
        h = {int(v): int(n) for v, n in zip(*np.unique(lengths, return_counts=True))}
        assert _check_plan(h, 2048) <= lengths.sum() / 2048 * 1.01 + 2


def test_packed_rows(spark, odd_documents, no_documents):
    words = packing.WordIds(WORDS)
    rows = packing.pack_documents(odd_documents, WORDS).collect()
    docs = odd_documents.collect()
    want = Counter()
    for d in docs:
        ids = words.tok.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[d["doc_id"], k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) == -(-sum(r["length"] for r in rows) // 2048)
    assert packing.pack_documents(no_documents, WORDS).count() == 0
