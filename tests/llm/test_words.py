"""Words of many texts at once: only distinct ones are looked up, and windows that share a hash are told apart."""

import hashlib

import numpy as np

from turnwise.llm import common

ODD = [b"", b"  ", b"a", b" a\t\nb\x0b\x0cC\rd ", b"\x00 a\x00 \x1c\x1d\x85\xc2\xa0 x", "AÄ ".encode() + b"L" * 200, b"a " * 5000, b""]


def test_a_word_is_looked_up_once(monkeypatch):
    seen, plain = [], common.Digests.of
    monkeypatch.setattr(common.Digests, "of", lambda self, words: seen.extend(words) or plain(self, words))
    common.words_of(ODD)
    assert sorted(seen) == sorted({w for t in ODD for w in t.split()})


def test_digests_are_those_of_each_word():
    for texts in (ODD, ODD[:2], [], ODD[::-1]):
        for lower in (False, True):
            words = [(i, w) for i, t in enumerate(texts) for w in (t.lower() if lower else t).split()]
            want = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16, key=b"turnwise words").digest() for _, w in words), "<u8").reshape(-1, 2)
            for _ in range(2):  # as new words and as known ones
                first, second, text = common.words_of(texts, lower)
                assert text.tolist() == [i for i, _ in words]
                assert first.tolist() == want[:, 0].tolist() and second.tolist() == want[:, 1].tolist()
            common._DIGESTS.forget()


def test_groups_by_hash_and_check():
    wide, check = np.array([7, 3, 7, 7, 3, 9], np.uint64), np.array([1, 5, 2, 1, 5, 1], "<u4")
    order, at = common.grouped(wide, check)
    assert [sorted(g.tolist()) for g in np.split(order, at[1:])] == [[1, 4], [0, 3], [2], [5]]
    values, among = np.array([5, 1, 9, 3, 3]), np.array([1, 3, 3, 8])
    assert common.places_of(values, among).tolist() == np.searchsorted(among, values).tolist()
