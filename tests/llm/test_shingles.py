import pyarrow as pa
import pytest

from leafmill.llm.shingles import shingle_sets, word_hashes


@pytest.mark.parametrize("k", [1, 2, 5])
def test_sets_of_slices_are_those_of_the_texts(k):
    texts = ["é%d ÑANDÚ Ab\tcd\x0bef " % i * (i % 4) for i in range(60)] + [None, "", " \n ", "one"]
    whole = pa.array(texts)
    for at, n in ((0, 64), (20, 44), (63, 1), (30, 0)):
        sets, sizes = shingle_sets(whole.slice(at, n), k)
        parts = [shingle_sets(pa.array([t], pa.string()), k) for t in texts[at : at + n]]
        assert sizes.tolist() == [int(p[1][0]) for p in parts]
        assert sets.tolist() == [x for p in parts for x in p[0].tolist()]


@pytest.mark.parametrize("k", [1, 2, 5])
def test_sizes_are_those_of_distinct_shingles(k):
    for text in ("a b a b a b", "A a\x1cb", "x", " ", "a  b\nc d e f a b c d e f"):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for space in "\t\n\x0b\x0c\r":
            words = words.replace(space, " ")
        words = [w for w in words.split(" ") if w]
        want = {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
        assert shingle_sets(pa.array([text]), k)[1].tolist() == [len(want)]


def test_words_split_at_ascii_space_only():
    assert word_hashes(pa.array(["a b c\x85d e"]))[1].tolist() == [2]
