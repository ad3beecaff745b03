import numpy as np
import pyarrow as pa

from marquee.llm.words import PLAIN, Shingles, Words, slices


def test_words_of_rows_do_not_run_together():
    column = pa.array(["a b", None, "", "b\t\x0bc  é", "  "])
    found = Words(column)
    assert found.counts().tolist() == [2, 0, 0, 3, 0]
    a, b, again, c, e = found.hashes.tolist()
    assert again == b and len({a, b, c, e}) == 4


def test_hash_does_not_depend_on_place_or_slice():
    column = pa.array(["skip me", "one two three", "three two one"])
    whole = Words(column).hashes[2:]
    cut = Words(column.slice(1, 2)).hashes
    assert whole.tolist() == cut.tolist() == cut[::-1].tolist()


def test_lower_case_is_ascii_only():
    found = Words(pa.array(["ÀB àb àB"]), lower=True).hashes
    assert found[1] == found[2] != found[0]


def test_plain_words():
    assert Words(pa.array(["a-b, (c) d."]), True, PLAIN).counts().tolist() == [4]


def test_long_words_are_hashed_as_a_whole():
    text = "a " + "x" * 1000 + " b " + "x" * 1000 + " a " + "x" * 999 + "y"
    h = Words(pa.array([text])).hashes
    assert h[0] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 4
    assert h[0] == Words(pa.array(["a"])).hashes[0]


def thue_morse(n: int, a: str, b: str) -> str:
    """The sequence whose polynomial hashes modulo powers of two all collide with its complement's."""
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_words_of_any_shape_have_their_own_hashes():
    words = {thue_morse(n, *pair) for n in (7, 8, 9, 16, 64, 255, 256, 257, 1024, 2048) for pair in ("ab", "ba")}
    words |= {"a" * n for n in range(1, 300)} | {"a" * n + "\0" for n in range(1, 40)}
    words = sorted(words)
    assert len(set(Words(pa.array([" ".join(words)])).hashes.tolist())) == len(words)


def test_slices_cover_all_rows():
    column = pa.array(["x" * 10] * 7 + ["y" * 1000] + [None] * 3)
    found = list(slices(column, 25))
    assert [i for a, b in found for i in range(a, b)] == list(range(11))
    assert (7, 8) in found or any(a <= 7 < b and b - a < 5 for a, b in found)


def test_shingles_are_sets_of_runs_or_the_whole():
    sets = Shingles(pa.array(["a b c a b c", "a b", "A B", "a", "", None]), 3)
    assert np.diff(sets.first).tolist() == [3, 1, 1, 1, 0, 0]
    assert sets.of(1).tolist() == sets.of(2).tolist() != sets.of(3).tolist()
