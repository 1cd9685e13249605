"""Obfuscations with several readings: letters said twice, long tokens, marks between words, words spaced out."""

import itertools
import random

import pytest

from palimpsest.llm import toxicity

WORDS = [("idiot", 50), ("stupid", 40), ("the", 900), ("jerk", 30), ("you", 800), ("loser", 30), ("book", 60), ("is", 500), ("cat", 90), ("are", 300), ("an", 300)]


@pytest.fixture(scope="module")
def channel():
    return toxicity.Channel(toxicity.Letters(WORDS))


def test_letters_said_twice(channel):
    for written, word in (("iidiioott", "idiot"), ("stuupid", "stupid"), ("jeerk", "jerk"), ("book", "book"), ("bookk", "book")):
        assert channel.restore(written) == word, written


def test_marks_between_words(channel):
    for written, words in (("jerk,idiot", "jerk idiot"), ("you—idiot", "you idiot"), ("stupid/1d10t", "stupid idiot"), ("i.d.i.o.t", "idiot"), ("s-t-u-p-i-d", "stupid")):
        assert channel.restore(written) == words, written


def test_long_tokens(channel):
    assert "idiot" in channel.words(",".join(["cat"] * 20 + ["1d10t"] + ["book"] * 20))
    assert channel.restore("i" + "." * 3 + "-.".join("idiot" * 1)[1:] + "-_" * 40) == "idiot"
    channel.restore("a1" * 20_000)  # linear in the length, and no recursion


def test_spaced_out_words(channel):
    assert {"you", "are", "an", "idiot"} <= channel.words(" ".join("youareanidiot"))
    long = " ".join("thecatis" * 5 + "idiot" + "thecatis" * 5)
    assert "idiot" in channel.words(long)
    assert "idiot" in channel.words("x you i d 1 0 t there")


def test_viterbi_with_bounds_finds_the_best_path(channel):
    """The best of all paths, by listing them; a mark may be a space, which ends a word."""
    rng = random.Random(5)
    for _ in range(60):
        token = "".join(rng.choice("idotkcas1!,-. 0") for _ in range(rng.randint(2, 7)))
        options = [(*o, *([("/", o[-1][1])] if not c.isalnum() else [])) for (c, _), o in zip(itertools.groupby(token), channel.lattice(token), strict=True)]
        best = -float("inf")
        for path in itertools.product(*options):
            written = "".join(p for p, _ in path)
            s, words = sum(c for _, c in path), written.split("/")
            if "" in words[:-1]:
                continue  # a boundary needs a word before it
            for word in words if len(words) == 1 or words[-1] else words[:-1]:
                at = "\x02" * toxicity.CONTEXT
                for letter in word + "\x03":
                    s += channel.letters.log(at, letter)
                    at = at[1:] + letter
            if s > best + 1e-9:
                best, want = s, " ".join(w for w in words if w)
        assert channel.decode(token, True) == want, token
