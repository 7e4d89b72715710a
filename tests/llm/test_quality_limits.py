"""What the suffix-array rules of operator 6 reject by themselves."""

import random

from chunklake.llm import quality

from .test_llm import prose


def test_the_method_rejects_what_base_rules_keep(frame):
    rnd = random.Random(8)
    passage = prose(rnd, 60, "abcdefghijklm")
    rows = [(1, " ".join([prose(rnd, 60, "abcdefghijklm"), passage, prose(rnd, 120, "abcdefghijklm"), passage])), (2, prose(rnd, 300, "abcdefghijklm")), (3, prose(rnd, 240, "abcdefghijklm") + " go" * 60)]
    got = {r.doc_id: r for r in quality.verdicts(frame(rows, extra=True)).collect()}
    assert {i: (r.base_failed, r.kept) for i, r in got.items()} == {1: (False, False), 2: (False, True), 3: (False, True)}
    # Places that overlap do not make a repeat longer: 59 of 300 words would be too many.
    assert (got[3].longest_repeat, got[3].longest_apart) == (59, 30)


def test_repeats_apart_equal_a_plain_search():
    rnd = random.Random(1)

    def plain(w):
        n = len(w)
        return max((k for k in range(n // 2 + 1) if any(w[i : i + k] == w[j : j + k] for i in range(n - k + 1) for j in range(i + k, n - k + 1))), default=0)

    texts = [" ".join(rnd.choice("abcde") for _ in range(rnd.randint(0, 40))) for _ in range(120)] + ["a " * 30, "a b " * 21, None]
    assert quality.measures(texts, 4)[7].tolist() == [plain((t or "").split()) for t in texts]
