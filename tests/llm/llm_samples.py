"""Documents for the tests of the llm subpackage."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, words):
    out = []
    for i in range(words):
        out.append(rng.choice(WORDS) + rng.choice(WORDS))
        if i % 11 == 10:
            out[-1] += "."
        if i % 37 == 36:
            out[-1] += "\n"
    return " ".join(out).replace("\n ", "\n")


def sample_rows():
    """Documents with nulls, empty and long texts, copies, near copies, ties and repeated rows."""
    rng = random.Random(8)
    shared = prose(rng, 90)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "zwei drei"), (6, "Ünï cödé ß 中文字 🙂 x\x1cy"), (7, "a" * 9000), (8, " lead  double \n end ")]
    rows += [(20 + i, prose(rng, rng.randrange(20, 120))) for i in range(20)]
    rows += [(60 + i, prose(rng, 20) + " " + shared + " " + prose(rng, 15)) for i in range(6)]
    copy = prose(rng, 300)
    rows += [(80 + i, copy) for i in range(4)]
    words = copy.split(" ")
    rows += [(90 + i, " ".join(words[:i] + ["changed"] + words[i + 1 :])) for i in range(3)]
    rows += [(100, prose(rng, 12000)), (101, "abcdefgh " * 400)]
    rows += [(None, prose(rng, 50)), (None, copy), (80, copy), (20, "same id, other text of a few words")]
    return [(i, t, "en", None if k % 9 == 0 else f"s{k % 3 if k % 2 else 0}", None if t is None else len(t), "x") for k, (i, t) in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"
