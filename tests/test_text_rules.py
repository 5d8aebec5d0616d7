"""README rules on literal texts with known outcomes."""

import random
import re

import pytest

from trustlake import constants as C
from trustlake.functions import text as T

CLAIMS = [
    ("The model achieved accuracy of 92%.", True),
    ("This model description contains no numeric scores.", False),
    ("Our accuracy benchmark is described below but no value is given.", False),
    ("The system processed 2048 tokens per batch.", False),
    ("\n    Version 2024-01-05 released.\n    Accuracy section coming soon.\n", False),
    ("\n    # Evaluation\n    accuracy: coming soon\n    # Results\n    accuracy improved\n", False),
    ("evaluation results coming soon, more information needed.", False),
    ("\nmodel-index:\n  metrics:\n    - name: accuracy\n      value: 0.912\n", True),
    ("\n| Metric | Accuracy |\n|--------|----------|\n| ModelA | 92%      |\n", True),
    ("\n| Metric | Accuracy |\n|--------|----------|\n| ModelA | TBD      |\n", False),
    ("accuracy " + "x" * 200 + " 95%", False),
    ("accuracy " + "x" * 50 + " 95%", True),
    ("# Benchmark\nBLEU: 32.5\n\n| Metric | BLEU |\n|--------|------|\n| M1     | 32.5 |\n", True),
    # Only evaluation sections count once there are any.
    ("accuracy 93%\n# Results\nsee paper\n", False),
    ("# Intro\nnothing\n# Results\naccuracy 93%\n", True),
    # A decimal looks like a version and is skipped by the proximity rule.
    ("accuracy 0.88 on dev", False),
    # The window is measured in characters, not in UTF-16 units.
    ("\U0001f600" * 60 + " accuracy " + "x" * 20 + " 95%", True),
    ("accuracy " + "\U0001f600" * 80 + " 95%", True),
    ("accuracy " + "\U0001f600" * 95 + " 95%", False),
    ("", False),
]


def test_claims(evaluate):
    assert evaluate(T.has_claims, [t for t, _ in CLAIMS]) == [e for _, e in CLAIMS]


def test_claims_survive_huge_tables(evaluate):
    table = "\n| Metric | Accuracy |\n|---|---|\n" + "| a | b |\n" * 20_000
    assert evaluate(T.has_claims, [table, table + "| a | 91 |\n"]) == [False, True]


def python_claims(text):
    """The rules for claims on plain strings, by brute force over positions."""
    low = text.lower()
    if all(w in low for w in ("model-index", "metrics:")) and re.search(C.YAML_VALUE, low):
        return True
    evaluations = [
        part for part in re.split(C.HEADING_SPLIT, low)
        if part and re.search(C.CLAIM_HEADING, part.splitlines()[0])
    ]

    def named(piece):
        return any(piece.count(w) for w in C.METRIC_WORDS)

    def measured(scope):
        for at in (m.start() for m in re.finditer(C.NUMBER, scope)):
            dated = re.search(C.DATE_OR_VERSION, scope[max(at - 10, 0) : at + 10])
            if named(scope[max(at - 100, 0) : at + 100]) and not dated:
                return True
        tables = [block.splitlines()[1:] for block in re.findall(C.METRIC_TABLE, scope)]
        return any(named(t[0]) and re.search(C.NUMBER, "\n".join(t[1:])) for t in tables)

    scopes = evaluations or [low]
    return any(measured(s) for s in scopes if not any(w in s for w in C.PLACEHOLDER_WORDS))


def test_claims_against_python(evaluate):
    rng = random.Random(7)
    atoms = [
        "accuracy", "recall", "x" * 40, "y" * 90, "92%", "7", "0.88", "2024", "2024-01-05", "v1.2",
        "\n# results\n", "\n## intro\n", "\n### Metrics é\n", "tbd", "none", "\n", " ", "é5", "5é",
        "\U0001f600" * 30, "12 %", "9,9", "\n| acc | b |\n|---|---|\n| 1 | x |\n", "٣", "\r\n", "_7",
    ]
    texts = ["".join(rng.choice(atoms) + rng.choice(["", " "]) for _ in range(rng.randint(1, 14)))
             for _ in range(1500)]
    assert evaluate(T.has_claims, texts) == [python_claims(t) for t in texts]


def test_number_positions_against_python(evaluate):
    texts = ["92", "a 92 % of 3.5", "no", "1 2  3", "x1 2x 3", "", "10%5", "é5 5é 5"]
    found = evaluate(T.number_positions, texts)
    expected = [[(m.start(), m.group()) for m in re.finditer(C.NUMBER, t)] for t in texts]
    assert [[(p.start, p.token) for p in row] for row in found] == expected
    assert evaluate(T.number_positions, [None]) == [None]


def test_many_number_positions(evaluate):
    """A text of 200 000 numbers takes time in proportion to its length."""
    text = " ".join(str(i % 977) for i in range(200_000)) + " 𝟘 12%"
    (found,) = evaluate(T.number_positions, [text])
    assert [(p.start, p.token) for p in found] == [(m.start(), m[0]) for m in re.finditer(C.NUMBER, text)]


def test_sections(evaluate):
    text = "# evaluation\naccuracy 93%\n\n# results\nf1 0.88\n# other\nx"
    (sections,) = evaluate(T.claim_sections, [text])
    assert sections == ["# evaluation\naccuracy 93%\n", "# results\nf1 0.88"]
    assert evaluate(T.claim_sections, ["no headings here"]) == [[]]


LICENSES = [
    ("This project is licensed under GPLv3", 0.0),
    ("Licensed under the OpenRAIL license", 0.5),
    ("MIT License", 1.0),
    ("License: Apache 2.0", 1.0),
    ("\n        ## License\n        BSD-3-Clause\n        ", 1.0),
    ("This model is released under CC-BY-4.0", 1.0),
    ("license: cc-by-nc-4.0", 0.0),
    ("license: llama2", 0.5),
    ("Mozilla Public License 2.0", 0.0),  # permissive, yet not in the compatible list
    ("license: other\n\nMIT", 0.0),  # the license line decides alone
    ("# License\n\n# Next\nMIT", 0.0),  # an empty license section decides alone
    ("license: mit\r\nfoo: gpl-3.0", 0.0),  # "\r" is no line end: the whole text decides
    ("admit limits", 0.0),
    ("émit", 0.0),
    ("apache_2.0", 1.0),
    ("", 0.0),
    (None, 0.0),
]


def test_license(evaluate):
    assert evaluate(T.license_score, [t for t, _ in LICENSES]) == [e for _, e in LICENSES]


def python_license(text):
    """The license ladder on plain strings."""
    whole = text.strip()
    line = re.search(C.LICENSE_LINE, whole.lower(), re.I | re.M)
    start = re.search(rf"^[ \t]*#{{1,6}}[ \t]*{C.LICENSE_HEADING}\b[^\n]*\n", whole, re.I | re.M)
    stated = whole
    if line:
        stated = line[1]
    elif start:
        body = whole[start.end() :]
        following = re.search(r"^[ \t]*#{1,6}[ \t]+\S", body, re.M)
        stated = body[: following.start()] if following else body
    stated = re.sub(r"[\s_]+", "-", stated.strip().lower())
    tiers = (C.LICENSE_RESTRICTIVE, C.LICENSE_UNCLEAR, C.LICENSE_PERMISSIVE, C.LICENSE_COMPATIBLE)
    bad, unclear, good, usable = (any(re.search(p, stated) for p in tier) for tier in tiers)
    return 0.0 if bad else 0.5 if unclear else float(good and usable)


def test_license_against_python(evaluate):
    rng = random.Random(3)
    atoms = [
        "mit", "MIT", "gpl", "gpl-3.0", "agpl", "apache", "2.0", "license", "License:", "bsd",
        "cc by", "cc-by-nc", "nc", "4.0", "research only", "open rail", "llama 2", "lgpl-2.1", "\n",
        "## License\n", "# x\n", "_", "-", " ", "é", "ü", "\x1c", "\u2003", "\r\n", "#", "mpl 2.0",
    ]
    texts = ["".join(rng.choice(atoms) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 10)))
             for _ in range(2000)]
    assert evaluate(T.license_score, texts) == [python_license(t) for t in texts]


def test_dataset_section(evaluate):
    texts = [
        "# Intro\nx\n## Dataset\nTrained on C4.\n## More\ny",
        "# Corpus\nbody",
        "## Datasets used\nfirst\n## Training data\nsecond",
        "## Dataset\n## Training data\nsecond",  # an empty first match still wins
        "no heading, dataset: c4",
        "  ### pre-training data\nabc\n  # end\n",
    ]
    assert evaluate(T.dataset_section, texts) == [
        "Trained on C4.\n", "body", "first\n", "", "", "abc\n",
    ]


@pytest.mark.parametrize(
    "content, strict, lenient",
    [
        ("Final Response -- Status Code : 0.5", 0.5, 0.5),
        ("Final Response -- Status Code: 1", 0.0, 1.0),
        ("garbage", 0.0, 0.0),
        ("x Final Response -- Status Code : 1. Done", 1.0, 1.0),
    ],
)
def test_status_code(evaluate, content, strict, lenient):
    assert evaluate(T.status_code, [content]) == [strict]
    assert evaluate(lambda c: T.status_code(c, lenient=True), [content]) == [lenient]


def test_license_words_may_be_parted_by_blanks_and_underscores(evaluate):
    texts = ["apache_ 2.0", "x_mit_x", "mitx", "cc \n by nc", "gpl -3", "lgpl__3", "émit", "bsd-3  clause"]
    assert evaluate(T.license_class_score, texts) == [1.0, 1.0, 0.0, 0.0, 0.0, 0.5, 0.0, 1.0]
