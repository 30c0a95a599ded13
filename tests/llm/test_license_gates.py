import random
from re import _parser

import pyarrow.parquet as pq
import pytest

from glyphlake.llm import licenses


def sample(parsed, rng):
    """A random text that the parsed pattern matches."""
    out = ""
    for op, value in parsed:
        if op is _parser.LITERAL:
            out += chr(value)
        elif op is _parser.NOT_LITERAL:
            out += rng.choice("abz09")
        elif op is _parser.IN:
            kind, x = rng.choice(value)
            out += chr(x) if kind is _parser.LITERAL else chr(rng.randint(*x)) if kind is _parser.RANGE else rng.choice("abz09")
        elif op is _parser.SUBPATTERN:
            out += sample(value[3], rng)
        elif op is _parser.BRANCH:
            out += sample(rng.choice(value[1]), rng)
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
            out += "".join(sample(value[2], rng) for _ in range(rng.randint(value[0], min(value[1], value[0] + 4))))
        else:
            assert op in (_parser.ASSERT, _parser.ASSERT_NOT), op
    return out


def ungated(rules, stream):
    found = [(m.start() + 1, m.end(), r.label, r.priority) for r in rules for m in r.pattern.finditer(stream)]
    kept = []
    for a, b, label, priority in sorted(found, key=lambda x: (-x[3], x[0] - x[1], x[0], x[2])):
        if not any(c <= a and b <= d for c, d, _ in kept):
            kept.append((a, b, label))
    return [x for x in kept if x[2]]


def gated(scanner, stream):
    return [(a, b, r.label) for a, b, r in scanner.detections(stream)]


def test_every_match_passes_its_gate():
    rng, scanner = random.Random(3), licenses.Scanner()
    for rule in scanner.rules:
        assert rule.gate
        for _ in range(30):
            stream = sample(_parser.parse(rule.pattern.pattern), rng) + " "
            assert rule.pattern.match(stream), stream
            present = {w for _, w in scanner.automaton.iter(stream)}
            assert not any(map(present.isdisjoint, rule.gate)), (stream, rule.gate)
            assert not rule.label or scanner.detections(stream) or any(r.pattern.search(stream) for r in scanner.rules if not r.label)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MIT licence", ["mit"]),
        ("Ce texte est sous licence MIT.", ["mit"]),
        ("provided with GPL v3", ["gpl-3"]),
        ("see http://www.wtfpl.net/", ["wtfpl"]),
        ("https://joinup.ec.europa.eu/software/page/eupl", ["eupl-1.2"]),
    ],
)
def test_matches_without_the_usual_words(text, want):
    stream = f" {b' '.join(licenses.words(text)).decode()} "
    assert [x[2] for x in gated(licenses.Scanner(), stream)] == want


def test_gates_change_nothing(sf):
    scanner = licenses.Scanner()
    for text in pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column(0).to_pylist():
        stream = f" {b' '.join(licenses.words(text)).decode()} "
        assert gated(scanner, stream) == ungated(scanner.rules, stream)
