"""The regular expression over letters finds what the automaton finds."""

import random
import re

import pandas as pd
import pytest

from spillway.operators import cep


def pattern(rng, depth=0):
    kind = rng.randrange(4 if depth < 2 else 1)
    if kind < 2:
        name = rng.choice("ABCD")
        return name + rng.choice(["", "", "?", "*", "+", "{2}", "{1,2}", "+?", "*?", "{0,2}?"])
    parts = [pattern(rng, depth + 1) for _ in range(rng.randrange(2, 4))]
    return "(" + (" " if kind == 2 else " | ").join(parts) + ")"


@pytest.mark.parametrize("after", cep.AFTER)
def test_letters_and_automaton_agree(after):
    rng, compared = random.Random(1), 0
    while compared < 300:
        tree = cep.parse_pattern(" ".join(pattern(rng) for _ in range(rng.randrange(1, 4))))
        if cep.nullable(tree) or cep.repeats_repeat(tree):
            continue
        compared += 1
        # D has no condition: it fits any row
        flags = {v: f"__is_{v}" for v in "ABC" if v in cep.variables(tree)}
        bits = {v: k for k, v in enumerate(flags)}
        pdf = pd.DataFrame({f: [rng.choice([True, False, None]) for _ in range(rng.randrange(0, 1) or 25)] for f in flags.values()} or {"x": [0] * 25})
        program = cep.compile_pattern(tree)
        rows = cep.Frame(pdf)
        want = list(cep.match_rows([rows[k] for k in range(len(pdf))], *program, flags, {}, after))
        got = list(cep.match_letters(pdf, cep.Frame(pdf), re.compile(cep.letters_of(tree, bits), re.DOTALL), bits, program, flags, after))
        assert got == want
