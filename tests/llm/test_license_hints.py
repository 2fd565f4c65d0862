"""The words that licenses are looked for by lose none that the coverage accepts."""

import random

import pytest

from vellum.llm import licenses


@pytest.mark.parametrize("text", ["Licensed under the MIT License.", "It is available under the MIT License"])
def test_four_of_five_words(text):
    assert [(x[0], x[1]) for x in licenses.Scanner(licenses.TEMPLATES, 0.8).scan(text)] == [("MIT-notice", 0.8)]


@pytest.mark.parametrize("name", list(licenses.TEMPLATES))
def test_every_window_of_every_template(name):
    draw = random.Random(name)
    template = licenses.words(licenses.TEMPLATES[name].encode())
    scanner, size, slack = licenses.Scanner({name: licenses.TEMPLATES[name]}, 0.8), len(template), 1 + len(template) // 5
    covered = 0
    for _ in range(200 if size < 20 else 12):
        ws = [draw.choice(["lorem", "ipsum", "the", "license", "dolor"]) for _ in range(30)]
        put = [w for w in template if draw.random() < 0.87]
        k = draw.randint(0, 30)
        ws[k:k] = [w.decode() for w in put]
        raw = [w.encode() for w in ws]
        every = any(len(licenses.align(template, raw[max(0, s - slack) : s + size + slack])) >= 0.8 * size for s in range(len(ws)))
        covered += every
        assert bool(scanner.scan(" ".join(ws))) or not every
    assert covered


@pytest.mark.parametrize("size", range(1, 41))
def test_hints_outnumber_what_may_be_lacking(size):
    ws = [f"w{k}" for k in range(size)]
    for tenths in range(1, 11):
        least = -(-tenths * size // 10)
        assert len(licenses.Scanner({"x": " ".join(ws)}, tenths / 10).hints) >= size - least + 1
