"""Whole licenses and their siblings."""

import pytest

from tidemark.llm import licenses
from tidemark.llm.license_templates import TEMPLATES

ALL = [licenses.Template(name, t) for name, texts in TEMPLATES.items() for t in texts]
KEYS = licenses.by_word(ALL)


def names(text):
    return [s[0] for s in licenses.find(text.encode(), ALL, KEYS)]


@pytest.mark.parametrize("name, k", [(name, k) for name, texts in TEMPLATES.items() for k in range(len(texts))])
def test_every_template_is_its_own_license(name, k):
    got = licenses.find(f"Some words. {TEMPLATES[name][k]}\nOther words. {TEMPLATES[name][k]} End.".encode(), ALL, KEYS)
    n = len(licenses.words_of(TEMPLATES[name][k].encode()))
    assert [(s[0], s[3], s[2] - s[1] >= n) for s in got] == [(name, 1.0, True)] * 2


@pytest.mark.parametrize("text, want", [
    ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]), ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0"]), ("Licensed under CC BY 2.0.", []), ("Licensed under CC BY-XX 4.0.", []),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
    ("released under the very free MIT license", []),
    *[(f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version.", want)
      for kind, v, want in (("", "2", ["GPL-2.0"]), ("", "3", ["GPL-3.0"]), ("", "4", []), ("Lesser ", "2.1", ["LGPL-2.1"]), ("Lesser ", "3", ["LGPL-3.0"]), ("Affero ", "3", ["AGPL-3.0"]), ("Other ", "3", []))]])
def test_siblings(text, want):
    assert names(text) == want


def test_a_part_is_not_the_whole():
    mit = TEMPLATES["MIT"][1]
    assert names(mit[:len(mit) // 3]) == []
    assert names(mit.replace("conditions:", "conditions: one two three").replace("SOFTWARE IS PROVIDED", "SOFTWARE COMES")) == ["MIT"]
    assert names("a b c d " * 4000 + TEMPLATES["GPL-2.0"][-1].replace("program", "tool") + " a b c") == ["GPL-2.0"]
