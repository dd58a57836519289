import re

import brute
import pytest

from geotrends.llm.licenses import PHRASES, TEMPLATES, compile_template, normalized, scan_licenses

TEXTS = [
    None, "", "GNU General Public License", "gnu general public licenses", "x CC BY-NC 4.0. cc by cc by",
    "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.", "apache\u00a0license apache-license apache license",
    "This work is not licensed under the terms of the GNU General Public License", "licensed the GNU General Public License",
    "Released under the MIT\u00e9 License", "w " * 30000 + "mit license",
]


def test_phrases_and_words(make_docs):
    out = {r["doc_id"]: r["license"] for r in scan_licenses(make_docs(TEXTS), column="license").collect()}
    for i, text in enumerate(TEXTS):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        hits = [(k, label) for p, label in PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in hits]
        r = out[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(hits))
        assert (r["first_word"], r["last_word"]) == (min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in hits}))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1
    assert "gpl-notice" in out[6]["labels"] and "gpl-notice" in out[8]["labels"] and "gpl-notice" not in out[9]["labels"]
    assert "cc-by-notice" not in out[4]["labels"] and "mit-notice" in out[5]["labels"] and "apache-2.0-notice" in out[5]["labels"]


def test_automata():
    a = compile_template('alpha <<beginOptional>>beta <<var;match="2">><<endOptional>> gamma delta')
    accepts = lambda t: a.accepts_from(t.split(), 0) if False else a.accepts_from(normalized(t.encode()).split(), 0)
    assert accepts("alpha gamma delta") == 3
    assert accepts("alpha beta gamma delta") == 4
    assert accepts("alpha beta x y gamma delta more") == 6
    assert accepts("alpha beta x y z gamma delta") == -1
    assert accepts("alpha x gamma delta") == -1 and accepts("alpha gamma") == -1 and accepts("") == -1
    with pytest.raises(ValueError):
        compile_template("a <<beginOptional>> b")


def test_every_template_accepts_its_own_wording(make_docs):
    plain = {k: re.sub(r"<<.*?>>", " ", t) for k, t in TEMPLATES.items()}
    optional = r"<<beginOptional>>(?:(?!<<beginOptional>>).)*?<<endOptional>>"
    mandatory = {k: re.sub(r"<<.*?>>", " ", re.sub(optional, " ", t, flags=re.S)) for k, t in TEMPLATES.items()}
    for texts in (plain, mandatory):
        rows = scan_licenses(make_docs(list(texts.values()))).collect()
        for label, r in zip(texts, sorted(rows, key=lambda r: r["doc_id"])):
            assert label in r["license"]["labels"].split(",") and r["license"]["score"] == 1.0
    assert scan_licenses(make_docs([])).count() == 0
    assert brute.plain_words("A b") == ["a", "b"]


GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
    "is furnished to do so, subject to the following conditions:\n\n"
)
REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    '\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {} BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
    "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n"
)


def test_altered_conditions_are_rejected(make_docs):
    """A license counts only with all its mandatory wording; names in the replaceable places may differ."""
    holders = "THE AUTHORS OR COPYRIGHT HOLDERS"
    clause = next(t for k, t in TEMPLATES.items() if k == "bsd-3-clause")
    bsd3 = re.sub(r"<<.*?>>", "3", clause)
    bsd2 = re.sub(r"<<.*?>>", "2", TEMPLATES["bsd-2-clause"])
    texts = [
        f"Copyright (c) A\n\n{GRANT}{REST.format(holders)}", GRANT + REST.format("ACME INC"),
        GRANT + "The Software may not be sold. " + REST.format(holders), GRANT + REST.format(holders).replace("ANY CLAIM", "CLAIMS"),
        GRANT, bsd3, bsd2, bsd2.replace("binary", "compiled"),
    ]
    rows = sorted(scan_licenses(make_docs(texts)).collect(), key=lambda r: r["doc_id"])
    found = [(r["license"]["labels"], r["license"]["score"]) for r in rows]
    assert found == [("mit", 1.0)] * 2 + [("", 0.0)] * 3 + [("bsd-3-clause", 1.0), ("bsd-2-clause", 1.0), ("", 0.0)]
