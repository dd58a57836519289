"""License scan: phrases, and license templates as token automata.

A template is text with the usual markup of license templates: between
``<<beginOptional>>`` and ``<<endOptional>>`` stands wording that may be left
out, and ``<<var;match="WORDS">>`` is replaceable text, up to WORDS words of
any kind (at least none). All other wording is mandatory: a text is accepted
where its words pass through the automaton from its first to its last
mandatory word without a foreign word. Compiling yields a nondeterministic
automaton over words; a scan starts it only where the template's first words
stand, so texts without them cost one search.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrends.llm.shared_store import bound_batches

# Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased; all else separates.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

# Fixed phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public wording of usual notices and short licenses, with markup.
TEMPLATES = {
    "gpl-notice": """<<beginOptional>>This <<var;match="4">> is<<endOptional>> licensed under
        <<beginOptional>>the terms of<<endOptional>> the GNU General Public License
        <<beginOptional>>version <<var;match="2">><<endOptional>>
        <<beginOptional>>or any later version<<endOptional>>""",
    "gpl-header": """This program is free software you can redistribute it and or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation either version <<var;match="2">> of the
        License or at your option any later version This program is distributed in the hope that it will be useful but
        WITHOUT ANY WARRANTY without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE
        See the GNU General Public License for more details""",
    "apache-2.0-notice": """Licensed under the Apache License Version 2.0 <<beginOptional>>the License<<endOptional>>""",
    "apache-2.0-header": """Licensed under the Apache License Version 2.0 the License you may not use this file except in
        compliance with the License You may obtain a copy of the License at
        <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> www apache org licenses LICENSE 2.0 Unless required by
        applicable law or agreed to in writing software distributed under the License is distributed on an AS IS BASIS
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND either express or implied See the License for the specific language
        governing permissions and limitations under the License""",
    "cc-by-notice": """<<beginOptional>>This <<var;match="3">> is<<endOptional>> licensed under
        <<beginOptional>>a<<endOptional>> CC BY <<beginOptional>>NC<<endOptional>>
        <<beginOptional>>SA<<endOptional>> <<beginOptional>>ND<<endOptional>> 4.0""",
    "mit-notice": """Released under the MIT License""",
    "mit": """Permission is hereby granted free of charge to any person obtaining a copy of
        <<beginOptional>>this<<endOptional>> software and associated documentation files the Software to deal in the
        Software without restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the Software and to permit persons to whom the Software is
        furnished to do so subject to the following conditions The above copyright notice and this permission notice
        <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of
        the Software THE SOFTWARE IS PROVIDED AS IS WITHOUT WARRANTY OF ANY KIND EXPRESS OR IMPLIED INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT IN NO EVENT
        SHALL <<var;match="12">> BE LIABLE FOR ANY CLAIM DAMAGES OR OTHER LIABILITY WHETHER IN AN ACTION OF CONTRACT TORT
        OR OTHERWISE ARISING FROM OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE""",
    "isc": """Permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or
        without fee is hereby granted provided that the above copyright notice and this permission notice appear in all
        copies THE SOFTWARE IS PROVIDED AS IS AND <<var;match="8">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS IN NO EVENT SHALL <<var;match="8">> BE LIABLE FOR
        ANY SPECIAL DIRECT INDIRECT OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE DATA OR
        PROFITS WHETHER IN AN ACTION OF CONTRACT NEGLIGENCE OR OTHER TORTIOUS ACTION ARISING OUT OF OR IN CONNECTION WITH
        THE USE OR PERFORMANCE OF THIS SOFTWARE""",
    "bsd-2-clause": """Redistribution and use in source and binary forms with or without modification are permitted provided
        that the following conditions are met <<var;match="1">> Redistributions of source code must retain the above
        copyright notice this list of conditions and the following disclaimer <<var;match="1">> Redistributions in binary
        form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
        documentation and or other materials provided with the distribution THIS SOFTWARE IS PROVIDED BY
        <<var;match="12">> AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES INCLUDING BUT NOT LIMITED TO THE IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED IN NO EVENT SHALL <<var;match="12">> BE
        LIABLE FOR ANY DIRECT INDIRECT INCIDENTAL SPECIAL EXEMPLARY OR CONSEQUENTIAL DAMAGES INCLUDING BUT NOT LIMITED TO
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES LOSS OF USE DATA OR PROFITS OR BUSINESS INTERRUPTION HOWEVER CAUSED AND
        ON ANY THEORY OF LIABILITY WHETHER IN CONTRACT STRICT LIABILITY OR TORT INCLUDING NEGLIGENCE OR OTHERWISE ARISING
        IN ANY WAY OUT OF THE USE OF THIS SOFTWARE EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE""",
    "bsd-3-clause": """Redistribution and use in source and binary forms with or without modification are permitted provided
        that the following conditions are met <<var;match="1">> Redistributions of source code must retain the above
        copyright notice this list of conditions and the following disclaimer <<var;match="1">> Redistributions in binary
        form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
        documentation and or other materials provided with the distribution <<var;match="1">>
        Neither the name of <<var;match="12">> nor the names of <<var;match="3">> contributors may be used to endorse or
        promote products derived from this software without specific prior written permission THIS SOFTWARE IS PROVIDED BY
        <<var;match="12">> AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES INCLUDING BUT NOT LIMITED TO THE IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED IN NO EVENT SHALL <<var;match="12">> BE
        LIABLE FOR ANY DIRECT INDIRECT INCIDENTAL SPECIAL EXEMPLARY OR CONSEQUENTIAL DAMAGES INCLUDING BUT NOT LIMITED TO
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES LOSS OF USE DATA OR PROFITS OR BUSINESS INTERRUPTION HOWEVER CAUSED AND
        ON ANY THEORY OF LIABILITY WHETHER IN CONTRACT STRICT LIABILITY OR TORT INCLUDING NEGLIGENCE OR OTHERWISE ARISING
        IN ANY WAY OUT OF THE USE OF THIS SOFTWARE EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE""",
}


def normalized(data: bytes | None) -> bytes:
    """The words of a text between single blanks, with a blank at both ends."""
    return b" " + b" ".join((data or b"").translate(_TABLE).split()) + b" "


@dataclass
class Automaton:
    """States are positions of a token list; ``skips`` are moves without a word."""

    words: list[bytes | None] = field(default_factory=list)  # None takes any word
    skips: dict[int, set[int]] = field(default_factory=dict)

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips.get(todo.pop(), ()):
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def accepts_from(self, words: list[bytes], start: int) -> int:
        """End of the longest accepted run of words from ``start``; -1 if none."""
        states, end, best = self.closure({0}), len(self.words), -1
        for at in range(start, len(words) + 1):
            if end in states:
                best = at
            if at == len(words):
                break
            states = self.closure({s + 1 for s in states if s < end and self.words[s] in (None, words[at])})
            if not states:
                break
        return best


_MARK = re.compile(r'<<(beginOptional|endOptional|var;match="(\d+)")>>')


def compile_template(template: str) -> Automaton:
    """The automaton of a template; markup must nest."""
    out, opened, at = Automaton(), [], 0
    for mark in [*_MARK.finditer(template), None]:
        out.words += normalized(template[at : mark.start() if mark else None].encode()).split()
        here = len(out.words)
        if mark is None:
            break
        at = mark.end()
        if mark[1] == "beginOptional":
            opened.append(here)
        elif mark[1] == "endOptional":
            out.skips.setdefault(opened.pop(), set()).add(here)
        else:
            for k in range(int(mark[2])):
                out.skips.setdefault(here + k, set()).add(here + int(mark[2]))
            out.words += [None] * int(mark[2])
    if opened:
        raise ValueError("an optional region is not closed")
    return out


def first_words(automaton: Automaton) -> set[bytes]:
    found = {automaton.words[s] for s in automaton.closure({0}) if s < len(automaton.words)}
    if None in found or len(automaton.words) in automaton.closure({0}):
        raise ValueError("a template must begin with a fixed word and have mandatory wording")
    return found


def mandatory_pair(automaton: Automaton) -> bytes:
    """Two adjacent fixed words that every accepted run holds: a cheap test for texts."""
    end = len(automaton.words)
    for s in range(end - 1):
        pair = automaton.words[s : s + 2]
        bridged = any(a <= s and b > s or a <= s + 1 and b > s + 1 for a, to in automaton.skips.items() for b in to)
        if None not in pair and not bridged:
            return b" " + b" ".join(pair) + b" "
    raise ValueError("a template needs two adjacent mandatory words")


@cache
def _compiled(templates: tuple[tuple[str, str], ...]) -> list:
    out = []
    for label, text in templates:
        automaton = compile_template(text)
        out.append((label, mandatory_pair(automaton), first_words(automaton), automaton))
    return out


def template_spans(words: list[bytes], text: bytes, templates: tuple[tuple[str, str], ...]) -> list[tuple[str, int, int]]:
    """(label, start, end) of the accepted runs, in word numbers; the longest run at each start,
    and none inside another one of the same label."""
    spans = []
    for label, pair, firsts, automaton in _compiled(templates):
        if pair not in text:
            continue
        covered = 0
        for start, word in enumerate(words):
            if start >= covered and word in firsts and (end := automaton.accepts_from(words, start)) >= 0:
                spans.append((label, start, end))
                covered = end
    return spans


def phrase_starts(text: bytes, phrase: bytes) -> list[int]:
    """Start words of every place where the phrase's words stand consecutively."""
    wanted, starts, at, count = b" " + phrase + b" ", [], 0, 0
    found = text.find(wanted)
    while found >= 0:
        count += text.count(b" ", at, found)
        starts.append(count)
        at = found
        found = text.find(wanted, found + 1)
    return starts


_SCAN = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
    ]
)
SCAN_TYPE = (
    "struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: string,"
    " labels: string, score: double, spans: array<struct<label: string, start: bigint, end: bigint>>>"
)


def scan_text(data: bytes | None, phrases: dict[str, str], templates: tuple[tuple[str, str], ...]) -> dict:
    text = normalized(data)
    n_words = text.count(b" ") - 1 if len(text) > 2 else 0
    hits = {label: s for phrase, label in phrases.items() if (s := phrase_starts(text, phrase.encode()))}
    starts = [s for found in hits.values() for s in found]
    spans = template_spans(text.split(), text, templates) if any(p[1] in text for p in _compiled(templates)) else []
    return {
        "n_words": n_words,
        "n_base": len(starts),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(hits)),
        "labels": ",".join(sorted({*hits, *(s[0] for s in spans)})),
        "score": 1.0 if spans else 0.5 if hits else 0.0,
        "spans": [{"label": a, "start": b, "end": c} for a, b, c in spans],
    }


def license_scan(
    text: Column | str, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None
) -> Column:
    """A struct per text: word count, phrase places, labels, score and template spans.

    Null and empty texts have no words, no labels and score 0. The score is 1
    where a whole template matches, 0.5 where only a phrase stands, else 0.
    Two phrases may carry one label. Rows are judged one by one: ties,
    repeats and other columns do not matter.
    """
    phrases = PHRASES if phrases is None else phrases
    fixed = tuple((TEMPLATES if templates is None else templates).items())
    _compiled(fixed)  # a wrong template fails here and not in a task

    @F.arrow_udf(SCAN_TYPE)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [scan_text(data, phrases, fixed) for data in batch.cast(pa.binary()).to_pylist()]
            yield pa.array(rows, _SCAN)

    return scan(text)


def scan_licenses(docs: DataFrame, text: str = "text", column: str = "license", **settings) -> DataFrame:
    """``docs`` with the scan's struct in ``column``; a column of this name is replaced."""
    bound_batches(docs.sparkSession)
    return docs.withColumn(column, license_scan(F.col(f"`{text}`"), **settings))
