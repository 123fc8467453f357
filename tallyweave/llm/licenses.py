"""License scans by matching template mark-up.

A template is license text with mark-up for optional regions, replaceable regions and
mandatory wording:

    <<beginOptional>> ... <<endOptional>>      may be left out
    <<var;most=N>>                             any 0 to N words stand here

All other words are mandatory and must stand exactly and in order. Each template is
compiled to an automaton over words, which reads a text from every place where the
template's first mandatory words stand. Phrases, whose places are counted, are
templates without mark-up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyweave.llm.common import add_columns, as_bytes, plain_words

# Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of public licenses, their notices and grants, with mark-up, by label.
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<var;most=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
    TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
    <<var;most=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
    NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
    CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
    ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: <<var;most=1>> Redistributions of source code must retain the above copyright notice, this list
    of conditions and the following disclaimer. <<var;most=1>> Redistributions in binary form must reproduce the above copyright
    notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
    distribution."""
_BY = "<<beginOptional>>Licensed under<<endOptional>> <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY"
_VERSION = "<<beginOptional>>4.0<<endOptional>> <<beginOptional>>3.0<<endOptional>> <<beginOptional>>International<<endOptional>> <<beginOptional>>License<<endOptional>>"
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 <<beginOptional>>(the \"License\")<<endOptional>>",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at <<var;most=12>> Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. <<beginOptional>>See the License for the specific language governing
        permissions and limitations under the License.<<endOptional>>""",
    "bsd-2-clause": f"{_CLAUSES} {_DISCLAIMER}",
    "bsd-3-clause": f"""{_CLAUSES} <<var;most=1>> Neither the name of <<var;most=12>> nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission. {_DISCLAIMER}""",
    "bsd-redistribution": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met <<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer.""",
    "cc-by-notice": f"{_BY} {_VERSION}",
    "cc-by-sa-notice": f"{_BY} SA {_VERSION}",
    "cc-by-nd-notice": f"{_BY} ND {_VERSION}",
    "cc-by-nc-notice": f"{_BY} NC {_VERSION}",
    "cc-by-nc-sa-notice": f"{_BY} NC SA {_VERSION}",
    "cc-by-nc-nd-notice": f"{_BY} NC ND {_VERSION}",
    "gpl-notice": """<<beginOptional>>This work is<<endOptional>> licensed under <<beginOptional>>the terms of<<endOptional>> the GNU
        General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>>
        <<beginOptional>>either<<endOptional>> version <<var;most=1>>""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.
        <<beginOptional>>THE SOFTWARE IS PROVIDED "AS IS" AND <<var;most=4>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;most=4>> BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
        AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
        THIS SOFTWARE.<<endOptional>>""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
        WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;most=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
        THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mit-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software
        <<beginOptional>>and to permit persons to whom the Software is furnished to do so<<endOptional>>""",
    "mit-notice": """<<beginOptional>>Released<<endOptional>> <<beginOptional>>Licensed<<endOptional>> under the
        <<beginOptional>>terms of the<<endOptional>> MIT License""",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

_MARK = re.compile(r"<<(beginOptional|endOptional|var)(?:;most=(\d+))?>>")


class Automaton:
    """A compiled template. State k waits for words[k]; after[k] are the states that
    reading on from k without a word gives, itself included; loose[k] is the number
    of words that a replaceable region before it takes."""

    def __init__(self, template: str) -> None:
        self.words: list[bytes | None] = []  # None: any word, or none, of a replaceable region
        jumps: list[tuple[int, int]] = []
        begun: list[int] = []
        at = 0
        for mark in [*_MARK.finditer(template), None]:
            self.words += plain_words(template[at : mark.start() if mark else len(template)].encode())
            if mark is None:
                break
            at = mark.end()
            if mark[1] == "beginOptional":
                begun.append(len(self.words))
            elif mark[1] == "endOptional":
                if not begun:
                    raise ValueError("an optional region ends that did not begin")
                jumps.append((begun.pop(), len(self.words)))
            else:
                for _ in range(int(mark[2] or 10)):
                    jumps.append((len(self.words), len(self.words) + 1))
                    self.words.append(None)
        if begun:
            raise ValueError("an optional region does not end")
        self.after: list[frozenset[int]] = []
        for k in range(len(self.words) + 1):
            seen, todo = {k}, [k]
            while todo:
                s = todo.pop()
                new = {b for a, b in jumps if a == s} - seen
                seen |= new
                todo += new
            self.after.append(frozenset(seen))
        if len(self.words) in self.after[0]:
            raise ValueError("a template needs mandatory wording")
        self.first = {self.words[s] for s in self.after[0] if s < len(self.words)}
        # The longest run of words that every accepted text holds, to find texts worth reading.
        skipped = {k for a, b in jumps for k in range(a, b)}
        runs, run = [[]], []
        for k, w in enumerate(self.words):
            run = [] if k in skipped else [*run, w]
            runs.append(run)
        self.anchor = b" " + b" ".join(max(runs, key=len)) + b" "

    def match(self, words: list[bytes], at: int) -> int | None:
        """The end of the longest accepted stretch that begins at this word."""
        states, last, found = self.after[0], len(self.words), None
        while states:
            if last in states:
                found = at
            if at >= len(words):
                break
            word = words[at]
            states = frozenset().union(*(self.after[s + 1] for s in states if s < last and (self.words[s] is None or self.words[s] == word)))
            at += 1
        return found


def outermost(spans: list[dict]) -> list[dict]:
    """Spans, by start and then label, less those that lie within a longer one: its
    template says more of the same words."""
    order = sorted(spans, key=lambda s: (s["start"], -s["end"], s["label"]))
    kept: list[dict] = []
    widest: dict | None = None
    for s in order:
        inside = widest is not None and s["end"] <= widest["end"] and s["end"] - s["start"] < widest["end"] - widest["start"]
        if not inside:
            kept.append(s)
        if widest is None or s["end"] > widest["end"]:
            widest = s
    return kept


class Scanner:
    """Phrases and templates, compiled."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]) -> None:
        given = {" ".join(w.decode() for w in plain_words(p.encode())): label for p, label in phrases.items()}
        self.label = {p.encode(): label for p, label in given.items()}
        self.phrase = re.compile(b" (?=(" + b"|".join(re.escape(p) for p in sorted(self.label, key=len, reverse=True)) + b") )") if given else None
        self.automata = [(label, Automaton(t)) for label, t in sorted(templates.items())]

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, list[str], list[str], float, list[dict]]:
        words = plain_words(text)
        joined = b" " + b" ".join(words) + b" "
        base: set[str] = set()
        at: list[int] = []
        seen, place = 0, 0
        for m in self.phrase.finditer(joined) if self.phrase else ():
            place += joined.count(b" ", seen, m.start())
            seen = m.start()
            at.append(place)
            base.add(self.label[m[1]])
        spans: list[dict] = []
        for label, automaton in self.automata:
            if automaton.anchor in joined:
                end = 0
                for k, w in enumerate(words):
                    if k >= end and w in automaton.first:
                        stop = automaton.match(words, k)
                        if stop is not None:
                            spans.append({"label": label, "start": k, "end": stop})
                            end = stop
        spans = outermost(spans)
        labels = sorted(base | {s["label"] for s in spans})
        covered = len({k for s in spans for k in range(s["start"], s["end"])})
        score = 0.0 if not labels else 0.5 + 0.5 * min(1.0, covered / max(1, len(words))) if spans else 0.25
        return len(words), len(at), min(at, default=None), max(at, default=None), sorted(base), labels, score, spans


_SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FIELDS = [
    (T.StructField("n_words", T.LongType()), pa.int64()),
    (T.StructField("n_base", T.LongType()), pa.int64()),
    (T.StructField("first_word", T.LongType()), pa.int64()),
    (T.StructField("last_word", T.LongType()), pa.int64()),
    (T.StructField("base_labels", T.ArrayType(T.StringType())), pa.list_(pa.string())),
    (T.StructField("license_labels", T.ArrayType(T.StringType())), pa.list_(pa.string())),
    (T.StructField("license_score", T.DoubleType()), pa.float64()),
    (T.StructField("license_spans", T.ArrayType(_SPAN)), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
]


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with n_words, n_base (places of all phrases), first_word and last_word
    (the smallest and largest of those places, words counted from 0, null without
    one), base_labels, license_labels (with the templates'), license_score (0 with
    no label, 0.25 with phrases only, from 0.5 by the share of words that templates
    cover) and license_spans (word ranges of template matches, end exclusive, as long
    as the template allows; of one template they do not overlap, and none lies within
    a longer one of another). A null text counts as empty; repeated rows give repeated
    results; an empty table gives no rows. At a place where two phrases begin the
    longer one counts; templates that match the same words both give their labels."""
    given = (PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    Scanner(*given)  # faulty templates are told here and not in a task

    def run(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        scanner = Scanner(*given)
        for (texts,) in batches:
            made = [scanner.scan(t) for t in as_bytes(texts)]
            yield [pa.array([m[k] for m in made], kind) for k, (_, kind) in enumerate(FIELDS)]

    return add_columns(docs, [T.StructField(prefix + f.name, f.dataType) for f, _ in FIELDS], [text], run)
