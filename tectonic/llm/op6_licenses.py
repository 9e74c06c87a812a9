"""License scans: template markup compiled to token automata, beside base phrases.

A template is wording with two kinds of regions: ``<<optional>> ... <</optional>>`` may be absent, and
``<<any N>>`` stands for up to N words of the licensor's own. Its words and regions become a
non-deterministic automaton over word tokens; a text is accepted where the automaton reads a stretch of
its words from start to end, so the mandatory wording must match word for word while optional and
replaceable regions may differ. Only stretches around a template's anchor (its longest run of mandatory
words) are read: whole texts are scanned for anchors as bytes, the automaton runs on the few places left.

Base phrases are found independently, at every place where their words stand consecutively.

Words are runs of digits, letters (A-Z in lower case) and characters from U+0080 on; everything else
separates. ``score`` is the share of a text's words that lie in base phrases or accepted stretches.

Defined results: null counts as empty; a text without words has no places, empty labels and score 0;
overlapping places each count; equal rows each give a row; other columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .textnum import runs, text_slices

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label -> wording with markup. The wording is that of the public licenses' notices and texts.
TEMPLATES = {
    "gpl-notice": "<<optional>> this <<any 4>> is <<optional>> free software <<any 12>> <</optional>> "
                  "licensed <</optional>> under the <<optional>> terms of the <</optional>> gnu general public license "
                  "<<optional>> as published by the free software foundation <</optional>> "
                  "<<optional>> either <</optional>> version <<any 1>>",
    "apache-2.0-notice": "licensed under the apache license version 2 0 <<optional>> the license "
                         "you may not use this file except in compliance with the license <</optional>>",
    "mit-notice": "<<optional>> this <<any 4>> is <</optional>> released under the <<optional>> terms of the <</optional>> "
                  "mit license",
    "cc-by-notice": "<<optional>> this work is <</optional>> licensed under <<optional>> a <</optional>> "
                    "<<optional>> the <</optional>> cc by <<optional>> nc <</optional>> <<optional>> sa <</optional>> "
                    "<<optional>> nd <</optional>> <<any 1>> 0 <<optional>> license <</optional>>",
    "mit-text": "<<optional>> mit license <</optional>> <<optional>> copyright <<any 12>> <</optional>> "
                "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                "associated documentation files the software to deal in the software without restriction including "
                "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
                "copies of the software and to permit persons to whom the software is furnished to do so subject to "
                "the following conditions the above copyright notice and this permission notice "
                "<<optional>> including the next paragraph <</optional>> shall be included in all copies or "
                "substantial portions of the software the software is provided as is without warranty of any kind "
                "express or implied including but not limited to the warranties of merchantability fitness for a "
                "particular purpose and noninfringement in no event shall <<any 12>> be liable for any claim damages "
                "or other liability whether in an action of contract tort or otherwise arising from out of or in "
                "connection with the software or the use or other dealings in the software",
    "gpl-header": "<<any 4>> is free software you can redistribute it and or modify it under the terms of the gnu general "
                  "public license as published by the free software foundation either version <<any 1>> of the license or "
                  "<<optional>> at your option <</optional>> any later version <<any 4>> is distributed in the hope that it "
                  "will be useful but without any warranty without even the implied warranty of merchantability or fitness "
                  "for a particular purpose see the gnu general public license for more details "
                  "<<optional>> you should have received a copy of the gnu general public license along with <<any 4>> "
                  "if not see <<any 8>> <</optional>>",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in "
                         "compliance with the license you may obtain a copy of the license at <<any 12>> unless required by "
                         "applicable law or agreed to in writing software distributed under the license is distributed on "
                         "an as is basis without warranties or conditions of any kind either express or implied see the "
                         "license for the specific language governing permissions and limitations under the license",
    "bsd-2-clause-text": "<<optional>> copyright <<any 12>> <</optional>> redistribution and use in source and binary forms "
                         "with or without modification are permitted provided that the following conditions are met "
                         "<<optional>> 1 <</optional>> redistributions of source code must retain the above copyright "
                         "notice this list of conditions and the following disclaimer <<optional>> 2 <</optional>> "
                         "redistributions in binary form must reproduce the above copyright notice this list of conditions "
                         "and the following disclaimer in the documentation and or other materials provided with the "
                         "distribution this software is provided by <<any 12>> as is and any express or implied warranties "
                         "including but not limited to the implied warranties of merchantability and fitness for a "
                         "particular purpose are disclaimed in no event shall <<any 12>> be liable for any direct indirect "
                         "incidental special exemplary or consequential damages including but not limited to procurement "
                         "of substitute goods or services loss of use data or profits or business interruption however "
                         "caused and on any theory of liability whether in contract strict liability or tort including "
                         "negligence or otherwise arising in any way out of the use of this software even if advised of "
                         "the possibility of such damage",
    "bsd-3-clause-text": "<<optional>> copyright <<any 12>> <</optional>> redistribution and use in source and binary forms "
                         "with or without modification are permitted provided that the following conditions are met "
                         "<<optional>> 1 <</optional>> redistributions of source code must retain the above copyright "
                         "notice this list of conditions and the following disclaimer <<optional>> 2 <</optional>> "
                         "redistributions in binary form must reproduce the above copyright notice this list of conditions "
                         "and the following disclaimer in the documentation and or other materials provided with the "
                         "distribution <<optional>> 3 <</optional>> neither the name of <<any 12>> nor the names of its "
                         "contributors may be used to endorse or promote products derived from this software without "
                         "specific prior written permission this software is provided by <<any 12>> as is and any express "
                         "or implied warranties including but not limited to the implied warranties of merchantability and "
                         "fitness for a particular purpose are disclaimed in no event shall <<any 12>> be liable for any "
                         "direct indirect incidental special exemplary or consequential damages including but not limited "
                         "to procurement of substitute goods or services loss of use data or profits or business "
                         "interruption however caused and on any theory of liability whether in contract strict liability "
                         "or tort including negligence or otherwise arising in any way out of the use of this software "
                         "even if advised of the possibility of such damage",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will <<any 6>> be held "
                 "liable for any damages arising from the use of this software permission is granted to anyone to use this "
                 "software for any purpose including commercial applications and to alter it and redistribute it freely "
                 "subject to the following restrictions <<optional>> 1 <</optional>> the origin of this software must not be "
                 "misrepresented you must not claim that you wrote the original software if you use this software in a "
                 "product an acknowledgment in the product documentation would be appreciated but is not required "
                 "<<optional>> 2 <</optional>> altered source versions must be plainly marked as such and must not be "
                 "misrepresented as being the original software <<optional>> 3 <</optional>> this notice may not be removed "
                 "or altered from any source distribution",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify "
                      "publish use compile sell or distribute this software either in source code form or as a compiled "
                      "binary for any purpose commercial or non commercial and by any means <<optional>> in jurisdictions "
                      "that recognize copyright laws the author or authors of this software dedicate any and all copyright "
                      "interest in the software to the public domain we make this dedication for the benefit of the public "
                      "at large and to the detriment of our heirs and successors we intend this dedication to be an overt "
                      "act of relinquishment in perpetuity of all present and future rights to this software under copyright "
                      "law <</optional>> the software is provided as is without warranty of any kind express or implied "
                      "including but not limited to the warranties of merchantability fitness for a particular purpose and "
                      "noninfringement in no event shall the authors be liable for any claim damages or other liability "
                      "whether in an action of contract tort or otherwise arising from out of or in connection with the "
                      "software or the use or other dealings in the software",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee "
                "is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BETWEEN = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_MARK = re.compile(r"<<(/?)(optional|any)(?: (\d+))?>>|(\S+)")


class Automaton:
    """A token automaton: states are numbers, arrows read one word (None: any word) or nothing."""

    def __init__(self, markup: str):
        self.reads: list[list[tuple[bytes | None, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        runs_of_words: list[list[bytes]] = [[]]
        open_at: list[int] = []
        at = 0
        for close, kind, count, word in _MARK.findall(markup):
            if word:
                at = self._arrow(at, word.encode())
                if not open_at:
                    runs_of_words[-1].append(word.encode())
                continue
            runs_of_words.append([])
            if kind == "any":
                before = [at]
                for _ in range(int(count)):
                    at = self._arrow(at, None)
                    before.append(at)
                for state in before[:-1]:
                    self.skips[state].append(at)
            elif not close:
                open_at.append(at)
            elif not open_at:
                raise ValueError(f"an optional region ends that has not begun: {markup!r}")
            else:
                self.skips[open_at.pop()].append(at)
        self.final = at
        if open_at or not any(runs_of_words):
            raise ValueError(f"a template needs mandatory words, and every optional region an end: {markup!r}")
        #: The longest run of mandatory words; where a text lacks it, the template cannot match.
        self.anchor = max(runs_of_words, key=lambda r: sum(map(len, r)))
        #: No stretch starts further before the anchor than all arrows could read.
        self.reach = len(self.reads)

    def _arrow(self, at: int, word: bytes | None) -> int:
        self.reads.append([])
        self.skips.append([])
        self.reads[at].append((word, len(self.reads) - 1))
        return len(self.reads) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for to in self.skips[todo.pop()]:
                if to not in states:
                    states.add(to)
                    todo.append(to)
        return states

    def longest(self, words: list[bytes], start: int) -> int | None:
        """End of the longest stretch accepted from ``start``, None if there is none."""
        states, end = self._closed({0}), None
        for i in range(start, len(words)):
            states = self._closed({to for s in states for word, to in self.reads[s] if word is None or word == words[i]})
            if not states:
                break
            if self.final in states:
                end = i + 1
        return end


def _phrase(words: list[bytes]) -> re.Pattern:
    """Matches at every place where the words stand consecutively, overlapping places too."""
    body = _BETWEEN.join(re.escape(w) for w in words)
    return re.compile(rb"(?<!" + _WORD + rb")(?=(" + body + rb")(?!" + _WORD + rb"))" + re.escape(words[0][:1]))


@cache
def _compiled(base: tuple, templates: tuple):
    phrases = [(p.encode().split(), _phrase(p.encode().split()), label) for p, label in base]
    automata = [(label, a, _phrase(a.anchor)) for label, a in ((label, Automaton(t)) for label, t in templates)]
    return phrases, automata


def scan(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) per document;
    spans are the accepted stretches (label, first word, end word)."""
    setup = (tuple(base.items()), tuple(templates.items()))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, automata = _compiled(*setup)
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                low = _LOWER[data]
                starts, ends, first = runs(_IN_WORD[low], offsets)
                raw = low.tobytes()
                out = []
                for i in range(hi - lo):
                    a, b = int(first[i]), int(first[i + 1])
                    text = raw[offsets[i]:offsets[i + 1]]
                    out.append((b - a, *_scan_text(text, starts[a:b] - offsets[i], ends[a:b] - offsets[i], phrases, automata)))
                columns = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
             "score double, spans array<struct<label string, start long, stop long>>")


def _places(text: bytes, words: list[bytes], pattern: re.Pattern, starts: np.ndarray) -> list[int]:
    if max(words, key=len) not in text:
        return []
    return np.searchsorted(starts, [m.start() for m in pattern.finditer(text)]).tolist()


def _scan_text(text, starts, ends, phrases, automata):
    base, labels, spans, inside = [], set(), [], []
    for words, pattern, label in phrases:
        for at in _places(text, words, pattern, starts):
            base.append(at)
            labels.add(label)
            inside.append((at, at + len(words)))
    base_labels = ",".join(sorted(labels))
    for label, automaton, pattern in automata:
        anchors = _places(text, automaton.anchor, pattern, starts)
        done = 0
        for anchor in anchors:
            if anchor < done:
                continue
            lo = max(done, anchor - automaton.reach)
            hi = min(len(starts), anchor + automaton.reach)
            words = [text[s:e] for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)]
            for start in range(anchor - lo + 1):
                end = automaton.longest(words, start)
                if end is not None and end >= anchor - lo + len(automaton.anchor):
                    labels.add(label)
                    spans.append({"label": label, "start": lo + start, "stop": lo + end})
                    inside.append((lo + start, lo + end))
                    done = lo + end
                    break
    covered = end = 0
    for a, b in sorted(inside):
        covered += max(0, b - max(a, end))
        end = max(end, b)
    return (len(base), min(base, default=None), max(base, default=None), base_labels, ",".join(sorted(labels)),
            covered / len(starts) if len(starts) else 0.0, spans)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
