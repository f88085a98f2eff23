"""Licence recognition by sentence rules.

Texts are cut into fragments at line ends and sentence ends. Fragments, and
runs of them up to a sentence's end (a sentence may be wrapped over any number
of lines), are normalised and looked up among known licence sentences; each
gives an identifier, the longest run first. The identifiers of a text, in
order, are then matched against an ordered list of rules: the first rule whose
sequence occurs takes its sentences, and the search goes on among the rest.
Sentences that belong to a licence but to no rule are reported as fragments of
it. Two things belong to the rules' language: an asterisk in a sentence stands
for a name or place of up to ``OPEN_WORDS`` words, and up to ``GAP``
identifiers of other kinds (copyright lines, say) may lie between two
sentences of a rule.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that an asterisk in a known sentence may stand for.
OPEN_WORDS = 40
#: Identifiers of other kinds that may lie between two sentences of a rule.
GAP = 2

# Known sentences, normalised (see normalise); * stands for any words, up to OPEN_WORDS.
SENTENCES: dict[str, list[str]] = {
    "spdx": ["spdx license identifier *"],
    "copyright": ["copyright c *", "copyright * all rights reserved", "all rights reserved", "copyright 1*", "copyright 2*"],
    "apache2.name": [
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license",
        "this * is licensed under the apache license version 2.0",
        "released under the apache license version 2.0",
        "apache license version 2.0",
        "apache license version 2.0 january 2004",
    ],
    "apache2.comply": ["you may not use this file except in compliance with the license"],
    "apache2.copy": ["you may obtain a copy of the license at *"],
    "apache2.as-is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache2.see": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit.name": ["released under the mit license", "licensed under the mit license", "this * is licensed under the mit license", "the mit license", "mit license", "distributed under the mit license", "the mit license mit"],
    "mit.grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ],
    "mit.notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit.as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "mit.liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "isc.name": ["isc license", "licensed under the isc license", "released under the isc license"],
    "isc.grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "isc.as-is": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "bsd.grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd.source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd.binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd.endorse": ["neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd.advert": ["all advertising materials mentioning features or use of this software must display the following acknowledgement *"],
    "bsd.as-is": ["this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "bsd2.name": ["licensed under the bsd 2 clause license", "bsd 2 clause license", "released under the bsd 2 clause license"],
    "bsd3.name": ["licensed under the bsd 3 clause license", "bsd 3 clause license", "released under the bsd 3 clause license"],
    "gpl.free": ["* is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2.free": ["* is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "lgpl.free": ["* is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version * of the license or at your option any later version"],
    "gpl.hope": ["* is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl.see": ["see the gnu * public license for more details"],
    "gpl.copy": ["you should have received a copy of the gnu * public license along with this program *", "you should have received a copy of the gnu * public license along with *"],
    "gpl3.name": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "gnu general public license version 3", "gnu general public license version 3 29 june 2007", "licensed under the gnu gpl version 3", "licensed under gplv3"],
    "gpl2.name": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "gnu general public license version 2", "gnu general public license version 2 june 1991", "licensed under gplv2"],
    "agpl3.name": ["licensed under the gnu affero general public license version 3", "gnu affero general public license version 3"],
    "lgpl.name": ["licensed under the gnu lesser general public license version *", "gnu lesser general public license version *"],
    "mpl2.subject": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0", "mozilla public license version 2.0"],
    "mpl2.copy": ["if a copy of the mpl was not distributed with this file you can obtain one at *"],
    "epl2.name": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 *", "eclipse public license v 2.0"],
    "unlicense.domain": ["this is free and unencumbered software released into the public domain"],
    "unlicense.anyone": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "public-domain": ["this work is in the public domain", "released into the public domain"],
    "cc0.name": ["cc0 1.0 universal", "licensed under cc0 1.0", "released under cc0 1.0"],
    "cc-by.name": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa.name": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc-by-nc.name": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc-by-nc-sa.name": ["licensed under cc by nc sa 4.0", "this work is licensed under a creative commons attribution noncommercial sharealike 4.0 international license"],
    "cc-by-nd.name": ["licensed under cc by nd 4.0"],
}

# Licences and the sentences that make them, longest and most specific first.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["apache2.name", "apache2.comply", "apache2.copy", "apache2.as-is", "apache2.see"]),
    ("Apache-2.0", ["apache2.name"]),
    ("MIT", ["mit.grant", "mit.notice", "mit.as-is", "mit.liability"]),
    ("MIT", ["mit.name"]),
    ("ISC", ["isc.grant", "isc.as-is"]),
    ("ISC", ["isc.name"]),
    ("BSD-4-Clause", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.advert", "bsd.endorse", "bsd.as-is"]),
    ("BSD-3-Clause", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse", "bsd.as-is"]),
    ("BSD-2-Clause", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.as-is"]),
    ("BSD-3-Clause", ["bsd3.name"]),
    ("BSD-2-Clause", ["bsd2.name"]),
    ("GPL-3.0-or-later", ["gpl.free", "gpl.hope", "gpl.see"]),
    ("GPL-3.0-or-later", ["gpl.free"]),
    ("GPL-2.0-or-later", ["gpl2.free", "gpl.hope", "gpl.see"]),
    ("GPL-2.0-or-later", ["gpl2.free"]),
    ("LGPL", ["lgpl.free", "gpl.hope", "gpl.see"]),
    ("LGPL", ["lgpl.free"]),
    ("AGPL-3.0", ["agpl3.name"]),
    ("LGPL", ["lgpl.name"]),
    ("GPL-3.0", ["gpl3.name"]),
    ("GPL-2.0", ["gpl2.name"]),
    ("MPL-2.0", ["mpl2.subject", "mpl2.copy"]),
    ("MPL-2.0", ["mpl2.subject"]),
    ("EPL-2.0", ["epl2.name"]),
    ("Unlicense", ["unlicense.domain", "unlicense.anyone"]),
    ("Unlicense", ["unlicense.domain"]),
    ("CC0-1.0", ["cc0.name"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa.name"]),
    ("CC-BY-NC-4.0", ["cc-by-nc.name"]),
    ("CC-BY-SA-4.0", ["cc-by-sa.name"]),
    ("CC-BY-ND-4.0", ["cc-by-nd.name"]),
    ("CC-BY-4.0", ["cc-by.name"]),
    ("LicenseRef-Public-Domain", ["public-domain"]),
]

#: Every known sentence holds a word with one of these, so that other texts need not be cut up. Single words, as a sentence may be wrapped or hyphenated between two.
HINTS = tuple(w.encode() for w in "licen copyright reserved permission redistribut liable advertising gnu domain warrant anyone cc0 gpl obtain".split())

_MARK = re.compile(r"(?m)^[ \t]*(?://+|/?\*+/?|#+|;+|--+|<!--|dnl|rem)[ \t]?")
_END = re.compile(r"[.;:!?](?=[\"')\]]*(?:\s|\Z))|\n[ \t]*\n|\Z")
_OTHER = re.compile(r"[^a-z0-9.*]+")
_STOP = re.compile(r" ?\.+(?= |\Z)")


def normalise(text: str) -> str:
    """Lower case, one spelling of licence, words and version numbers only."""
    text = _OTHER.sub(" ", text.lower().replace("licence", "license")).strip()
    return _STOP.sub("", text).strip()


def _pattern(sentence: str) -> re.Pattern[str]:
    """A known sentence with * as a pattern over normalised text."""
    out, first = "", rf"(?:\S+ ){{0,{OPEN_WORDS}}}"
    for i, word in enumerate(sentence.split(" ")):
        if word == "*":
            out += rf"(?: \S+){{0,{OPEN_WORDS}}}" if i else first
        else:
            out += (" " if i and out != first else "") + re.escape(word).replace(r"\*", r"\S*")
    return re.compile(out + r"\Z")


#: No known sentence has more words; an item's number may stand before it.
_MOST_WORDS = 1 + max(len(s.split()) + OPEN_WORDS * s.split().count("*") for all_ in SENTENCES.values() for s in all_)
_LICENCE = {s: licence for licence, parts in reversed(RULES) for s in parts}


class _Open:
    """A sentence with asterisks: its pattern, a word that must be there, its most words, and what follows an asterisk at its start."""

    def __init__(self, number: int, sentence: str, name: str):
        words = sentence.split()
        self.number, self.name, self.pattern = number, name, _pattern(sentence)
        first = next(i for i, w in enumerate(words) if "*" in w)
        self.word = max((w for w in words[first:] if "*" not in w), key=len, default="")
        self.most = len(words) + OPEN_WORDS * words.count("*")
        self.follows = tuple(words[1:4]) if not first else None


def _trie() -> dict:
    """Known sentences by word; "" holds the name of one that ends here, "*" the open ones whose first asterisk comes next."""
    root: dict = {}
    for number, (name, sentence) in enumerate((name, s) for name, all_ in SENTENCES.items() for s in all_):
        node = root
        for word in sentence.split():
            if "*" in word:
                node.setdefault("*", []).append(_Open(number, sentence, name))
                break
            node = node.setdefault(word, {})
        else:
            node.setdefault("", name)
    return root


_TRIE = _trie()
_NUMBER = re.compile(r"(?:[0-9]{1,2}|[a-z])[.)]?")


def _sentence_at(words: list[str], at: int, ends: Iterator[int], followed: dict[tuple, list[int]]) -> tuple[int, str] | None:
    """(number of the end, name) of the longest known sentence from a word on; ends are the word numbers where lines end.

    The trie is followed word by word and open sentences are tried only when
    what stands before their asterisk is there, so most lines are left at once.
    """
    best, node, start = None, _TRIE, at
    near = lambda x: (k := bisect_left(followed[x.follows], start)) < len(followed[x.follows]) and followed[x.follows][k] <= start + OPEN_WORDS
    live = [x for x in _TRIE.get("*", ()) if near(x)]
    for k, end in enumerate(ends):
        while node is not None and at < end:
            node = node.get(words[at])
            at += 1
            live += node.get("*", ()) if node else ()
        name = node.get("") if node and at == end else None
        if not name and live:
            live = [x for x in live if end - start <= x.most]
            text = " ".join(words[start:end]) if live else ""
            name = next((x.name for x in sorted(live, key=lambda x: x.number) if x.word in text and x.pattern.match(text)), None)
        if name:
            best = k, name
        if node is None and not live:
            break
    return best


def _followed(words: list[str]) -> dict[tuple, list[int]]:
    """Where the words stand that follow an asterisk at a sentence's start."""
    out = {x.follows: [] for x in _TRIE.get("*", ())}
    for at in range(len(words) - 2):
        if (three := tuple(words[at : at + 3])) in out:
            out[three].append(at)
    return out


def sentence_id(sentence: str) -> str | None:
    """The identifier of a normalised sentence."""
    words = sentence.split(" ")
    found = _sentence_at(words, 0, iter([len(words)]), _followed(words))
    return found[1] if found else None


def known_sentences(text: str) -> list[tuple[str, int, int]]:
    """(identifier, first character, end) of the known sentences of a text, in order."""
    body = _MARK.sub(lambda m: " " * len(m[0]), text)
    pieces: list[tuple[int, int, bool]] = []  # fragments, and whether a sentence ends with each
    at = 0
    for end in _END.finditer(body):
        lines = list(re.finditer(r"[^\n]+", body[at : end.end()]))
        for k, line in enumerate(lines):
            indent = len(line[0]) - len(line[0].lstrip())
            pieces.append((at + line.start() + indent, at + line.end(), k == len(lines) - 1))
        at = end.end()
    lines: list[list] = []  # first character, end, whether a sentence ends, words
    for a, b, ends in pieces:
        if plain := normalise(body[a:b]):
            lines.append([a, b, ends, plain])
        elif lines and ends:  # a line without words joins nothing, but may end what stands before it
            lines[-1][2] = True
    words: list[str] = []
    starts = []
    for line in lines:
        starts.append(len(words))
        words += line[3].split(" ")
    starts.append(len(words))
    followed = _followed(words)

    def ends(i: int) -> Iterator[int]:
        for k in range(i, len(lines)):
            if starts[k + 1] - starts[i] > _MOST_WORDS:
                return
            yield starts[k + 1]
            if lines[k][2]:
                return

    out, i = [], 0
    while i < len(lines):
        at = starts[i]
        best = _sentence_at(words, at, ends(i), followed)
        if _NUMBER.fullmatch(words[at]) and at + 1 < len(words) and "a" <= words[at + 1][0] <= "z":
            after = _sentence_at(words, at + 1, ends(i), followed)
            best = max(best or (-1, ""), after, key=lambda x: x[0]) if after else best
        if best:
            out.append((best[1], lines[i][0], lines[i + best[0]][1]))
            i += best[0] + 1
        else:
            i += 1
    return out


def match_rules(names: list[str]) -> list[tuple[str, list[int]]]:
    """(licence, numbers of its sentences), by the ordered rules; what is left of a licence is licence-fragment."""
    free = [True] * len(names)
    out = []
    for licence, parts in RULES:
        i = 0
        while i < len(names):
            got, k, gap = [], i, 0
            for part in parts:
                while k < len(names) and got and gap < GAP and free[k] and names[k] != part:
                    k, gap = k + 1, gap + 1
                if k < len(names) and free[k] and names[k] == part:
                    got.append(k)
                    k, gap = k + 1, 0
                else:
                    break
            if len(got) == len(parts):
                out.append((licence, got))
                for n in got:
                    free[n] = False
            i += 1
    left = [n for n, open_ in enumerate(free) if open_ and names[n] in _LICENCE]
    out += [(f"{_LICENCE[names[n]]}-fragment", [n]) for n in left]
    return sorted(out, key=lambda x: x[1][0])


_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)")
_SPDX_WORD = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9.:+-]+)")
_SPDX_JOINT = ("AND", "OR", "WITH")


def spdx_ids(text: str) -> list[tuple[str, int, int]]:
    """(licence, first character, end) of every licence in the expressions of SPDX tags; an exception stays with its licence."""
    out = []
    for tag in _SPDX.finditer(text):
        at, joint = tag.start(1), "OR"
        while word := _SPDX_WORD.match(text, at, tag.end(1)):
            at = word.end()
            if word[1] in "()":
                continue
            if joint:
                if joint == "WITH":
                    out[-1] = (f"{out[-1][0]} WITH {word[1]}", out[-1][1], word.end(1))
                else:
                    out.append((word[1], word.start(1), word.end(1)))
                joint = ""
            elif word[1].upper() in _SPDX_JOINT:
                joint = word[1].upper()
            else:
                break
    return out


def _scan(batches):
    kind = pa.list_(pa.struct([("licence", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("sentences", pa.list_(pa.string()))]))
    for batch in batches:
        out = []
        for value in batch.column("text"):
            found = []
            if value.is_valid:
                raw = value.as_buffer().to_pybytes()
                low = raw.lower()
                if any(h in low for h in HINTS):
                    text = raw.decode("utf-8", "replace")
                    known = known_sentences(text)
                    names = [name for name, _, _ in known]
                    for licence, parts in match_rules(names):
                        found.append({"licence": licence, "first": known[parts[0]][1], "end": known[parts[-1]][2], "sentences": [names[p] for p in parts]})
                    found += [{"licence": tag, "first": first, "end": end, "sentences": ["spdx"]} for tag, first, end in spdx_ids(text)]
                    found.sort(key=lambda x: (x["first"], x["end"]))
            out.append(found)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, kind)], names=["id", "matches"])


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, matches (licence, first and end character, sentences), licences.

    matches is in text order; licences has the distinct names, sorted. Null,
    empty and other texts without licence sentences have empty lists. Texts are
    read whole, however long. Of two readings that start at the same place the
    longer one counts, and of rules that could take a sentence the first. Rows
    are independent, repeated rows and null ids too, and nothing is shuffled.
    Other columns, whatever their names, are not read. An empty table gives an
    empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_scan, f"id {kind}, matches array<struct<licence: string, first: long, end: long, sentences: array<string>>>")
    return out.select(F.col("id").alias(id_col), "matches", F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"]))).alias("licences"))
