"""License scanning by an exact set-similarity join of text blocks with license templates.

Method.  A block and a template are sets of words.  A block matches when it contains at least ``THRESHOLD`` of the
template's words; a template of fewer than ``SHORT`` different words must be there whole, as one word is often all that
tells it from another.  All words are put in one global order, rarest in the corpus first.  A template that may miss m
words must share one of its first m + 1 words with a matching block, so only these are indexed (prefix filter).  A
block that meets an indexed word is a candidate if it has enough words at all (length filter) and if enough words can
still follow the shared one on both sides (positional filter); then the overlap is counted.  No match is missed.

Blocks are windows of the whole text's words regardless of line ends, as notices are mostly wrapped.  A template of n
words is held against windows of the least power of two from 16 that is at least 2 n; windows overlap by half, so any
notice of that length lies whole in one of them.  A shorter text is one block.

Scale.  Word frequencies cover all documents (only words of the templates are counted).  The templates are a fixed,
small list, so the index travels with the code; the scan is one pass without a shuffle.  Only windows that hold an
indexed word are looked at, and places are counted as the text is read, so a text takes time in proportion to its length.

Edge cases.  Null text counts as empty: no words, no labels, score 0, null positions.  Repeated rows get a row each.
Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_batches

#: Phrases whose words standing one after another name a license.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Notices of common licenses, in words as ``prepared`` gives them.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("spdx license identifier mit", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software "
        "is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in "
        "no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
        "connection with the software or the use or other dealings in the software",
        "mit",
    ),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("spdx license identifier apache 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2"),
    (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either "
        "express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache-2",
    ),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 "
        "of the license or at your option any later version",
        "gpl-3",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 "
        "of the license or at your option any later version",
        "gpl-2",
    ),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("it under the terms of the gnu affero general public license as published by the free software foundation", "agpl-3"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above "
        "copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "bsd",
    ),
    (
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability "
        "and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or "
        "consequential damages",
        "bsd",
    ),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("distributed under the boost software license version 1 0", "bsl-1"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "zlib"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
)
THRESHOLD = 0.8
#: A template of fewer different words must be there whole.
SHORT = 8
#: The smallest window.
LEAST_BLOCK = 16


def needed_of(words: int, threshold: float = THRESHOLD) -> int:
    """How many of a template's different words a block must hold."""
    return words if words < SHORT else max(1, math.ceil(threshold * words - 1e-9))


def block_of(words: int) -> int:
    """The window that a template of so many words is held against."""
    return max(LEAST_BLOCK, 1 << (2 * words - 1).bit_length())


#: Lower case; everything but digits, letters and bytes of other characters is a blank.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def prepared(text: str | None) -> bytes:
    """The text's words with blanks between."""
    return (text or "").encode("utf-8", "replace").translate(_WORDS)


@dataclass
class TemplateIndex:
    """Templates as numbers in the global order of words, and by window size where each word stands in their prefixes."""

    order: dict[bytes, int]
    labels: list[str]
    words: list[np.ndarray]
    needed: list[int]
    prefix: dict[int, dict[int, list[tuple[int, int]]]]
    indexed: frozenset[bytes] = frozenset()


def index_templates(templates, frequency: dict[bytes, int], threshold: float = THRESHOLD) -> TemplateIndex:
    sets = [frozenset(text.encode().split()) for text, _ in templates]
    vocabulary = sorted(set().union(*sets), key=lambda w: (frequency.get(w, 0), w))
    order = {w: i for i, w in enumerate(vocabulary)}
    index = TemplateIndex(order, [label for _, label in templates], [np.array(sorted(order[w] for w in s)) for s in sets], [], {})
    for t, (words, (text, _)) in enumerate(zip(index.words, templates, strict=True)):
        needed = needed_of(len(words), threshold)
        index.needed.append(needed)
        of_size = index.prefix.setdefault(block_of(len(text.split())), {})
        for at, word in enumerate(words[: len(words) - needed + 1].tolist()):
            of_size.setdefault(word, []).append((t, at))
    held = set().union(*index.prefix.values())
    index.indexed = frozenset(w for w, i in order.items() if i in held)
    return index


def frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """In how many documents each word of the templates occurs; over all documents."""
    vocabulary = frozenset(w for text, _ in templates for w in text.encode().split())
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def body(batches):
        seen: dict[bytes, int] = {}
        for batch in batches:
            for text in batch["text"]:
                for word in vocabulary.intersection(prepared(text).split()):
                    seen[word] = seen.get(word, 0) + 1
        yield {"word": [w.decode() for w in seen], "n": list(seen.values())}

    rows = map_batches(docs.select("text"), body, schema).groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r.word.encode(): r.n for r in rows}


def blocks(n: int, size: int) -> range:
    """Where the windows of a text of ``n`` words start."""
    return range(0, max(1, n - size // 2), size // 2) if n > size else range(1)


def matches(own: np.ndarray, index: TemplateIndex, size: int) -> dict[int, float]:
    """Containment by template, of all templates of this window size that a block's different known words hold to the threshold."""
    found: dict[int, float] = {}
    tried = set()
    prefix = index.prefix[size]
    for at_block, word in enumerate(own.tolist()):
        for t, at_template in prefix.get(word, ()):
            if t in tried:
                continue
            tried.add(t)
            words, needed = index.words[t], index.needed[t]
            # the first shared word: what can follow it bounds the overlap
            if len(own) < needed or min(len(words) - at_template, len(own) - at_block) < needed:
                continue
            overlap = len(np.intersect1d(own, words, assume_unique=True))
            if overlap >= needed:
                found[t] = overlap / len(words)
    return found


def template_matches(words: list[bytes], index: TemplateIndex) -> dict[int, float]:
    """The best containment of each template that some block of the text holds."""
    if index.indexed.isdisjoint(words):
        return {}
    get = index.order.get
    numbers = np.array([get(w, -1) for w in words], dtype=np.int64)
    places = np.flatnonzero(numbers >= 0)
    best: dict[int, float] = {}
    for size, prefix in index.prefix.items():
        hits = places[np.isin(numbers[places], list(prefix))]
        starts = blocks(len(words), size)
        last = hits // starts.step if len(words) > size else np.zeros(len(hits), dtype=np.int64)
        for k in np.unique(np.r_[last, last - 1]).tolist():
            if 0 <= k < len(starts):
                own = numbers[starts[k] : starts[k] + size]
                for t, share in matches(np.unique(own[own >= 0]), index, size).items():
                    best[t] = max(best.get(t, 0.0), share)
    return best


SCANNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def scan_text(text: str | None, index: TemplateIndex, phrases=PHRASES) -> tuple:
    """The columns of ``SCANNED`` after the id, for one whole text."""
    raw = prepared(text)
    words = raw.split()
    joined = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in phrases:
        wanted = b" " + phrase.encode() + b" "
        at, counted, word = joined.find(wanted), 0, 0
        while at >= 0:
            word += joined.count(b" ", counted, at)
            counted = at
            places.append(word)
            base.add(label)
            at = joined.find(wanted, at + 1)
    labels, score = set(base), 1.0 if base else 0.0
    for t, share in template_matches(words, index).items():
        labels.add(index.labels[t])
        score = max(score, share)
    ends = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), score


def scan(docs: DataFrame, *, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: words, places of the phrases, and labels of phrases and templates with the best containment."""
    index = index_templates(templates, frequencies(docs, templates), threshold)

    def body(batches):
        for batch in batches:
            rows = [(i, *scan_text(t, index, phrases)) for i, t in zip(batch["doc_id"], batch["text"], strict=True)]
            yield dict(zip(SCANNED.names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in SCANNED.names}

    return map_batches(docs.select("doc_id", "text"), body, SCANNED)
