"""License scans: fuzzy search for short notices.

A notice may differ from its published words by a number of edits (inserted, lost or changed
characters).  Cut into one more piece than edits are allowed, at least one piece of any such
occurrence is unharmed; so the pieces of all notices are searched exactly, in one Aho-Corasick pass
over the whole text, and each piece's own window, as long as the notice and its edits, is matched
with bounded errors by the ``regex`` library, which reports the edits and the span.  Pieces of one
occurrence share a window, equal windows of a text are matched once, and of matches that overlap
the one with fewest edits stays.

Texts are compared as lower-case words joined by one space, so that layout and punctuation don't
matter.  A phrase's exact places are those among its pieces' places where the whole phrase stands.

Work is row by row in Arrow batches; nothing is shuffled.

Edge cases: a very long text is searched whole, in windows of bounded length; a null text is empty; an empty text has no words and no labels; repeated rows get
equal results; occurrences of one phrase that overlap are all counted; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .text import byte_texts, pieces

#: A-Z to a-z, every other ASCII character except a-z and 0-9 to a space; the rest stays.
NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


@dataclass(frozen=True)
class Notice:
    """Words of a notice, the label it stands for, the edits it may have, and whether it is a base phrase."""

    label: str
    words: str
    edits: int
    base: bool = False


#: Published wordings, in the normal form.
NOTICES = (
    Notice("mit", "mit license", 1, True),
    Notice("apache", "apache license", 1, True),
    Notice("gpl", "general public license", 2, True),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 7),
    Notice("apache", "licensed under the apache license version 2 0", 4),
    Notice("gpl", "this program is free software you can redistribute it and or modify", 6),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("agpl", "gnu affero general public license", 3),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification", 7),
    Notice("bsd", "bsd 3 clause license", 1),
    Notice("bsd", "bsd 2 clause license", 1),
    Notice("mpl", "mozilla public license", 2),
    Notice("epl", "eclipse public license", 2),
    Notice("cc", "creative commons attribution", 2),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 7),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 6),
    Notice("boost", "boost software license", 2),
    Notice("reserved", "all rights reserved", 1),
)


def seeds(notice: Notice) -> list[tuple[str, int]]:
    """The pieces of a notice and where in it they begin."""
    n, parts = len(notice.words), notice.edits + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(notice.words[a:b], a) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, notices: tuple[Notice, ...]):
        self.notices = notices
        self.places: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(notices):
            for piece, at in seeds(notice):
                self.places.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece in self.places:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.patterns = [
            regex.compile(rf"(?e)(?<= )(?:{regex.escape(n.words, literal_spaces=True)}){{e<={n.edits}}}(?= )") for n in notices
        ]

    def scan(self, text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Exact places (notice, start) of base phrases, and matches (notice, start, end, edits).

        ``text`` is in the normal form, with a space before and after.
        """
        exact: list[tuple[int, int]] = []
        windows: dict[int, set[int]] = {}
        for end, piece in self.automaton.iter(text):
            for i, at in self.places[piece]:
                notice = self.notices[i]
                start = end + 1 - len(piece) - at
                if at == 0 and notice.base and text.startswith(f" {notice.words} ", start - 1):
                    exact.append((i, start))
                windows.setdefault(i, set()).add(start)
        found = [(i, *m) for i, starts in windows.items() for m in self.matches(i, text, sorted(starts))]
        return exact, found

    def matches(self, i: int, text: str, starts: list[int]) -> list[tuple[int, int, int]]:
        """Matches (start, end, edits) of a notice in the windows where it would begin at ``starts``."""
        notice, pattern = self.notices[i], self.patterns[i]
        seen: dict[str, list[tuple[int, int, int]]] = {}
        found = set()
        for start in starts:
            low = max(0, start - notice.edits - 1)
            window = text[low : start + len(notice.words) + notice.edits + 1]
            if window not in seen:
                seen[window] = [(m.start(), m.end(), sum(m.fuzzy_counts)) for m in pattern.finditer(window)]
            found.update((low + a, low + b, e) for a, b, e in seen[window])
        kept: list[tuple[int, int, int]] = []
        for a, b, e in sorted(found):
            if not kept or a >= kept[-1][1]:
                kept.append((a, b, e))
            elif e < kept[-1][2]:
                kept[-1] = (a, b, e)
        return kept


@cache
def scanner(notices: tuple[Notice, ...]) -> Scanner:
    return Scanner(notices)


def normal(text: bytes | None) -> tuple[int, str]:
    """Number of words, and the words between spaces; bytes stand for characters."""
    words = (text or b"").translate(NORMAL).split()
    return len(words), f" {b' '.join(words).decode('latin-1')} "


def scanned(text: bytes | None, notices: tuple[Notice, ...] = NOTICES) -> tuple:
    """The result columns of one text."""
    n, spaced = normal(text)
    exact, found = scanner(notices).scan(spaced)
    word = lambda at: spaced.count(" ", 0, at) - 1
    starts = [word(at) for _, at in exact]
    base = sorted({notices[i].label for i, _ in exact})
    labels = sorted({*base, *(notices[i].label for i, *_ in found)})
    scores = [1 - edits / len(notices[i].words) for i, _, _, edits in found] + [1.0] * bool(exact)
    spans = [
        {"label": notices[i].label, "first_word": word(a), "last_word": word(b) - 1 if spaced[b - 1] == " " else word(b), "edits": e}
        for i, a, b, e in sorted(found, key=lambda x: (x[1], x[2], x[0]))
    ]
    return (
        n,
        len(exact),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(base),
        ",".join(labels),
        max(scores, default=0.0),
        spans,
    )


SPANS = pa.list_(
    pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())])
)
SCHEMA = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
    "score double, spans array<struct<label:string,first_word:bigint,last_word:bigint,edits:int>>"
)


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """``doc_id`` and the scan of each row's whole text."""
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), SPANS]
    names = ["doc_id", *(f.split()[0] for f in SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = zip(*[scanned(t, notices) for t in byte_texts(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(found, kinds))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
