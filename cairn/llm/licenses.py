"""License scans: exact phrases, and fuzzy short-notice search.

Texts are lower-cased (A-Z) and cut into words [a-z0-9 and non-ASCII]+. Phrases are found where their words stand
consecutively. Notices are found with errors: a notice with k allowed edits is split into k + 1 pieces, one of which must
stand unchanged in any match (pigeonhole); around each piece found the regex library matches the notice with at most k
errors and gives its span and edits. The words of a notice that name its license or version (in braces) must stand in the
match unchanged, so one license isn't taken for another: what is before and after them is matched from where they stand.
Of matches that overlap, the closest and then the longest counts; so notices that stand whole are looked up first, and errors
are looked for between them only. A notice that is all in braces is found whole only. Whole texts are searched, and all
places are reported.

Null counts as an empty text: no words, no spans. Texts may be of any length. Repeated rows give equal results; an empty
table gives an empty one. Other columns aren't read, so their names may clash.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.words import buffers, letters_digits, lower_ascii, slices

# Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notices that are found with errors, and their labels. Words in braces must stand as they are.
NOTICES = {
    "released under the {mit} license": "mit",
    "licensed under the {mit} license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the {apache} license {version 2} 0": "apache-2",
    "the {apache} software license {version 1} 1": "apache-1",
    "gnu {general public} license {version 1}": "gpl-1",
    "gnu {general public} license {version 2}": "gpl-2",
    "gnu {general public} license {version 3}": "gpl-3",
    "gnu {lesser} general public license": "lgpl",
    "gnu {library} general public license": "lgpl",
    "gnu {affero} general public license": "agpl",
    "released under the {bsd} license": "bsd",
    "licensed under the {bsd} license": "bsd",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the {mozilla} public license": "mpl",
    "subject to the terms of the {eclipse} public license": "epl",
    "made available under the terms of the {eclipse} public license": "epl",
    "released under the {isc} license": "isc",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "distributed under the {boost} software license": "boost",
    "released under the {zlib} license": "zlib",
    "released under the {artistic} license": "artistic",
    "licensed under the {european union} public licence": "eupl",
    "licensed under the sil {open font} license": "ofl",
    "common development and distribution license": "cddl",
    "creative commons {attribution 4} 0": "cc-by",
    "creative commons {attribution noncommercial}": "cc-by-nc",
    "creative commons {attribution noncommercial sharealike}": "cc-by-nc-sa",
    "creative commons {attribution noncommercial noderivatives}": "cc-by-nc-nd",
    "creative commons {attribution sharealike}": "cc-by-sa",
    "creative commons {attribution noderivatives}": "cc-by-nd",
    "creative commons {zero} 1 0 universal": "cc0",
    "licensed under {cc by 4} 0": "cc-by",
    "licensed under {cc by nc 4} 0": "cc-by-nc",
    "licensed under {cc by nc sa 4} 0": "cc-by-nc-sa",
    "licensed under {cc by nc nd 4} 0": "cc-by-nc-nd",
    "licensed under {cc by sa 4} 0": "cc-by-sa",
    "licensed under {cc by nd 4} 0": "cc-by-nd",
    "{mit license}": "mit",
    "spdx license identifier {mit}": "mit",
    "spdx license identifier {apache 2} 0": "apache-2",
    "{mozilla public license}": "mpl",
    "{eclipse public license}": "epl",
    "all rights {reserved}": "all-rights-reserved",
}
#: Characters of a notice per allowed edit, and the most edits.
PER_EDIT, MOST_EDITS = 10, 6

SCHEMA = "id long, n_words long, spans array<struct<label:string,notice:string,first_word:long,end_word:long,edits:int,base:boolean>>"


class Notice:
    """A notice as patterns: what is before its first exact words, these words, and what follows."""

    def __init__(self, marked: str, label: str):
        self.text, self.label = marked.replace("{", "").replace("}", ""), label
        self.raw = self.text.encode()
        parts = [p.strip().encode() for p in re.split(r"[{}]", marked)]  # free, exact, free, ...
        self.edits = min(MOST_EDITS, len(self.raw) // PER_EDIT) if any(parts[::2]) else 0
        self.exact = [b" " + w + b" " for w in parts[1::2]]

        def near(part: bytes) -> bytes:
            return b"(?:" + regex.escape(part, special_only=True) + b"){e<=%d}" % self.edits if part else b""

        best = b"(?b)"
        if self.exact:
            self.before = regex.compile(best + near(parts[0]) + rb"\Z") if parts[0] else None
            # Exact words share the space between them and what stands next to them.
            rest = b"".join(b" " + re.escape(w) + b" " + near(free) for w, free in zip(parts[3::2], parts[4::2]))
            self.after = regex.compile(best + near(parts[2]) + rest) if parts[2] or rest else None
            self.shared = not parts[2]
        else:  # what is before and after each piece
            self.sides = {a: (regex.compile(best + near(self.raw[:a]) + rb"\Z") if a else None, regex.compile(best + near(self.raw[a + len(p) :])) if a + len(p) < len(self.raw) else None) for p, a in self.pieces()}

    def pieces(self) -> list[tuple[bytes, int]]:
        cuts = [len(self.raw) * j // (self.edits + 1) for j in range(self.edits + 2)]
        return [(self.raw[a:z], a) for a, z in zip(cuts[:-1], cuts[1:])]

    def around(self, text: bytes, at: int, a: int, z: int) -> tuple[int, int, int] | None:
        """(start, end, edits) of the match within a and z whose first exact words stand at a place; None without one."""
        start, end, edits = at + 1, at + len(self.exact[0]) - 1, 0
        if self.before:
            if not (m := self.before.search(text, a, at)):
                return None
            start, edits = m.start(), sum(m.fuzzy_counts)
        if self.after:
            if not (m := self.after.match(text, end + (not self.shared), z)):
                return None
            end, edits = m.end() - self.closed, edits + sum(m.fuzzy_counts)
        return (start, end, edits) if edits <= self.edits else None

    @property
    def closed(self) -> int:
        """1 if the notice ends with exact words, whose space isn't part of it."""
        return int(len(self.exact) > 1 and self.raw.endswith(self.exact[-1][1:-1]))

    def beside(self, text: bytes, at: int, size: int, place: int, a: int, z: int) -> tuple[int, int, int] | None:
        """(start, end, edits) of the best match within a and z in which a piece stands unchanged; for a notice without exact words."""
        (before, after), start, end, edits = self.sides[place], at, at + size, 0
        if after:
            if not (m := after.match(text, end, z)):
                return None
            end, edits = m.end(), sum(m.fuzzy_counts)
        if before:
            if edits > self.edits or not (m := before.search(text, a, at)):
                return None
            start, edits = m.start(), edits + sum(m.fuzzy_counts)
        return (start, end, edits) if edits <= self.edits else None


class Apart:
    """Spans that don't overlap."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def take(self, a: int, z: int) -> bool:
        """Adds a span, unless it overlaps one."""
        i = bisect.bisect_left(self.ends, a + 1)
        if i < len(self.starts) and self.starts[i] < z:
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, z)
        return True

    def gap(self, a: int, z: int) -> tuple[int, int] | None:
        """The free range around a span, as far as it is free on either side; None if the span isn't."""
        i = bisect.bisect_left(self.ends, a + 1)
        if i < len(self.starts) and self.starts[i] < z:
            return None
        return (self.ends[i - 1] if i else 0), (self.starts[i] if i < len(self.starts) else 1 << 62)


def _places(text: bytes, part: bytes, a: int = 0, z: int | None = None) -> Iterator[int]:
    at = text.find(part, a, len(text) if z is None else z)
    while at >= 0:
        yield at
        at = text.find(part, at + 1, len(text) if z is None else z)


class Scanner:
    """The notices' pieces and patterns."""

    def __init__(self, phrases: dict[str, str], notices: dict[str, str]):
        self.phrases = [(b" " + p.encode() + b" ", label, p, len(p.split())) for p, label in phrases.items()]
        self.notices = [Notice(marked, label) for marked, label in notices.items()]
        self.pieces: dict[bytes, list[tuple[int, int]]] = {}
        for n, notice in enumerate(self.notices):
            for piece, place in notice.pieces() if notice.edits else []:
                self.pieces.setdefault(piece, []).append((n, place))

    def scan(self, texts: pa.Array) -> list[tuple[int, list[tuple[str, str, int, int, int, bool]]]]:
        """Of each text: its number of words, and its spans in order."""
        data, off = buffers(texts)
        table = np.where(letters_digits(), lower_ascii(), 32).astype(np.uint8)
        raw = table[data].tobytes()
        sizes, lines, heads = [], [], [0]
        for a, z in zip(off[:-1].tolist(), off[1:].tolist()):
            row = raw[a:z].split()
            sizes.append(len(row))
            lines.append(b" " + b" ".join(row) + b" \n")
            heads.append(heads[-1] + len(lines[-1]))
        whole = b"".join(lines)
        at = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
        spaces, before = memoryview(at), np.searchsorted(at, heads).tolist()
        found: list[set] = [set() for _ in sizes]

        def add(first: int, end: int, label: str, notice: str, edits: int, base: bool) -> None:
            """first: a word's first byte, or one within it; end: after the last byte."""
            d = bisect.bisect_right(heads, first) - 1
            a, z = (bisect.bisect_left(spaces, x) - before[d] for x in (first, end))
            a, z = a + (whole[first] == 32) - 1, z - (whole[end - 1] == 32)
            found[d].add((a, max(z, a + 1), label, notice, edits, base))

        for pattern, label, phrase, _ in self.phrases:
            for at in _places(whole, pattern):
                add(at + 1, at + len(pattern) - 1, label, phrase, 0, True)
        exact = [(-len(n.raw), at + 1, n) for n in self.notices for at in _places(whole, b" " + n.raw + b" ")]
        taken, done = Apart(), []
        for size, at, n in sorted(exact, key=lambda x: x[:2]):
            if taken.take(at, at - size):
                done.append((at, at - size, 0, n))
        near = []
        seen: set[tuple[int, int]] = set()
        last = [(0, 0, 0)] * len(self.notices)  # the match found before, and how far its piece is shifted
        spots = ((at, len(piece), uses) for piece, uses in self.pieces.items() for at in _places(whole, piece))
        for at, size, uses in sorted(spots, key=lambda x: x[:2]):
            gap = taken.gap(at, at + size)
            if gap is None:
                continue
            d = bisect.bisect_right(heads, at) - 1
            for k, place in uses:
                n = self.notices[k]
                a, z = max(at - place - n.edits, heads[d], gap[0]), min(at - place + len(n.raw) + 2 * n.edits, heads[d + 1] - 1, gap[1])
                if n.exact:
                    for p in _places(whole, n.exact[0], max(a - 1, heads[d]), min(z + 1, heads[d + 1] - 1)):
                        if (k, p) not in seen:
                            seen.add((k, p))
                            reach = len(n.raw) + n.edits
                            if m := n.around(whole, p, max(p - reach, heads[d], gap[0]), min(p + reach, heads[d + 1] - 1, gap[1] + 1)):
                                near.append((*m, n))
                elif not (last[k][0] <= at and at + size <= last[k][1] and at - place - last[k][0] == last[k][2]) and (m := n.beside(whole, at, size, place, a, z)):
                    near.append((*m, n))
                    last[k] = (m[0], m[1], at - place - m[0])
        # Of matches that overlap, the closest one counts.
        for a, z, edits, n in sorted(near, key=lambda m: (m[2] / len(m[3].raw), m[0] - m[1], m[0], m[1], m[3].text)):
            if taken.take(a, z):
                done.append((a, z, edits, n))
        for a, z, edits, n in done:
            add(a, z, n.label, n.text, edits, False)
        return [(size, sorted((label, notice, a, z, e, b) for a, z, label, notice, e, b in f)) for size, f in zip(sizes, found)]


def license_spans(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """One row per row of df: id, n_words, and spans (label, notice, first_word, end_word, edits, base)."""
    scanner_of = (phrases or PHRASES, notices or NOTICES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*scanner_of)
        span = pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32()), ("base", pa.bool_())])
        for b in batches:
            for lo, hi in slices(b.column(1)):
                rows = scanner.scan(b.column(1).slice(lo, hi - lo))
                spans = [[dict(zip(("label", "notice", "first_word", "end_word", "edits", "base"), s)) for s in r[1]] for r in rows]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([r[0] for r in rows], pa.int64()), pa.array(spans, pa.list_(span))], ["id", "n_words", "spans"])

    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)
