"""Fuzzy search for short license notices.

A text is lower-cased (A-Z) and its words are joined by single spaces. A notice
that may differ in e edits is cut into e + 1 pieces, one of which must occur
unchanged; the pieces found exactly give candidate windows, and the regex
library's bounded-error matching verifies each window and counts its edits. A
place must start and end at word limits. Windows without any edit are the exact
places of the notice.

Each text is handled by itself, so nothing is shuffled and a task holds one batch.

Defined cases: a null text is empty: no words, no places, empty labels, score 0.
A null identifier is passed on. Repeated rows give repeated results. Very long
texts are searched whole. An empty table gives an empty result. Other columns are
not looked at.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopspark.llm.textbytes import chunks

#: The exact phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notices searched for.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license version": "apache",
    "lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution": "cc",
    "licensed under the": "licensed",
}
CHARS_PER_EDIT = 11
#: Word bytes after lower-casing: digits, a-z and everything outside ASCII; the rest separates.
TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


@dataclass(frozen=True)
class Match:
    label: str
    notice: str
    edits: int
    first_word: int
    last_word: int
    text: str


class Notice:
    """One notice with its pieces and its bounded-error pattern."""

    def __init__(self, words: str, label: str, chars_per_edit: int):
        import regex

        self.words, self.label, self.body = words, label, words.encode()
        self.edits = max(1, len(words) // chars_per_edit)
        n, k = len(self.body), self.edits + 1
        cuts = [n * i // k for i in range(k + 1)]
        self.pieces = [(low, self.body[low:high]) for low, high in zip(cuts, cuts[1:])]
        self.pattern = regex.compile(rb"(?b)(?<![^ ])(?:%s){e<=%d}(?![^ ])" % (regex.escape(self.body, literal_spaces=True), self.edits))

    def places(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """(start, end, edits) of the notice in a text that begins and ends with a space."""
        size, windows = len(self.body), set()
        for offset, piece in self.pieces:
            at = text.find(piece)
            while at >= 0:
                windows.add(at - offset)
                at = text.find(piece, at + 1)
        exact = {s for s in windows if s > 0 and text.startswith(self.body, s) and text[s - 1] == 32 and text[s + size] == 32}
        for start in sorted(exact):
            yield start, start + size, 0
        covered = 0
        taken = sorted(exact)
        for start in sorted(windows - exact):
            low, high = max(0, start - self.edits), min(len(text), start + size + self.edits)
            low, high = text.rfind(b" ", 0, low + 1), text.find(b" ", high - 1)
            low, high = max(low, 0), len(text) - 1 if high < 0 else high
            # What lies between exact places is searched, from the space before to the one after.
            at = bisect(taken, low)
            inside = taken[max(at - 1, 0) : bisect(taken, high)]
            for left, right in zip([low, *(s + size for s in inside)], [*(s - 1 for s in inside), high]):
                left, right = max(low, left, covered), min(right, high)
                found = self.pattern.search(text, left + 1, right) if left + 1 < right else None
                if found:
                    covered = found.end()
                    yield found.start(), found.end(), sum(found.fuzzy_counts)


def scan_text(raw: bytes, notices: list[Notice]) -> tuple[int, list[Match]]:
    """Number of words and the verified matches of one text."""
    words = raw.translate(TABLE).split(b" ")
    words = [w for w in words if w]
    text = b" " + b" ".join(words) + b" "
    found = []
    for notice in notices:
        for start, end, edits in notice.places(text):
            first = text.count(b" ", 0, start) - 1
            last = first + text.count(b" ", start, end)
            found.append(Match(notice.label, notice.words, edits, first, last, text[start:end].decode("utf-8", "replace")))
    return len(words), found


MATCH_DDL = "array<struct<label string, notice string, edits int, first_word long, last_word long, matched string>>"
MATCH_TYPE = pa.list_(
    pa.struct([("label", pa.string()), ("notice", pa.string()), ("edits", pa.int32()), ("first_word", pa.int64()),
               ("last_word", pa.int64()), ("matched", pa.string())])
)


def _scan(phrases: dict[str, str], chars_per_edit: int):
    def scan(batches):
        notices = [Notice(words, label, chars_per_edit) for words, label in phrases.items()]
        for batch in batches:
            for part in chunks(batch, "text"):
                sizes, found = [], []
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    n, matches = scan_text(text or b"", notices)
                    sizes.append(n)
                    found.append([{"label": m.label, "notice": m.notice, "edits": m.edits, "first_word": m.first_word,
                                   "last_word": m.last_word, "matched": m.text} for m in matches])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(found, MATCH_TYPE)], names=["id", "n_words", "matches"]
                )

    return scan


def license_matches(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    notices: dict[str, str] | None = None, chars_per_edit: int = CHARS_PER_EDIT,
) -> DataFrame:
    """One row per document: id, n_words, matches (label, notice, edits, first and last word, matched words)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    wanted = {**PHRASES, **NOTICES} if notices is None else notices
    return rows.mapInArrow(_scan(wanted, chars_per_edit), f"id {kind}, n_words long, matches {MATCH_DDL}")


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its exact phrases, and all labels with the score of the best match."""
    found = license_matches(docs, id_col, text_col)
    # Matches without edits of the fixed phrases are the base places.
    base = F.filter("matches", lambda m: (m.edits == 0) & m.notice.isin(*PHRASES))
    labels = lambda matches: F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m.label))), ",")
    quality = F.transform("matches", lambda m: 1.0 - m.edits / F.length(m.notice))
    starts = F.transform("base", lambda m: m.first_word)
    return found.withColumn("base", base).select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(F.col("base")).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(quality), F.lit(0.0)).alias("score"),
    )
