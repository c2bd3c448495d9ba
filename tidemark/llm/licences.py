"""Licence scan with a positional index of rare words (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ngrams import summed
from tidemark.llm.words import word_hashes

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, notice as it is commonly placed in files, and phrases without which it isn't that notice.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted", "free of charge")),
    ("mit", "released under the mit license", ("mit license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistribution and use", "source and binary forms")),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "free software")),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

#: Bytes outside digits, a-z and code points beyond ASCII separate words (after lower-casing).
SEPARATOR = np.ones(256, dtype=bool)
SEPARATOR[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Rarest words of a notice that are looked up, and how many of them must stand in place; least share of a notice's words.
RARE, VOTES, COVER = 8, 2, 0.8
#: Words by which a passage may be shifted against the notice, from insertions or losses.
SLACK = 3
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, label_words string"


@dataclass
class Index:
    """Postings of the notices' words. Words have numbers by their sorted hashes; -1 is any other word."""

    vocabulary: np.ndarray
    phrases: list[tuple[np.ndarray, str]]
    notices: list[tuple[str, np.ndarray, list[np.ndarray]]]
    postings: dict[int, list[tuple[int, int]]]  # of rare words: (notice, place in it)
    need: list[int]

    @staticmethod
    def numbers(vocabulary: np.ndarray, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
        return np.where(vocabulary[at] == words, at, -1)

    @classmethod
    def vocabulary_of(cls, notices, phrases) -> np.ndarray:
        return np.unique(word_hashes([t.encode() for _, t, _ in notices] + [p.encode() for p in phrases], SEPARATOR)[0])

    @classmethod
    def build(cls, notices, phrases: dict[str, str], idf: np.ndarray) -> Index:
        vocabulary = cls.vocabulary_of(notices, phrases)
        number = lambda t: cls.numbers(vocabulary, word_hashes([t.encode()], SEPARATOR)[0])
        made = [(label, number(text), [number(k) for k in keys]) for label, text, keys in notices]
        postings: dict[int, list[tuple[int, int]]] = {}
        need = []
        for t, (_, words, _) in enumerate(made):
            rare = sorted(range(len(words)), key=lambda o: (-idf[words[o]], o))[:RARE]
            need.append(min(VOTES, len(rare)))
            for o in rare:
                postings.setdefault(int(words[o]), []).append((t, o))
        return cls(vocabulary, [(number(p), label) for p, label in phrases.items()], made, postings, need)

    def places(self, words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        """Where the words of a phrase stand consecutively."""
        if len(words) < len(phrase):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(words[: len(words) - len(phrase) + 1] == phrase[0])
        for i in range(1, len(phrase)):
            at = at[words[at + i] == phrase[i]]
        return at

    def found(self, words: np.ndarray) -> list[tuple[str, int, float]]:
        """(label, first word, share) of each notice that stands in the text, words being their numbers.

        Occurrences of rare words vote for the place where a notice would begin. Where enough vote within the slack, the
        share of the notice's words in place is counted, and its key phrases are looked up there.
        """
        out = []
        votes: dict[int, list[int]] = {}
        rare = np.flatnonzero(np.isin(words, self._rare))
        for p in rare.tolist():
            for t, o in self.postings[int(words[p])]:
                votes.setdefault(t, []).append(p - o)
        for t, begins in votes.items():
            label, notice, keys = self.notices[t]
            begin = np.sort(np.array(begins))
            near = np.searchsorted(begin, begin + SLACK, side="right") - np.arange(len(begin))
            last = None
            for b in begin[near >= self.need[t]].tolist():
                if last is not None and b - last <= SLACK:
                    continue
                lo, hi = max(0, b - SLACK), b + len(notice) + SLACK
                region = words[lo:hi]
                if not all(len(self.places(region, k)) for k in keys):
                    continue
                share = self.cover(words, notice, b)
                if share >= COVER:
                    out.append((label, max(0, b), share))
                    last = b
        return out

    @property
    def _rare(self) -> np.ndarray:
        return np.fromiter(self.postings, np.int64, len(self.postings))

    @staticmethod
    def cover(words: np.ndarray, notice: np.ndarray, begin: int) -> float:
        """The share of a notice's words that stand in their place, give or take the slack."""
        hit = np.zeros(len(notice), dtype=bool)
        for shift in range(-SLACK, SLACK + 1):
            at = begin + shift + np.arange(len(notice))
            ok = (at >= 0) & (at < len(words))
            hit[ok] |= words[at[ok]] == notice[ok]
        return float(hit.mean())


def _lower(text: bytes | None) -> bytes:
    return (text or b"").lower()


def scan(docs: DataFrame, notices=NOTICES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Licence labels of each row of `docs` (doc_id, text): see SCHEMA.

    n_base counts the places of all base phrases, first_word and last_word are the smallest and largest of them, and score
    is the best share of a notice's words in place (1 where a base phrase stands; 0 without any label). label_words lists
    label@word, the evidence of the notices. IDF counts all rows of `docs`; the index holds the notices, whatever the
    input's size. Words: A-Z lower-cased, runs of digits, a-z and code points beyond ASCII. Null text: no words. Null
    doc_id: kept. Repeated rows: each by itself. Texts of any length are scanned whole. No rows: no rows. Other columns
    are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vocabulary = Index.vocabulary_of(notices, phrases)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(len(vocabulary) + 1, dtype=np.int64)
        for number, bounds, _ in _texts(batches, vocabulary):
            doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            known = number >= 0
            pairs = np.unique(doc[known] * len(vocabulary) + number[known])
            total[:-1] += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
            total[-1] += len(bounds) - 1
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())], names=["part", "v"])

    counts = summed(slim.mapInArrow(frequencies, "part long, v binary"))
    counts = np.zeros(len(vocabulary) + 1) if counts is None else counts
    index = Index.build(notices, phrases, np.log((1 + counts[-1]) / (1 + counts[:-1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, bounds, ids in _texts(batches, vocabulary):
            rows = []
            for i, key in enumerate(ids):
                words = number[bounds[i] : bounds[i + 1]]
                base = [(index.places(words, p), label) for p, label in index.phrases] if (words >= 0).any() else []
                places = np.concatenate([b for b, _ in base]) if base else np.zeros(0, np.int64)
                own = {label for b, label in base if len(b)}
                found = index.found(words) if base else []
                rows.append((
                    key, len(words), len(places), int(places.min()) if len(places) else None, int(places.max()) if len(places) else None, ",".join(sorted(own)),
                    ",".join(sorted(own | {f[0] for f in found})), max([1.0 if own else 0.0, *(f[2] for f in found)]), ",".join(f"{f[0]}@{f[1]}" for f in sorted(found, key=lambda f: (f[1], f[0]))),
                ))
            kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.string()]
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return slim.mapInArrow(run, SCHEMA)


def _texts(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray, rows: int = 256):
    """Word numbers, bounds and ids of some texts at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            words, bounds = word_hashes([_lower(t) for t in part.column("text").cast(pa.binary()).to_pylist()], SEPARATOR)
            yield Index.numbers(vocabulary, words), bounds, part.column("doc_id").to_pylist()
