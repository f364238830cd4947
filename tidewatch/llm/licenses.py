"""License wording by template markup.

A template is the wording of a notice with regions that may be left out and regions that
may be replaced:

    <<optional>> released under <</optional>> the apache license version <<var:1>>

A region opened by ``<<optional>>`` may be missing, ``<<var:n>>`` stands for one to n words
of any kind, ``<<var:0-n>>`` for none to n. All other words are mandatory. A template is
compiled into an automaton over words; it accepts a stretch of text whose mandatory
wording is there word for word. From each place where a template can begin, the longest
accepted stretch counts.

The base phrases are templates without regions: every place where their words stand
consecutively counts. A null text is empty: no words, no labels, a score of 0.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.texts import ALNUM, add_result, fresh
from tidewatch.session import with_tasks

with_tasks(__name__)

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

TEMPLATES = {
    "gpl-notice": "<<optional>> this <<var:1-3>> is <</optional>> licensed under the <<optional>> terms of the <</optional>> "
                  "gnu general public license <<optional>> <<optional>> either <</optional>> version <<var:1-2>> <</optional>>",
    "gpl-3.0": "gnu general public license <<optional>> as published by the free software foundation <</optional>> "
               "<<optional>> either <</optional>> <<optional>> version <</optional>> 3 <<optional>> 0 <</optional>>",
    "lgpl": "gnu <<var:1>> general public license",
    "apache-2.0": "apache license <<optional>> version <</optional>> 2 <<optional>> 0 <</optional>>",
    "apache-notice": "licensed under the apache license <<optional>> version <<var:1-2>> <</optional>> "
                     "<<optional>> the license <</optional>>",
    "mit-notice": "<<optional>> <<optional>> this <<var:1-3>> is <</optional>> released <</optional>> under the "
                  "<<optional>> terms of the <</optional>> mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this <<var:1-6>> "
                "to deal in <<var:1-3>> without restriction",
    "cc-by-4.0": "cc by 4 0 <<optional>> international <</optional>>",
    "cc-by-sa": "cc by sa <<optional>> <<var:1>> 0 <</optional>>",
    "cc-by-nc": "cc by nc <<optional>> <<var:1>> 0 <</optional>>",
    "cc-by-nd": "cc by nd <<optional>> <<var:1>> 0 <</optional>>",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted "
                  "provided that the following conditions are met",
    "copyright": "copyright <<optional>> c <</optional>> <<optional>> <<var:0-2>> <</optional>> <<var:1-6>> all rights reserved",
}

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType())]))),
    T.StructField("score", T.DoubleType())])

_MARK = re.compile(r"<<(optional|/optional|var:(\d+)(?:-(\d+))?)>>|([^\s<]+)")


class Automaton:
    """A template as a nondeterministic automaton over words.

    ``words[s]`` maps a word to the states after it, ``any[s]`` are the states after any
    word, ``free[s]`` those reached without one. ``run`` follows all of them at once.
    """

    def __init__(self, template: str):
        self.words: list[dict[bytes, int]] = [{}]
        self.any: list[int | None] = [None]
        self.free: list[list[int]] = [[]]
        at, opened, phrase, phrases = 0, [], [], []
        for found in _MARK.finditer(template.lower()):
            mark, low, high, word = found.groups()
            if word:
                at = self._step(at, word.encode())
                if not opened:
                    phrase.append(word)
                continue
            phrases, phrase = [*phrases, phrase], []
            if mark == "optional":
                opened.append(at)
            elif mark == "/optional":
                at = self._join(at)
                self.free[opened.pop()].append(at)
            else:
                least, most = (int(low), int(high)) if high else (1, int(low))
                skips = []
                for i in range(most):
                    if i >= least:
                        skips.append(at)
                    at = self._step(at, None)
                at = self._join(at)
                for state in skips:
                    self.free[state].append(at)
        if opened:
            raise ValueError(f"an optional region is not closed: {template}")
        self.end = at
        # The longest mandatory wording has to be in a text for the automaton to accept any of it.
        self.needs = " ".join(max([*phrases, phrase], key=len)).encode()
        if not self.needs:
            raise ValueError(f"a template needs mandatory words: {template}")
        self.first = self._first()

    def _state(self) -> int:
        self.words.append({})
        self.any.append(None)
        self.free.append([])
        return len(self.words) - 1

    def _step(self, at: int, word: bytes | None) -> int:
        to = self._state()
        if word is None:
            self.any[at] = to
        else:
            self.words[at][word] = to
        return to

    def _join(self, at: int) -> int:
        to = self._state()
        self.free[at].append(to)
        return to

    def _closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def _first(self) -> set[bytes] | None:
        """Words the template can begin with; None for any."""
        states = self._closure({0})
        if any(self.any[s] is not None for s in states):
            return None
        return {w for s in states for w in self.words[s]}

    def run(self, words: list[bytes], start: int) -> int | None:
        """End of the longest accepted stretch from ``start``, or None."""
        states, best, at = self._closure({0}), None, start
        while states and at < len(words):
            word, after = words[at], set()
            for s in states:
                if (to := self.words[s].get(word)) is not None:
                    after.add(to)
                if (to := self.any[s]) is not None:
                    after.add(to)
            at += 1
            states = self._closure(after)
            if self.end in states:
                best = at
        return best


def _starts(joined: bytes, phrase: bytes, ends: list[int]) -> list[int]:
    """Word numbers at which the phrase stands. ``joined`` has a space around each word."""
    out, at = [], joined.find(b" " + phrase + b" ")
    while at >= 0:
        out.append(bisect_left(ends, at + 1))
        at = joined.find(b" " + phrase + b" ", at + 1)
    return out


class Scanner:
    def __init__(self, base: dict[str, str], templates: dict[str, str]):
        self.base = [(p.encode(), label) for p, label in base.items()]
        self.automata = [(label, Automaton(t)) for label, t in templates.items()]

    def scan(self, text: bytes | None) -> dict:
        words = (text or b"").translate(ALNUM).split()
        joined = b" " + b" ".join(words) + b" "
        ends: list[int] = []

        def positions() -> list[int]:
            if not ends:
                at = 0
                for word in words:
                    at += len(word) + 1
                    ends.append(at)
            return ends

        starts, base, spans = [], set(), []
        for phrase, label in self.base:
            if b" " + phrase + b" " in joined:
                found = _starts(joined, phrase, positions())
                base.add(label)
                starts += found
                spans += [(label, s, s + phrase.count(b" ") + 1) for s in found]
        for label, automaton in self.automata:
            if b" " + automaton.needs + b" " not in joined:
                continue
            at = 0
            while at < len(words):
                end = automaton.run(words, at) if automaton.first is None or words[at] in automaton.first else None
                if end is not None:
                    spans.append((label, at, end))
                at = end or at + 1
        covered, last = 0, 0
        for _, start, end in sorted(spans, key=lambda s: s[1:]):
            covered += max(0, end - max(start, last))
            last = max(last, end)
        return {"n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None),
                "last_word": max(starts, default=None), "base_labels": sorted(base),
                "labels": sorted({s[0] for s in spans}),
                "spans": [dict(zip(("label", "start", "end"), s)) for s in spans],
                "score": covered / len(words) if words else 0.0}


def scan_licenses(docs: DataFrame, text: str = "text", base: dict[str, str] | None = None,
                  templates: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """All rows with a struct column of labels, spans (in words) and the share of words that
    license wording covers, and the name of the column."""
    base, templates = BASE if base is None else base, TEMPLATES if templates is None else templates
    name = fresh(docs, "licenses")
    kinds = [(f.name, f.dataType) for f in FOUND]

    def start():
        scanner = Scanner(base, templates)

        def compute(texts):
            rows = [scanner.scan(t) for t in texts]
            return [pa.array([r[n] for r in rows], arrow[n]) for n, _ in kinds]

        return compute

    strings = pa.list_(pa.string())
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    arrow = {n: pa.int64() for n in ("n_words", "n_base", "first_word", "last_word")}
    arrow |= {"base_labels": strings, "labels": strings, "spans": pa.list_(span), "score": pa.float64()}
    return add_result(docs, text, FOUND, name, start), name


def license_report(docs: DataFrame) -> DataFrame:
    """A row per document; label lists as comma-joined text."""
    found, name = scan_licenses(docs.select("doc_id", "text"))
    plain = [F.col(name)[n].alias(n) for n in ("n_words", "n_base", "first_word", "last_word")]
    return found.select("doc_id", *plain,
                        F.array_join(F.col(name)["base_labels"], ",").alias("base_labels"),
                        F.array_join(F.col(name)["labels"], ",").alias("labels"), F.col(name)["score"].alias("score"))
