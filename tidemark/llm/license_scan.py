"""Operator 3 - license scans by template-markup matching.

A template (``license_templates``) is the wording of a license or notice with
marked-up regions: ``[...]`` may be left out and ``{n}`` stands for one to ``n``
words of any kind. It is compiled into a token automaton, which accepts a text
only if all mandatory words, to the last one, match exactly and in order.
The automata start only where a template's first two words stand, found by
comparing word hashes of a whole batch at once; fixed base phrases are counted
in the same pass.

Scale: a single map pass without a shuffle; memory is one batch of texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_templates import TEMPLATES
from .textops import ALNUM, chunks_of, fold_ascii, span_hash, text_buffer, word_spans

CHUNK = 1 << 20

#: Brackets, placeholders and words of a template.
MARKUP = re.compile(r"[\[\]]|\{\d+\}|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

def word_hash(words: list[str]) -> list[int]:
    raw = "".join(words).encode()
    size = np.array([len(w.encode()) for w in words], np.int64)
    ends = np.cumsum(size)
    return span_hash(np.frombuffer(raw, np.uint8), ends - size, ends).tolist()


@dataclass
class Automaton:
    """States are numbered along the wording; ``free[s]`` are states reachable without a word."""

    label: str
    word: list[int | None]  # the word hash that leads from state s to s + 1; None takes any word
    free: list[tuple[int, ...]]
    heads: frozenset[tuple[int | None, int | None]] = frozenset()

    @classmethod
    def compile(cls, label: str, markup: str) -> Automaton:
        parts = MARKUP.findall(markup.lower())
        words: list[str | None] = []
        skips: list[tuple[int, int]] = []
        opened: list[int] = []
        for part in parts:
            if part == "[":
                opened.append(len(words))
            elif part == "]":
                skips.append((opened.pop(), len(words)))
            elif part.startswith("{"):
                n = int(part[1:-1])
                skips += [(len(words) + k, len(words) + n) for k in range(1, n)]
                words += [None] * n
            else:
                words.append(part)
        named = [w for w in words if w is not None]
        codes = iter(word_hash(named))
        free: list[list[int]] = [[] for _ in range(len(words) + 1)]
        for a, b in skips:
            free[a].append(b)
        made = cls(label, [None if w is None else next(codes) for w in words], [tuple(x) for x in free])
        made.heads = frozenset(made.starts())
        if any(first is None for first, _ in made.heads):
            raise ValueError("a template must begin with a mandatory word")
        return made

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def starts(self) -> set[tuple[int | None, int | None]]:
        """The first two words of all accepted wordings (None: any)."""
        out = set()
        for s in self.closure({0}):
            if s < len(self.word):
                for t in self.closure({s + 1}):
                    out.add((self.word[s], self.word[t] if t < len(self.word) else None))
        return out

    def accepts(self, tokens: list[int]) -> int:
        """The number of words of the longest accepted beginning of ``tokens``, or 0."""
        states, best = self.closure({0}), 0
        for i, token in enumerate(tokens):
            states = self.closure({s + 1 for s in states if s < len(self.word) and self.word[s] in (None, token)})
            if not states:
                break
            if len(self.word) in states:
                best = i + 1
        return best


def scan_batch(column, base: dict[str, str], automata: list[Automaton]) -> dict[str, list]:
    n = len(column)
    n_words, n_base = np.zeros(n, np.int64), np.zeros(n, np.int64)
    first, last = np.full(n, 1 << 62), np.full(n, -1)
    base_labels, labels = [set() for _ in range(n)], [set() for _ in range(n)]
    matched = np.zeros(n, bool)
    phrases = [(word_hash(p.split()), label) for p, label in base.items()]
    data, offsets = text_buffer(column)
    for a, b in chunks_of(offsets, CHUNK):
        part, off = fold_ascii(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
        s, e, row = word_spans(part, off, ALNUM)
        tok = span_hash(part, s, e)
        count = np.bincount(row, minlength=b - a)
        begin = np.cumsum(count) - count
        n_words[a:b] = count
        where: dict[int, np.ndarray] = {}

        def at(code: int, where=where, tok=tok) -> np.ndarray:
            if code not in where:
                where[code] = np.flatnonzero(tok == np.uint64(code))
            return where[code]

        for codes, label in phrases:
            i = at(codes[0])
            i = i[i + len(codes) <= len(tok)]
            for k, code in enumerate(codes):
                i = i[tok[i + k] == np.uint64(code)]
            i = i[row[i] == row[i + len(codes) - 1]] if len(i) else i
            np.add.at(n_base, row[i] + a, 1)
            np.minimum.at(first, row[i] + a, i - begin[row[i]])
            np.maximum.at(last, row[i] + a, i - begin[row[i]])
            for r in np.unique(row[i]).tolist():
                base_labels[a + r].add(label)
        for auto in automata:
            places: set[int] = set()
            for x, y in auto.heads:
                i = at(x)
                if y is not None:
                    i = i[i + 1 < len(tok)]
                    i = i[tok[i + 1] == np.uint64(y)]
                places.update(i.tolist())
            for i in sorted(places):
                end = int(begin[row[i]] + count[row[i]])
                if auto.accepts(tok[i : min(end, i + len(auto.word))].tolist()):
                    labels[a + int(row[i])].add(auto.label)
                    matched[a + int(row[i])] = True
    none = n_base == 0
    return {
        "n_words": pa.array(n_words),
        "n_base": pa.array(n_base),
        "first_word": pa.array(first, mask=none),
        "last_word": pa.array(last, mask=none),
        "base_labels": pa.array([",".join(sorted(x)) for x in base_labels], pa.string()),
        "labels": pa.array([",".join(sorted(x | y)) for x, y in zip(labels, base_labels, strict=True)], pa.string()),
        "score": pa.array(np.where(matched, 1.0, np.where(none, 0.0, 0.5))),
    }


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, templates: tuple = TEMPLATES) -> DataFrame:
    """Find license phrases and templates in every text.

    Returns (``id_col``, n_words, n_base, first_word, last_word, base_labels,
    labels, score), a row for each input row. The score is 1 where a template
    is accepted, 0.5 where only base phrases stand, else 0. Null and empty
    texts have no words; label lists without a label are empty strings; other
    columns are ignored.
    """
    phrases = BASE if base is None else base
    automata = [Automaton.compile(label, markup) for label, markup in templates]
    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = cols.schema["id"].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            found = scan_batch(batch["text"], phrases, automata)
            yield pa.RecordBatch.from_arrays([batch["id"], *found.values()], ["id", *found])

    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return cols.mapInArrow(scan, schema).withColumnRenamed("id", id_col)
