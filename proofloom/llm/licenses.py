"""Operator 2, licence scans.

An Aho-Corasick automaton runs once over the words of every whole text and finds notice phrases
and the `SPDX-License-Identifier` tag; a shunting-yard parser reads the expression after a tag and
evaluates its and/or/with: OR takes the freer side, AND the stricter, WITH an exception softens
copyleft by one step.

Null and empty texts have no words and no labels; repeated rows give repeated results; columns
other than the named ones are ignored. A tag without a readable expression gives no expression
label. Grades: 3 permissive, 2 weak copyleft, 1 copyleft, 0 reserved or unknown.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Phrases that are counted, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases and their labels.
NOTICES = {
    "apache license": "apache",
    "mit license": "mit",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "isc license": "isc",
    "public domain": "public-domain",
    "creative commons attribution": "cc-by-text",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "unlicense": "unlicense",
    "redistribution and use in source and binary forms": "bsd-text",
    "permission is hereby granted free of charge": "mit-text",
    "without warranty of any kind": "no-warranty",
}
TAG = "spdx license identifier"
#: Grades of licence families by the first part of an identifier.
GRADES = {"mit": 3, "apache": 3, "bsd": 3, "isc": 3, "zlib": 3, "unlicense": 3, "cc0": 3, "0bsd": 3, "cc": 2, "mpl": 2, "lgpl": 2, "epl": 2, "cddl": 2, "gpl": 1, "agpl": 1}

_TAG_LINE = re.compile(r"spdx-license-identifier\s*:?[ \t]*((?:(?!spdx-license-identifier)[^\r\n])+)", re.IGNORECASE | re.ASCII)
_PART = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+\-]*")
_STRENGTH = {"or": 1, "and": 2, "with": 3}

# lower-cases A-Z, keeps digits, letters and all bytes of non-ASCII characters, and turns the rest into spaces
_WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def parse(expression: str) -> list[str]:
    """The longest readable licence expression at the front, in postfix order; empty if there is none."""
    out: list[str] = []
    ops: list[str] = []
    best: list[str] = []
    operand = True  # an identifier or "(" must come next
    for part in _PART.finditer(expression):
        token = part[0]
        low = token.lower()
        if operand:
            if token == "(":
                ops.append(token)
                continue
            if token == ")" or low in _STRENGTH:
                break
            out.append(low)
            operand = False
        elif token == ")":
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                break
            ops.pop()
        elif low in _STRENGTH:
            while ops and ops[-1] != "(" and _STRENGTH[ops[-1]] >= _STRENGTH[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = True
            continue
        else:
            break
        if "(" not in ops:
            best = out + ops[::-1]
    return best


def family_grade(identifier: str) -> int:
    """The grade of the longest family name that the identifier starts with, followed by a mark, a digit or nothing."""
    fits = [f for f in GRADES if identifier == f or re.match(re.escape(f) + r"[-.+\d]", identifier)]
    return GRADES[max(fits, key=len)] if fits else 0


def evaluate(postfix: list[str]) -> int:
    """The grade of a postfix expression."""
    stack: list[int] = []
    for token in postfix:
        if token in _STRENGTH:
            b, a = stack.pop(), stack.pop()
            stack.append(max(a, b) if token == "or" else min(a, b) if token == "and" else min(3, a + 1) if a else 0)  # an exception helps a known licence alone
        else:
            stack.append(family_grade(token))
    return stack[-1] if stack else 0


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE, TAG: "spdx"}.items():
        found.add_word(f" {phrase} ", (phrase, label))
    found.make_automaton()
    return found


def scan(text: str) -> tuple[int, int, int | None, int | None, str, str, str | None, int | None, float]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, expression, grade, score) of one text."""
    words = text.encode().translate(_WORD_TABLE).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    places: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    n_hits = 0
    for end, (phrase, label) in _automaton().iter(line):
        n_hits += 1
        labels.add(label)
        if phrase in BASE:
            base.add(label)
            places.append(line.count(" ", 0, end - len(phrase)) - 1 if len(places) < 64 else end - len(phrase))
    if len(places) > 64:  # many hits: count spaces once for all
        spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        tail = np.searchsorted(spaces, places[64:], side="left") - 1
        places[64:] = tail.tolist()
    expression = grade = None
    if "spdx" in labels:
        parsed = [p for p in map(parse, _TAG_LINE.findall(text)) if p]
        for p in parsed:
            labels.update(f"id:{x}" for x in p if x not in _STRENGTH)
        if parsed:
            expression, grade = " ".join(parsed[0]), min(map(evaluate, parsed))
    if grade is None and labels:
        known = [GRADES[x.split("-")[0]] for x in labels if x.split("-")[0] in GRADES]
        grade = 0 if "reserved" in labels and not known else min(known, default=0)
    # confidence that the text carries a licence notice: rises with hits, more with an evaluated tag
    score = 0.0 if not n_hits else 1.0 - 0.5 ** (n_hits + 2 * (expression is not None))
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), expression, grade, score)


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("expression", pa.string()), ("grade", pa.int32()), ("score", pa.float64())]
)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document with counts, places, labels, the first expression (postfix), the strictest grade and a score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(scan(t or "") for t in batch.column("text").to_pylist()), strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(r, f.type) for r, f in zip(rows, list(_OUT)[1:], strict=True))], schema=_OUT)

    return common.columns(docs, doc_id=(id_col, "long"), text=(text_col, "string")).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expression string, grade int, score double"
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(common.read(spark, sf_dir, "documents"))
