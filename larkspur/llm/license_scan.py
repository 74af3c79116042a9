"""License scans: Aho-Corasick for tags and notices, shunting-yard for licence expressions.

One automaton finds the word sequences of notices (the base phrases among them) in the
normalised words of a text; another finds identifier tags in the raw text. What follows a
tag is read as a licence expression: a shunting-yard parser puts it in postfix order
(``with`` binds closest, then ``and``, then ``or``) and a stack evaluates its score.

Scores say how freely a text may be reused: 1 public domain, 0.9 permissive, 0.6 weak
copyleft, 0.3 copyleft, 0.2 non-commercial, 0 reserved or unknown. ``or`` takes the larger
score, ``and`` the smaller one, ``with`` (an exception) moves a score a third of the way
to 0.9. A text's score is the smallest over its tags and notices, 0 if it has none. A notice
inside a longer one neither scores nor labels, except that the base phrases keep their labels.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame

from larkspur.llm.common import map_texts

BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
NOTICES = (
    ("apache license version 2 0", "apache-2.0"),
    ("apache license", "apache"),
    ("mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("general public license version 2", "gpl-2.0"),
    ("general public license version 3", "gpl-3.0"),
    ("lesser general public license", "lgpl"),
    ("lesser general public license version 2", "lgpl-2.0"),
    ("lesser general public license version 2 1", "lgpl-2.1"),
    ("lesser general public license version 3", "lgpl-3.0"),
    ("library general public license", "lgpl"),
    ("affero general public license", "agpl"),
    ("affero general public license version 3", "agpl-3.0"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("bsd license", "bsd"),
    ("bsd 3 clause", "bsd-3-clause"),
    ("bsd 2 clause", "bsd-2-clause"),
    ("isc license", "isc"),
    ("boost software license", "bsl-1.0"),
    ("creative commons attribution", "cc-by"),
    ("cc by nc", "cc-by-nc"),
    ("cc by nc 4 0", "cc-by-nc-4.0"),
    ("cc by sa", "cc-by-sa"),
    ("cc by sa 4 0", "cc-by-sa-4.0"),
    ("cc by nd", "cc-by-nd"),
    ("cc by 4 0", "cc-by-4.0"),
    ("cc0 1 0 universal", "cc0-1.0"),
    ("public domain dedication", "public-domain"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("proprietary and confidential", "proprietary"),
)
TAGS = ("spdx-license-identifier:", "license-expression:", "licenseref:")
WORD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:\-]*")
BINDING = {"with": 3, "and": 2, "or": 1}
SCORES = (
    (("cc-by-nc", "cc-by-nd"), 0.2),
    (("agpl", "gpl"), 0.3),
    (("cc-by-sa",), 0.5),
    (("lgpl", "mpl", "epl", "cddl", "eupl", "ofl", "cecill", "ms-rl"), 0.6),
    (("cc0", "unlicense", "public-domain", "0bsd", "wtfpl"), 1.0),
    (("mit", "apache", "bsd", "isc", "bsl", "zlib", "cc-by", "python", "psf", "artistic", "afl", "ncsa", "x11", "curl", "postgresql", "unicode", "openssl", "ms-pl"), 0.9),
)
OWN = "licenseref-"


def family_score(label: str) -> float | None:
    """The score of the family that a label belongs to by its prefix, if there is one."""
    return next((score for prefixes, score in SCORES if any(label == p or label.startswith((p + "-", p + "+")) for p in prefixes)), None)


def score_of(label: str) -> float:
    """The score of one licence; reserved, a text's own and unknown ones have 0."""
    return family_score(label) or 0.0


def is_operand(token: str, exception: bool) -> bool:
    """Whether a token is a known identifier, or the name of an exception where one is due."""
    if exception:
        return "exception" in token or token.endswith("-note")
    return token.startswith(OWN) or family_score(token) is not None


def known_start(tokens: list[str]) -> list[str]:
    """The tokens before the first that is no identifier, so that prose after a tag is no licence."""
    for i, t in enumerate(tokens):
        if t not in BINDING and t not in "()" and not is_operand(t, i > 0 and tokens[i - 1] == "with"):
            return tokens[:i]
    return tokens


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: the longest well-formed start of the tokens in postfix order."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether an operand is due
    good: list[str] = []
    for t in tokens:
        if operand and t not in BINDING and t != ")":
            if t == "(":
                stack.append(t)
                continue
            out.append(t)
            operand = False
        elif not operand and t in BINDING:
            while stack and stack[-1] != "(" and BINDING[stack[-1]] >= BINDING[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = True
        elif not operand and t == ")" and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            break
        if not operand and "(" not in stack:
            good = out + stack[::-1]
    return good


def evaluate(expression: list[str]) -> tuple[float, set[str]]:
    """Score and licence labels of a postfix expression."""
    stack: list[float] = []
    names: list[tuple[float, str]] = []
    labels: set[str] = set()
    for t in expression:
        if t not in BINDING:
            stack.append(score_of(t))
            names.append((stack[-1], t))
            labels.add(t)
            continue
        b, a = stack.pop(), stack.pop()
        if t == "with":
            labels.discard(names[-1][1])  # an exception isn't a licence
            stack.append(a + max(0.0, 0.9 - a) / 3)
        else:
            stack.append(max(a, b) if t == "or" else min(a, b))
    return stack[0], labels


def longest(spans: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """The spans that no other span holds."""
    out, reach = set(), -1
    for start, end in sorted(spans, key=lambda s: (s[0], -s[1])):
        if end > reach:
            out.add((start, end))
            reach = end
    return out


class Scanner:
    def __init__(self):
        import ahocorasick

        self.phrases, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        found: dict[str, list] = {}
        for base, rows in ((True, BASE), (False, NOTICES)):
            for phrase, label in rows:
                found.setdefault(f" {phrase} ", []).append((base, label))
        for phrase, hits in found.items():
            self.phrases.add_word(phrase, (len(phrase), tuple(hits)))
        for tag in TAGS:
            self.tags.add_word(tag, tag)
        self.phrases.make_automaton()
        self.tags.make_automaton()

    def expressions(self, text: str) -> list[list[str]]:
        """Postfix expressions after the tags of a text; each ends with its line."""
        if ":" not in text:
            return []
        low = text.lower()
        out = []
        for end, _ in self.tags.iter(low):
            stop = low.find("\n", end)
            line = low[end + 1 : stop if stop >= 0 else len(low)]
            if expr := postfix(known_start(TOKEN.findall(line))):
                out.append(expr)
        return out

    def scan(self, text: str | None) -> dict:
        text = text or ""
        words = text.encode("utf-8", "surrogatepass").translate(WORD).split()
        row = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None}
        base, labels, scores = set(), set(), []
        flat = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
        place = at = 0  # the word number ``at`` of the place that was looked at last
        matches = [(end - length + 1, end, hits) for end, (length, hits) in self.phrases.iter(flat)]
        outer = longest([(start, end) for start, end, _ in matches])
        for start, end, hits in matches:
            at += flat.count(" ", place, start) if start >= place else -flat.count(" ", start, place)
            place = start
            for is_base, label in hits:
                if (start, end) in outer:
                    labels.add(label)
                    scores.append(score_of(label))
                if is_base:
                    base.add(label)
                    row["n_base"] += 1
                    row["first_word"] = at if row["first_word"] is None else min(at, row["first_word"])
                    row["last_word"] = at if row["last_word"] is None else max(at, row["last_word"])
        for expr in self.expressions(text):
            score, found = evaluate(expr)
            scores.append(score)
            labels |= found
        return row | {"base_labels": sorted(base), "labels": sorted(labels | base), "score": min(scores, default=0.0)}


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score), labels as arrays.

    Null and empty texts have no words, no labels and score 0; a phrase that occurs several
    times counts each time; repeated rows stay; an empty table gives an empty table; other
    columns are ignored.
    """
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

    def kernel():
        find = scanner().scan

        def apply(texts: list) -> dict:
            rows = [find(t) for t in texts]
            return {name: [r[name] for r in rows] for name in names}

        return apply

    kinds = ("bigint", "bigint", "bigint", "bigint", "array<string>", "array<string>", "double")
    return map_texts(df, [id_col], text_col, kernel, list(zip(names, kinds)))
