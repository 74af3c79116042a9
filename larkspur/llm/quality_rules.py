"""Quality rules as a short-circuit cascade.

Every document gets its base counts. The method's own rules then run as a cascade: each
partition measures every rule's cost and rejection on its first documents, orders the rules
by rejection per cost and, for every later document, stops at the first rule that rejects
it. Documents that fail the base test never reach the cascade. A verdict is "no rule
rejects", so the order changes the work and never the result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame

from larkspur.llm.common import map_texts

SAMPLE_ROWS = 64
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
WINDOW = 5


class View:
    """One text as the rules see it; the base counts are shared, the rest is made on demand."""

    __slots__ = ("data", "text", "words", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

    def __init__(self, text: str | None):
        self.text = text = text or ""
        self.data = data = text.encode("utf-8", "surrogatepass")
        self.words = words = data.split()  # bytes.split() cuts at exactly \x20 and \x09-\x0D
        self.n_words = len(words)
        self.word_chars = len(text) - (len(data) - len(data.translate(None, WHITE)))
        self.n_symbols = len(data) - len(data.translate(None, SYMBOLS))
        lines = [x for x in data.split(b"\n") if x.strip()]
        self.n_lines = len(lines)
        self.n_dup_lines = len(lines) - len(set(lines))
        self.n_repeat_words = repeated_words(words)


def repeated_words(words: Sequence[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more, the first included."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64, count=n)
    size, code = len(seen), ids[: n - window + 1]
    if size == n:
        return 0
    top = size
    for k in range(1, window):
        if top * size >= 1 << 62:  # renumber, so that the codes stay exact
            code = np.unique(code, return_inverse=True)[1]
            top = int(code.max()) + 1
        code = code * size + ids[k : n - window + 1 + k]
        top *= size
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(code.size, dtype=np.int64)
    twice[order] = np.r_[same, False] | np.r_[False, same]
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[: code.size] += twice
    edge[window : window + code.size] -= twice
    return int((np.cumsum(edge[:n]) > 0).sum())


def base_failed(v: View) -> bool:
    return v.n_words < 10 or 100 * v.n_repeat_words > 20 * v.n_words


def symbol_heavy(v: View) -> bool:
    """More than one markup symbol for every four words."""
    return 4 * v.n_symbols > v.n_words


def shouting(v: View) -> bool:
    """Most ASCII letters are capitals, or exclamation marks follow every third word."""
    upper = len(v.data) - len(v.data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(v.data) - len(v.data.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return upper > lower or 3 * v.data.count(b"!") > v.n_words


def repeated_lines(v: View) -> bool:
    """More than half of at least six lines repeat an earlier one."""
    return v.n_lines >= 6 and 2 * v.n_dup_lines > v.n_lines


def odd_lengths(v: View) -> bool:
    """A mean word length that prose in any alphabetic script doesn't have."""
    return v.word_chars < 2 * v.n_words or v.word_chars > 25 * v.n_words


def few_letters(v: View) -> bool:
    """Fewer than half of the words hold a letter."""
    return 2 * sum(1 for w in v.words if not w.isdigit() and (w.upper() != w.lower() or max(w) > 127)) < v.n_words


def one_word(v: View) -> bool:
    """One word makes up more than two fifths of fifty words or more."""
    if v.n_words < 50:
        return False
    count: dict[bytes, int] = {}
    for w in v.words:
        count[w] = count.get(w, 0) + 1
    return 5 * max(count.values()) > 2 * v.n_words


RULES: tuple[tuple[str, Callable[[View], bool]], ...] = (
    ("symbol_heavy", symbol_heavy),
    ("shouting", shouting),
    ("repeated_lines", repeated_lines),
    ("odd_lengths", odd_lengths),
    ("few_letters", few_letters),
    ("one_word", one_word),
)


class Cascade:
    """Rules in order of rejection per cost, as measured on the first documents."""

    def __init__(self, rules=RULES, sample: int = SAMPLE_ROWS, clock: Callable[[], float] = time.perf_counter):
        self.rules, self.left, self.clock = list(rules), sample, clock
        self.cost = {name: 0.0 for name, _ in rules}
        self.hits = {name: 0 for name, _ in rules}

    def accepts(self, v: View) -> bool:
        if not self.left:
            return not any(rule(v) for _, rule in self.rules)
        good = True
        for name, rule in self.rules:
            began = self.clock()
            rejected = rule(v)
            self.cost[name] += self.clock() - began
            self.hits[name] += rejected
            good = good and not rejected
        self.left -= 1
        if not self.left:
            self.rules.sort(key=lambda r: -(self.hits[r[0]] + 0.5) / (self.cost[r[0]] + 1e-9))
        return good


FIELDS = [("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean")]


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, sample: int = SAMPLE_ROWS) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    A null or empty text has no words, so it fails the base test and isn't kept. Repeated
    rows get equal verdicts; an empty table gives an empty table; other columns are ignored.
    """

    def kernel():
        cascade = Cascade(rules, sample)

        def apply(texts: list) -> dict:
            out: dict[str, list] = {name: [] for name, _ in FIELDS}
            for text in texts:
                v = View(text)
                for name, _ in FIELDS[:5]:
                    out[name].append(getattr(v, name))
                failed = base_failed(v)
                out["base_failed"].append(failed)
                out["kept"].append(not failed and cascade.accepts(v))
            return out

        return apply

    return map_texts(df, [id_col], text_col, kernel, FIELDS)


#: The query in SQL: base counts, then all rules at once, as their order never changes a verdict.
ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
w AS (SELECT r, len(ws) AS n, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM l),
g AS (SELECT *, CASE WHEN i + 4 <= n THEN w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o END AS gram FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT *, gram IS NOT NULL AND count(*) OVER (PARTITION BY r, gram) > 1 AS twice FROM g),
m AS (SELECT *, max(CASE WHEN twice THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM c),
k AS (SELECT r, count(*) AS n_words, sum(length(w)) AS chars, sum(covered) AS repeated, count(*) FILTER (WHERE regexp_matches(w, '[A-Za-z]|[^\x00-\x7F]')) AS letters FROM m GROUP BY r),
f AS (SELECT r, max(k) AS most FROM (SELECT r, w, count(*) AS k FROM w GROUP BY r, w) GROUP BY r),
s AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
a AS (SELECT d.doc_id, CAST(coalesce(k.n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(k.chars, 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(s.dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(k.repeated, 0) AS BIGINT) AS n_repeat_words, coalesce(s.n_lines, 0) AS n_lines, coalesce(k.letters, 0) AS letters, coalesce(f.most, 0) AS most,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper_, length(regexp_replace(t, '[^a-z]', '', 'g')) AS lower_, length(regexp_replace(t, '[^!]', '', 'g')) AS marks
  FROM d LEFT JOIN k ON d.r = k.r LEFT JOIN s ON d.r = s.r LEFT JOIN f ON d.r = f.r),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 4 * n_symbols > n_words OR upper_ > lower_ OR 3 * marks > n_words OR (n_lines >= 6 AND 2 * n_dup_lines > n_lines)
    OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 2 * letters < n_words OR (n_words >= 50 AND 5 * most > 2 * n_words)) AS kept
FROM b
"""
