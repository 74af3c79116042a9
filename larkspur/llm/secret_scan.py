"""Secret scans: base patterns, and dictionary-primed zstandard novelty for the rest.

The novelty method looks at strings of token characters that follow a sensitive word (key,
token, credential, ...) closely. A candidate's marginal size is what it adds to the
compressed size of the code around it, with a compressor primed by a dictionary of common
identifiers and words. Ordinary identifiers, words, paths and repeats compress well; a
string that adds 0.7 bytes a character or more is reported as ``novel``. Nothing else
decides: there are no rules about cases, digits or letters.
"""

from __future__ import annotations

import builtins
import hashlib
import keyword
import re
import sys
from collections import Counter
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import map_texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the maximal runs of 32 characters or more
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = ("password", "passwd", "secret", "token", "apikey", "api_key", "api-key", "credential", "bearer", "private", "authorization", "access_key", "client_key", "signature", "key", "auth", "pwd")
SENSITIVE_AT = re.compile("|".join(map(re.escape, SENSITIVE)))
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=\-]{{{LEAST},}}")
CONTEXT = 256
REACH = 48
SHARE = 0.7
IDENTIFIERS = b"""the and of to in for with from this that return function class public private static void int string
 char const unsigned long double float boolean true false null none undefined self import export default package module
 password passwd secret token api_key apikey access_key client_id client_secret authorization bearer credential
 username user_name user_id session_id request_id response_code content_type application_json get_value set_value
 configuration environment variable parameter argument example placeholder changeme your_api_key_here insert_token_here
 xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx 0000000000000000000000000000000 1111111111111111 1234567890 abcdefghijklmnopqrstuvwxyz
 ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 abcdef0123456789 qwertyuiopasdfghjklzxcvbnm http://www.example.com/index.html
 https://localhost:8080/ /usr/local/bin /home/user/ --------------------------------================================"""


def dictionary() -> bytes:
    """Lower-case words of code and its prose, the frequent ones last, where matches are cheapest.

    They come from the language reference that Python brings along, and from its keywords,
    built-in names and module names, so that driver and workers of one version agree.
    """
    from pydoc_data.topics import topics

    words = Counter(w.lower() for page in topics.values() for w in re.findall(r"[A-Za-z]{4,}", page))
    for name in (*dir(builtins), *keyword.kwlist, *sorted(sys.stdlib_module_names)):
        words.update(w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name) if len(w) >= 4)
    return " ".join(sorted(words, key=lambda w: (words[w], w))).encode() + b" " + IDENTIFIERS.lower()


class Novelty:
    """Marginal compressed bytes of a string beside its context, letter case aside."""

    def __init__(self, identifiers: bytes | None = None):
        import zstandard

        primed = zstandard.ZstdCompressionDict(dictionary() if identifiers is None else identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.zstd = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False, write_dict_id=False)

    def marginal(self, before: str, candidate: str, after: str) -> int:
        before, candidate, after = (x.lower().encode("utf-8", "surrogatepass") for x in (before, candidate, after))
        return len(self.zstd.compress(before + candidate + after)) - len(self.zstd.compress(before + after))

    def novel(self, before: str, candidate: str, after: str) -> bool:
        """Whether the candidate adds at least ``SHARE`` bytes a character."""
        return self.marginal(before, candidate, after) >= SHARE * len(candidate)


@lru_cache(maxsize=1)
def novelty() -> Novelty:
    return Novelty()


def base_spans(text: str, lower: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, in code points, end exclusive."""
    out = []
    if any(w in lower for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def novel_spans(text: str, lower: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Incompressible strings close after a sensitive word that no base span touches."""
    if len(lower) != len(text) or not any(w in lower for w in SENSITIVE):
        if len(lower) == len(text) or not any(w in lower for w in SENSITIVE):
            return []
        lower = "".join(c.lower() if c < "\x80" else c for c in text)
    out: list[tuple[int, int, int]] = []
    done = past = 0  # no base span before ``past`` reaches the candidate; candidates ascend
    until = list(accumulate((e for _, e, _ in base), max))
    for word in SENSITIVE_AT.finditer(lower):
        at = max(done, word.end())
        while at <= word.end() + REACH and (m := CANDIDATE.search(text, at, word.end() + REACH + LEAST)):
            m = CANDIDATE.match(text, m.start())  # the whole of it, which may reach further
            at = done = m.end()
            while past < len(base) and until[past] <= m.start():
                past += 1
            if past < len(base) and base[past][0] < m.end():
                continue
            if novelty().novel(text[max(0, m.start() - CONTEXT) : m.start()], m.group(), text[m.end() : m.end() + CONTEXT]):
                out.append((m.start(), m.end(), 3))
    return out


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a whole text, each by start, then kind."""
    text = text or ""
    lower = text.lower()
    base = base_spans(text, lower)
    return base, sorted(base + novel_spans(text, lower, base), key=lambda s: (s[0], s[2]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def redact(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with every span, overlapping ones together, replaced by a mark."""
    if text is None:
        return None
    out, at, until = [], 0, -1
    for s, e, _ in scan(text)[1]:
        if s >= until:
            if until >= 0:
                at = until
            out += [text[at:s], mark]
            until = e
        else:
            until = max(until, e)
    return text if until < 0 else "".join(out) + text[until:]


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end, base>>) of every whole text.

    Null and empty texts have no spans; repeated rows and keys stay as they are; an empty
    table gives an empty table; other columns are ignored. Ties in start go by kind.
    """

    def kernel():
        def apply(texts: list) -> dict:
            return {"spans": [[{"kind": KINDS[k], "start": s, "end": e, "base": k < 3} for s, e, k in scan(t)[1]] for t in texts]}

        return apply

    return map_texts(df, [id_col], text_col, kernel, [("spans", "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")])


def secret_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans): counts and digests of the scan."""

    def kernel():
        def apply(texts: list) -> dict:
            out: dict[str, list] = {"n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
            for t in texts:
                base, every = scan(t)
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(sum(s[2] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(every))
            return out

        return apply

    fields = [("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"), ("spans", "string")]
    return map_texts(df, [id_col], text_col, kernel, fields)


def redact_secrets(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns, with the secrets in the text column replaced by ``[secret]``.

    A column of text lengths follows the new text. Null texts stay null; an empty table gives
    an empty table.
    """
    others = [c for c in df.columns if c != text_col]

    def kernel():
        return lambda texts: {"redacted": [redact(t) for t in texts]}

    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # names may clash with the result's
    at = {c: f"c{i}" for i, c in enumerate(df.columns)}
    out = map_texts(numbered, [at[c] for c in others], at[text_col], kernel, [("redacted", "string")])
    columns = []
    for c in df.columns:
        if c == text_col:
            columns.append(F.col("redacted").alias(c))
        elif c == chars_col:
            columns.append(F.when(F.col("redacted").isNotNull(), F.length("redacted")).otherwise(F.col(at[c])).cast(df.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(at[c]).alias(c))
    return out.select(*columns)
