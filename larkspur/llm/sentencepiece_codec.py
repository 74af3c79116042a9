"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Many words are encoded at once as one flat numpy array of symbols. Each round looks up the
rank of every adjacent pair, takes the segmented minimum per word, merges the leftmost
occurrences of that minimum in all words simultaneously and compacts the array; words
without a mergeable pair leave the array. The rounds end when no pair remains.

Equality with the sequential algorithm (always the best pair, leftmost on ties): within a
word several occurrences of the minimum are merged in one round only up to and including
the first one whose merge creates a pair of a better rank, because the sequential
algorithm would turn to that pair before the next occurrence.

Words: no piece holds a space mark after another character, nor a line feed, so text cut
before each run of space marks and around line feeds merges exactly as the whole text does.
Both facts are checked when a model is loaded; otherwise whole texts are single words.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from larkspur.llm.common import map_texts

SPACE = "▁"
NONE = np.int64(1) << 40
CACHE_WORDS = 150_000
CACHE_CHARS = 4_000_000
MERGE_WORDS = 20_000


class PieceModel:
    """Encoder and decoder of one SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != 2 or not train.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("only the identity normalisation that keeps white space is supported")
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.dummy_prefix = norm.add_dummy_prefix
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        order = {p: r for r, p in enumerate(sorted(normal, key=lambda p: (-proto.pieces[normal[p]].score, normal[p])))}
        scores: dict[float, int] = {}
        for p in sorted(normal, key=order.get):  # pieces of one score share a rank, as ties go to the leftmost pair
            scores.setdefault(proto.pieces[normal[p]].score, len(scores))
        self.size = len(proto.pieces)
        self.char_id = np.arange(0x110000, dtype=np.int64) + self.size  # unknown characters: size + code point
        for p, i in normal.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        byte_at = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.byte_ids = [byte_at[b] for b in range(256)]
        self.decoded: list[bytes] = []
        for p in proto.pieces:
            if p.type == 6:
                self.decoded.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == 2:
                self.decoded.append(train.unk_surface.encode())
            else:
                self.decoded.append(b"" if p.type == 3 else p.piece.replace(SPACE, " ").encode())
        self.is_byte = np.array([p.type == 6 for p in proto.pieces])
        self.texts = [str(i) for i in range(self.size)]
        self._pairs(proto, normal, scores)
        spaced = any(SPACE in p.lstrip(SPACE) for p in normal)
        self.words = re.compile(r"(?s:.+)" if spaced else r" +[^ ]*|[^ ]+" if any("\n" in p for p in normal) else r"\n| +[^ \n]*|[^ \n]+")

    def _pairs(self, proto, normal: dict, scores: dict) -> None:
        """An open-addressing table from a pair of symbols to (rank, merged id)."""
        keys, vals, ranks = [], [], []
        at = lambda s: normal.get(s, self.size + ord(s) if len(s) == 1 else None)
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = at(p[:k]), at(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 21 | b)
                    vals.append(i)
                    ranks.append(scores[proto.pieces[i].score])
        key = np.array(keys, dtype=np.int64)
        bits = max(12, int(np.ceil(np.log2(max(len(key), 1) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, dtype=np.int64)
        self.value = np.zeros(1 << bits, dtype=np.int64)
        self.rank = np.full(1 << bits, NONE, dtype=np.int64)
        for k, v, r, h in zip(keys, vals, ranks, self._hash(key).tolist()):
            while self.table[h] != -1:
                h = (h + 1) & self.mask
            self.table[h], self.value[h], self.rank[h] = k, v, r

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The table slot of each pair; an empty slot (rank NONE) if it isn't a piece."""
        key = left << 21 | right
        at = self._hash(key)
        found = self.table[at]
        bad = np.flatnonzero((found != key) & (found != -1))
        while bad.size:
            at[bad] = (at[bad] + 1) & self.mask
            found = self.table[at[bad]]
            bad = bad[(found != key[bad]) & (found != -1)]
        return at

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode words (space marks in place): symbols of all words, and each word's count of them.

        A symbol below ``size`` is a piece id, otherwise an unknown character (size + code point).
        """
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        done_sym, done_word = [], []
        sym, word = self.char_id[code], np.repeat(np.arange(len(words)), length)
        slot = rank = None
        while sym.size:
            n = sym.size
            if slot is None:
                slot = np.zeros(n, dtype=np.int64)
                rank = np.full(n, NONE, dtype=np.int64)
                pairs = np.flatnonzero(word[1:] == word[:-1])
                slot[pairs] = self._look(sym[pairs], sym[pairs + 1])
                rank[pairs] = self.rank[slot[pairs]]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, n])
            going = least < NONE
            if not going.all():  # compaction: finished words leave
                keep = np.repeat(going, sizes)
                done_sym.append(sym[~keep])
                done_word.append(word[~keep])
                sym, word, slot, rank = sym[keep], word[keep], slot[keep], rank[keep]
                least, sizes = least[going], sizes[going]
                n = sym.size
                if not n:
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            hit = self._leftmost(hit)
            made = self.value[slot[hit]]
            hit, made = self._until_better(hit, made, sym, word, rank)
            alive = np.ones(n, dtype=bool)
            alive[hit + 1] = False
            sym[hit] = made
            place = np.cumsum(alive) - 1
            sym, word, slot, rank = sym[alive], word[alive], slot[alive], rank[alive]
            at = place[hit]
            renew = np.r_[at, at[at > 0] - 1]  # a pair that two merges touch is looked up twice, which is cheaper than sorting
            last = np.r_[word[1:] != word[:-1], True]
            rank[renew] = NONE
            renew = renew[~last[renew]]
            slot[renew] = self._look(sym[renew], sym[renew + 1])
            rank[renew] = self.rank[slot[renew]]
        all_sym = np.concatenate(done_sym) if done_sym else np.zeros(0, dtype=np.int64)
        all_word = np.concatenate(done_word) if done_word else np.zeros(0, dtype=np.int64)
        return all_sym[np.argsort(all_word, kind="stable")], np.bincount(all_word, minlength=len(words))

    @staticmethod
    def _leftmost(hit: np.ndarray) -> np.ndarray:
        """Of overlapping pairs (runs of neighbouring positions) every other one, from the left."""
        first = np.r_[True, np.diff(hit) != 1]
        run = np.maximum.accumulate(np.where(first, np.arange(hit.size), 0))
        return hit[(np.arange(hit.size) - run) % 2 == 0]

    def _until_better(self, hit, made, sym, word, rank):
        """Per word, hits up to and including the first whose merge makes a better pair."""
        w = word[hit]
        again = np.r_[False, w[1:] == w[:-1]]
        if not again.any():
            return hit, made
        several = again | np.r_[again[1:], False]
        i = np.flatnonzero(several)
        h, m, n = hit[i], made[i], sym.size
        best = np.full(i.size, NONE, dtype=np.int64)
        after = h + 2
        ok = np.flatnonzero((after < n) & (word[np.minimum(after, n - 1)] == word[h]))
        best[ok] = self.rank[self._look(m[ok], sym[after[ok]])]
        ok = np.flatnonzero((h > 0) & (word[h - 1] == word[h]))
        before = sym[h[ok] - 1]
        joined = np.flatnonzero((ok > 0) & (h[ok - 1] + 2 == h[ok]))  # the neighbour was merged just before
        before[joined] = m[ok[joined] - 1]
        best[ok] = np.minimum(best[ok], self.rank[self._look(before, m[ok])])
        better = np.zeros(hit.size, dtype=np.int64)
        better[i] = best < rank[h]
        stops = np.cumsum(better) - better  # better ones before this hit
        base = np.maximum.accumulate(np.where(again, 0, np.arange(hit.size)))
        keep = stops == stops[base]
        return hit[keep], made[keep]

    def flat_ids(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Piece ids of all words, and where each word's ids end; plain spaces stand for space marks."""
        sym, count = self.merge([w.replace(" ", SPACE) for w in words])
        ends = np.cumsum(count)
        is_unknown = sym >= self.size
        unknown = np.flatnonzero(is_unknown)
        if unknown.size:  # byte fallback
            made = [[self.byte_ids[b] for b in chr(s - self.size).encode("utf-8", "surrogatepass")] for s in sym[unknown].tolist()]
            width = np.ones(sym.size, dtype=np.int64)
            width[unknown] = [len(ids) for ids in made]
            upto = np.r_[0, np.cumsum(width)]
            sym = np.repeat(sym, width)
            sym[np.repeat(is_unknown, width)] = [i for ids in made for i in ids]
            ends = upto[ends]
        return sym.tolist(), ends.tolist()

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Piece ids of each word; plain spaces stand for space marks."""
        flat, ends = self.flat_ids(words)
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def split(self, text: str) -> list[str]:
        """Words of a whole text, the dummy prefix included; none for an empty text."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        return self.words.findall(" " + text if self.dummy_prefix else text)

    def encode(self, text: str) -> list[int]:
        """Ids of a text as the library's encode gives them, without begin and end ids."""
        return [i for ids in self.encode_words(self.split(text)) for i in ids]

    def decode(self, ids: list[int]) -> str:
        """The text of ids as the library's decode gives it; malformed bytes become U+FFFD, one each."""
        out = self.decode_bytes(ids)
        if self.dummy_prefix and out[:1] == b" " and not self.is_byte[self._first(ids)]:
            out = out[1:]
        return out.decode("utf-8", "replace")

    def _first(self, ids: list[int]) -> int:
        return next((i for i in ids if self.decoded[i]), ids[0])

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.decoded[i] for i in ids])


@lru_cache(maxsize=4)
def load_model(path: str) -> PieceModel:
    """The model of a path, loaded once per worker process."""
    return PieceModel(path)


class _Cached:
    """Encodings of words met before: (count, ids as text, bytes); bounded, and dropped as a whole when full."""

    def __init__(self, path: str):
        self.model = load_model(path)
        self.known: dict[str, tuple[int, str, bytes]] = {}
        self.chars = 0

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.known.clear()
            self.chars, new = 0, list(words)
        self.chars += sum(map(len, new))
        names, pieces = self.model.texts, self.model.decoded
        for start in range(0, len(new), MERGE_WORDS):
            part = new[start : start + MERGE_WORDS]
            flat, ends = self.model.flat_ids(part)
            text, data = [names[i] for i in flat], [pieces[i] for i in flat]
            for w, a, b in zip(part, [0, *ends], ends):
                self.known[w] = b - a, ",".join(text[a:b]), b"".join(data[a:b])


def _digest_kernel(path: str, with_ids: bool = False):
    def start():
        cache = _Cached(path)
        strip = cache.model.dummy_prefix

        def apply(texts: list) -> dict:
            words = [cache.model.split(t or "") for t in texts]
            cache.learn({w for ws in words for w in ws})
            known = cache.known
            n, ids, back, lists = [], [], [], []
            for w in words:
                counts, lines, made = zip(*[known[x] for x in w]) if w else ((), (), ())
                line, text = ",".join(lines), b"".join(made)
                n.append(sum(counts))
                ids.append(hashlib.sha256(line.encode()).hexdigest())
                back.append(hashlib.sha256(text[1:] if strip and text[:1] == b" " else text).hexdigest())
                if with_ids:
                    lists.append(np.fromstring(line, dtype=np.int32, sep=",") if line else np.zeros(0, dtype=np.int32))
            return {"n_tokens": n, "ids_sha256": ids, "decoded_sha256": back, "ids": lists}

        return apply

    return start


def _ids_kernel(path: str):
    def start():
        model = load_model(path)

        def apply(texts: list) -> dict:
            words = [model.split(t or "") for t in texts]
            flat = iter(model.encode_words([w for ws in words for w in ws]))
            ids = [[i for _ in ws for i in next(flat)] for ws in words]
            return {"ids": ids, "decoded": [model.decode(x) if x else "" for x in ids]}

        return apply

    return start


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every whole text.

    Null and empty texts give no ids and an empty string; repeated rows and keys stay as they
    are; an empty table gives an empty table; columns other than the two named are ignored.
    ``path`` must be readable by every worker.
    """
    return map_texts(df, [id_col], text_col, _ids_kernel(path), [("ids", "array<int>"), ("decoded", "string")], 1 << 20)


def encode_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]): the digests of :func:`encode_decode`.

    Words met before are not merged again within a worker. Edge cases as there: a null or
    empty text has 0 tokens and the digests of the empty string.
    """
    fields = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    fields += [("ids", "array<int>")] * with_ids
    return map_texts(df, [id_col], text_col, _digest_kernel(path, with_ids), fields, 1 << 20)
