"""Operator 4: byte-pair encoding and decoding by speculation and verification.

For each distinct word, greedy longest match proposes tokens. Over a batch of
words, every adjacent pair of proposed tokens is looked up at once in a table of
compatible pairs: a pair is compatible if merging the two tokens' symbols gives
back these two tokens. A sequence whose tokens are all stable (each alone merges
to itself) and whose neighbours are all compatible is the one that exact merging
gives; only words that fail the check are merged exactly.

Words come from the tokenizer's own rules. A plain path covers texts of common
Latin characters; any other text is split by the library's normaliser and
pre-tokeniser, so no rule is approximated. Words that need exact
merging are merged side by side in one matrix: each round merges the best pair
of every row.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import giving_back, read, slices

#: Words, and letters of them, that a worker remembers, and as many from before them; beyond it the older ones are forgotten.
MAX_CACHE, MAX_LETTERS = 120_000, 3_000_000
END = "</w>"
#: Words of up to so many letters are merged side by side, by classes of length; so many at once.
WIDTHS = (4, 8, 12, 16, 24, 32, 48)
SIDE_BY_SIDE = 16_384
#: Longer words are merged with a heap.
LONG_WORD = 256
#: The rank of a pair that never merges.
NEVER = 1 << 62
#: Texts of these characters alone take the plain path (checked one by one in the tests).
_PLAIN = "\t\n\r\x20-\x7e\xa0-ſ‐-‧‰-⁞€"


def _byte_letters() -> list[str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on, in order."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def as_bytes(ids) -> bytes:
    """Ids as 32-bit little-endian numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class WordBPE:
    """Encoder and decoder for a tokenizer file with word ends (``</w>``), lower case and byte-level letters."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        if max(self.vocab.values()) > 0xFFFF:
            raise ValueError("token ids must fit 16 bits")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        self.ranks: dict[int, int] = {}  # a pair as one integer: its rank, then the merged token
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            if a in self.vocab and b in self.vocab and a + b in self.vocab:
                self.ranks[self.vocab[a] << 16 | self.vocab[b]] = rank << 16 | self.vocab[a + b]
        self.longest = max(map(len, self.vocab))
        self.letters = _byte_letters()
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        chars = [chr(c) for lo, hi in ((9, 10), (13, 13), (32, 126), (0xA0, 0x17F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC)) for c in range(lo, hi + 1)]
        kinds: dict[str, str] = {"L": "", "N": "", " ": ""}
        for c in chars:
            kind = " " if c.isspace() else unicodedata.category(c)[0]
            if kind in kinds:
                kinds[kind] += re.escape(c)
        self.plain = re.compile(f"[{_PLAIN}]*")
        self.words = re.compile(f"[{kinds['L']}]+|'s|'t|'re|'ve|'m|'ll|'d|[{kinds['N']}]|[^{kinds[' ']}{kinds['L']}{kinds['N']}]+")
        self.known: dict[int, bool] = {}  # pairs of tokens, as one integer: compatible?
        self.stable = np.full(max(self.names) + 1, -1, np.int8)
        self.memory = Memory()
        self.speculated = self.merged = 0
        keys = np.array(sorted(self.ranks), np.int64)
        self.pairs, self.order = self._hashed(keys, np.array([self.ranks[k] >> 16 for k in keys.tolist()], np.int64))
        self.made = np.zeros(max((r >> 16 for r in self.ranks.values()), default=0) + 1, np.int32)
        for r in self.ranks.values():
            self.made[r >> 16] = r & 0xFFFF
        self.inner, self.last = (np.array([self.vocab.get(chr(c) + end, -1) for c in range(max(map(ord, self.letters)) + 1)], np.int32) for end in ("", END))

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)).astype(np.int64)

    def _hashed(self, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An open table of keys and values; a key lies in its slot or soon after it."""
        table, out = np.full((1 << 18) + len(keys), -1, np.int64), np.full((1 << 18) + len(keys), NEVER, np.int64)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[table[slot[todo]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            free = free[first]
            table[slot[free]], out[slot[free]] = keys[free], values[free]
            todo = todo[table[slot[todo]] != keys[todo]]
            slot[todo] += 1
        return table, out

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, ``NEVER`` if it doesn't merge; negative tokens never do."""
        keys = (a.astype(np.int64) << 16) | b
        slot = self._slot(keys)
        out = np.full(len(keys), NEVER, np.int64)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        while len(todo):
            there = self.pairs[slot[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.order[slot[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
            slot[todo] += 1
        return out

    def merge_all(self, words: list[str]) -> list[bytes]:
        """Each word by exact merging, words of like length side by side; ids as 32-bit little-endian numbers."""
        out: list = [None] * len(words)
        spelled = [w if w.isascii() and w[0] != "\0" else self.spelled(w) for w in words]
        sizes = np.array([len(s) for s in spelled], np.int64)
        low = 0
        for width in WIDTHS:
            mine = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for k in range(0, len(mine), SIDE_BY_SIDE):
                some = mine[k : k + SIDE_BY_SIDE]
                self._side_by_side([spelled[i] for i in some.tolist()], sizes[some], width, some, out)
        return [as_bytes(self.merge(self.symbols(w))) if x is None else x for w, x in zip(words, out, strict=True)]

    def _side_by_side(self, spelled: list[str], sizes: np.ndarray, width: int, place: np.ndarray, out: list) -> None:
        """Puts the tokens of words of at most ``width`` letters into ``out``; leaves words with an unknown letter."""
        n, columns = len(spelled), np.arange(width)
        codes = np.frombuffer("".join(spelled).encode("utf-32-le"), "<u4")
        ids = np.full((n, width + 1), -1, np.int32)
        inside = columns < sizes[:, None]
        # a letter beyond the alphabet is as unknown as one that the vocabulary lacks
        ids[:, :width][inside] = np.where(codes < len(self.inner), self.inner[np.minimum(codes, len(self.inner) - 1)], -1)
        ends = codes[np.cumsum(sizes) - 1]
        ids[np.arange(n), sizes - 1] = np.where(ends < len(self.last), self.last[np.minimum(ends, len(self.last) - 1)], -1)
        good = ((ids[:, :width] >= 0) == inside).all(1)
        ids, place, sizes = ids[good], place[good], sizes[good].copy()
        best = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), width)
        while len(ids):
            at = best.argmin(1)
            row = np.arange(len(ids))
            rank = best[row, at]
            done = rank == NEVER
            if done.any():
                whole, each = ids[done].astype("<i4").tobytes(), 4 * (width + 1)
                for p, k, m in zip(place[done].tolist(), range(0, len(whole), each), sizes[done].tolist(), strict=True):
                    out[p] = whole[k : k + 4 * m]
                left = ~done
                ids, best, place, sizes, at, rank = ids[left], best[left], place[left], sizes[left], at[left], rank[left]
                row = row[: len(ids)]
                if not len(ids):
                    break
            token = self.made[rank]
            after = columns + (columns > at[:, None])
            # all that stands right of the merged pair moves one place to the left
            ids[:, :width] = np.take_along_axis(ids, after, 1)
            ids[row, at] = token
            best = np.take_along_axis(np.concatenate((best, np.full((len(best), 1), NEVER)), 1), after, 1)
            best[row, at] = self.rank(token, ids[row, at + 1])
            some = np.flatnonzero(at)
            best[some, at[some] - 1] = self.rank(ids[some, at[some] - 1], token[some])
            sizes -= 1

    def pretokens(self, text: str) -> list[str]:
        """The words of a text without special tokens, before the byte alphabet on the plain path, marked by a leading NUL after it."""
        if self.plain.fullmatch(text) and "İ" not in text and unicodedata.is_normalized("NFC", text):
            return self.words.findall(text.lower())
        lib = self.library
        return ["\0" + w for w, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))]

    def spelled(self, word: str) -> str:
        """A word in byte-level letters."""
        if word[0] == "\0":
            return word[1:]
        return word if word.isascii() else "".join([self.letters[b] for b in word.encode()])

    def symbols(self, word: str) -> list[int]:
        s = self.spelled(word)
        try:
            out = [self.vocab[c] for c in s]
            out[-1] = self.vocab[s[-1] + END]
            return out
        except KeyError:
            out = [self.vocab.get(c) for c in s[:-1]] + [self.vocab.get(s[-1] + END)]
            return [x for x in out if x is not None]

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: the pair of lowest rank first, the leftmost of equals."""
        get = self.ranks.get
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        ids = list(ids)
        todo = [get(a << 16 | b, NEVER) for a, b in zip(ids, ids[1:])]  # noqa: B905
        n = len(todo)
        while n:
            best = min(todo)
            if best == NEVER:
                break
            i = todo.index(best)
            t = ids[i] = best & 0xFFFF
            n -= 1
            del ids[i + 1], todo[i]
            if i:
                todo[i - 1] = get(ids[i - 1] << 16 | t, NEVER)
            if i < n:
                todo[i] = get(t << 16 | ids[i + 1], NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and a linked list, for words of thousands of letters."""
        n, get = len(ids), self.ranks.get
        ids, after, before = [*ids], list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 16 | ids[i + 1], NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or get(ids[i] << 16 | ids[j], NEVER) != r:
                continue
            ids[i], ids[j], after[i] = r & 0xFFFF, None, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := get(ids[k] << 16 | ids[after[k]], NEVER)) != NEVER:
                    heapq.heappush(heap, (r, k))
        return [x for x in ids if x is not None]

    def _split(self, token: int) -> list[int]:
        name = self.names[token]
        end = name.endswith(END)
        s = name[: -len(END)] if end else name
        return [self.vocab[c] for c in (s[:-1] if end else s)] + ([self.vocab[s[-1] + END]] if end else [])

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match; None if some letter is not in the vocabulary."""
        s = self.spelled(word)
        vocab, n, out, i = self.vocab, len(s), [], 0
        while i < n:
            got = vocab.get(s[i:] + END) if n - i < self.longest else None
            if got is not None:
                out.append(got)
                break
            for j in range(min(n - 1, i + self.longest), i, -1):
                got = vocab.get(s[i:j])
                if got is not None:
                    break
            else:
                return None
            out.append(got)
            i = j
        return out

    def verified(self, words: list[str]) -> list[list[int]]:
        """The ids of words: proposed, checked all at once, and merged exactly where the check fails."""
        made = [self.propose(w) for w in words]
        sizes = np.array([len(m) if m else 0 for m in made], np.int64)
        flat = np.array([t for m in made if m for t in m], np.int64)
        owner = np.repeat(np.arange(len(made)), sizes)
        for t in np.unique(flat[self.stable[flat] < 0]):
            self.stable[t] = self.merge(self._split(int(t))) == [t]
        bad = np.array([m is None for m in made], bool)
        bad[owner[self.stable[flat] == 0]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        distinct, back = np.unique((flat[inner] << 32) | flat[inner + 1], return_inverse=True)
        fits = np.empty(len(distinct), bool)
        if len(self.known) > 4 * MAX_CACHE:
            self.known.clear()
        for k, key in enumerate(distinct.tolist()):
            ok = self.known.get(key)
            if ok is None:
                a, b = key >> 32, key & 0xFFFFFFFF
                ok = self.known[key] = self.merge(self._split(a) + self._split(b)) == [a, b]
            fits[k] = ok
        bad[owner[inner[~fits[back]]]] = True
        failed = np.flatnonzero(bad).tolist()
        for i, ids in zip(failed, self.merge_all([words[i] for i in failed]), strict=True):
            made[i] = np.frombuffer(ids, "<i4").tolist()
        self.speculated += len(words)
        self.merged += len(failed)
        return made

    def exact(self, word: str) -> list[int]:
        """One word by exact merging alone."""
        return self.merge(self.symbols(word))

    def parts(self, text: str | None) -> list[list[str] | int]:
        """Lists of words, and ids of special tokens between them."""
        if not text:
            return []
        pieces = self.split_special.split(text) if self.split_special and "<|" in text else [text]
        return [self.special[p] if k % 2 else self.pretokens(p) for k, p in enumerate(pieces) if p]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.parts(t) for t in texts]
        of = self.memory.of(split, self.verified)
        return [[i for p in parts for i in ([p] if isinstance(p, int) else [t for w in p for t in of[w]])] for parts in split]

    def decode(self, ids: list[int]) -> str:
        """The library's decoding without a decoder: the tokens' names with blanks between; unknown ids are skipped."""
        return " ".join([self.names[i] for i in ids if i in self.names])


class Memory:
    """What was made of late for words, within ``MAX_CACHE`` words and ``MAX_LETTERS`` letters, those of one lot of texts aside."""

    def __init__(self):
        self.new, self.old, self.letters = {}, {}, 0

    def of(self, split: list[list], make) -> dict:
        """A dictionary with all words of some split texts; ``make`` gives what is to be held for a list of words."""
        if len(self.new) > MAX_CACHE or self.letters > MAX_LETTERS:
            self.new, self.old, self.letters = {}, self.new, 0
        wanted: set[str] = set()
        for parts in split:
            for p in parts:
                if not isinstance(p, int):
                    wanted.update(p)
        wanted.difference_update(self.new)
        again = wanted.intersection(self.old)
        self.new.update((w, self.old[w]) for w in again)
        wanted.difference_update(again)
        words = list(wanted)
        self.new.update(zip(words, make(words), strict=True))
        self.letters += sum(map(len, words)) + sum(map(len, again))
        return self.new


_LOADED: dict[str, WordBPE] = {}


def loaded(path: str) -> WordBPE:
    """The tokenizer of a file, made once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
        # the tables stay, and what is made later has no cycles
        gc.freeze()
        gc.set_threshold(100_000, 50, 100)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row's whole ``text``.

    Null and empty texts have no tokens (the hashes of the empty string). Repeated rows are kept. Other columns
    are not read.
    """

    def run(batches):
        bpe = loaded(path or default_path())
        digits: dict[int, bytes] = {i: b"%d" % i for i in bpe.names}
        names = {i: n.encode() for i, n in bpe.names.items()}
        shown = lambda t: (len(t), b" ".join([digits[i] for i in t]), b" ".join([names[i] for i in t]))
        memory = Memory()
        for batch in slices(batches, most=1 << 20):
            out: list[tuple[int, str, str]] = []
            split = [bpe.parts(t) for t in batch["text"].to_pylist()]
            of = memory.of(split, lambda words: map(shown, bpe.verified(words)))
            for parts in split:
                found = [s for p in parts for s in ([shown([p])] if isinstance(p, int) else map(of.__getitem__, p)) if s[0]]
                out.append((sum([s[0] for s in found]), hashlib.sha256(b" ".join([s[1] for s in found])).hexdigest(), hashlib.sha256(b" ".join([s[2] for s in found])).hexdigest()))
            del split
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_decode(read(spark, sf_dir, "documents", "doc_id", "text"))
