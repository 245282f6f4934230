"""Operator 3: removal of 50-byte strings that an earlier document has, by suffix sorting.

A string of ``LENGTH`` bytes contains ``LENGTH - GRAM + 1`` substrings of
``GRAM`` bytes; the one of smallest hash (the leftmost of equals) is its anchor.
Equal strings have equal anchors at equal offsets, so only strings whose anchors
occur in several documents can repeat. The work goes in three rounds over
documents dealt into batches by a hash of their ids:

1. each batch sends the distinct hashes of its anchors; a bucket of hashes
   answers which of them several documents have;
2. each batch sends, for these, the distinct contexts around the anchor; a
   bucket sorts the suffixes that start there, by deep-shallow sorting to
   ``LENGTH`` bytes: multikey partition on 8-byte characters down to ``SHALLOW``
   bytes, then blind tries for groups that still differ further on. Neighbours
   in this order that share ``LENGTH`` bytes form a class, with its smallest id;
3. each batch learns which of its strings start in an earlier document, and
   removes the bytes that they cover.

Each round pre-aggregates within the batch, so a passage that a third of all
documents holds is sent once a batch. An anchor with very many contexts is hot:
its strings are dealt by their own hashes, one by one, and not to one bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U, give_back, mix, pair, partitions, powers, read

LENGTH = 50
#: Bytes of an anchor.
GRAM = 24
#: Bytes ordered by multikey partition; blind tries order what follows.
SHALLOW = 32
#: An anchor with more contexts than this, summed over the batches, is hot.
HOT = 4096
#: Parts of a bucket that are sorted one after another, to bound what is held at once.
PARTS = 64
#: Starts of strings treated in one numpy pass; a longer text is cut into pieces that overlap by a string less a byte.
CHUNK = 1 << 18
_MASK = U((1 << 28) - 1)
_NONE = np.iinfo(np.int64).max
with np.errstate(over="ignore"):
    _VALUES = mix((np.arange(256, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15))


def _views(column: pa.Array | pa.ChunkedArray):
    """The bytes of each chunk of a column without nulls and the bounds of its values, not copied."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        kind = np.int64 if pa.types.is_large_binary(chunk.type) else np.int32
        _, bounds, data = chunk.buffers()
        at = np.frombuffer(bounds, kind)[chunk.offset : chunk.offset + len(chunk) + 1] if len(chunk) else np.zeros(1, kind)
        yield np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), at.astype(np.int64)


def _runs(table: pa.Table):
    """The texts that have a string, in pieces, several side by side: bytes, sizes, number of the text, offset in it, id (a null one is the largest)."""
    ids = table["doc_id"].fill_null(_NONE).to_numpy()
    held, size, before = [], 0, 0

    def run():
        text = np.array([h[1] for h in held])
        return np.concatenate([h[0] for h in held]), np.array([len(h[0]) for h in held]), text, np.array([h[2] for h in held]), ids[text]

    for data, at in _views(table["text"]):
        for i in np.flatnonzero(np.diff(at) >= LENGTH).tolist():
            first, end = int(at[i]), int(at[i + 1])
            for s in range(first, end - LENGTH + 1, CHUNK):
                e = min(end, s + CHUNK + LENGTH - 1)
                held.append((data[s:e], before + i, s - first))
                size += e - s
                if size >= CHUNK:
                    yield run()
                    held, size = [], 0
        before += len(at) - 1
    if held:
        yield run()


class _Anchored:
    """Anchors of a run of pieces: for each, its hash, the range of starts of its strings, its document and its piece."""

    __slots__ = ("data", "key", "lo", "hi", "doc", "piece", "prefix", "down", "shift", "text")

    def __init__(self, data: np.ndarray, sizes: np.ndarray, text: np.ndarray, offset: np.ndarray, docs: np.ndarray):
        n = len(data)
        self.data, self.text, self.shift = data, text, offset - (np.cumsum(sizes) - sizes)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        with np.errstate(over="ignore"):
            up, self.down = powers(n + 1)
            self.prefix = np.zeros(n + 1, U)
            np.cumsum(_VALUES[data] * up[:n], out=self.prefix[1:])
        gram = self._hash(slice(0, n - GRAM + 1), slice(GRAM, n + 1))
        best = (gram & ~_MASK) | np.arange(len(gram), dtype=U)
        width, reach = LENGTH - GRAM + 1, 1
        while 2 * reach <= width:
            best = np.minimum(best[:-reach], best[reach:])
            reach *= 2
        if reach < width:
            best = np.minimum(best[: len(best) - (width - reach)], best[width - reach :])
        at = (best & _MASK).astype(np.int64)
        whole = owner[: len(at)] == owner[LENGTH - 1 :][: len(at)]
        step = (at[1:] != at[:-1]) | (owner[1 : len(at)] != owner[: len(at) - 1])
        new, last = whole.copy(), whole.copy()
        new[1:] &= step | ~whole[:-1]
        last[:-1] &= step | ~whole[1:]
        self.lo, self.hi = np.flatnonzero(new), np.flatnonzero(last)
        self.key = gram[at[self.lo]]
        self.piece = owner[self.lo]
        self.doc = docs[self.piece]

    def _hash(self, first, end) -> np.ndarray:
        """Hashes of byte ranges, the same wherever equal bytes lie."""
        with np.errstate(over="ignore"):
            return mix((self.prefix[end] - self.prefix[first]) * self.down[first])

    def windows(self, starts: np.ndarray) -> np.ndarray:
        """Hashes of the strings at some starts."""
        return self._hash(starts, starts + LENGTH)

    def contexts(self, i: np.ndarray) -> np.ndarray:
        """Hashes of some anchors' whole contexts, from the first to the last string."""
        with np.errstate(over="ignore"):
            return pair(pair(self.windows(self.lo[i]), self.windows(self.hi[i])), (self.hi[i] - self.lo[i]).astype(U))


def _least(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of distinct keys, in the order of the keys, each with its smallest document; how many different documents it has there."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    first = np.flatnonzero(new)
    step = np.concatenate(([True], new[1:] | (d[1:] != d[:-1]))).astype(np.int64)
    return order[first], docs[order[first]], np.add.reduceat(step, first)


def _gathered(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of some ranges, side by side."""
    ends = np.cumsum(size)
    return data[np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


_ROW = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary()), ("cuts", pa.binary())])
_ROW_SQL = "bucket int, batch int, kind int, keys binary, docs binary, sizes binary, data binary, cuts binary"


def _row(bucket: int, batch: int, kind: int, keys=b"", docs=b"", sizes=b"", data=b"", cuts=b"") -> dict:
    return {"bucket": bucket, "batch": batch, "kind": kind, "keys": bytes(keys), "docs": bytes(docs), "sizes": bytes(sizes), "data": bytes(data), "cuts": bytes(cuts)}


def _dealt(bucket: np.ndarray):
    """(bucket, places) of each bucket that has some; the places keep their order."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(cut, np.append(cut[1:], len(order)), strict=False):
        yield int(bucket[order[a]]), order[a:b]


def _column(table: pa.Table, name: str, kind) -> list[np.ndarray]:
    """Each binary value as an array, not copied."""
    return [x.view(kind) for data, at in _views(table[name]) for x in (data[at[i] : at[i + 1]] for i in range(len(at) - 1))]


def _anchor_rows(n: int):
    """Round 1, in a batch: the distinct hashes of its anchors, and how many contexts each has; 0 if only one document of the batch has it."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        batch, parts = int(key[0].as_py()), []
        for some in _runs(table):
            a = _Anchored(*some)
            parts.append((a.key, a.doc, a.contexts(slice(None))))
        rows = []
        if parts:
            every, docs, contexts = map(np.concatenate, zip(*parts, strict=True))
            del parts
            at, _, several = _least(every, docs)
            keys, times = every[at], np.zeros(len(at), np.uint16)
            often = several > 1
            if often.any():
                i = np.flatnonzero(often[np.searchsorted(keys, every)])
                at, _, different = _least(every[i], contexts[i])
                times[often] = np.minimum(different, 65535)
            del every, docs, contexts, several, often
            for bucket, i in _dealt(((keys >> U(32)) % U(n)).astype(np.int64)):
                rows.append(_row(bucket, batch, 0, keys[i].astype(np.uint32), sizes=times[i]))
        made = pa.Table.from_pylist(rows, schema=_ROW)
        del rows
        give_back()
        return made

    return run


def _shared_anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Round 1, in a bucket: for each batch the hashes that several documents have, the hot ones marked.

    A document is in one batch, so a hash that two batches have is in two documents.
    """
    parts = _column(table, "keys", np.uint32)
    times = np.concatenate(_column(table, "sizes", np.uint16)).astype(np.int64)
    distinct, back = np.unique(np.concatenate(parts), return_inverse=True)
    shared = ((np.bincount(back) > 1) | (np.bincount(back, times) > 0))[back]
    hot = (np.bincount(back, np.maximum(times, 1)) > HOT)[back]
    out, at, bucket = [], 0, int(key[0].as_py())
    for batch, p in zip(table["batch"].to_pylist(), parts, strict=True):
        here = slice(at, at + len(p))
        at += len(p)
        if shared[here].any():
            out.append(_row(bucket, batch, 1, p[shared[here]], sizes=hot[here][shared[here]].astype(np.uint8)))
    made = pa.Table.from_pylist(out, schema=_ROW)
    del out, distinct, back, shared, hot, times, parts
    give_back()
    return made


def _of_kind(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pa.array(np.asarray(table["kind"].to_numpy()) == kind))


def _known(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted marks (bucket, hash) of a batch's shared anchors, and which are hot."""
    rows = _of_kind(table, 1)
    marks = [(np.int64(b) << 32) | k.astype(np.int64) for b, k in zip(rows["bucket"].to_pylist(), _column(rows, "keys", np.uint32), strict=True)]
    if not marks:
        return np.empty(0, np.int64), np.empty(0, np.uint8)
    marks, hot = np.concatenate(marks), np.concatenate(_column(rows, "sizes", np.uint8))
    order = np.argsort(marks)
    return marks[order], hot[order]


def _look(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key among the sorted ones, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    i = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[i] == keys, i, -1)


def _strings(a: _Anchored, marks: np.ndarray, hot: np.ndarray, n: int):
    """Contexts of the anchors that are shared: first and last start, key, document, piece, hash to deal them by.

    A hot anchor has one context for each of its strings.
    """
    place = _look(marks, (((a.key >> U(32)) % U(n)).astype(np.int64) << 32) | (a.key & U(0xFFFFFFFF)).astype(np.int64))
    i = np.flatnonzero(place >= 0)
    is_hot = hot[place[i]].astype(bool)
    cold, warm = i[~is_hot], i[is_hot]
    many = a.hi[warm] - a.lo[warm] + 1
    starts = np.repeat(a.lo[warm], many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    one = a.windows(starts)
    with np.errstate(over="ignore"):
        single = pair(pair(one, one), np.zeros(len(starts), U))
    join = lambda x, y: np.concatenate((x, y))
    return join(a.lo[cold], starts), join(a.hi[cold], starts), join(a.contexts(cold), single), join(a.doc[cold], np.repeat(a.doc[warm], many)), join(a.piece[cold], np.repeat(a.piece[warm], many)), join(a.key[cold] >> U(32), single >> U(32))


def _context_rows(n: int):
    """Round 2, in a batch: the distinct contexts of its shared anchors, each with its smallest document."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        batch, rows = int(key[0].as_py()), []
        marks, hot = _known(right)
        parts = []
        for some in _runs(left) if len(marks) else ():
            a = _Anchored(*some)
            lo, hi, keys, docs, _, by = _strings(a, marks, hot, n)
            i, least, _ = _least(keys, docs)
            size = (hi - lo)[i]
            parts.append((keys[i], least, size.astype(np.uint8), by[i], _gathered(a.data, lo[i], size + LENGTH)))
        if parts:
            keys, docs, sizes, by, data = map(np.concatenate, zip(*parts, strict=True))
            del parts
            size = sizes.astype(np.int64) + LENGTH
            first = np.cumsum(size) - size
            i, docs, _ = _least(keys, docs)
            keys, sizes, size, first, by = keys[i], sizes[i], size[i], first[i], by[i]
            part = (by // U(n) % U(PARTS)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            for bucket, at in _dealt((by[order] % U(n)).astype(np.int64)):
                j = order[at]
                rows.append(_row(bucket, batch, 2, keys[j], docs[j], sizes[j], _gathered(data, first[j], size[j]), np.bincount(part[j], minlength=PARTS).astype(np.uint32)))
            del keys, docs, sizes, by, data, size, first, part, order
        made = pa.Table.from_pylist(rows, schema=_ROW)
        del rows
        give_back()
        return made

    return run


class BlindTrie:
    """Orders distinct strings of one length: a trie of branching depths, searched blindly and then checked at one leaf."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: int | list = 0  # a leaf is a string's number; a node is [depth, {byte: child}]
        for k in range(1, len(strings)):
            self._insert(k)

    def _insert(self, k: int) -> None:
        s, path, node = self.strings[k], [], self.root
        while isinstance(node, list):
            path.append(node)
            node = node[1].get(s[node[0]]) if s[node[0]] in node[1] else next(iter(node[1].values()))
        other = self.strings[node]
        depth = next((i for i, (x, y) in enumerate(zip(s, other, strict=True)) if x != y), len(s))
        if depth == len(s):
            raise ValueError("strings must be distinct")
        above = [p for p in path if p[0] < depth]
        under = path[len(above)] if len(above) < len(path) else node
        if isinstance(under, list) and under[0] == depth:
            under[1][s[depth]] = k
            return
        new = [depth, {other[depth]: under, s[depth]: k}]
        if above:
            above[-1][1][s[above[-1][0]]] = new
        else:
            self.root = new

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out.append(node)
        return out


def deep_shallow_sort(data: bytes, starts: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes of ``data`` at ``starts`` by their first ``length`` bytes, and the class number of each in that order.

    All suffixes must have ``length`` bytes; equal ones share a class and stay in input order.
    """
    raw = np.frombuffer(data + b"\0" * 64, np.uint8)
    n = len(starts)
    word = np.zeros(len(raw) - 8, U)
    for j in range(8):
        word |= raw[j : len(raw) - 8 + j].astype(U) << U(56 - 8 * j)
    order, group = np.arange(n), np.zeros(n, np.int64)
    todo = np.arange(n)  # places in the order whose groups have more than one suffix
    for depth in range(0, shallow, 8):
        if not len(todo):
            break
        w, g = word[starts[order[todo]] + depth], group[todo]
        o = np.lexsort((w, g)) if depth else np.argsort(w, kind="stable")
        order[todo], w, g = order[todo[o]], w[o], g[o]
        split = np.concatenate(([True], (w[1:] != w[:-1]) | (g[1:] != g[:-1])))
        group[todo] = todo[np.maximum.accumulate(np.where(split, np.arange(len(todo)), 0))]
        alone = split & np.concatenate((split[1:], [True]))
        todo = todo[~alone]
    if len(todo):
        g = group[todo]
        at = starts[order[todo]] + shallow
        tail = length - shallow
        mark = np.zeros(len(todo), U)
        with np.errstate(over="ignore"):
            for d in range(0, tail, 8):
                w = word[at + d]
                mark = pair(mark, w >> U(8 * max(0, 8 - (tail - d))))
        o = np.lexsort((mark, g))
        todo_order, mark, g = order[todo[o]], mark[o], g[o]
        leaf = np.concatenate(([True], (mark[1:] != mark[:-1]) | (g[1:] != g[:-1])))
        head = np.flatnonzero(leaf)
        number = np.cumsum(leaf) - 1
        place = np.arange(len(head))
        # groups with several different rests go through a blind trie
        cut = np.flatnonzero(np.diff(g[head], prepend=-1))
        count = np.diff(np.append(cut, len(head)))
        first = starts[todo_order[head]] + shallow
        for c, m in zip(cut[count > 1].tolist(), count[count > 1].tolist(), strict=True):
            trie = BlindTrie([data[f : f + tail] for f in first[c : c + m].tolist()])
            for r, k in enumerate(trie.order()):
                place[c + k] = c + r
        o = np.argsort(place[number], kind="stable")
        order[todo] = todo_order[o]
        leaf_of = place[number][o]
        new = np.concatenate(([True], leaf_of[1:] != leaf_of[:-1]))
        group[todo] = todo[np.maximum.accumulate(np.where(new, np.arange(len(todo)), 0))]
    return order, group


def _first_documents(keys: np.ndarray, docs: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some contexts: which distinct one each is, its smallest document, and as bits the strings that start in a still smaller one."""
    distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
    least = np.full(len(distinct), _NONE, np.int64)
    np.minimum.at(least, back, docs)
    ends = np.cumsum(sizes + LENGTH)
    lo = (ends - sizes - LENGTH)[first]
    many = sizes[first] + 1
    owner = np.repeat(np.arange(len(distinct)), many)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    order, group = deep_shallow_sort(data.tobytes(), lo[owner] + offset)
    class_least = np.full(len(owner), _NONE, np.int64)
    np.minimum.at(class_least, group, least[owner[order]])
    earliest = np.empty(len(owner), np.int64)
    earliest[order] = class_least[group]
    # each offset counts once, and there are 27 at most, so the sums are exact
    bits = np.bincount(owner, np.where(earliest < least[owner], np.int64(1) << offset, 0), len(distinct)).astype(np.int64)
    return back, least[back], bits[back]


def _earlier(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Round 2, in a bucket: for each batch, which strings of its contexts start in an earlier document; part by part."""
    keys, docs, sizes, data = _column(table, "keys", U), _column(table, "docs", np.int64), _column(table, "sizes", np.uint8), _column(table, "data", np.uint8)
    cuts = [np.concatenate(([0], np.cumsum(c.astype(np.int64)))) for c in _column(table, "cuts", np.uint32)]
    bytes_at = [np.concatenate(([0], np.cumsum(s.astype(np.int64) + LENGTH)))[c] for s, c in zip(sizes, cuts, strict=True)]
    found: list[list] = [[] for _ in keys]
    for part in range(PARTS):
        have = [(r, slice(c[part], c[part + 1]), slice(b[part], b[part + 1])) for r, (c, b) in enumerate(zip(cuts, bytes_at, strict=True)) if c[part] < c[part + 1]]
        if not have:
            continue
        doc = np.concatenate([docs[r][at] for r, at, _ in have])
        back, least, bits = _first_documents(np.concatenate([keys[r][at] for r, at, _ in have]), doc, np.concatenate([sizes[r][at] for r, at, _ in have]).astype(np.int64), np.concatenate([data[r][at] for r, _, at in have]))
        size = np.concatenate([sizes[r][at] for r, at, _ in have]).astype(np.int64)
        mask = np.where(doc > least, (np.int64(1) << (size + 1)) - 1, bits)
        end = 0
        for r, at, _ in have:
            end, begin = end + at.stop - at.start, end
            some = np.flatnonzero(mask[begin:end])
            if len(some):
                found[r].append((keys[r][at][some], mask[begin:end][some].astype(np.uint32)))
    bucket = int(key[0].as_py())
    out = [_row(bucket, batch, 3, np.concatenate([f[0] for f in mine]), np.concatenate([f[1] for f in mine])) for batch, mine in zip(table["batch"].to_pylist(), found, strict=True) if mine]
    made = pa.Table.from_pylist(out, schema=_ROW)
    del out, found, keys, docs, sizes, data, cuts, bytes_at
    give_back()
    return made


def _intervals(first: np.ndarray, end: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges in order, of which none holds another, those of one text that meet joined."""
    if not len(first):
        return first, end, text
    at = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (first[1:] > end[:-1]))))
    return first[at], end[np.append(at[1:], len(end)) - 1], text[at]


def _rest(text: np.ndarray, gone: list[tuple[int, int]], chars: bool) -> list[np.ndarray]:
    """What is left of a text; with ``chars`` without the characters that a cut breaks."""
    out, at = [], 0
    for first, end in [*gone, (len(text), len(text))]:
        a, b = at, first
        if chars:
            while a < b and at and text[a] & 0xC0 == 0x80:
                a += 1
            if first < len(text) and text[first] & 0xC0 == 0x80:
                while b > a and text[b - 1] & 0xC0 == 0x80:
                    b -= 1
                b = max(a, b - 1)
        out.append(text[a:b])
        at = end
    return out


def _removed(n: int, digest: bool, chars: bool):
    """Round 3, in a batch: the documents without the bytes that repeat."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        marks, hot = _known(right)
        rows = _of_kind(right, 3)
        mask_keys, mask_bits = ([np.empty(0, kind), *_column(rows, c, kind)] for c, kind in (("keys", U), ("docs", np.uint32)))
        mask_keys, mask_bits = np.concatenate(mask_keys), np.concatenate(mask_bits)
        order = np.argsort(mask_keys)
        mask_keys, mask_bits = mask_keys[order], mask_bits[order]
        parts = []
        for some in _runs(left) if len(marks) else ():
            a = _Anchored(*some)
            lo, hi, k, d, piece, _ = _strings(a, marks, hot, n)
            parts.append((k, d, (hi - lo).astype(np.uint8), a.text[piece].astype(np.int32), lo + a.shift[piece]))
        first = end = text = np.empty(0, np.int64)
        if parts:
            k, d, span, of, at = map(np.concatenate, zip(*parts, strict=True))
            del parts
            i, least, _ = _least(k, d)
            bits = np.zeros(len(k), np.uint32)
            place = _look(mask_keys, k)
            bits[place >= 0] = mask_bits[place[place >= 0]]
            later = d > least[_look(k[i], k)]
            bits[later] = ((np.uint64(1) << (span[later].astype(U) + U(1))) - U(1)).astype(np.uint32)
            some = np.flatnonzero(bits)
            order = some[np.lexsort((at[some], of[some]))]
            bits, of, at = bits[order], of[order].astype(np.int64), at[order]
            del k, d, span, place, later, order, least, i
            # strings of one context lie closer than their length, so a context removes from its first to its last marked one, gaps included
            low, high = np.zeros(len(bits), np.int64), np.zeros(len(bits), np.int64)
            for o in range(LENGTH - GRAM + 1):
                has = (bits >> np.uint32(o)) & np.uint32(1) == 1
                high[has] = o
                low[has & (bits & np.uint32((1 << o) - 1) == 0)] = o
            first, end, text = _intervals(at + low, at + high + LENGTH, of)
        texts = [data[bounds[i] : bounds[i + 1]] for data, bounds in _views(left["text"]) for i in range(len(bounds) - 1)]
        spans = np.bincount(text, minlength=len(texts)) if len(texts) else np.empty(0, np.int64)
        gone = np.bincount(text, end - first, len(texts)).astype(np.int64) if len(texts) else spans
        cut = np.concatenate(([0], np.cumsum(spans)))
        kept = []
        for i, t in enumerate(texts):
            mine = list(zip(first[cut[i] : cut[i + 1]].tolist(), end[cut[i] : cut[i + 1]].tolist(), strict=True))
            rest = _rest(t, mine, chars)
            if digest:
                h = hashlib.sha256()
                for r in rest:
                    h.update(r)
                kept.append(h.digest())
            else:
                kept.append(rest[0].tobytes() if len(rest) == 1 else np.concatenate(rest).tobytes())
        sizes = np.array([len(t) for t in texts], np.int64)
        made = pa.Table.from_arrays([left["row"], pa.array(sizes), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["row", "n_bytes", "n_removed", "n_spans", "kept"])
        del kept, texts
        give_back()
        return made

    return run


def remove_repeats(docs: DataFrame, text: str = "text", digest: bool = False, chars: bool = False) -> DataFrame:
    """``row`` (the other columns of ``docs``, as a struct), n_bytes, n_removed, n_spans and kept of every row.

    ``kept`` has the remaining bytes, or their SHA-256 if ``digest``; with ``chars`` a character that a cut breaks
    is left out. Null and empty texts have no bytes; texts under ``LENGTH`` bytes keep all. A repeated string stays
    in every row with the smallest id that has it, so rows that share that id keep it; a null id counts as larger
    than any other. Texts may be of any length; matches never cross documents. Extra columns may have any names.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rest = F.struct(*[docs[c] for c in docs.columns if c != text])
    batch = F.pmod(F.xxhash64(docs["doc_id"]), F.lit(n)).cast("int")
    source = docs.select(batch.alias("batch"), docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("binary"), F.lit(b"")).alias("text"), rest.alias("row"))
    dealt = source.repartition(n, "batch")
    out = T.StructType([dealt.schema["row"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    anchors = dealt.groupBy("batch").applyInArrow(_anchor_rows(n), _ROW_SQL)
    shared = anchors.groupBy("bucket").applyInArrow(_shared_anchors, _ROW_SQL).repartition(n, "batch")
    contexts = dealt.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(_context_rows(n), _ROW_SQL)
    # all three rounds read the same exchange of whole rows, so it is written once
    earlier = contexts.groupBy("bucket").applyInArrow(_earlier, _ROW_SQL).repartition(n, "batch")
    return dealt.groupBy("batch").cogroup(shared.unionByName(earlier).groupBy("batch")).applyInArrow(_removed(n, digest, chars), out)


def without_repeats(docs: DataFrame) -> DataFrame:
    """Pipeline stage: every document with its columns, the text without the bytes that an earlier document has.

    A character broken by a cut is left out; other characters stay as they are. ``n_chars``, if there, follows the
    text; a null text stays null, with its ``n_chars``. Repeated rows are all kept; an empty table gives an empty one.
    """
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("own"), docs["doc_id"], docs["text"], docs["text"].isNull().alias("missing"))
    cut = remove_repeats(whole, chars=True)
    clean = F.when(~F.col("row.missing"), F.col("kept").cast("string"))
    made = {"text": clean, "n_chars": F.when(~F.col("row.missing"), F.length(clean)).otherwise(F.col("row.own").getField("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": clean}
    return cut.select(*[made[c].alias(c) if c in made else F.col("row.own").getField(c).alias(c) for c in docs.columns])


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"), digest=True)
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))
