"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each prefix of a piece there is exactly one token that can end the prefix's encoding: the token whose left
neighbour, the last token of the shorter prefix, stays apart from it under the merges. Storing that token for
every prefix makes appending exact (only new positions are computed) and lets an edit keep all positions before
it and reuse those after it once the tables agree again. A pair of tokens stays apart if merging their joined
bytes gives back the same two tokens.

PrefixTable holds one piece. PrefixColumns computes the tables of many short pieces together, one prefix length after the
other: from all pieces' tokens at a length, the tokens that may follow are walked down a trie of the vocabulary.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of texts whose tokens a Python worker remembers before it starts anew, and the characters of these parts (a text
#: without spaces is one part); together they bound its memory at about 300 MB besides the texts at hand.
PARTS_KEPT, CHARS_KEPT = 1_000_000, 20_000_000
#: Characters of whole texts that are encoded together.
BATCH_CHARS = 4_000_000
PAIRS_KEPT = 2_000_000
#: The code points with the White_Space property, as a class of the re module.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_AFTER_SPACE = "(?:^|[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]) "
SPACE_AFTER_OTHER = re.compile(f"(?<=[^{SPACE}]) ").split


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks of a byte-level vocabulary, with the pair test that the prefix tables need."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            self.by_id[v] = k
        self.longest = max(map(len, ranks), default=1)
        #: every suffix of a token -> the token that it is, or -1
        self.suffixes = {k[n:]: -1 for k in ranks for n in range(1, len(k))} | ranks
        self.apart: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """The merges themselves, lowest rank first and leftmost among equals; used on the bytes of one or two tokens."""
        parts, get, none = [data[i : i + 1] for i in range(len(data))], self.ranks.get, len(self.by_id)
        beside = [get(x + y, none) for x, y in zip(parts[:-1], parts[1:], strict=True)]  # the rank of each two neighbours
        while beside and (best := min(beside)) < none:
            i = beside.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del beside[i]
            if i:
                beside[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(beside):
                beside[i] = get(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def stands(self, token: int) -> bool:
        """Whether merging a token's own bytes gives the token."""
        got = self.alone.get(token)
        if got is None:
            got = self.alone[token] = self.merge(self.by_id[token]) == [token]
        return got

    def stays_apart(self, left: int, right: int) -> bool:
        key = left << 32 | right
        got = self.apart.get(key)
        if got is None:
            if len(self.apart) > PAIRS_KEPT:
                self.apart.clear()
            got = self.apart[key] = self.merge(self.by_id[left] + self.by_id[right]) == [left, right]
        return got


class PrefixTable:
    """The last token of every prefix of one piece: append, replace and read the encoding off the end."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [0]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Only the prefixes that end in the new bytes are computed."""
        done = len(self.data)
        self.data = data = self.data + more
        last, get, v = self.last, self.v.suffixes.get, self.v
        apart = v.apart.get
        for end in range(done + 1, len(data) + 1):
            for start in range(end - 1, -1, -1):
                token = get(data[start:end])
                if token is None:
                    raise ValueError("no token ends here")
                if token >= 0:
                    if start:
                        fits = apart(last[start] << 32 | token)
                        if fits is None:
                            fits = v.stays_apart(last[start], token)
                    else:
                        fits = v.stands(token)
                    if fits:
                        last.append(token)
                        break

    def become(self, data: bytes) -> None:
        """Go over to other bytes, keeping the prefixes that both share."""
        old, n = self.data, 0
        for n, (x, y) in enumerate(zip(old, data)):  # noqa: B007
            if x != y:
                break
        else:
            n = min(len(old), len(data))
        self.data, self.last = data[:n], self.last[: n + 1]
        self.append(data[n:])

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Replace data[start:stop]; returns how many positions were computed anew."""
        old, shift = self.last, len(new) - (stop - start)
        tail = self.data[stop:]
        self.data, self.last = self.data[:start], old[: start + 1]
        agree, at, reach = 0, start + len(new), self.v.longest
        self.append(new)
        for k in range(0, len(tail), reach):
            part = tail[k : k + reach]
            self.append(part)
            for end in range(at + k + 1, at + k + len(part) + 1):
                # as many equal tokens as the longest token has bytes, all wholly behind the edit, fix what follows
                agree = agree + 1 if end - at >= reach and self.last[end] == old[end - shift] else 0
            if agree >= reach:
                rest = tail[k + len(part) :]
                computed = len(self.data) - start
                self.data += rest
                self.last += old[len(old) - len(rest) :] if rest else []
                return computed
        return len(self.data) - start

    def tokens(self) -> list[int]:
        out, end, size = [], len(self.data), self.v.by_id
        while end:
            token = self.last[end]
            out.append(token)
            end -= len(size[token])
        return out[::-1]


class IntTable:
    """Numbers (0 or more) under 64-bit keys (0 or more), looked up for whole arrays; open addressing with linear probes."""

    def __init__(self, bits: int = 10):
        self.used, self.bits = 0, bits
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for keys that aren't there."""
        slot = self._slots(keys)
        there = self.keys[slot]
        hit = there == keys
        out = np.where(hit, self.values[slot], -1)
        at = np.flatnonzero(~hit & (there >= 0))
        slot, mask = slot[at], (1 << self.bits) - 1
        while len(at):
            slot = (slot + 1) & mask
            there = self.keys[slot]
            hit = there == keys[at]
            out[at[hit]] = self.values[slot[hit]]
            go = ~hit & (there >= 0)
            at, slot = at[go], slot[go]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't there yet."""
        if (self.used + len(keys)) * 3 > len(self.keys):
            old = self.keys >= 0
            k, v = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            while len(k) * 4 > 1 << self.bits:
                self.bits += 1
            self.keys, self.values, self.used = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32), 0
            return self.put(k, v)
        self.used += len(keys)
        slot, mask = self._slots(keys), (1 << self.bits) - 1
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] < 0
            self.keys[slot[left[free]]] = keys[left[free]]  # of several for one slot, the last stays
            done = self.keys[slot[left]] == keys[left]
            self.values[slot[left[done]]] = values[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) & mask


class PrefixColumns:
    """The prefix tables of many pieces at once."""

    #: Bytes of a piece that goes through here, at most, and cells of a table.
    LONGEST, CELLS = 32, 1 << 21

    def __init__(self, v: Vocabulary):
        self.v = v
        nodes: dict[bytes, int] = {b"": 0}
        for token in v.ranks:
            for n in range(1, len(token) + 1):
                nodes.setdefault(token[:n], len(nodes))
        self.token = np.full(len(nodes), -1, np.int32)
        keys, values = np.empty(len(nodes) - 1, np.int64), np.empty(len(nodes) - 1, np.int32)
        for k, (prefix, node) in enumerate(nodes.items()):
            if k:
                keys[k - 1], values[k - 1] = nodes[prefix[:-1]] << 8 | prefix[-1], node
            self.token[node] = v.ranks.get(prefix, -1)
        self.edges, self.pairs = IntTable(), IntTable()
        self.edges.put(keys, values)
        self.size = np.array([len(b) for b in v.by_id], np.int64)

    def fits(self, left: np.ndarray | None, right: np.ndarray) -> np.ndarray:
        """Whether each token may follow the one to its left, or start a piece (left is None)."""
        if self.pairs.used > PAIRS_KEPT:
            self.pairs = IntTable()
        keys = right.astype(np.int64) + 1 if left is None else (left.astype(np.int64) + 1) << 32 | (right.astype(np.int64) + 1)
        got = self.pairs.get(keys)
        new = np.unique(keys[got < 0])
        if len(new):
            v, mask = self.v, (1 << 32) - 1
            said = [v.merge(v.by_id[a - 1] + v.by_id[b - 1]) == [a - 1, b - 1] if a else v.stands(b - 1) for a, b in ((k >> 32, k & mask) for k in new.tolist())]
            self.pairs.put(new, np.array(said, np.int32))
            got = self.pairs.get(keys)
        return got == 1

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, count): the tokens of all pieces, and where each piece's are."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(size, kind="stable")
        count, flat, i = np.zeros(len(pieces), np.int64), [], 0
        while i < len(order):
            n = 1
            while i + n < len(order) and (n + 1) * (size[order[i + n]] + 1) <= self.CELLS:
                n = min(2 * n, len(order) - i)
            while n > 1 and n * (size[order[i + n - 1]] + 1) > self.CELLS:
                n -= -(-n // 8)
            group = order[i : i + n]
            ids, count[group] = self._columns([pieces[k] for k in group.tolist()], size[group])
            flat.append(ids)
            i += n
        start = np.empty(len(pieces), np.int64)
        start[order] = np.cumsum(count[order]) - count[order]
        return np.concatenate([np.empty(0, np.int32), *flat]), start, count

    def _columns(self, pieces: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces in order of their sizes. last[e] has the last token of every piece's prefix of e bytes."""
        n, longest = len(pieces), int(size[-1]) if len(size) else 0
        data = np.frombuffer(b"".join(p.ljust(longest, b"\0") for p in pieces), np.uint8).reshape(n, longest).T.copy()
        # pieces of at least e bytes are those from first[e] on
        first = np.searchsorted(size, np.arange(longest + 2))
        last = np.full((longest + 1, n), -1, np.int32)
        for s in range(longest):
            row = np.arange(first[s + 1], n)
            left = last[s, row] if s else None
            node = np.zeros(len(row), np.int32)
            for e in range(s + 1, longest + 1):
                if first[e] > first[s + 1]:
                    here = row >= first[e]
                    row, node, left = row[here], node[here], left[here] if s else None
                node = self.edges.get(node.astype(np.int64) << 8 | data[e - 1, row])
                here = node >= 0
                row, node, left = row[here], node[here], left[here] if s else None
                if not len(row):
                    break
                token = self.token[node]
                some = np.flatnonzero(token >= 0)
                ok = some[self.fits(left[some] if s else None, token[some])]
                last[e, row[ok]] = token[ok]
        ends = np.zeros((n, longest + 1), bool)
        row, at = np.flatnonzero(size > 0), size[size > 0].copy()
        while len(row):
            token = last[at, row]
            if (token < 0).any():
                raise ValueError("no token ends here")
            ends[row, at] = True
            at -= self.size[token]
            row, at = row[at > 0], at[at > 0]
        return last.T[ends], ends.sum(axis=1)


class _Parts:
    """What stands between two spaces -> its number; the tokens of all numbered parts lie one after the other in ids.

    Under the pattern of public_tokenizers a space after a character that isn't white space always starts a new match, so a
    text is cut there first and the pattern runs once for each distinct part. lead is the space before the part, or nothing
    for a text's first. Under any other pattern a part is a whole text.
    """

    def __init__(self, columns: PrefixColumns, findall, lead: str):
        self.columns, self.findall, self.lead = columns, findall, lead
        self.empty()

    def empty(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.ids, self.start, self.count = array("i"), array("q"), array("q")

    def add(self, parts: list[str]) -> None:
        """Distinct parts that are new."""
        self.chars += sum(map(len, parts))
        plain = [p for p in parts if p.split() == [p]] if self.lead else []
        if len(plain) < len(parts):
            known = set(plain)
            parts = plain + [p for p in parts if p not in known]
        # no white space within: of the pieces of all together, those with the lead start a part
        pieces = self.findall(self.lead + self.lead.join(plain)) if plain else []
        first = np.flatnonzero(np.fromiter((p[0] == " " for p in pieces), bool, len(pieces)))
        cut = [self.findall(self.lead + p) for p in parts[len(plain) :]]
        first = np.concatenate([first, len(pieces) + np.cumsum([0, *map(len, cut)])])
        pieces += chain.from_iterable(cut)
        kinds: dict[str, int] = {}
        kind = np.fromiter((kinds.setdefault(p, len(kinds)) for p in pieces), np.int64, len(pieces))
        ids, start, count = encode_pieces(self.columns, [p.encode("utf-8", "surrogatepass") for p in kinds])
        before = len(self.ids)
        self.ids.frombytes(_gather(ids, start[kind], count[kind]).tobytes() if len(kind) else b"")
        ends = np.concatenate([[0], np.cumsum(count[kind])])[first]
        self.start.frombytes((before + ends[:-1]).astype(np.int64).tobytes())
        self.count.frombytes(np.diff(ends).astype(np.int64).tobytes())
        self.number.update(zip(parts, range(len(self.number), len(self.number) + len(parts)), strict=True))

    def numbers(self, parts: list[str]) -> np.ndarray:
        """The numbers of parts; those that are new are encoded together."""
        if len(self.number) > PARTS_KEPT or self.chars > CHARS_KEPT:
            self.empty()
        get = self.number.get
        found = np.fromiter(map(get, parts, repeat(-1)), np.int64, len(parts))
        gap = np.flatnonzero(found < 0)
        if len(gap):
            self.add(list(dict.fromkeys(parts[i] for i in gap.tolist())))
            found[gap] = [get(parts[i]) for i in gap.tolist()]
        return found

    def tokens(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, count of each)."""
        count = np.frombuffer(self.count, np.int64)[numbers]
        return (_gather(np.frombuffer(self.ids, np.int32), np.frombuffer(self.start, np.int64)[numbers], count) if len(numbers) else np.empty(0, np.int32)), count


def encode_pieces(columns: PrefixColumns, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, start, count) of distinct pieces. A piece that is itself a token is that token; short ones go through their
    prefix tables together, and long ones through one table in sorted order, so that each costs only the bytes in which it
    differs from the one before."""
    ranks, alone = columns.v.ranks, np.empty(len(pieces), np.int64)
    alone[:] = [ranks.get(p, -1) for p in pieces]
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    whole, short = np.flatnonzero(alone >= 0), np.flatnonzero((alone < 0) & (size <= columns.LONGEST))
    start, count = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
    start[whole], count[whole] = np.arange(len(whole)), 1
    ids, at, n = columns.encode([pieces[i] for i in short.tolist()])
    start[short], count[short] = at + len(whole), n
    out, end, table = [alone[whole].astype(np.int32), ids], len(whole) + len(ids), PrefixTable(columns.v)
    for i in sorted(np.flatnonzero((alone < 0) & (size > columns.LONGEST)).tolist(), key=pieces.__getitem__):
        table.become(pieces[i])
        out.append(np.array(table.tokens(), np.int32))
        start[i], count[i] = end, len(out[-1])
        end += len(out[-1])
    return np.concatenate(out), start, count


class Codec:
    """Encodes and decodes texts; one per Python worker and vocabulary."""

    def __init__(self, ranks_path: str, pattern: str):
        self.v = Vocabulary(read_ranks(ranks_path))
        self.cut = pattern == public_tokenizers.PATTERN
        columns, findall = PrefixColumns(self.v), regex.compile(pattern).findall
        self.later, self.first = _Parts(columns, findall, " "), _Parts(columns, findall, "")
        self.sizes = np.array([len(b) for b in self.v.by_id], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.v.by_id), np.uint8)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); texts without nulls. Whole texts go on until BATCH_CHARS are together."""
        size = np.asarray(pc.utf8_length(texts)).astype(np.int64)
        group = (np.cumsum(size) - size) // BATCH_CHARS
        bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        some = [self._encode(texts.slice(a, b - a)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return np.concatenate([x for x, _ in some]), np.concatenate([n for _, n in some])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.cut:
            lists, odd = pc.split_pattern(texts, " "), np.flatnonzero(np.asarray(pc.match_substring_regex(texts, SPACE_AFTER_SPACE), bool)).tolist()
            parts, n = lists.flatten().dictionary_encode(), np.asarray(lists.value_lengths()).astype(np.int64)
        else:
            parts, n, odd = texts.dictionary_encode(), np.ones(len(texts), np.int64), []
        words, kind = parts.dictionary.to_pylist(), np.asarray(parts.indices).astype(np.int64)
        if odd:  # few texts have a space behind white space; they are cut again
            again = [SPACE_AFTER_OTHER(texts[i].as_py()) for i in odd]
            known = {w: i for i, w in enumerate(words)}
            ends, pieces, done = np.cumsum(n), [], 0
            for i, new in zip(odd, again, strict=True):
                pieces += [kind[done : ends[i] - n[i]], np.fromiter((known.setdefault(w, len(known)) for w in new), np.int64, len(new))]
                done = ends[i]
            kind = np.concatenate([*pieces, kind[done:]])
            n[odd] = [len(x) for x in again]
            words = list(known)
        lead = np.zeros(len(kind), bool)
        lead[np.cumsum(n) - n] = True
        # a text's first part stands without a space, all others behind one
        count = np.empty(len(kind), np.int64)
        if len(kind):
            front, back = (self._kinds(p, words, kind[m]) for p, m in ((self.first, lead), (self.later, ~lead)))
            (x, cx), (y, cy) = front, back
            count[lead], count[~lead] = cx, cy
            start = np.empty(len(kind), np.int64)
            start[lead], start[~lead] = np.cumsum(cx) - cx, len(x) + np.cumsum(cy) - cy
            ids = _gather(np.concatenate([x, y]), start, count)
        else:
            ids = np.empty(0, np.int32)
        ends = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(n)])]
        return ids, np.diff(ends)

    @staticmethod
    def _kinds(parts: _Parts, words: list[str], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        used = np.bincount(kind, minlength=len(words)) > 0
        return parts.tokens(parts.numbers(list(compress(words, used.tolist())))[(np.cumsum(used) - 1)[kind]])

    def encode(self, text: str) -> np.ndarray:
        return self.encode_array(pa.array([text], pa.string()))[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return _gather(self.bytes, self.starts[ids], self.sizes[ids]).tobytes() if len(ids) else b""


def _gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """flat[start:start+count] for all ranges, joined."""
    ends = np.cumsum(count)
    return flat[np.arange(ends[-1]) + np.repeat(start - ends + count, count)]


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32()))


def encode_column(text: Column, ranks_path: str, pattern: str) -> Column:
    """array<int> of a text column's tokens; null counts as empty. ranks_path must be readable on every executor."""

    @F.arrow_udf("array<int>")
    def bpe_encode(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.list_(pa.int32()))
        return _lists(*codec(ranks_path, pattern).encode_array(pc.fill_null(texts, "")))

    return bpe_encode(text)


def decode_column(ids: Column, ranks_path: str, pattern: str) -> Column:
    """binary of an array<int> column's tokens; a null array counts as empty."""

    @F.arrow_udf("binary")
    def bpe_decode(lists: pa.Array) -> pa.Array:
        c = codec(ranks_path, pattern)
        flat, ends = np.asarray(lists.flatten()), np.cumsum([0, *(n or 0 for n in lists.value_lengths().to_pylist())])
        return pa.array([c.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())

    return bpe_decode(ids)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """docs with a column of token ids and, if asked for, a column with the bytes these ids decode to.

    No shuffle: each row is encoded by itself. A null or empty text gets an empty list; rows that repeat get the
    same ids; very long texts cost in proportion to their length. A column of docs called like out or decoded is
    replaced. An empty table stays empty.
    """
    coded = docs.withColumn(out, encode_column(F.col(text), ranks_path, pattern))
    return coded.withColumn(decoded, decode_column(F.col(out), ranks_path, pattern)) if decoded else coded
