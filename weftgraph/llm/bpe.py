"""Byte-level BPE by speculation and verification.

Greedy longest match proposes the tokens of a word.  A proposal is the true BPE
result exactly when every token is reachable by its own merges and no pair of
neighbours has a merge that would have crossed their boundary before both were
complete.  That test depends on the pair alone, so it runs vectorised over the
distinct pairs of a batch; only words that fail it are merged exactly.

Texts are cut at white space into chunks that no pre-token crosses, and results
are remembered per chunk in a bounded table, so a frequent word costs a lookup.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrow import batch_of, columns, keyed, run, slices

#: The published pre-token pattern of this vocabulary family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Unicode White_Space, spelled out since Python's \s also takes U+001C to U+001F.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

NEVER = np.int64(1) << 40
#: Longer chunks and pre-tokens are not remembered, so that tables of so many entries are bounded in bytes too.
LONG = 64


def byte_letters() -> dict[str, int]:
    """The vocabulary file's letter for each byte: printable bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Position of each of the keys in the order given, by open addressing, looked up vectorised."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(len(keys) * 8).bit_length()))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.key = np.full(self.mask + 1, -1, np.int64)
        self.value = np.full(self.mask + 1, NEVER, np.int64)
        todo = np.arange(len(keys))
        at = self._slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.key[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.key[slot], self.value[slot] = keys[todo[won]], todo[won]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        held = self.key[at]
        out = np.where(held == keys, self.value[at], NEVER)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            held = self.key[at[open_]]
            same = held == keys[open_]
            out[open_[same]] = self.value[at[open_[same]]]
            open_ = open_[~same & (held >= 0)]
        return out


class Bpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str, remember: int = 250_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.ids = {raw(t): i for t, i in vocab.items() if t not in self.special}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        tokens = [self.bytes.get(i, b"") for i in range(self.size)]
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.size_of = np.fromiter(map(len, tokens), np.int64, self.size)
        self.start_of = np.cumsum(self.size_of) - self.size_of
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.rank = {(int(a), int(b)): (r, int(t)) for r, (a, b, t) in enumerate(zip(left, right, made, strict=True))}
        #: For each token, the merge that made it (-1: a byte) and its parts.
        self.born = np.full(self.size, -1, np.int64)
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        self.born[made], self.left[made], self.right[made] = np.arange(len(made)), left, right
        self.pairs = PairTable(left * self.size + right)
        self.made = made
        self.sound = self._sound_tokens()
        self._plant()
        self.name = list(map(str, range(self.size)))
        self.split = regex.compile(PATTERN).findall
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.remember = remember
        self.long: list[str] = []  # what is forgotten again after a call
        self.of_word: dict[str, str] = {}
        self.of_chunk: dict = {}
        self._forget()
        self.exact_words = self.new_words = 0

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.pairs.find(a * self.size + b)

    def crossed(self, a: np.ndarray, b: np.ndarray, skip_top: bool = False) -> np.ndarray:
        """Whether a merge across the boundary of a and b would have come before one of them was complete.

        Walks both tokens back in time: the part born last is replaced by its half
        at the boundary, which lived until that birth.  A crossing merge of two
        parts happens if its rank is below the rank that consumes the left part
        (a tie goes to the leftmost merge, which is the one inside the left token)
        and not above the rank that consumes the right part.
        """
        bad = np.zeros(len(a), bool)
        where = np.arange(len(a))
        x, y = a.copy(), b.copy()
        until_x, until_y = np.full(len(a), NEVER - 1), np.full(len(a), NEVER - 1)
        first = True
        while len(where):
            m = self._rank_of(x, y)
            hit = (m < until_x) & (m <= until_y)
            if first and skip_top:
                hit[:] = False
            first = False
            bad[where[hit]] = True
            bx, by = self.born[x], self.born[y]
            go = ~hit & ((bx >= 0) | (by >= 0))
            where, x, y, until_x, until_y, bx, by = (v[go] for v in (where, x, y, until_x, until_y, bx, by))
            back_x = bx > by
            until_x, until_y = np.where(back_x, bx, until_x), np.where(back_x, until_y, by)
            x, y = np.where(back_x, self.right[x], x), np.where(back_x, y, self.left[y])
        return bad

    def _sound_tokens(self) -> np.ndarray:
        """Tokens that their own bytes encode to."""
        made = np.flatnonzero(self.born >= 0)
        sound = np.ones(self.size, bool)
        sound[made] = ~self.crossed(self.left[made], self.right[made], skip_top=True)
        for t in made[np.argsort(self.born[made])]:
            sound[t] &= sound[self.left[t]] and sound[self.right[t]]
        return sound

    def _plant(self) -> None:
        """Trie over the vocabulary, as a table from (node, byte) to node."""
        node, token, edges = {b"": 0}, [-1], []
        for word, t in self.ids.items():
            at = 0
            for k in range(1, len(word) + 1):
                to = node.get(word[:k])
                if to is None:
                    to = node[word[:k]] = len(token)
                    token.append(-1)
                    edges.append(at * 256 + word[k - 1])
                at = to
            token[at] = t
        self.trie, self.token_of = PairTable(np.array(edges, np.int64)), np.array(token, np.int64)

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens by greedy longest match, all words in one array, and how many each word has."""
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        length = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(length) - length
        end = np.repeat(start + length, length)
        token, reach = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        at, node, depth = np.arange(len(data)), np.zeros(len(data), np.int64), 0
        while len(at):
            edge = self.trie.find(node * 256 + data[at + depth])
            ok = edge < NEVER
            at, node = at[ok], edge[ok] + 1  # edges and the nodes they lead to are numbered alike
            depth += 1
            is_token = self.token_of[node] >= 0
            token[at[is_token]], reach[at[is_token]] = self.token_of[node[is_token]], depth
            more = at + depth < end[at]
            at, node = at[more], node[more]
        first = np.zeros(len(data), bool)
        cur = start[(length > 0) & (length <= 64)]
        while len(cur):
            first[cur] = True
            stop = end[cur]
            cur = cur + reach[cur]
            cur = cur[cur < stop]
        for i in np.flatnonzero(length > 64):
            k, stop, jump = 0, int(length[i]), reach[start[i] : start[i] + length[i]].tolist()
            while k < stop:
                first[start[i] + k] = True
                k += jump[k]
        count = np.bincount(np.repeat(np.arange(len(words)), length)[first], minlength=len(words))
        return token[first], count

    def merge_exactly(self, word: bytes) -> list[int]:
        """Merge by rank, leftmost first, with a heap over a linked list."""
        token = [self.ids[word[i : i + 1]] for i in range(len(word))]
        after, before = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
        alive = [True] * len(token)
        heap = [(*r, i, token[i], token[i + 1]) for i in range(len(token) - 1) if (r := self.rank.get((token[i], token[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, made, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= len(token) or token[i] != a or token[j] != b:
                continue
            token[i], alive[j], after[i] = made, False, after[j]
            if after[j] < len(token):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(token) and (r := self.rank.get((token[k], token[after[k]]))):
                    heapq.heappush(heap, (*r, k, token[k], token[after[k]]))
        return [t for t, ok in zip(token, alive, strict=True) if ok]

    def merge_words(self, words: list[bytes]) -> list[list[int]]:
        """As merge_exactly, over all words at once: each round makes each word's merge of least rank.

        A merge only makes pairs of higher rank, so all places of the least rank
        can go in one round, from the left where they overlap.
        """
        length = np.fromiter(map(len, words), np.int64, len(words))
        token = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), length)
        done: list = [None] * len(words)
        while len(word):
            rank = np.full(len(word), NEVER)
            rank[:-1] = np.where(word[1:] == word[:-1], self._rank_of(token[:-1], token[1:]), NEVER)
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[start, len(word)])
            least = np.minimum.reduceat(rank, start)
            for i in np.flatnonzero(least == NEVER):
                done[word[start[i]]] = token[start[i] : start[i] + size[i]].tolist()
            going = np.repeat(least != NEVER, size)
            here = going & (rank == np.repeat(least, size))
            lead = here & ~np.r_[False, here[:-1]]
            place = np.arange(len(word))
            run = place - np.maximum.accumulate(np.where(lead, place, 0))
            here &= run % 2 == 0
            token[here] = self.made[rank[here]]
            keep = going & ~np.r_[False, here[:-1]]
            token, word = token[keep], word[keep]
        return done

    def words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each pre-token."""
        flat, counts = self.propose(words)
        owner = np.repeat(np.arange(len(words)), counts)
        failing = np.zeros(len(words), bool)
        failing[owner[~self.sound[flat]]] = True
        same = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, inverse = np.unique(flat[same] * self.size + flat[same + 1], return_inverse=True)
        failing[owner[same[self.crossed(pairs // self.size, pairs % self.size)[inverse]]]] = True
        ids, stop = flat.tolist(), np.cumsum(counts).tolist()
        found = [ids[a:b] for a, b in zip([0, *stop], stop)]
        short = [i for i in np.flatnonzero(failing) if len(words[i]) <= 64]
        for i, ids in zip(short, self.merge_words([words[i] for i in short]), strict=True):
            found[i] = ids
        for i in np.flatnonzero(failing):
            if len(words[i]) > 64:
                found[i] = self.merge_exactly(words[i])
        self.exact_words += int(failing.sum())
        self.new_words += len(words)
        return found

    def _forget(self) -> None:
        """Start a new chunk table with the special tokens, whose keys are tuples; the one before stays as ``old``."""
        self.old, self.of_chunk = self.of_chunk, {(s,): str(i) for s, i in self.special.items()}

    def _learn(self, chunks: set[str]) -> None:
        """Ids of chunks by way of their pre-tokens, most of which are known already."""
        cut, known, name = self.split, self.of_word, self.name
        pieces = [(c, cut(c)) for c in chunks]
        new = list({w for _, ws in pieces for w in ws if w not in known})
        if len(known) + len(new) > self.remember:
            known.clear()
            new = list({w for _, ws in pieces for w in ws})
        for w, ids in zip(new, self.words([w.encode() for w in new]), strict=True):
            known[w] = ",".join([name[t] for t in ids])
        self.long += [w for w in new if len(w) > LONG] + [c for c in chunks if len(c) > LONG]
        for c, ws in pieces:
            self.of_chunk[c] = known[ws[0]] if len(ws) == 1 else ",".join([known[w] for w in ws])

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, special ones too, end to end."""
        size = self.size_of[ids]
        stop = np.cumsum(size)
        place = np.arange(int(stop[-1]) if len(stop) else 0)
        return self.flat[place + np.repeat(self.start_of[ids] - stop + size, size)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of the tokens; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def encode_texts(self, texts: list[str]) -> list[str]:
        """For each text, its decimal ids joined by commas."""
        cut = []
        for text in texts:
            parts, at = [], 0
            for m in self.specials.finditer(text) if self.specials else ():
                parts += [*CHUNK.findall(text[at : m.start()]), (m[0],)]
                at = m.end()
            cut.append([*parts, *CHUNK.findall(text[at:])] if parts else CHUNK.findall(text))
        need = set()
        for parts in cut:
            need.update(parts)
        new = need - self.of_chunk.keys()
        if len(self.of_chunk) + len(new) > self.remember:
            self._forget()
            new = need - self.of_chunk.keys()
        again = new & self.old.keys()
        self.of_chunk.update((c, self.old[c]) for c in again)
        self._learn(new - again)
        out = [",".join(map(self.of_chunk.__getitem__, parts)) for parts in cut]
        for table in (self.of_chunk, self.of_word):
            for c in self.long:
                table.pop(c, None)
        self.long = []
        return out

    def encode(self, text: str) -> list[int]:
        ids = self.encode_texts([text])[0]
        return [int(i) for i in ids.split(",")] if ids else []


@functools.lru_cache(maxsize=1)
def shared(vocabulary: str) -> Bpe:
    """One encoder for a worker process, whose tables serve all its tasks."""
    return Bpe(vocabulary)


def round_trip(bpe: Bpe, texts: list[str], digests: bool) -> list[list]:
    """Columns of the texts: number of ids, the ids, and the text that the ids decode to, the last two as digests if asked."""
    found = bpe.encode_texts(texts)
    ids_of = [np.fromstring(i, np.int32, sep=",") if i else np.zeros(0, np.int32) for i in found]
    n, back = list(map(len, ids_of)), list(map(bpe.decode, ids_of))
    if digests:
        return [n, [hashlib.sha256(i.encode()).hexdigest() for i in found], [hashlib.sha256(t.encode()).hexdigest() for t in back]]
    return [n, [i.tolist() for i in ids_of], back]


def tokenize(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode each whole text and decode it again.

    Returns doc_id, n_tokens and either ids array<int> and decoded string, or with
    ``digests`` their SHA-256 in hex (ids as decimals joined by commas).  Null texts
    count as empty: no ids, an empty decoded text.  Rows map one to one, so
    repeated rows and null ids come through; other columns of ``df`` are left out.
    A text without letters has the ids of its spaces; an empty table gives no rows;
    equal texts give equal rows.  No shuffle; memory is bounded by the batch, the longest text (which
    is taken whole) and tables of at most ``remember`` chunks and pre-tokens of at most LONG characters.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64())]
    fields += [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
    schema = pa.schema(fields)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(vocabulary)
        for batch in batches:
            ids, texts = columns(batch, "doc_id", "text")
            for a, b in slices(texts):
                yield batch_of(schema, [ids[a:b], *round_trip(bpe, [t or "" for t in texts[a:b]], digests)])

    out = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return run(keyed(df, id_col, text_col), kernel, out)
