"""BPE encoding by speculation and check, and decoding.

Text is cut into the pretokens of the byte-level scheme. For each pretoken not seen before, greedy
longest match proposes tokens. A proposal is right if each token encodes to itself and no two
neighbours would have merged across their border; that test runs for all distinct neighbours of a
batch at once, over arrays. Only pretokens that fail it are merged step by step.

Null and empty texts have no tokens. Strings of added tokens in a text become those tokens, as the
tokenizers library does by default. Rows are taken one by one: repeated rows, ties and null ids give
results as they come, and an empty table none. Extra columns are not read. A very long text is one
row; its memory is a small multiple of its length.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from quernel.llm import common
from quernel.llm.common import Encoder, encode_pieces, id_text, ship, tidy

#: Fixed value: how the byte-level scheme cuts a text into pretokens.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space other than single blanks between other characters and line ends; texts with it are
#: cut by PRETOKEN alone.
ODD = "[\\x00\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|  |\\n \\n|\\A | \\z"
#: Entries of each worker's table of known chunks and of known pretokens.
KNOWN = 250_000
#: Rows and bytes of text, about, that are encoded and decoded at a time; a longer text goes alone.
SLICE_ROWS, SLICE_BYTES = 500, 1 << 20
_NEVER = 1 << 40
_NONE = (_NEVER, 0)


def byte_names() -> dict[str, int]:
    """The scheme's printable character for each byte: itself where printable, else from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names, vocab = byte_names(), spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for s, i in vocab.items():
            self.bytes_of[i] = s.encode() if s in added else bytes(names[c] for c in s)
        for s, i in added.items():
            self.bytes_of[i] = s.encode()
        self.id_of = {b: i for i, b in enumerate(self.bytes_of) if b and i not in added.values()}
        self.longest = max(map(len, self.id_of))
        self.added = added
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pretokens = regex.compile(PRETOKEN)
        self.one = [self.id_of.get(bytes([b])) for b in range(256)]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        formed = np.full(size, -1, np.int64)
        halves = np.full((size, 2), -1, np.int64)
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.rank[i, j] = (r, k)
            if formed[k] < 0:
                formed[k], halves[k] = r, (i, j)
        self._spines(size, formed, halves)
        keys = np.array([i * size + j for i, j in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.rank.values()], np.int64)[order]
        self.size = size
        self.own = np.full(size, -1, np.int8)
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.counts = {"words": 0, "merged": 0}

    def _spines(self, size: int, formed: np.ndarray, halves: np.ndarray) -> None:
        """For each token the pieces at its right and left border: piece, from which rank on it
        stands there, and the rank at which it goes into the next."""
        self.spine = []
        for side in (1, 0):
            cols, at, until = [], np.arange(size), np.full(size, _NEVER)
            while True:
                begin = np.where(at >= 0, formed[at], _NEVER)
                cols.append((at.copy(), begin, until.copy()))
                nxt = np.where(at >= 0, halves[at, side], -1)
                if (nxt < 0).all():
                    break
                until = np.where(nxt >= 0, begin, 0)
                at = nxt
            self.spine.append([np.stack(x, 1) for x in zip(*cols)])

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For arrays of tokens: whether a before b stays as two.

        The pieces at the border change as merging goes on; a merge across it happens if some
        piece of a and some of b stand there together when the rank of their pair comes up. Of
        equal ranks the leftmost goes first.
        """
        (lp, lf, lu), (rp, rf, ru) = self.spine
        ok = np.ones(len(a), bool)
        for i in range(lp.shape[1]):
            some = np.flatnonzero(lp[a, i] >= 0)
            if not len(some):
                break
            for j in range(rp.shape[1]):
                x, y = a[some], b[some]
                live = rp[y, j] >= 0
                if not live.any():
                    break
                begin = np.maximum(lf[x, i], rf[y, j])
                live &= (begin < lu[x, i]) & (begin <= ru[y, j])
                where = some[live]
                if not len(where):
                    continue
                x, y, begin = x[live], y[live], begin[live]
                keys = lp[x, i] * self.size + rp[y, j]
                at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
                q = np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NEVER)
                ok[where[(q > begin) & (q < lu[x, i]) & (q <= ru[y, j])]] = False
        return ok

    def merge(self, word: bytes) -> list[int]:
        """Exact: the lowest-ranked pair merges, leftmost first, until none is left."""
        ids, get = [self.one[b] for b in word], self.rank.get
        if len(ids) > 64:
            return self._merge_long(ids)
        ranks = [get(p, _NONE) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks))[0] != _NEVER:
            i = ranks.index(best)
            ids[i : i + 2] = [best[1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), _NONE)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for words without a break."""
        n, get = len(ids), self.rank.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, k = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j] = k, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if r := get((k, ids[after[i]])):
                    heapq.heappush(heap, (r[0], i, k, ids[after[i]], r[1]))
            if (h := before[i]) >= 0 and (r := get((ids[h], k))):
                heapq.heappush(heap, (r[0], h, ids[h], k, r[1]))
        return [x for x in ids if x >= 0]

    def greedy(self, word: bytes) -> list[int]:
        out, i, n, get, longest = [], 0, len(word), self.id_of.get, self.longest
        while i < n:
            j = min(n, i + longest)
            while (t := get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def stays(self, tokens: np.ndarray) -> np.ndarray:
        """Whether each token's own bytes encode to it."""
        for t in np.unique(tokens[self.own[tokens] < 0]).tolist():
            self.own[t] = self.merge(self.bytes_of[t]) == [t]
        return self.own[tokens] == 1

    def learn(self, words: list[str]) -> None:
        """Encode pretokens that are not known yet: propose all, check all, merge those that fail."""
        if not words:
            return
        todo = [w.encode() for w in words]
        guesses = list(map(self.greedy, todo))
        flat = np.fromiter(chain.from_iterable(guesses), np.int64)
        ends = np.cumsum(np.fromiter(map(len, guesses), np.int64, len(guesses)))
        word = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
        wrong = np.zeros(len(words), bool)
        wrong[word[~self.stays(flat)]] = True
        inner = np.flatnonzero(word[1:] == word[:-1])
        keys, at = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        wrong[word[inner[~self.compatible(keys // self.size, keys % self.size)[at]]]] = True
        data, known, begin = flat.astype("<u4").tobytes(), self.words, 0
        for w, b, end, bad in zip(words, todo, (4 * ends).tolist(), wrong.tolist()):
            known[w] = np.array(self.merge(b), "<u4").tobytes() if bad else data[begin:end]
            begin = end
        self.counts["words"] += len(words)
        self.counts["merged"] += int(wrong.sum())

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """ids of pieces that begin and end where pretokens do; new pretokens are learned at once."""
        known = self.chunks
        found = list(map(known.get, pieces))
        if None in found:
            new = [x for x, ids in zip(pieces, found) if ids is None]
            if len(known) > KNOWN:
                known = self.chunks = {}
            own = {x: self.pretokens.findall(x) for x in new}
            if len(self.words) > KNOWN:
                self.words = {}
            self.learn(list(set(chain.from_iterable(own.values())) - self.words.keys()))
            get = self.words.__getitem__
            for x, ws in own.items():
                known[x] = get(ws[0]) if len(ws) == 1 else b"".join(map(get, ws))
            found = [known[x] if ids is None else ids for x, ids in zip(pieces, found)]
        return found

    def _odd(self, text: str, special: bool) -> bytes:
        """ids of a text that blanks alone don't cut right."""
        parts = self.split.split(text) if special and self.split is not None else [text]
        cuts = [[x] if special and x in self.added else self.pretokens.findall(x) for x in parts]
        words = {w for c, x in zip(cuts, parts) if not (special and x in self.added) for w in c}
        if len(self.words) > KNOWN:
            self.words = {}
        self.learn(list(words - self.words.keys()))
        own = self.words.__getitem__
        return b"".join(np.array([self.added[x]], "<u4").tobytes() if special and x in self.added else b"".join(map(own, c)) for c, x in zip(cuts, parts))

    def encode_many(self, texts: pa.Array, special: bool = True) -> list[bytes]:
        """ids of each text, little-endian 32 bits each. special: strings of added tokens become those tokens."""
        odd = pc.match_substring_regex(texts, ODD)
        if special:
            for t in self.added:
                odd = pc.or_(odd, pc.match_substring(texts, t))
        where = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        # A blank before another character always begins a pretoken.
        plain = pc.if_else(odd, pa.scalar("", texts.type), texts)
        out = encode_pieces(pc.replace_substring(plain, " ", "\0 "), "\0", self.pieces)
        for i in where.tolist():
            out[i] = self._odd(texts[i].as_py(), special)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many(pa.array([text], pa.string()))[0]

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8; what is not UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace").encode()


def plain_encoder(path: str) -> Encoder:
    """Encodes lists of texts; strings of added tokens are ordinary text."""
    return lambda texts: load(path).encode_many(texts, special=False)


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """One for each worker and file."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows whose texts, in its second column, are SLICE_BYTES at most together."""
    return common.slices(batch, SLICE_ROWS, SLICE_BYTES)


def encode_documents(docs: DataFrame, path: str, decode: bool = True) -> DataFrame:
    """(doc_id, n_tokens long, ids binary: little-endian 32-bit, decoded string) for each row of docs;
    decoded is null where it isn't asked for."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch):
                ids = bpe.encode_many(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) if decode else None for x in ids], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return id_text(docs).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), hashed beside the encoder so that neither
    ids nor texts go back to the JVM."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            n, a, b = [], [], []
            for part in slices(batch):
                for ids in bpe.encode_many(part.column(1)):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
