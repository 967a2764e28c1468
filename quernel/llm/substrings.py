"""Exact substring dedup over sparse suffix arrays, sorted deep-shallow.

Each byte covered by a string of SPAN bytes that starts in two places of the corpus goes; both
places may lie in one document. Strings are judged on the input, matches don't cross documents.

1. Texts are known by 128-bit fingerprints, never by their ids. Of equal texts of SPAN bytes or more
   all of each goes, and one stands for them in what follows.
2. Of the GRAM-byte strings in each window of SPAN bytes the one with the least hash, the first of
   equals, is the window's anchor: equal windows have equal anchors at the same place. Anchors,
   about one in fifty bytes, are dealt out by hash as packed arrays, and those that occur once drop
   out, with all windows that they stand for. An anchor that stands twice in a batch of texts is
   known to repeat, so that batch sends one mark for it instead of its places.
3. The suffixes at the remaining anchors meet by anchor, with the bytes their windows reach; what a
   batch holds twice is settled there and sent once, without its places. The rest is sorted
   deep-shallow: multikey quicksort over eight bytes at a time down to SHALLOW bytes, then a blind
   trie for each group that still agrees; so are the reversed prefixes. The common prefixes of
   neighbours give, for each window at each distance from the anchor, which others hold the same
   bytes.
4. Anchors with more than CHUNK places are too many for one task: their windows meet one by one, by
   128-bit hashes, so that no group grows with the number of copies but by one row for a batch.
5. The windows found are joined to spans and cut out.

Null texts are empty. Texts below SPAN bytes keep all. Rows that repeat an id, or have none, are
documents of their own: equal ones lose all of their text as other copies do, different ones stay
apart. Ties and empty tables need no care. Of extra columns only those to carry are read; a very long
text takes a few times its own size in one worker. Memory in step 3 follows CHUNK.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import id_text, parts, raw, ship, slices, stored, tidy
from quernel.llm.textkernel import mix, powers

SPAN, GRAM = 200, 100
REACH = SPAN - GRAM
SHALLOW = 24
CHUNK = 50_000
SEGMENT = 1 << 17
#: Rows and bytes of text, about, within which equal places are put together before they are dealt.
SLICE_ROWS, SLICE_BYTES = 10_000, 8 << 20
#: Distinct places up to which pairs of them are cheaper than distances.
FEW = 8
#: Parts that the rows of one fingerprint are dealt to where they are joined.
SALTS = 16
#: Anchors with more than CHUNK places, eight bytes each, that go to all tasks; more are joined by a shuffle.
MOST_BROADCAST = 100_000


def anchors(data: memoryview | bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, place, first, last): each anchor of a text with the windows that it stands for, by segments."""
    buf = np.frombuffer(data, np.uint8)
    windows = len(buf) - SPAN + 1
    for at in range(0, max(windows, 0), SEGMENT):
        b = buf[at : at + SEGMENT + SPAN - 1]
        up, down = powers.get(len(b) + 1)
        h = np.empty(len(b) + 1, np.uint64)
        h[0] = 0
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=h[1:])
        g = mix((h[GRAM:] - h[:-GRAM]) * down[: len(b) - GRAM + 1])
        v, p, width = g, np.arange(len(g), dtype=np.int32), 1
        while width < REACH + 1:
            s = min(width, REACH + 1 - width)
            later = v[s:] < v[:-s]
            v, p = np.where(later, v[s:], v[:-s]), np.where(later, p[s:], p[:-s])
            width += s
        first = np.flatnonzero(np.diff(p, prepend=-1))
        last = np.append(first[1:], len(p)) - 1
        place = p[first]
        yield g[place], place.astype(np.int64) + at, first + at, last + at


def fingerprint(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n) of each text."""
    return id_text(docs).select("doc_id", fingerprint(F.col("text")).alias("key"), F.octet_length("text").alias("n"))


def _deal(docs: DataFrame) -> DataFrame:
    """Anchors of all texts as packed arrays, a row for each batch and bucket: those that stand once
    in the batch with their texts and places, those that stand there more often as marks with their
    number. The places of the latter go along, a row for each text (key, at, anchors)."""
    buckets = 4 * parts(docs.sparkSession)
    names = ["bucket", "keys", "counts", "hashes", "places", "marks", "totals", "key", "at", "anchors"]
    kinds = (pa.int32(), *[pa.binary()] * 7, pa.list_(pa.int32()), pa.list_(pa.int64()))

    def packed(keys: list[bytes], h: np.ndarray, p: np.ndarray, doc: np.ndarray) -> list[tuple]:
        where = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        low = h.astype("<u4")
        name = where << 32 | low
        order = np.lexsort((p, doc, name))
        first = np.flatnonzero(np.diff(name[order], prepend=-1))
        total = np.diff(first, append=len(order))
        alone, mark = order[first[total == 1]], order[first[total > 1]]
        cut, cut_marks = (np.searchsorted(where[x], np.arange(buckets + 1)) for x in (alone, mark))
        total = total[total > 1].astype("<u4")
        rows = []
        for b in np.flatnonzero(np.diff(cut) + np.diff(cut_marks)).tolist():
            at, to = alone[cut[b] : cut[b + 1]], slice(cut_marks[b], cut_marks[b + 1])
            at = at[np.argsort(doc[at], kind="stable")]
            owners, n = np.unique(doc[at], return_counts=True)
            rows.append((b, b"".join(keys[i] for i in owners), n.astype("<u4").tobytes(), low[at].tobytes(), p[at].tobytes(), low[mark[to]].tobytes(), total[to].tobytes(), None, None, None))
        known = np.ones(len(h), bool)
        known[alone] = False
        known = np.flatnonzero(known)
        owners, at = np.unique(doc[known], return_index=True)  # documents stand in order
        for i, x, y in zip(owners.tolist(), at.tolist(), [*at[1:].tolist(), len(known)]):
            part = known[x:y]
            rows.append((int.from_bytes(keys[i][:4]) % buckets, *[None] * 6, keys[i], p[part].tolist(), name[part].tolist()))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE_ROWS, SLICE_BYTES):
                texts = dict(zip(part.column(0).to_pylist(), raw(part.column(1))))
                keys, counts, hs, ps = [], [], [], []
                for key, t in texts.items():
                    for h, p, _, _ in anchors(t):
                        keys.append(key)
                        counts.append(len(h))
                        hs.append(h)
                        ps.append(p)
                if not keys:
                    continue
                # A long text's segments are entries of their own, but one owner.
                index = {k: i for i, k in enumerate(texts)}
                doc = np.repeat([index[k] for k in keys], counts)
                rows = packed(list(texts), np.concatenate(hs), np.concatenate(ps).astype("<u4"), doc)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    rows = id_text(docs).select(fingerprint(F.col("text")).alias("key"), "text").where(F.octet_length("text") >= SPAN)
    return rows.mapInArrow(tidy(run), "bucket int, keys binary, counts binary, hashes binary, places binary, marks binary, totals binary, key binary, at array<int>, anchors array<long>")


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dealt rows sorted by bucket to (key, at, anchors): of each text the anchors that occur elsewhere
    too; and (hot) the anchors with more than CHUNK places."""
    names, kinds = ["key", "at", "anchors", "hot"], (pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64())
    held, now = [], None

    def close() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        keys, *cols = zip(*held)
        keys = np.frombuffer(b"".join(keys), "V16")
        counts, h, p, marks, totals = (np.frombuffer(b"".join(c), "<u4") for c in cols)
        owner = np.repeat(np.arange(len(keys)), counts)
        known, index = np.unique(keys.view("<u8").reshape(-1, 2), axis=0, return_inverse=True) if len(keys) else (np.zeros((0, 2), "<u8"), np.zeros(0, np.int64))
        owner = index.reshape(-1)[owner]
        # Equal texts of different batches hold the same anchors in the same places; one of them counts.
        order = np.lexsort((p, owner, h))
        h, p, owner = h[order], p[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]) | (p[1:] != p[:-1])
        h, p, owner = h[new], p[new], owner[new]
        every, at, n = np.unique(np.concatenate([h, marks]), return_inverse=True, return_counts=True)
        n = n.astype(np.int64)
        np.add.at(n, at[len(h) :], totals.astype(np.int64) - 1)
        hot = every[n > CHUNK]
        many = np.flatnonzero(n[at[: len(h)]] > 1)
        many = many[np.argsort(owner[many], kind="stable")]
        who, begin = np.unique(owner[many], return_index=True)
        ends = [*begin[1:].tolist(), len(many)]
        ps, hs = p[many].tolist(), (now << 32 | h[many].astype(np.int64)).tolist()
        rows = [(known[w].tobytes(), ps[i:j], hs[i:j], None) for w, i, j in zip(who.tolist(), begin.tolist(), ends)]
        rows += [(None, None, None, now << 32 | int(x)) for x in hot]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    for batch in batches:
        passed = batch.filter(batch.column(7).is_valid())
        if passed.num_rows:
            yield pa.RecordBatch.from_arrays([passed.column(7), passed.column(8), passed.column(9), pa.nulls(passed.num_rows, pa.int64())], names)
        own = batch.filter(batch.column(7).is_null())
        for b, *x in zip(*(own.column(i).to_pylist() for i in range(7))):
            if b != now:
                yield from close()
                held, now = [], b
            held.append(x)
    yield from close()


class _Places:
    """What a batch of texts sends on: contexts and windows that it holds once with their place, those
    that it holds more often without; the latter's places are spans already."""

    names = ["h", "w", "key", "lo", "p", "context", "spans"]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))

    def __init__(self) -> None:
        self.once: dict[tuple, tuple[bytes | None, int]] = {}
        self.spans: dict[bytes, list[int]] = {}
        self.held = 0

    def add(self, name: tuple, key: bytes, lo: int, size: int) -> None:
        """name: (anchor, place in context, context), or (hash, None, None) of a window."""
        other = self.once.get(name)
        if other is None:
            self.once[name] = (key, lo)
            self.held += size
            return
        if other[0] is not None:
            self.spans.setdefault(other[0], []).extend((other[1], other[1] + size))
            self.once[name] = (None, 0)
        self.spans.setdefault(key, []).extend((lo, lo + size))

    def batch(self) -> pa.RecordBatch:
        rows = []
        for (h, p, context), (key, lo) in self.once.items():
            if context is None:
                rows.append((int.from_bytes(h[:8], signed=True), int.from_bytes(h[8:], signed=True), key, lo, None, None, None))
            else:
                rows.append((h, None, key, lo, p, context, None))
        rows += [(int.from_bytes(k[:8], signed=True), None, k, None, None, None, x) for k, x in self.spans.items()]
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, self.kinds)], self.names)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text, at, hot) to a row for each repeated anchor: its hash, the text, where its
    first window begins, the anchor's place from there, and the bytes of its windows. For hot anchors
    a row for each window, by its hash h and w. Spans found on the way are rows too."""
    places = _Places()
    for batch in batches:
        for key, t, at, hot in zip(batch.column(0).to_pylist(), raw(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            wanted = np.array([x for part in at for x in part], np.int64)
            heat = np.array([x for part in hot for x in part], bool) if hot else np.zeros(len(wanted), bool)
            order = np.argsort(wanted)
            wanted, heat = wanted[order], heat[order]
            for h, p, first, last in anchors(t):
                i = np.minimum(np.searchsorted(wanted, p), len(wanted) - 1)
                ok = np.flatnonzero(wanted[i] == p)
                for x, y, lo, hi, many in zip(h[ok].view(np.int64).tolist(), p[ok].tolist(), first[ok].tolist(), last[ok].tolist(), heat[i[ok]].tolist()):
                    if many:
                        for k in range(lo, hi + 1):
                            places.add((xxhash.xxh3_128_digest(t[k : k + SPAN]), None, None), key, k, SPAN)
                    else:
                        places.add((x, y - lo, bytes(t[lo : hi + SPAN])), key, lo, hi + SPAN - lo)
                if places.held > SLICE_BYTES:
                    yield places.batch()
    yield places.batch()


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n if not x else n - (x.bit_length() + 7) // 8


class _Node:
    """A branch of a blind trie: at this depth its members differ. below: by the byte there, -1 at an end."""

    __slots__ = ("depth", "below")

    def __init__(self, depth: int, below: dict):
        self.depth, self.below = depth, below


def blind_trie(strings: list[bytes], members: list[int]) -> tuple[list[int], list[int]]:
    """members in order of their strings, and the common prefix of each with the one before.

    The trie keeps the depths where strings branch and one byte for each branch; a string goes down
    by those bytes alone, is compared once with the leaf that it reaches, and is put in where that
    comparison says.
    """

    def byte(s: bytes, d: int) -> int:
        return s[d] if d < len(s) else -1

    root = [members[0]]
    for m in members[1:]:
        s, node = strings[m], root
        while isinstance(node, _Node):
            c = byte(s, node.depth)
            node = node.below[c] if c in node.below else next(iter(node.below.values()))
        leaf = strings[node[0]]
        if s == leaf:
            node.append(m)
            continue
        d = common_prefix(s, leaf)
        node, above, key = root, None, None
        while isinstance(node, _Node) and node.depth < d:
            above, key = node, byte(s, node.depth)
            node = node.below[key]
        if isinstance(node, _Node) and node.depth == d:
            node.below[byte(s, d)] = [m]
            continue
        new = _Node(d, {byte(leaf, d): node, byte(s, d): [m]})
        if above is None:
            root = new
        else:
            above.below[key] = new
    order, common = [], []
    stack = [(root, 0)]
    while stack:
        node, before = stack.pop()
        if isinstance(node, _Node):
            below = [node.below[c] for c in sorted(node.below)]
            stack.extend((x, before if k == 0 else node.depth) for k, x in reversed(list(enumerate(below))))
        else:
            order.extend(node)
            common.append(before)
            common.extend([len(strings[node[0]])] * (len(node) - 1))
    return order, common


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """The strings' order, and the common prefix of each with the one before (0 for the first)."""
    order, common = [], []
    stack = [(list(range(len(strings))), 0, 0)]
    while stack:
        part, depth, before = stack.pop()
        if len(part) == 1:
            order.append(part[0])
            common.append(before)
        elif depth >= SHALLOW:
            o, c = blind_trie(strings, part)
            order.extend(o)
            common.extend([before, *c[1:]])
        else:
            # Strings that end within the eight bytes sort before those that go on.
            keys = {m: (strings[m][depth : depth + 8], len(strings[m]) >= depth + 8) for m in part}
            pivot = keys[part[len(part) // 2]]
            less, same, more = ([m for m in part if keys[m] < pivot], [m for m in part if keys[m] == pivot], [m for m in part if keys[m] > pivot])
            near = lambda x: max(common_prefix(pivot[0], keys[m][0]) for m in x) if x else 0
            a, b = depth + near(less), depth + near(more)
            if more:
                stack.append((more, depth, b))
            if pivot[1]:
                stack.append((same, depth + 8, a if less else before))
            else:
                order_same = [(m, a if less else before) if k == 0 else (m, len(strings[m])) for k, m in enumerate(same)]
                stack.extend(([m], depth, c) for m, c in reversed(order_same))
            if less:
                stack.append((less, depth, before))
    return order, common


def _classes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    order, common = deep_shallow(strings)
    return np.array(order), np.array(common)


def repeats(group: list[tuple[int, bytes]]) -> list[list[tuple[int, int]]]:
    """group: distinct (p, context) of places with one anchor. For each the windows, as runs of first
    and last start, that another of them holds too."""
    g = len(group)
    ps = np.array([p for p, _ in group])
    ro, rc = _classes([c[p:] for p, c in group])
    lo, lc = _classes([c[:p][::-1] for p, c in group])
    if g <= FEW:
        # The common prefix of two is the least between neighbours from one to the other.
        right, left = np.empty(g, np.int64), np.empty(g, np.int64)
        right[ro], left[lo] = np.arange(g), np.arange(g)
        near: list[list[tuple[int, int]]] = [[] for _ in group]
        for x in range(g):
            for y in range(x):
                i, j = sorted((right[x], right[y]))
                d0 = SPAN - int(rc[i + 1 : j + 1].min())
                i, j = sorted((left[x], left[y]))
                d1 = int(lc[i + 1 : j + 1].min())
                if d0 <= d1:
                    for z in (x, y):
                        near[z].append((group[z][0] - d1, group[z][0] - d0))
        return near
    last = ps - np.array([len(c) - SPAN for _, c in group])
    hit: dict[int, list[int]] = {}
    for d in range(int(ps.max()), int(max(0, last.min())) - 1, -1):
        has = (last <= d) & (d <= ps)
        if has.sum() < 2:
            continue
        a, b = np.empty(g, np.int64), np.empty(g, np.int64)
        a[ro] = np.cumsum(rc < SPAN - d)
        b[lo] = np.cumsum(lc < d)
        x = np.flatnonzero(has)
        _, inv, n = np.unique((a * (g + 1) + b)[x], return_inverse=True, return_counts=True)
        for k in x[n[inv] > 1].tolist():
            hit.setdefault(k, []).append(int(ps[k]) - d)
    out = []
    for k in range(g):
        s = np.array(hit.get(k, ()), np.int64)
        cut = np.flatnonzero(np.diff(s) > 1)
        out.append(list(zip(s[np.r_[0, cut + 1]].tolist(), s[np.r_[cut, len(s) - 1]].tolist())) if len(s) else [])
    return out


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as _contexts gives them, sorted by h and w, to (key, spans)."""
    spans: dict[bytes, list[int]] = {}
    places: dict[tuple | None, list[tuple[bytes | None, int]]] = {}
    now, held = None, 0

    def close() -> int:
        """places: by (p, context), or None for a window; those of an anchor, or of a window."""
        found = 0
        runs = repeats(list(places)) if len(places) > 1 else [()]
        for (name, where), own in zip(places.items(), runs):
            if len(where) > 1 or where[0][0] is None:
                own = [(0, 0 if name is None else len(name[1]) - SPAN)]
            for key, lo in where:
                if key is not None:
                    for a, b in own:
                        spans.setdefault(key, []).extend((lo + a, lo + b + SPAN))
                        found += 1
        return found

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(spans.keys(), pa.binary()), pa.array(spans.values(), pa.list_(pa.int64()))], ["key", "spans"])

    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(7)]
        for h, w, key, lo, p, context, known in zip(*cols):
            if known is not None:
                spans.setdefault(key, []).extend(known)
                held += len(known)
                continue
            # Windows have a second half of their hash, anchors none.
            if (h, w) != now:
                held += close() if places else 0
                places, now = {}, (h, w)
                if held > 200_000:
                    yield flush()
                    spans, held = {}, 0
            places.setdefault(None if w is not None else (p, context), []).append((key, lo))
    if places:
        close()
    yield flush()


def _merge(spans: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.array([x for s in spans for x in s], np.int64).reshape(-1, 2)
    flat = flat[np.argsort(flat[:, 0], kind="stable")]
    ends = np.maximum.accumulate(flat[:, 1])
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:, 0] > ends[:-1]
    at = np.flatnonzero(new)
    return flat[at, 0], ends[np.append(at[1:], len(flat)) - 1]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, whole, spans) to what is kept of each."""
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            part = batch.slice(k, 1000)
            rows = []
            for t, whole, spans in zip(raw(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist()):
                if whole:
                    rows.append((len(t), len(t), 1, b""))
                elif spans:
                    a, b = _merge(spans)
                    keep = [bytes(t[x:y]) for x, y in zip([0, *b.tolist()], [*a.tolist(), len(t)])]
                    rows.append((len(t), int((b - a).sum()), len(a), b"".join(keep)))
                else:
                    rows.append((len(t), 0, 0, bytes(t)))
            n, removed, runs, kept = zip(*rows)
            digest = [hashlib.sha256(x).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest), pa.array(kept, pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()), *part.columns[4:]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text", *part.schema.names[4:]],
            )


def _heated(each: DataFrame, hot: DataFrame, few: bool) -> DataFrame:
    """Places (key, at, hot: their anchor), with heat: whether the anchor is one of the hot ones. Few of
    these go to all tasks and the places stay where they are; of more, each is dealt by a salt too, as
    the places of one anchor may be very many."""
    hot = hot.withColumn("heat", F.lit(True))
    if few:
        each = each.join(F.broadcast(hot), "hot", "left")
    else:
        hot = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        each = each.withColumn("salt", F.pmod(F.xxhash64("key", "at"), F.lit(SALTS)).cast("int"))
        each = each.join(hot.hint("merge"), ["hot", "salt"], "left")
    return each.select("key", "at", F.coalesce("heat", F.lit(False)).alias("heat"))


def spans(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(key, spans): the repeated windows of each distinct text. names: (key, doc_id), a document with it."""
    spark = docs.sparkSession
    dealt = _deal(docs).repartition(parts(spark), "bucket").sortWithinPartitions("bucket")
    found = stored(dealt.mapInArrow(tidy(_repeated), "key binary, at array<int>, anchors array<long>, hot long"))
    own, hot = found.where("key IS NOT NULL").select("key", "at", "anchors"), found.where("hot IS NOT NULL").select("hot").distinct()
    number = hot.limit(MOST_BROADCAST + 1).count()
    if number == 0:
        wanted = own.groupBy("key").agg(F.collect_list("at").alias("at")).withColumn("heat", F.lit(None).cast("array<array<boolean>>"))
    else:
        each = own.select("key", F.explode(F.arrays_zip("at", "anchors")).alias("x")).select("key", F.col("x.at").alias("at"), F.col("x.anchors").alias("hot"))
        each = _heated(each, hot, number <= MOST_BROADCAST)
        each = each.groupBy("key").agg(F.collect_list(F.struct("at", "heat")).alias("x"))
        wanted = each.select("key", F.array("x.at").alias("at"), F.array("x.heat").alias("heat"))
    wanted = wanted.join(names.select(F.col("key").alias("_k"), F.col("doc_id").alias("_d")), F.col("key") == F.col("_k")).drop("_k")
    texts = id_text(docs).select("doc_id", "text", fingerprint(F.col("text")).alias("_k"))
    texts = texts.join(wanted, (F.col("_k") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select("key", "text", "at", "heat")
    rows = texts.mapInArrow(tidy(_contexts), "h long, w long, key binary, lo long, p int, context binary, spans array<long>")
    rows = rows.repartition(parts(spark), "h").sortWithinPartitions("h", "w")
    return stored(rows.mapInArrow(tidy(_sorted_groups), "key binary, spans array<long>"))


def dedup(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary, kept_text: kept without the
    halves of characters cut in two) for each document, and the columns to carry along."""
    spark = docs.sparkSession
    ship(spark)
    prints = stored(fingerprints(docs).where(F.col("n") >= SPAN).select("doc_id", "key"))
    texts = stored(prints.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("c")))
    # All of each copy goes; the copies of one text may be very many, so they are dealt by a salt too.
    copies = texts.where("c > 1").select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = prints.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    whole = salted.join(copies, ["key", "salt"]).select("doc_id", "key").distinct().select("doc_id", "key", F.lit(True).alias("whole"), F.lit(None).cast("array<array<long>>").alias("spans"))
    cut = spans(docs, texts).groupBy("key").agg(F.collect_list("spans").alias("spans"))
    single = texts.where("c = 1").join(cut, "key").select("doc_id", "key", F.lit(False).alias("whole"), "spans")
    info = whole.unionByName(single).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "whole", "spans")
    carried = [F.col(c).alias(f"_carry{k}") for k, c in enumerate(carry)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *carried).withColumn("key", fingerprint(F.col("text")))
    rows = rows.join(info, (F.col("key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    rows = rows.select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "spans", *(F.col(f"_carry{k}").alias(c) for k, c in enumerate(carry)))
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(tidy(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, kept_text string" + more)
