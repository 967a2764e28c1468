"""N-gram Jaccard join: groups of documents whose shingle sets are 0.75 alike or more.

A document's set holds the distinct runs of five words, A-Z in lower case; fewer words make one
shingle, no words an empty set, which links with nothing. Sets are compared as 64-bit hashes.

1. One pass over the texts cuts them into shingles. Equal sets fall together by their 128-bit
   fingerprint, never by ids; one document stands for each.
2. A set links with another only if three quarters of its shingles occur in other sets. In the same
   pass the shingles are dealt out by their hash, as packed arrays: those that one set of a slice of
   the texts holds with that set's number in the slice, those that several hold once, as a mark; the
   latter are counted at once. Each set gets a number of shared ones, no less than the true one, and
   those with too few drop out; this loses no link.
3. The others meet by MinHash keys: two sets with similarity s share a key with probability s, and
   miss all KEYS with probability (1 - s)^KEYS, below 4e-15. The keys go in rounds; in the later
   ones only groups that still hold different components are looked at.
4. A group above CHUNK shingles is dealt to chunks. Each chunk meets the first one, which makes most
   of a group of copies one component; then only sets outside the group's largest component meet the
   chunks that they haven't met. So work grows with a group of copies, not with its square.
5. Groups meet by token bitmaps first: only sets that may link with one of another component there are
   sent with their shingles. A bitmap is a fraction of a set, and sets that share a key by chance, of
   which there are the more the more texts there are, stay behind; this loses no link.
6. In a task a signature tree is built: leaves of sets, nodes with the OR and the AND of their
   token bitmaps and their range of sizes. A dual traversal drops pairs of nodes whose greatest
   possible overlap is too small or which are one component already; the sets of what remains are
   intersected exactly.
7. The links found give components.

Null, empty and blank texts are alone, with n_shingles 0. Rows that repeat an id are documents of
their own: each has the size of its own set and the least id of its own component. So have rows
without an id; a component without any id has a null name. Ties need no care; extra columns are not
read; an empty table gives no rows. A very long text takes a small multiple of its size in one worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import id_text, parts, raw, ship, slices, stored, tidy
from quernel.llm.components import components
from quernel.llm.textkernel import shingle_set

KEYS, ROUNDS = 24, ((0, 2), (2, 8), (8, 24))
CHUNK = 1 << 20
#: Rows and bytes of text, about, whose shingles are put together before they are dealt.
SLICE_ROWS, SLICE_BYTES = 10_000, 8 << 20
LEAF, FAN, WORDS = 16, 8, 16
#: Rows of a group that meet by bitmaps, and how many at once; larger groups meet with their shingles at once.
MEET, ABREAST = 1024, 64
#: Bits of the map that tells which texts are worth a shuffle: for each of them, and in all.
BITS, MOST_BITS = 16, 1 << 26
_rng = np.random.default_rng(20240611)
_FACTORS = _rng.integers(1 << 62, size=KEYS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _fingerprint(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


#: A row's document, or what is known of a slice's sets; see signatures.
_SIGNATURES = ["doc_id", "mark", "n", "key", "slice", "owners", "counts", "rows", "keys", "sizes"]
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
_SCHEMA = "doc_id long, mark long, n long, key binary, slice binary, owners binary, counts binary, rows long, keys binary, sizes binary"


def _pack(owners: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts of sets, which are known by their numbers in a slice: two bytes and one; an owner of more
    than 255 stands several times."""
    times = (counts + 254) // 255
    last = np.cumsum(times) - 1
    out = np.full(int(times.sum()), 255, np.uint8)
    out[last] = counts - 255 * (times - 1)
    return np.repeat(owners, times).astype("<u2").tobytes(), out.tobytes()


def _unpack(owners: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(owners, "<u2").astype(np.int64), np.frombuffer(counts, np.uint8).astype(np.int64)


def lonely(found: DataFrame) -> DataFrame:
    """(key) of the sets that have less than three quarters of their shingles in other sets, from rows of
    slices. A slice whose rows haven't all been counted, as after a task that ran again on rows in another
    order, has none.
    """
    spark = found.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counted, own, total = None, 0, None, np.zeros(SLICE_ROWS, np.int64)

        def close() -> list[bytes]:
            if own is None:
                return []
            rows, keys, sizes = own
            n = np.frombuffer(sizes, "<u4").astype(np.int64)
            few = np.flatnonzero(100 * total[: len(n)] < 75 * n).tolist() if counted == rows else []
            return [keys[16 * i : 16 * i + 16] for i in few]

        for batch in batches:
            out: list[bytes] = []
            for part, owners, counts, rows, keys, sizes in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if part != now:
                    out += close()
                    now, counted, own = part, 0, None
                    total[:] = 0
                if keys is None:
                    counted += rows
                elif own is not None:
                    continue
                else:
                    own = rows, keys, sizes
                np.add.at(total, *_unpack(owners, counts))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["key"])
        yield pa.RecordBatch.from_arrays([pa.array(close(), pa.binary())], ["key"])

    rows = found.select("slice", "owners", "counts", "rows", "keys", "sizes")
    return rows.repartition(parts(spark), "slice").sortWithinPartitions("slice").mapInArrow(tidy(run), "key binary")


def signatures(docs: DataFrame) -> DataFrame:
    """Rows of documents and, with a slice, of slices of them, stored. A document's: (doc_id, mark: a hash
    of its text, n: its set's size, key: its set's fingerprint, null for an empty set). A slice's: its
    sets' keys and sizes, how many rows it dealt, and how many shingles of each set (owners, counts) occur
    in another set of the slice; or, without keys, in one of another slice, as found in so many of the rows.

    A slice is named by its sets. Sets in several slices count as each other's partners; so a set's count
    is never below the true one, and too high only for repeated sets.
    """
    spark = docs.sparkSession
    ship(spark)
    buckets = parts(spark)
    names = ["bucket", "hashes", "marks", *_SIGNATURES]
    kinds = (pa.int32(), pa.binary(), pa.binary(), *_TYPES)

    def dealt(sets: dict[bytes, np.ndarray]) -> list[tuple]:
        """Packed shingles of distinct sets, a row for each bucket, and the shared ones counted here."""
        keys = b"".join(sets)
        name = xxhash.xxh3_128_digest(keys)
        sizes = np.array([len(s) for s in sets.values()], np.int64)
        h = np.concatenate(list(sets.values()))
        doc = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        first = np.flatnonzero(np.diff(h, prepend=h[:1] ^ np.uint64(1)))
        total = np.diff(first, append=len(h))
        here = np.bincount(doc[np.repeat(total > 1, total)], minlength=len(sets))
        alone, mark = first[total == 1], first[total > 1]
        low = h.astype("<u4")
        where = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        cuts = []
        for x in (alone, mark):
            x = x[np.argsort(where[x], kind="stable")]
            cuts.append((x, np.searchsorted(where[x], np.arange(buckets + 1))))
        (alone, cut), (mark, cut_marks) = cuts
        rows = []
        for b in np.flatnonzero(np.diff(cut) + np.diff(cut_marks)).tolist():
            at = alone[cut[b] : cut[b + 1]]
            at = at[np.argsort(doc[at], kind="stable")]
            owned = _pack(*np.unique(doc[at], return_counts=True))
            rows.append((b, low[at].tobytes(), low[mark[cut_marks[b] : cut_marks[b + 1]]].tobytes(), *[None] * 4, name, *owned, *[None] * 3))
        some = np.flatnonzero(here)
        to = int.from_bytes(name[:4], "little") % buckets
        return rows + [(to, *[None] * 6, name, *_pack(some, here[some]), len(rows), keys, sizes.astype("<u4").tobytes())]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE_ROWS, SLICE_BYTES):
                sets: dict[bytes, np.ndarray] = {}
                rows, seen = [], {}
                for i, t, mark in zip(part.column(0).to_pylist(), raw(part.column(1)), part.column(2).to_pylist()):
                    text = bytes(t)
                    if text not in seen:
                        s = shingle_set(t)
                        key = _fingerprint(s) if len(s) else None
                        seen[text] = len(s), key
                        if key is not None:
                            sets[key] = s
                    n, key = seen[text]
                    rows.append((mark % buckets, None, None, i, mark, n, key, *[None] * 6))
                if sets:
                    rows += dealt(sets)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A bucket's rows by slice; what was found so far of each slice: rows, owners, counts.
        held: dict[bytes, tuple] = {}
        found: dict[bytes, list[tuple[np.ndarray, np.ndarray]]] = {}
        now, many_found = None, 0

        def close() -> int:
            if not held:
                return 0
            known = list(held)
            h, marks = (np.frombuffer(b"".join(x[k] for x in held.values()), "<u4") for k in (0, 1))
            owner = np.concatenate([np.repeat(o + (k << 16), c) for k, (o, c) in enumerate(_unpack(*x[2:]) for x in held.values())])
            held.clear()
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            first = np.flatnonzero(np.diff(h, prepend=h[:1] ^ np.uint32(1)))
            size = np.diff(first, append=len(h))
            many = (size > 1) | np.isin(h[first], marks)
            some, n = np.unique(owner[np.repeat(many, size)], return_counts=True)
            cut = np.searchsorted(some, np.arange(len(known) + 1) << 16)
            for k, name in enumerate(known):
                at = slice(cut[k], cut[k + 1])
                found.setdefault(name, []).append((some[at] & 0xFFFF, n[at]))
            return len(some) + len(known)

        def flush() -> Iterator[pa.RecordBatch]:
            """What the buckets so far give, summed by slice."""
            rows = []
            for name, x in found.items():
                total = np.bincount(np.concatenate([o for o, _ in x]), weights=np.concatenate([c for _, c in x])).astype(np.int64)
                some = np.flatnonzero(total)
                rows.append((*[None] * 4, name, *_pack(some, total[some]), len(x), None, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _SIGNATURES)
            found.clear()

        for batch in batches:
            passed = batch.filter(batch.column(1).is_null())
            if passed.num_rows:
                yield pa.RecordBatch.from_arrays(passed.columns[3:], _SIGNATURES)
            own = batch.filter(batch.column(1).is_valid())
            for b, name, *x in zip(*(own.column(i).to_pylist() for i in (0, 7, 1, 2, 8, 9))):
                if b != now:
                    many_found, now = many_found + close(), b
                    if many_found > 1 << 20:
                        yield from flush()
                        many_found = 0
                # Slices of one name have the same rows.
                held[name] = x
        close()
        yield from flush()

    texts = id_text(docs).withColumn("mark", F.xxhash64("text"))
    rows = texts.mapInArrow(tidy(deal), "bucket int, hashes binary, marks binary, " + _SCHEMA)
    rows = rows.repartition(parts(spark), "bucket").sortWithinPartitions("bucket")
    return stored(rows.mapInArrow(tidy(count), _SCHEMA))


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), WORDS * 64), bool)
    for i, s in enumerate(sets):
        out[i, (s >> np.uint64(20)).astype(np.int64) & (WORDS * 64 - 1)] = True
    return np.packbits(out, axis=1).view(np.uint64)


def _may_link(n1: np.ndarray, m1: np.ndarray, only1: np.ndarray, n2: np.ndarray, m2: np.ndarray, only2: np.ndarray) -> np.ndarray:
    """For sizes n to m on both sides and bits that only one side has: overlap is at most a size less
    those bits, and 7 * overlap must reach 3 * both sizes."""
    return (4 * m1 - 7 * only1 >= 3 * n2) & (4 * m2 - 7 * only2 >= 3 * n1)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


class Tree:
    """A signature tree over sets: levels of nodes, from leaves of LEAF sets up."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.n = np.array([len(s) for s in sets], np.int64)
        self.bits = _bitmaps(sets)
        self.levels = []
        any_, all_, lo, hi, step = self.bits, self.bits, self.n, self.n, LEAF
        while len(lo) > 1 or not self.levels:
            at = np.arange(0, len(lo), step)
            any_, all_ = np.bitwise_or.reduceat(any_, at), np.bitwise_and.reduceat(all_, at)
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            self.levels.append((any_, all_, lo, hi))
            step = FAN

    def pairs(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of nodes those that may hold a link."""
        any_, all_, lo, hi = self.levels[level]
        ok = _may_link(lo[a], hi[a], _popcount(all_[a] & ~any_[b]), lo[b], hi[b], _popcount(all_[b] & ~any_[a]))
        return a[ok], b[ok]

    def links(self, root: list[int], find) -> Iterator[tuple[int, int]]:
        """Pairs of sets that are alike, without those already of one component; the caller joins
        each pair before it asks for the next. root: the component of each set, as find knows it."""
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, x, y = stack.pop()
            span = LEAF * FAN**level
            if x != y or level:
                names = {find(r) for r in root[x * span : (x + 1) * span]}
                if x != y and len(names) == 1:
                    names |= {find(r) for r in root[y * span : (y + 1) * span]}
                if len(names) == 1:
                    continue
            if level:
                count = len(self.levels[level - 1][2])
                xs, ys = (np.arange(k * FAN, min((k + 1) * FAN, count)) for k in (x, y))
                a, b = np.repeat(xs, len(ys)), np.tile(ys, len(xs))
                if x == y:
                    a, b = a[a <= b], b[a <= b]
                a, b = self.pairs(level - 1, a, b)
                stack.extend((level - 1, i, j) for i, j in zip(a.tolist()[::-1], b.tolist()[::-1]))
                continue
            xs, ys = (np.arange(k * LEAF, min((k + 1) * LEAF, len(self.sets))) for k in (x, y))
            a, b = np.repeat(xs, len(ys)), np.tile(ys, len(xs))
            if x == y:
                a, b = a[a < b], b[a < b]
            ok = _may_link(self.n[a], self.n[a], _popcount(self.bits[a] & ~self.bits[b]), self.n[b], self.n[b], _popcount(self.bits[b] & ~self.bits[a]))
            for i, j in zip(a[ok].tolist(), b[ok].tolist()):
                if find(root[i]) == find(root[j]):
                    continue
                both = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
                if 100 * both >= 75 * (len(self.sets[i]) + len(self.sets[j]) - both):
                    yield i, j


class _Union:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, r = self.up, x
        while (p := up.get(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up[x]
        return r

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, comp, shingles) sorted by the first three: links between components."""
    union = _Union()
    group, now = [], None

    def close() -> None:
        if len(group) > 1:
            group.sort(key=lambda x: (int(x[1][0]), len(x[1]), x[0]))
            root = [c for c, _ in group]
            for i, j in Tree([s for _, s in group]).links(root, union.find):
                union.join(root[i], root[j])

    for batch in batches:
        ids = zip(*(batch.column(i).to_pylist() for i in range(4)))
        for (key, i, j, comp), s in zip(ids, raw(batch.column(4))):
            if (key, i, j) != now:
                close()
                group, now = [], (key, i, j)
            group.append((comp, np.frombuffer(bytes(s), np.uint64)))
    close()
    pairs = [(x, r) for x in union.up if (r := union.find(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, i, j, comp, id, n, bits) sorted by the first three those that may link with a row of
    theirs that is of another component, without n and bits."""
    names, kinds = ["key", "i", "j", "comp", "id"], [pa.int64()] * 5
    group, now, large = [], None, False

    def close() -> list[tuple]:
        if len(group) < 2:
            return []
        comp, n = (np.array([g[k] for g in group], np.int64) for k in (3, 5))
        bits = np.frombuffer(b"".join(g[6] for g in group), np.uint64).reshape(len(group), WORDS)
        ok = np.zeros(len(group), bool)
        for at in range(0, len(group), ABREAST):
            x = slice(at, at + ABREAST)
            own, n1 = bits[x, None], n[x, None]
            may = _may_link(n1, n1, _popcount(own & ~bits), n, n, _popcount(bits & ~own)) & (comp[x, None] != comp)
            ok[x] = may.any(axis=1)
        return [group[k][:5] for k in np.flatnonzero(ok).tolist()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(batch.column(k).to_pylist() for k in range(7))):
            if row[:3] != now:
                out += close()
                group, now, large = [], row[:3], False
            group.append(row)
            if large or len(group) > MEET:
                out += [g[:5] for g in group]
                group, large = [], True
        yield made(out)
    yield made(close())


def _sets(texts: DataFrame) -> DataFrame:
    """(id, n, shingles, keys, bits) of rows (id, text, key) whose text has the set that key names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [(i, s) for i, t, key in zip(part.column(0).to_pylist(), raw(part.column(1)), part.column(2).to_pylist()) if _fingerprint(s := shingle_set(t)) == key]
                # The least multiples; a set's own mark goes with its place, so that places differ.
                keys = [[int((s * f).min() >> np.uint64(1)) ^ p << 56 for p, f in enumerate(_FACTORS)] for _, s in found]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array([b.tobytes() for b in _bitmaps([s for _, s in found])], pa.binary())], ["id", "n", "shingles", "keys", "bits"])

    return texts.select("id", "text", "key").mapInArrow(tidy(run), "id long, n long, shingles binary, keys array<long>, bits binary")


def _likely(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """texts whose mark's bit is set in a map of chosen's marks: all of chosen's texts and some others, the
    more the fuller the map, which has a bound and so may be broadcast."""
    bits = min(MOST_BITS, 1 << max(15, (BITS * chosen.count()).bit_length()))
    slot = lambda c: F.pmod(c, F.lit(bits))
    maps = chosen.select(slot("rep_mark").alias("s")).groupBy(F.shiftright("s", 15).alias("_at")).agg(F.bitmap_construct_agg(F.expr("s & 32767")).alias("_map"))
    rows = texts.withColumn("_slot", slot("mark")).join(F.broadcast(maps), F.shiftright("_slot", 15) == F.col("_at"))
    byte = "cast(conv(hex(substring(_map, cast(shiftright(_slot & 32767, 3) AS int) + 1, 1)), 16, 10) AS int)"
    return rows.where(f"shiftright({byte}, cast(_slot & 7 AS int)) & 1 = 1").select(*texts.columns)


def _met(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The links that rows (key, i, j, comp, id) find where they meet by the first three."""
    by, n = ("key", "i", "j"), parts(sets.sparkSession)
    rows = rows.join(sets.select("id", "n", "bits"), "id").select(*by, "comp", "id", "n", "bits")
    # Stored, so that Spark knows how few they are before it shuffles the sets.
    rows = stored(rows.repartition(n, *by).sortWithinPartitions(*by).mapInArrow(tidy(_hopeful), "key long, i long, j long, comp long, id long"))
    rows = rows.join(sets.select("id", "shingles"), "id").select(*by, "comp", "shingles")
    return rows.repartition(n, *by).sortWithinPartitions(*by).mapInArrow(tidy(_match), "a long, b long")


def _chunks(size: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(size / CHUNK))


def _own(chunks: Column) -> Column:
    return F.pmod(F.xxhash64("id"), chunks)


def _open(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """rows (key, id, n) of groups with different components, with comp and the group's chunks."""
    if known is None:
        rows = rows.withColumn("comp", F.col("id"))
    else:
        rows = rows.join(known, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    groups = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), _chunks(F.sum("n")).alias("chunks")).where("lo <> hi")
    return rows.join(groups.select("key", "chunks"), "key")


def _first_chunk(rows: DataFrame) -> DataFrame:
    """Each chunk of a group meets the group's first one."""
    rows = rows.withColumn("own", _own(F.col("chunks")))
    others = F.when(F.col("own") == 0, F.expr("sequence(least(1L, chunks - 1), chunks - 1)")).otherwise(F.array("own"))
    return rows.select("key", F.lit(0).cast("long").alias("i"), F.explode(others).alias("j"), "comp", "id")


def _outsiders(rows: DataFrame) -> DataFrame:
    """What is outside a group's largest component, in chunks of its own, meets all chunks of the
    largest and each other's. Two chunks have met already."""
    rows = rows.where("chunks > 2")
    weight = rows.groupBy("key", "comp").agg(F.sum("n").alias("w"))
    largest = weight.groupBy("key").agg(F.max_by("comp", F.struct("w", "comp")).alias("major"), F.max("w").alias("inside"), (F.sum("w") - F.max("w")).alias("outside"))
    rows = rows.join(largest.select("key", "major", _chunks(F.col("inside")).alias("ins"), _chunks(F.col("outside")).alias("outs")), "key")
    inner = rows.where("comp = major").withColumn("j", _own(F.col("ins"))).withColumn("i", F.explode(F.expr("sequence(0L, outs - 1)")))
    outer = rows.where("comp <> major").withColumn("own", _own(F.col("outs")))
    across = outer.withColumn("i", F.col("own")).withColumn("j", F.explode(F.expr("sequence(0L, ins - 1)")))
    # Pairs of outer chunks stand below zero, so that they are no inner chunk's.
    among = outer.where("outs > 1").withColumn("other", F.explode(F.expr("sequence(0L, outs - 1)"))).where("other <> own")
    among = among.withColumn("i", F.least("own", "other")).withColumn("j", -1 - F.greatest("own", "other"))
    cols = ["key", "i", "j", "comp", "id"]
    return inner.select(*cols).union(across.select(*cols)).union(among.select(*cols))


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, mark: a hash of its text, n, component: its least id, group: its component's own mark, null
    for an empty set) for each document."""
    both = signatures(docs)
    sig = both.where("slice IS NULL").select("doc_id", "mark", "n", "key")
    # The least id names a set, and the text of some document with it is read again.
    source = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    reps = stored(sig.where("key IS NOT NULL").groupBy("key").agg(source.alias("s"), F.first("n").alias("n")).select("key", "n", F.col("s.doc_id").alias("rep"), F.col("s.mark").alias("rep_mark")))
    chosen = reps.join(lonely(both.where("slice IS NOT NULL")), "key", "left_anti").select("key", "rep", "rep_mark")
    # Numbers of sets, without collisions; stored, so that they stay as they are.
    chosen = stored(chosen.withColumn("id", F.monotonically_increasing_id()))
    texts = id_text(docs).withColumn("mark", F.xxhash64("text"))
    texts = _likely(texts, chosen).join(chosen, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("mark") == F.col("rep_mark")))
    # Rows repeated as they are count once.
    sets = stored(_sets(texts.groupBy("doc_id", "mark", "id", "key").agg(F.min("text").alias("text"))))
    light = sets.select("id", "n", "keys")
    edges, known = None, None
    for first, last in ROUNDS:
        rows = light.select("id", "n", F.explode(F.slice("keys", first + 1, last - first)).alias("key"))
        found = _met(_first_chunk(_open(rows, known)), sets)
        edges = stored(found if edges is None else found.union(edges))
        known = components(edges)
        # Few keys have groups of more than two chunks; only their rows are looked at again.
        large = stored(rows.groupBy("key").agg(_chunks(F.sum("n")).alias("c")).where("c > 2").select("key"))
        if not large.isEmpty():
            rest = _open(rows.join(large, "key", "left_semi"), known)
            edges = stored(_met(_outsiders(rest), sets).union(edges))
            known = components(edges)
    # A component's mark is the number of its least set; a set that links with no other has its fingerprint.
    comps = chosen.join(known, "id", "left").select("key", "rep", F.coalesce("component", "id").alias("root"))
    names = comps.groupBy("root").agg(F.min("rep").alias("component"))
    comps = comps.join(names, "root").select(F.col("key").alias("_k"), "component", F.concat(F.lit(b"set "), F.col("root").cast("string").cast("binary")).alias("group"))
    comps = reps.join(comps, F.col("key") == F.col("_k"), "left")
    own = [F.when(F.col("_k").isNull(), F.col("rep")).otherwise(F.col("component")).alias("component"), F.coalesce("group", "key").alias("group")]
    comps = comps.select(F.col("key").alias("_key"), *own)
    rows = sig.join(comps, F.col("key") == F.col("_key"), "left")
    return rows.select("doc_id", "mark", "n", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component"), "group")


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document."""
    return labelled(docs).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one document of each group: the one with the least id, of those the one
    whose text has the least hash. An id comes before none. Documents with empty sets stay."""
    rows = stored(labelled(docs))
    of = rows.where("group IS NOT NULL")
    first = of.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("s")).select("s.doc_id", "s.mark")
    kept = first.unionByName(rows.where("group IS NULL").select("doc_id", "mark")).distinct().toDF("_kept_id", "_kept_mark")
    marked = docs.withColumn("_own_mark", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    same = lambda x: F.col("doc_id").cast("long").eqNullSafe(x["_kept_id"]) & (F.col("_own_mark") == x["_kept_mark"])
    marked = marked.join(kept, same(kept), "left_semi")
    # Rows repeated as they are, which seldom are, leave one.
    again = stored(of.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id", "mark").toDF("_kept_id", "_kept_mark"))
    if not again.isEmpty():
        once = marked.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "_own_mark"])
        marked = marked.join(again, same(again), "left_anti").unionByName(once)
    return marked.drop("_own_mark")


def sql() -> str:
    """The same result for the documents table in DuckDB's SQL, by all pairs that share a shingle."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r(id, other) AS (SELECT x, y FROM l UNION SELECT r.id, l.y FROM r JOIN l ON r.other = l.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(r.other), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.id = w.doc_id GROUP BY w.doc_id, n.n"""
