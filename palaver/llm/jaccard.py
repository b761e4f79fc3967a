"""Near-duplicate documents by an exact, size-aware, heavy-light Jaccard join on word shingles.

Sets are the distinct 5-word shingles of a text (54-bit hashes). A set's content hash names its class: rows with equal sets
are one class from the start, so copies never meet in pairs.

Order. One pass counts in how many texts each shingle stands (two bytes a shingle travel); those in more
than ``hot_df`` texts, the ``most_hot`` most frequent of them if there are more, come last in the order of their counts,
all others come first in the order of their hashes. This one order holds for all sets and never changes; any order gives
the same links, this one gives short lists.

Candidates. Two sets that link share a shingle among their first p = n - ceil(0.75 n) + 1 shingles in the common order, and
two among the first p + 1 (their overlap is at least ceil(0.75 n)).

* light sets (n up to a boundary) enumerate the 2-subsets of that longer prefix; a subset is a key of its own;
* heavy sets, and light ones that a heavy set can reach (n >= 0.75 (boundary + 1)), stand in the inverted lists of the
  single shingles of the shorter prefix, with their places: at the first shingle that two linked sets share, neither has
  too little left behind it to reach the overlap, so pairs with less are not made;
* the boundary minimises the rows written plus the list entries scanned, from the histogram of small sizes and the mean
  list length measured on small sets.

Lists. One shuffle deals and sorts the keys, entries without their sets or sketches. Lists up to ``short`` give their pairs
where they lie. Longer lists come out as they are; their entries meet the sets' sketches and are dealt in pairs of blocks,
so no pairs of a long list are made in one task, and only pairs that their sketches let pass come out. A sketch holds, at each of 4 n or so places, the parity of the shingles hashed there;
two sketches differ in at most as many places as the sets differ in shingles, so nothing that links is lost.

Links. First each set meets the first set that its lists and sketches offer, of a long list's first block; exact overlaps of
whole sets give components. Then all offers between different components are verified: blocks of one component never meet,
so a cluster of any size is dealt about as often as there are blocks of others. A pair inside a component can not change it, so the result is
that of all pairs.

Defined cases: null, empty and blank texts have no shingles and link with nothing; fewer than five words are one shingle;
each row is a document of its own, also where rows share an id or have none (such a row alone has a null component);
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import Scratch, freed, mix64
from palaver.llm.components import connected_components
from palaver.llm.prints import SPREAD, counted, spread
from palaver.llm.shingles import BITS, K, contents, shingle_sets, slices

NUM, DEN = 3, 4  # similarity 0.75
_ONE = np.uint64(1 << 63)  # set in keys of single shingles


def overlap_least(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n has in common with any set it links with."""
    return -(-NUM * n // DEN)


def overlap_of(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The least overlap of linked sets of n and m."""
    return -(-NUM * (n + m) // (NUM + DEN))


def _prints(g: np.ndarray, bits: int) -> np.ndarray:
    return g >> np.uint64(BITS - bits)


def _counted_once(bits: int):
    """Of (text): the prints of the shingles of each text; copies in a task count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def prints() -> Iterator[np.ndarray]:
            for b in batches:
                for _, texts in slices(b, 0):
                    g, cut = shingle_sets(texts)
                    yield from (_prints(g[cut[i] : cut[i + 1]], bits) for i, c in enumerate(contents(g, cut).tolist()) if c not in seen and not seen.add(c))
                    if len(seen) > 500_000:
                        seen.clear()

        yield from spread(prints(), bits)

    return run


def frequent(docs: DataFrame, least: int, most: int, bits: int) -> np.ndarray:
    """Prints of the shingles in more than ``least`` texts, at most ``most``, the most frequent last. A print is the upper
    ``bits`` of a hash; shingles of one print share its place in the order, which is the same for all sets."""
    counts = counted(docs.select("text").mapInArrow(freed(_counted_once(bits)), SPREAD), bits, least + 1)
    got = counts.orderBy(F.desc("count"), "number").limit(most).toArrow()
    return got.column("number").to_numpy()[::-1].astype(np.uint64)


def sketch_places(n: int, most: int = 1 << 14) -> int:
    return min(most, max(64, 1 << (4 * n - 1).bit_length()))


def _prefixes(hot: np.ndarray, bits: int):
    """Of (doc_id, text): doc_id, n, set (its number), prefix (p + 1 shingles in the common order), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(hot)
        known, rank = hot[order], order + 1
        for b in batches:
            for x, texts in slices(b, 1):
                g, cut = shingle_sets(texts)
                n = np.diff(cut)
                row = np.repeat(np.arange(len(n)), n)
                own = g
                if len(known):
                    p = _prints(g, bits)
                    at = np.minimum(np.searchsorted(known, p), len(known) - 1)
                    late = np.where(known[at] == p, rank[at], 0)
                    mixed = np.flatnonzero(np.isin(row, row[late > 0]))
                    own = g.copy()
                    own[mixed] = g[mixed][np.lexsort((late[mixed], row[mixed]))]
                take = np.minimum(n, n - overlap_least(n) + 2)
                place = mix64(g + np.uint64(1))
                sketches = []
                for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    m = sketch_places(e - s)
                    parity = np.bincount((place[s:e] & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
                    sketches.append(np.packbits(parity.astype(np.uint8), bitorder="little").tobytes() if e > s else b"")
                yield pa.RecordBatch.from_arrays(
                    [x.column(0), pa.array(n.astype(np.int64)), pa.array(contents(g, cut)), pa.array([own[s : s + t].tobytes() for s, t in zip(cut[:-1], take, strict=True)], pa.binary()), pa.array(sketches, pa.binary())],
                    ["doc_id", "n", "set", "prefix", "sketch"],
                )

    return run


def _keys(boundary: int):
    """Of (set, n, prefix): rows (key, place, set), place being n and, for single shingles, the position among the set's
    shingles, as one number. A task gives a set's keys once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            keys, places, sets = [], [], []
            for c, n, prefix in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if c in seen:
                    continue
                seen.add(c)
                t = np.frombuffer(prefix, dtype=np.uint64)
                if n <= boundary:
                    i, j = np.triu_indices(len(t), 1)
                    keys.append(mix64(mix64(np.minimum(t[i], t[j])) * K + np.maximum(t[i], t[j])) & ~_ONE)
                    places.append(np.full(len(i), n << 32, dtype=np.int64))
                    sets.append(np.full(len(i), c, dtype=np.int64))
                if n > boundary or NUM * (boundary + 1) <= DEN * n:
                    k = len(t) - 1
                    keys.append(t[:k] | _ONE)
                    places.append((n << 32) + np.arange(k, dtype=np.int64))
                    sets.append(np.full(k, c, dtype=np.int64))
            if len(seen) > 500_000:
                seen.clear()
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(places)), pa.array(np.concatenate(sets))], ["key", "place", "set"])

    return run


def may_link(place_a: np.ndarray, place_b: np.ndarray) -> np.ndarray:
    """Whether sets that first meet at these places can link: by their sizes and by what is left behind the places."""
    n, m = place_a >> 32, place_b >> 32
    left = np.minimum(n - (place_a & 0xFFFFFFFF), m - (place_b & 0xFFFFFFFF))
    return (DEN * np.minimum(n, m) >= NUM * np.maximum(n, m)) & (left >= overlap_of(n, m))


class _Distinct:
    """Collects pairs and gives each once for every ``most`` of them."""

    def __init__(self, most: int = 400_000) -> None:
        self.most, self.size, self.held = most, 0, []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.held.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            self.size += len(a)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        x = np.concatenate(self.held, axis=1) if self.held else np.zeros((2, 0), dtype=np.int64)
        self.held, self.size = [], 0
        x = x[:, np.lexsort(x)]
        new = np.ones(x.shape[1], dtype=bool)
        new[1:] = (x[:, 1:] != x[:, :-1]).any(axis=0)
        return x[0, new], x[1, new]


def _meet(short: int):
    """Of rows (key, place, set) sorted so: pairs (null, a, b) of lists up to ``short``, entries (key, place, set) of longer
    ones. Holds back one list's start at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        last, long_key = None, None
        found = _Distinct()

        def rows(key, a, b) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([None] * len(a), pa.int64()) if key is None else pa.array(key), pa.array(a), pa.array(b)], ["key", "a", "b"])

        def close(cols: list[np.ndarray], end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, long_key
            key, place, c = cols
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([begin, [len(key)]]))
            lot = np.repeat(size > short, size) | (key == long_key if long_key is not None else False)
            use = np.ones(len(key), dtype=bool)
            if not end:  # the last list may go on
                if lot[-1]:
                    long_key = key[-1]
                else:
                    use[begin[-1] :] = False
                    held = [x[begin[-1] :] for x in cols]
            if (lot & use).any():
                yield rows(key[lot & use], place[lot & use], c[lot & use])
            left = np.repeat(begin + size, size) - np.arange(len(key)) - 1
            left[lot | ~use] = 0
            at, d = np.flatnonzero(left >= 1), 1
            while len(at):
                ok = may_link(place[at], place[at + d])
                found.add(c[at[ok]], c[at[ok] + d])
                d += 1
                at = at[left[at] >= d]
            if found.size >= found.most or (end and found.size):
                yield rows(None, *found.take())

        for b in batches:
            cols = [x.to_numpy(zero_copy_only=False) for x in b.columns]
            if not len(cols[0]):
                continue
            new = np.ones(len(cols[0]), dtype=bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[2][1:] != cols[2][:-1])
            new[0] = (int(cols[0][0]), int(cols[2][0])) != last
            last = (int(cols[0][-1]), int(cols[2][-1]))
            cols = [x[new] for x in cols]
            if held is not None:
                cols, held = [np.concatenate([h, x]) for h, x in zip(held, cols, strict=True)], None
            if len(cols[0]):
                yield from close(cols, False)
        if held is not None:
            cols, held = held, None
            yield from close(cols, True)
        elif found.size:
            yield rows(None, *found.take())

    return run


class Sketches:
    """The sketches of some sets, at each size and folded to half of it."""

    def __init__(self, sketches: list[bytes]) -> None:
        self.size = np.array([len(s) // 8 for s in sketches], dtype=np.int64)
        self.at = np.zeros(len(sketches), dtype=np.int64)
        self.half = np.zeros(len(sketches), dtype=np.int64)
        grown: dict[int, list[np.ndarray]] = {}
        for m in np.unique(self.size[self.size > 0]).tolist():
            own = np.flatnonzero(self.size == m)
            x = np.frombuffer(b"".join(sketches[i] for i in own), dtype=np.uint64).reshape(len(own), m)
            for size, y, into in ((m, x, self.at), (m // 2, x[:, : m // 2] ^ x[:, m // 2 :], self.half)):
                if size:
                    into[own] = sum(map(len, grown.get(size, []))) + np.arange(len(own))
                    grown.setdefault(size, []).append(y)
        self.of = {m: np.concatenate(x) for m, x in grown.items()}

    def pass_(self, i: np.ndarray, j: np.ndarray, n: np.ndarray, m: np.ndarray, step: int = 1 << 22) -> np.ndarray:
        """Which pairs of sets (sizes n and m) can link: their sketches differ in no more places than the sets may."""
        out = np.ones(len(i), dtype=bool)
        low = np.minimum(self.size[i], self.size[j])
        may = n + m - 2 * overlap_of(n, m)
        for size in np.unique(low).tolist():
            own = np.flatnonzero(low == size)
            for k in range(0, len(own), max(1, step // max(size, 1))):
                x = own[k : k + max(1, step // max(size, 1))]
                a, b = (np.where(self.size[y[x]] == size, self.at[y[x]], self.half[y[x]]) for y in (i, j))
                out[x] = np.bitwise_count(self.of[size][a] ^ self.of[size][b]).sum(axis=1, dtype=np.int64) <= may[x]
        return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, na, nb, sa, sb): the pairs whose sketches let them pass."""
    for b in batches:
        if len(b):
            m = len(b)
            both = Sketches(b.column(4).to_pylist() + b.column(5).to_pylist())
            n = [b.column(k).to_numpy() for k in (2, 3)]
            ok = both.pass_(np.arange(m), np.arange(m) + m, *n)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], ["a", "b"])


def _offers(first_only: bool):
    """Of long lists' entries (bucket, lo, hi, key, part, place, set, component, sketch) sorted by their first three: pairs
    of different components that can link; with ``first_only`` each set's first one in each list."""

    def group(rows: list[pa.Array], found: _Distinct) -> None:
        (lo, hi), key = (int(rows[k][0].as_py()) for k in (1, 2)), rows[3].to_numpy()
        part, place, c, component = (x.to_numpy() for x in rows[4:8])
        sketches = Sketches(rows[8].to_pylist())
        for own in (np.flatnonzero(key == k) for k in np.unique(key)):  # a bucket is a hash of the key
            left, right = (own[part[own] == p] for p in (lo, hi))
            for k in range(0, len(left), 256):
                i = np.repeat(left[k : k + 256], len(right))
                j = np.tile(right, len(left[k : k + 256]))
                ok = (i < j if lo == hi else i >= 0) & (component[i] != component[j])
                i, j = i[ok], j[ok]
                ok = may_link(place[i], place[j])
                i, j = i[ok], j[ok]
                ok = sketches.pass_(i, j, place[i] >> 32, place[j] >> 32)
                i, j = i[ok], j[ok]
                if first_only:
                    # of sets in the order (place, number) the later one takes the first that it is offered
                    later = np.where((place[i] < place[j]) | ((place[i] == place[j]) & (c[i] < c[j])), j, i)
                    earlier = i + j - later
                    order = np.lexsort((c[earlier], place[earlier], later))
                    i, j = earlier[order], later[order]
                    new = np.ones(len(j), dtype=bool)
                    new[1:] = j[1:] != j[:-1]
                    i, j = i[new], j[new]
                found.add(c[i], c[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        found = _Distinct()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found.take()], ["a", "b"])

        def close() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            if len(t):
                group([c.chunk(0) for c in t.columns], found)

        for b in batches:
            if not len(b):
                continue
            x = np.stack([b.column(k).to_numpy() for k in range(3)])
            begin = [0, *(np.flatnonzero((x[:, 1:] != x[:, :-1]).any(axis=0)) + 1).tolist(), len(b)]
            for s, e in zip(begin[:-1], begin[1:], strict=True):
                if held and tuple(x[:, s]) != tuple(held[0].column(k)[0].as_py() for k in range(3)):
                    close()
                    held = []
                    if found.size >= found.most:
                        yield out()
                held.append(b.slice(s, e - s))
        if held:
            close()
        if found.size:
            yield out()

    return run


def wanted_bits(sets: DataFrame, most: int = 1 << 27) -> np.ndarray:
    """Bits of the numbers in ``set``: 16 places for each, at most ``most`` (16 MB) whatever the input."""
    bits = min(most, max(1 << 16, 1 << (16 * sets.count()).bit_length()))
    at = F.pmod("set", F.lit(bits))
    rows = sets.select(at.alias("at")).groupBy((F.col("at") / 32768).cast("int").alias("b")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits")).toArrow()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for b, x in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
        out[b * 4096 : (b + 1) * 4096] = np.frombuffer(x, dtype=np.uint8)
    return out


def _sets_of(wanted: np.ndarray):
    """Of (text): (set, shingles) of sets that may be wanted; a task gives each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for _, texts in slices(b, 0):
                g, cut = shingle_sets(texts)
                c = contents(g, cut)
                at = c & (8 * len(wanted) - 1)
                hit = np.flatnonzero((wanted[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                new = [i for i in hit.tolist() if c[i] not in seen and not seen.add(c[i])]
                if len(seen) > 500_000:
                    seen.clear()
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array(c[new]), pa.array([g[cut[i] : cut[i + 1]].tobytes() for i in new], pa.binary())], ["set", "shingles"])

    return run


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, shingles_a, shingles_b): the pairs that link."""
    for b in batches:
        keep = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(both > 0 and 100 * both >= 75 * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), b.column(1).filter(pa.array(keep, pa.bool_()))], ["a", "b"])


class JaccardJoin:
    """One run over (doc_id, text); ``result`` has a row per document."""

    def __init__(self, docs: DataFrame, hot_df: int = 64, most_hot: int = 500_000, most_light: int = 48, short: int = 64, block: int = 1024, print_bits: int = 32) -> None:
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.scratch = Scratch(self.spark, "jaccard")
        self.hot_df, self.most_hot, self.most_light, self.short, self.block, self.print_bits = hot_df, most_hot, most_light, short, block, print_bits

    def _boundary(self) -> int:
        """The size up to which sets enumerate subsets, by rows written and list entries scanned."""
        small = self.sets.where(F.col("n").between(3, self.most_light * 2))
        sizes = {r.n: r["count"] for r in small.groupBy("n").count().collect()}  # a row for each small size
        lists = small.select("set", "n", "prefix").mapInArrow(freed(_keys(0)), "key long, place long, set long").groupBy("key").count()
        met = lists.agg(F.sum(F.col("count") * F.col("count")), F.sum("count")).first()
        scan = (met[0] or 1) / (met[1] or 1)

        def cost(x: int) -> float:
            total = 0.0
            for n, c in sizes.items():
                p = n - int(overlap_least(np.int64(n))) + 1
                total += c * p * (p + 1) / 2 if n <= x else 0
                total += c * p * (1 + scan) if n > x or NUM * (x + 1) <= DEN * n else 0
            return total

        return min(range(self.most_light + 1), key=cost)

    def _met(self) -> DataFrame:
        """(key, a, b): pairs of short lists where key is null, entries (key, place, set) of long ones else."""
        self.boundary = self._boundary()
        rows = self.sets.where("n > 2").select("set", "n", "prefix").mapInArrow(freed(_keys(self.boundary)), "key long, place long, set long")
        return self.scratch.write(rows.repartition("key").sortWithinPartitions("key", "place", "set").mapInArrow(freed(_meet(self.short)), "key long, a long, b long"), "met")

    def _offered(self, entries: DataFrame, components: DataFrame | None, first_only: bool) -> DataFrame:
        """Pairs (a, b) of long lists between different components."""
        return self._dealt(entries, components, first_only).mapInArrow(freed(_offers(first_only)), "a long, b long").distinct()

    def _dealt(self, entries: DataFrame, components: DataFrame | None, first_only: bool) -> DataFrame:
        """Entries of long lists in the pairs of blocks (bucket, lo, hi) that are to meet."""
        own = entries.join(self.sketches, "set")
        if components is None:
            own = own.withColumn("component", F.col("set"))
        else:
            own = own.join(components.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
        if first_only:
            # each block meets the list's first block only, so every entry is dealt once and the first block's once a block
            sizes = own.groupBy("key").agg(F.count("*").alias("entries"))
            own = own.join(sizes.select("key", F.ceil(F.col("entries") / self.block).cast("int").alias("parts")), "key")
            own = own.withColumn("part", F.pmod(F.xxhash64("set"), "parts").cast("int"))
            others = F.when(F.col("part") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0)))
        else:
            # a component with many entries of a list has blocks of its own, which meet those of others only; the rest share blocks
            groups = own.groupBy("key", "component").agg(F.count("*").alias("n")).withColumn("own_parts", F.when(F.col("n") > self.block // 2, F.ceil(F.col("n") / self.block).cast("int")))
            keys = groups.groupBy("key").agg(F.coalesce(F.sum(F.when(F.col("own_parts").isNull(), F.col("n"))), F.lit(0)).alias("shared"), F.coalesce(F.sum("own_parts"), F.lit(0)).alias("apart"), F.count("*").alias("several")).where("several > 1")
            keys = keys.select("key", F.ceil(F.col("shared") / self.block).cast("int").alias("pool"), (F.ceil(F.col("shared") / self.block) + F.col("apart")).cast("int").alias("parts"))
            before = Window.partitionBy("key").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
            large = groups.where("own_parts is not null").select("key", "component", "own_parts", F.coalesce(F.sum("own_parts").over(before), F.lit(0)).cast("int").alias("offset"))
            own = own.join(keys, "key").join(large, ["key", "component"], "left").withColumn("begin", F.col("pool") + F.col("offset"))
            h, within = F.xxhash64("set"), F.col("own_parts")
            own = own.withColumn("part", F.when(within.isNotNull(), F.col("begin") + F.pmod(h, within)).otherwise(F.pmod(h, F.greatest("pool", F.lit(1)))).cast("int"))
            others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: within.isNull() | (x < F.col("begin")) | (x >= F.col("begin") + within))
        own = own.withColumn("other", F.explode(others))
        own = own.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other")).withColumn("bucket", F.xxhash64("key"))
        return own.select("bucket", "lo", "hi", "key", "part", "place", "set", "component", "sketch").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

    def _verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose whole sets link."""
        both = pairs.join(self.whole.select(F.col("set").alias("a"), F.col("shingles").alias("x")), "a").join(self.whole.select(F.col("set").alias("b"), F.col("shingles").alias("y")), "b")
        return self.scratch.write(both.select("a", "b", "x", "y").mapInArrow(freed(_linked), "a long, b long"), name)

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id."""
        scratch = self.scratch
        self.hot = frequent(self.docs, self.hot_df, self.most_hot, self.print_bits)
        self.sets = scratch.write(self.docs.mapInArrow(freed(_prefixes(self.hot, self.print_bits)), "doc_id long, n long, set long, prefix binary, sketch binary"), "sets")
        met = self._met()
        slim = scratch.write(self.sets.select("doc_id", "n", "set"), "slim")
        pairs = met.where("key is null").select("a", "b").distinct()
        entries = met.where("key is not null").select("key", F.col("a").alias("place"), F.col("b").alias("set"))
        nodes = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).union(entries.select("set")).distinct()
        self.sketches = scratch.write(self.sets.select("set", "n", "sketch").join(nodes, "set", "left_semi").dropDuplicates(["set"]), "sketches").select("set", "sketch", "n")
        scratch.drop("sets")
        a, b = (self.sketches.select(F.col("set").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
        near = scratch.write(pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(freed(_sketched), "a long, b long"), "near")
        self.sketches = self.sketches.select("set", "sketch")
        long_lists = not entries.isEmpty()
        first = near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        if long_lists:
            first = first.union(self._offered(entries, None, True)).distinct()
        first = scratch.write(first, "first")
        ends = near.select(F.col("a").alias("set")).union(near.select("b")).union(entries.select("set")).distinct()
        found = self.docs.select("text").mapInArrow(freed(_sets_of(wanted_bits(ends))), "set long, shingles binary")
        self.whole = scratch.write(found.join(ends, "set", "left_semi").dropDuplicates(["set"]), "whole")
        links = self._verified(first, "links")
        component = scratch.write(connected_components(links, scratch), "components")
        a, b = (component.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
        rest = near.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
        if long_lists:
            rest = rest.union(self._offered(entries, component, False)).distinct()
        more = self._verified(rest.join(first, ["a", "b"], "left_anti"), "more")
        scratch.drop("met", "near", "first", "whole", "sketches", "links")
        joined = component.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
        final = connected_components(joined, Scratch(self.spark, "jaccard-components")).withColumnRenamed("node", "set")
        # classes name their component by a hash; the smallest doc_id of its rows is its id
        placed = slim.join(final, "set", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "set").alias("component"))
        least = placed.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
        alone = placed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return placed.where("n_shingles > 0").join(least, "component").select("doc_id", "n_shingles", F.col("least").alias("component_id")).unionByName(alone)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of (doc_id, text)."""
    return JaccardJoin(docs).result()


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(words[i:i + 4], ' ')) AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
z AS (SELECT doc_id, count(*) AS n, bit_xor(hash(g)) AS x, sum(hash(g, 7)::HUGEINT) AS y FROM s GROUP BY doc_id),
c AS (SELECT n, x, y, min(doc_id) AS rep FROM z GROUP BY n, x, y),
k AS (SELECT s.doc_id, g FROM s JOIN c ON c.rep = s.doc_id),
df AS (SELECT g, count(*) AS f FROM k GROUP BY g HAVING count(*) > 1),
o AS (SELECT k.doc_id, k.g, z.n, row_number() OVER (PARTITION BY k.doc_id ORDER BY coalesce(f, 1), k.g) AS pos
      FROM k JOIN z USING (doc_id) LEFT JOIN df USING (g)),
p AS (SELECT doc_id, g, n FROM o JOIN df USING (g) WHERE pos <= n - (3 * n + 3) // 4 + 1),
q AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb
      FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)),
e AS (SELECT q.a, q.b FROM q JOIN k i ON i.doc_id = q.a JOIN k j ON j.doc_id = q.b AND j.g = i.g
      GROUP BY q.a, q.b, na, nb HAVING 100 * count(*) >= 75 * (na + nb - count(*))),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, least(a, min(b)) AS component FROM r GROUP BY a)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(m.component, c.rep, d.doc_id) AS component_id
FROM documents d LEFT JOIN z USING (doc_id) LEFT JOIN c ON c.n = z.n AND c.x = z.x AND c.y = z.y LEFT JOIN m ON m.a = c.rep
"""
