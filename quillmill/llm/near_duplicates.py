"""Near-duplicate records with small edits: pigeonhole blocks on sparse fingerprints.

The fingerprint of a text is a sparse bit vector with one bit for each distinct
run of `width` terms, addressed by a 64-bit hash.  Two texts with n and m bits have
Jaccard similarity >= t exactly if the Hamming distance of their fingerprints is
at most (1 - t) / (1 + t) * (n + m).

* Pigeonhole: with the bits of every text in one global order (rarest first), a
  pair that close must agree in at least SHARED of the first n - ceil(t * n) + SHARED
  bits of each (in as many as it has in common, where that is less); each of those bits is one block.  Blocks are joined on their
  address, and pairs that meet in fewer blocks are dropped.  The order comes
  from a count sketch over all texts, and any order gives the same
  result; rare bits first only keeps blocks small.
* A pair in a block counts only if sizes and positions allow the distance.
* Verification: the Hamming distance of folded parity fingerprints never
  exceeds the true distance, so it drops pairs without loss; what remains is
  decided on the whole bit sets.

Exact copies (equal bit sets) are one class and are compared as one record.  Whatever
gathers at one bit, one class or one group of copies is split over several keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.termhash import Terms, distinct_by_owner, mix64, shingle_hashes, small_batches
from quillmill.plans import skew
from quillmill.plans.components import connected_components
from quillmill.plans.skew import salted_join
from quillmill.plans.vectors import Shipped, fold_counts, fold_vectors

#: Bits counted by a cell of the sketch that orders them, on average, and the least and most cells (powers of two): what a task holds and is sent.
CELL_LOAD, LEAST_CELLS, MOST_CELLS = 24, 16, 24
#: Bits of the first folded fingerprint.
FOLD = 256
#: Blocks in which a pair must meet.
SHARED = 3
#: Bits of a block's address, and bits of its digest by which a class is addressed; blocks and classes that share one are told apart at verification.
ADDRESS_BITS, SLOT_BITS = 48, 40
#: Sizes from here on are written as this value, and such pairs skip the size and position tests.
BIG = (1 << 15) - 1
#: Blocks that may hold more rows than this are split over several keys.
HOT = 4096
#: Cells of the filter that names the slots still wanted, for each of them, and their most (a power of two): one bit each.
WANTED_LOAD, MOST_WANTED = 16, 27
#: Copies of one class that are paired by one task.
COPIES = 512

_FOLDS = [f"fold{k}" for k in range(FOLD // 64)]
_CLASSES = "rec_id string, group_hash bigint, slot bigint, digest binary, bits binary, " + ", ".join(f"{f} bigint" for f in _FOLDS)


def _fold(bits: np.ndarray) -> np.ndarray:
    """Parity of the bits in each of FOLD cells: distances of folds never exceed distances of the sets."""
    return np.packbits(np.bincount((bits % np.uint64(FOLD)).astype(np.int64), minlength=FOLD).astype(np.uint8) & 1).view(np.int64)


def _fingerprints(width: int, min_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in small_batches(batches, 2):
            texts = [t.lower() for t in batch.column(2).to_pylist()]
            terms = Terms(texts)
            values, owner = shingle_hashes(terms, width)
            fits = (terms.count >= max(min_terms, width))[owner] if len(owner) else owner.astype(bool)
            values, _, at = distinct_by_owner(values[fits], owner[fits], len(texts))
            keep, slots, digests, bits, folds = [], [], [], [], []
            for i in range(len(texts)):
                own = values[at[i] : at[i + 1]]
                if not len(own):
                    continue
                digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                keep.append(i)
                digests.append(digest)
                slots.append(int.from_bytes(digest[: SLOT_BITS // 8], "little"))
                # Copies beyond the first of this task need no second set of bits.
                bits.append(None if digest in seen else own.tobytes())
                folds.append(_fold(own))
                seen.add(digest)
            at_rows = pa.array(keep, pa.int64())
            table = np.array(folds, dtype=np.int64).reshape(len(folds), len(_FOLDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at_rows), batch.column(1).take(at_rows), pa.array(slots, pa.int64()), pa.array(digests, pa.binary()), pa.array(bits, pa.binary()), *(pa.array(table[:, k]) for k in range(len(_FOLDS)))],
                ["rec_id", "group_hash", "slot", "digest", "bits", *_FOLDS],
            )

    return run


def _addresses(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bits of a column of bit sets, and how many each row has."""
    raw = column.to_pylist()
    sizes = np.fromiter((len(x) // 8 for x in raw), dtype=np.int64, count=len(raw))
    return np.frombuffer(b"".join(raw), dtype=np.uint64), sizes


class Order:
    """How often bits occur, by cells of a sketch: a level for each cell (eight to a doubling) and what a cell counts on average."""

    def __init__(self, counts: np.ndarray):
        self.cell_bits, self.load, self.hot = int(len(counts)).bit_length() - 1, float(counts.mean()) if len(counts) else 0.0, HOT
        self._levels = Shipped(np.minimum(np.round(8 * np.log2(counts + 1.0)), 255).astype(np.uint8))

    def levels(self, bits: np.ndarray) -> np.ndarray:
        return self._levels.vector[(bits >> np.uint64(64 - self.cell_bits)).astype(np.int64)]

    def parts(self, levels: np.ndarray) -> np.ndarray:
        """Over how many keys the block of a bit is spread; what its cell counts besides is taken off."""
        return np.maximum(1, np.ceil((np.exp2(levels / 8) - 1 - 2 * self.load) / self.hot)).astype(np.int64)


def prefix_sizes(sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each size: bits needed as the smaller and as the larger side of a pair, and blocks in which a pair must meet (at most what it must have in common)."""
    least = np.ceil(threshold * sizes - 1e-9).astype(np.int64)
    shared = np.clip(least, 1, SHARED)
    wide = np.minimum(sizes, sizes - least + shared)
    narrow = np.minimum(sizes, sizes - np.ceil(2 * threshold / (1 + threshold) * sizes - 1e-9).astype(np.int64) + shared)
    return np.where(sizes < BIG, narrow, wide), wide, shared


def _blocks(order, threshold: float):
    """The pigeonhole blocks of each class as two numbers: (address, size, may be the larger side) and (slot, position, may be the smaller side).

    A hot bit's block is split: a row takes part as the smaller side under one key and as the larger side under every key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            slots = batch.column(0).to_numpy()
            values, sizes = _addresses(batch.column(1))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            level = order.value.levels(values)
            by = np.lexsort((values, level, owner))
            values, level = values[by], level[by]
            first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            position = np.arange(len(values)) - first[owner]
            narrow, wide, _ = prefix_sizes(sizes, threshold)
            use = np.flatnonzero(position < wide[owner])
            key, own, pos = values[use], owner[use], position[use]
            small, parts = pos < narrow[own], order.value.parts(level[use])
            hot = parts > 1
            rows = [(key[~hot], own[~hot], pos[~hot], small[~hot], np.ones(int((~hot).sum()), dtype=bool))]
            if hot.any():
                key, own, pos, small, parts = key[hot], own[hot], pos[hot], small[hot], parts[hot]
                salted = lambda a, k: mix64(a + mix64(k.astype(np.uint64) + np.uint64(1)))
                as_small = np.flatnonzero(small)
                with np.errstate(over="ignore"):
                    rows.append((salted(key[as_small], slots[own[as_small]] % parts[as_small]), own[as_small], pos[as_small], np.ones(len(as_small), dtype=bool), np.zeros(len(as_small), dtype=bool)))
                    every = np.repeat(np.arange(len(parts)), parts)
                    salt = np.arange(len(every)) - np.repeat(np.concatenate([[0], np.cumsum(parts)])[:-1], parts)
                    rows.append((salted(key[every], salt), own[every], pos[every], np.zeros(len(every), dtype=bool), np.ones(len(every), dtype=bool)))
            key, own, pos, small, large = (np.concatenate(x) for x in zip(*rows))
            address = (key >> np.uint64(64 - ADDRESS_BITS)).astype(np.int64)
            size, pos = np.minimum(sizes, BIG)[own], np.minimum(pos, BIG)
            yield pa.RecordBatch.from_arrays([pa.array((address << 16) | (size << 1) | large, pa.int64()), pa.array((slots[own] << 16) | (pos << 1) | small, pa.int64())], ["where", "who"])

    return run


def _wanted(cells, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy() & (size - 1)
            keep = (cells.value.vector[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield batch.filter(pa.array(keep.astype(bool)))

    return run


def _wide_fold(bits: np.ndarray, width: int) -> np.ndarray:
    return np.bincount((bits & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1


def _wide_folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A parity fingerprint with at least four cells for each bit of the set."""
    for batch in batches:
        folds, sizes = [], []
        for x in batch.column(2).to_pylist():
            bits = np.frombuffer(x, np.uint64)
            sizes.append(len(bits))
            folds.append(np.packbits(_wide_fold(bits, 1 << max(8, (4 * len(bits) - 1).bit_length())).astype(np.uint8)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(sizes, pa.int32()), pa.array(folds, pa.binary())], ["slot_a", "slot_b", "digest_a", "n_a", "fold_a"])


def _still_near(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = (1 - threshold) / (1 + threshold)
        for batch in batches:
            keep = []
            for n, fold, raw in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_pylist()):
                bits = np.frombuffer(raw, np.uint64)
                a = np.unpackbits(np.frombuffer(fold, np.uint8))
                keep.append(int((a != _wide_fold(bits, len(a))).sum()) <= limit * (n + len(bits)) + 1e-6)
            out = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([out.column(k) for k in range(4)], ["slot_a", "slot_b", "digest_a", "digest_b"])

    return run


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sims = [], []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                distance = len(np.setxor1d(a, b, assume_unique=True))
                both = (len(a) + len(b) - distance) // 2
                union = len(a) + len(b) - both
                if both >= threshold * union - 1e-9:
                    keep.append(i)
                    sims.append(both / union)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(sims, pa.float64())], ["digest_a", "digest_b", "similarity"])

    return run


class NearDuplicates:
    """Near-duplicate records of one table.

    Records are rows with a non-null id and text, at least `min_terms` terms and at
    least `width` terms; all others are in no pair.  Rows repeated under one id count
    once.  With `group_col`, pairs within one group (equal values) are left out; a null group
    equals no other.  Empty tables give empty results.  Extra columns are not read, so
    their names cannot clash.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, group_col: str | None = None, *, width: int = 5, threshold: float = 0.8, min_terms: int = 1):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must be in (0, 1]")
        self.threshold, self.spark = threshold, df.sparkSession
        # Groups are told apart by a 64-bit hash; a row without a group gets none.
        group = F.when(F.col(group_col).isNotNull(), F.xxhash64(F.col(group_col))) if group_col else F.lit(None).cast("bigint")
        rows = df.select(F.col(id_col).cast("string").alias("rec_id"), group.alias("group_hash"), F.col(text_col).cast("string").alias("text")).where("rec_id is not null and text is not null")
        self._kept: list[DataFrame] = []
        self._rows = self._keep(rows.mapInArrow(_fingerprints(width, min_terms), _CLASSES))
        # The first copy of a class in each task stands for it; what is left of repeats falls away with the pairs.
        self._firsts = self._rows.where("bits is not null")

    def _keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def _release(self, *done: DataFrame) -> None:
        """Let go of what later steps need no more."""
        for df in done:
            df.unpersist()
        self._kept = [k for k in self._kept if all(k is not d for d in done)]

    def close(self) -> None:
        """Release what was kept; to be called once results are written."""
        while self._kept:
            self._kept.pop().unpersist()

    @property
    def _width(self) -> int:
        """Partitions of what is kept; named as a number, they stay as they are and joins rely on them."""
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _members(self, *columns: str) -> tuple[DataFrame, DataFrame | None]:
        """(digest, columns), distinct, of all classes but those of very many copies, which lie together by digest; and of these few, if any, which lie spread."""
        rows, total = self._rows.select("digest", *columns), self._rows.count()
        cold, hot = rows, None
        if total > skew.KEY_ROWS:
            named = self._keep(skew.hot_keys(rows, "digest", total).select("digest"))  # at most skew.MOST_KEYS rows
            if not named.isEmpty():
                cold, hot = rows.join(F.broadcast(named), "digest", "left_anti"), self._keep(rows.join(F.broadcast(named), "digest").distinct())
        return self._keep(cold.repartition(self._width, "digest").distinct()), hot

    def _order(self) -> Order:
        total = self._firsts.agg(F.sum(F.length("bits"))).first()[0] or 0
        cell_bits = min(MOST_CELLS, max(LEAST_CELLS, (total // (8 * CELL_LOAD)).bit_length()))
        return Order(fold_counts(self._firsts.select("bits"), 1 << cell_bits, lambda batch: (_addresses(batch.column(0))[0] >> np.uint64(64 - cell_bits)).astype(np.int64)))

    def blocks(self) -> DataFrame:
        """(where, who): a row for each block of each class."""
        return self._firsts.select("slot", "bits").mapInArrow(_blocks(self.spark.sparkContext.broadcast(self._order()), self.threshold), "where bigint, who bigint")

    def candidates(self) -> DataFrame:
        """(slot_a, slot_b): pairs of class slots that meet in enough blocks, sizes and positions allowing; a is the smaller side."""
        t = self.threshold
        address = F.shiftrightunsigned("where", 16)
        # Kept partitioned and sorted by address, in a number of partitions that is named and so stays: both sides of the self-join read it as it is.
        blocks = self._blocks_kept = self._keep(self.blocks().repartition(self._width, address).sortWithinPartitions(address))
        bits = lambda c, shift, mask: F.shiftright(c, shift).bitwiseAND(F.lit(mask))
        side = lambda x: blocks.select(address.alias("block"), bits("where", 1, BIG).alias(f"size_{x}"), bits("where", 0, 1).alias(f"large_{x}"), F.shiftrightunsigned("who", 16).alias(f"slot_{x}"), bits("who", 1, BIG).alias(f"pos_{x}"), bits("who", 0, 1).alias(f"small_{x}"))
        sa, sb = F.col("size_a"), F.col("size_b")
        need = F.greatest(F.lit(1), F.least(F.lit(SHARED), F.ceil(F.lit(t) * sa - 1e-9))).cast("int")
        close = (sa >= F.lit(t) * sb - 1e-6) & (F.least(sa - F.col("pos_a"), sb - F.col("pos_b")) >= F.lit(t / (1 + t)) * (sa + sb) - need + 1 - 1e-6)
        ordered = (sa < sb) | ((sa == sb) & (F.col("slot_a") < F.col("slot_b")))
        plain = (sa < BIG) & (sb < BIG)
        joined = side("a").join(side("b"), "block").where("small_a = 1 and large_b = 1 and slot_a <> slot_b").where(F.when(plain, ordered & close).otherwise(F.col("slot_a") < F.col("slot_b")))
        # Sizes that were cut off tell no order of the sides, so such pairs need one block only.
        met = joined.groupBy("slot_a", "slot_b").agg(F.count(F.lit(1)).alias("met"), F.min(F.when(plain, need).otherwise(1)).alias("need"))
        return met.where("met >= need").select("slot_a", "slot_b")

    def _near(self) -> DataFrame:
        """(slot_a, slot_b) of the candidates whose folded fingerprints are close enough."""
        met = self._met = self._keep(self.candidates())
        total = met.count()
        self._release(self._blocks_kept)
        folds = self._folds = self._keep(self._firsts.select("slot", (F.length("bits") / 8).cast("int").alias("n"), *_FOLDS).repartition(self._width, "slot"))
        folded = lambda x: folds.select(F.col("slot").alias(f"slot_{x}"), F.col("n").alias(f"n_{x}"), *(F.col(f).alias(f"{f}_{x}") for f in _FOLDS))
        # A class with very many neighbours is spread by its neighbours.
        both = salted_join(salted_join(met, folded("a"), "slot_a", "slot_b", total), folded("b"), "slot_b", "slot_a", total, counted=met)
        distance = sum((F.bit_count(F.col(f"{f}_a").bitwiseXOR(F.col(f"{f}_b"))) for f in _FOLDS), F.lit(0))
        return both.where(distance <= F.lit((1 - self.threshold) / (1 + self.threshold)) * (F.col("n_a") + F.col("n_b")) + 1e-6).select("slot_a", "slot_b").distinct()

    def class_pairs(self) -> DataFrame:
        """(digest_a, digest_b, similarity): all pairs of different classes at or over the threshold."""
        near = self._keep(self._near())
        total = near.count()
        self._release(self._met, self._folds)
        size = 1 << min(MOST_WANTED, max(16, (WANTED_LOAD * total).bit_length()))

        def cells(batch: pa.RecordBatch) -> np.ndarray:
            named = np.zeros(size, dtype=np.uint8)
            for k in range(2):
                named[batch.column(k).to_numpy() & (size - 1)] = 1
            return np.packbits(named, bitorder="little")

        # Sets that no close pair needs stay where they are: the filter lets some too many through, never too few.
        wanted = self.spark.sparkContext.broadcast(Shipped(fold_vectors(near, size >> 3, cells, dtype="uint8", merge="bitwise_or")))
        sets = self._firsts.select("slot", "digest", "bits").mapInArrow(_wanted(wanted, size), "slot bigint, digest binary, bits binary")
        sets = self._keep(sets.repartition(self._width, "slot").groupBy("slot", "digest").agg(F.first("bits").alias("bits")))
        side = lambda x: sets.select(F.col("slot").alias(f"slot_{x}"), F.col("digest").alias(f"digest_{x}"), F.col("bits").alias(f"bits_{x}"))
        meet = lambda rows, x, y: salted_join(rows, side(x), f"slot_{x}", f"slot_{y}", total, counted=near)
        folds = meet(near, "a", "b").select("slot_a", "slot_b", "bits_a", "digest_a").mapInArrow(_wide_folds, "slot_a bigint, slot_b bigint, digest_a binary, n_a int, fold_a binary")
        still = meet(folds, "b", "a").select("slot_a", "slot_b", "digest_a", "digest_b", "n_a", "fold_a", "bits_b").mapInArrow(_still_near(self.threshold), "slot_a bigint, slot_b bigint, digest_a binary, digest_b binary")
        named = still.withColumnsRenamed({"digest_a": "da", "digest_b": "db"})
        # The digest is compared after the join: as a second key it would move every set again.
        equal = lambda x, y: (F.col(x) >= F.col(y)) & (F.col(x) <= F.col(y))
        whole = meet(meet(named, "a", "b").where(equal("digest_a", "da")), "b", "a").where(equal("digest_b", "db"))
        return whole.select("digest_a", "digest_b", "bits_a", "bits_b").mapInArrow(_verified(self.threshold), "digest_a binary, digest_b binary, similarity double")

    def pairs(self, per_copy: bool = True) -> DataFrame:
        """(id_a, id_b, similarity), id_a < id_b: all direct pairs of records, copies included.

        Every row of a class meets every other in the result; classes of many copies are cut into parts, and parts meet in tasks of their own.
        """
        m, hot = self._members("rec_id", "group_hash")
        counted = lambda df: df.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
        sizes = counted(m) if hot is None else counted(m).unionByName(counted(hot))
        links = self.class_pairs()
        if per_copy:
            links = links.unionByName(sizes.where("n > 1").select(F.col("digest").alias("digest_a"), F.col("digest").alias("digest_b"), F.lit(1.0).alias("similarity")))
        parts = self._keep(sizes.where(F.col("n") > COPIES).select("digest", F.ceil(F.col("n") / COPIES).cast("int").alias("parts")))
        member = lambda df, x: df.select(F.col("digest").alias(f"digest_{x}"), F.col("rec_id").alias(f"i{x}"), F.col("group_hash").alias(f"g{x}"), *(F.col(c).alias(f"{c}_{x}") for c in df.columns if c == "part"))
        if parts.isEmpty():
            across = links.join(member(m, "a"), "digest_a").join(member(m, "b"), "digest_b")
        else:
            for x in "ab":
                links = links.join(parts.select(F.col("digest").alias(f"digest_{x}"), F.col("parts").alias(f"parts_{x}")), f"digest_{x}", "left")
            links = self._keep(links)
            single = links.where("parts_a is null and parts_b is null").drop("parts_a", "parts_b")
            cut_up = links.where("parts_a is not null or parts_b is not null")
            for x in "ab":
                cut_up = cut_up.withColumn(f"part_{x}", F.explode(F.sequence(F.lit(0), F.coalesce(f"parts_{x}", F.lit(1)) - 1))).drop(f"parts_{x}")
            placed = m.join(parts, "digest", "left")
            if hot is not None:
                own = self._keep(counted(hot).select("digest", F.ceil(F.col("n") / COPIES).cast("int").alias("parts")))  # at most skew.MOST_KEYS rows
                placed = placed.unionByName(hot.join(F.broadcast(own), "digest"))
            placed = placed.withColumn("part", F.pmod(F.hash("rec_id"), F.coalesce("parts", F.lit(1))))
            across = single.join(member(m, "a"), "digest_a").join(member(m, "b"), "digest_b")
            across = across.unionByName(cut_up.join(member(placed, "a"), ["digest_a", "part_a"]).join(member(placed, "b"), ["digest_b", "part_b"]).drop("part_a", "part_b"))
        far = F.coalesce(F.col("ga") != F.col("gb"), F.lit(True))
        once = F.when(F.col("digest_a") == F.col("digest_b"), F.col("ia") < F.col("ib")).otherwise(F.col("ia") != F.col("ib"))
        across = across.where(once & far)
        return across.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"), "similarity").groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))

    def groups(self) -> DataFrame:
        """One row per record: (rec_id, group_id, copies, links).

        group_id is the least record id of the connected group, copies the number of records
        of the same class (itself included), links the number of other classes at or over the
        threshold.  Groups take no notice of `group_col`.
        """
        edges = self._keep(self.class_pairs().select(F.col("digest_a").alias("src"), F.col("digest_b").alias("dst")))
        m, hot = self._members("rec_id")
        sized = lambda df: df.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("rec_id").alias("least"))
        sizes = self._keep(sized(m))
        every = sizes if hot is None else sizes.unionByName(self._keep(sized(hot)))
        # Only classes with neighbours take part in components; all others are groups of their own.
        degree = edges.select(F.col("src").alias("digest")).unionAll(edges.select(F.col("dst").alias("digest"))).groupBy("digest").agg(F.count(F.lit(1)).alias("links"))
        linked = connected_components(edges, "src", "dst").withColumnRenamed("node", "digest").join(degree, "digest").join(every.select("digest", "least"), "digest")
        linked = self._keep(linked)
        heads = linked.groupBy("component").agg(F.min("least").alias("group_id"))
        named = linked.join(heads, "component").select("digest", "group_id", "links")
        rows = m.join(sizes, "digest").join(named, "digest", "left")
        if hot is not None:
            few = sized(hot).join(named, "digest", "left")  # at most skew.MOST_KEYS rows
            rows = rows.unionByName(hot.join(F.broadcast(few), "digest"))
        return rows.select("rec_id", F.coalesce("group_id", "least").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, group_col: str | None = None, **options) -> DataFrame:
    """Shorthand for NearDuplicates(...).pairs()."""
    return NearDuplicates(df, id_col, text_col, group_col, **options).pairs()
