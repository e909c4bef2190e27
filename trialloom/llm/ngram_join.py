"""Exact Jaccard self-join of word n-gram sets, with prefix filters under several global token orders.

Equal sets are one node from the start, so copies cost nothing further. The n-grams of all documents are counted as
packed sorted arrays, and those that occur twice or more are written as a hash table with their frequency. The global
orders put n-grams of one document first and frequent ones last, so the prefix of a text that resembles no other holds
nothing that could be shared, and it is no candidate. Two sets of similarity t or more share a token among the first
``n - ceil(t n) + 1`` of each, under every order. The first order finds candidates; every candidate, whoever it was
found by, then has to share a token under each of the others, which is told from the prefixes alone. Whole sets are
joined to the pairs that remain, and verified.

Links are wanted as components, which saves pairs: in a bucket of sets that share a prefix token, members are first
compared with one leader only, the most central one (its shingles are the most frequent), then with another leader in
each bucket. Whatever is then in the same component needs no more comparisons. Between members of different components
every pair is compared, once, unless a sketch rules it out: a set's shingles mark bits of a short map, and each bit that
only one of two maps has is a shingle that the other set lacks. So no link between different components is missed.

The links of a set are counted last, when components are known: those within its component, as no others are left. The
sets of a component are dealt over blocks by hash, and a task compares all sets of two blocks, so a large component is
work for many tasks and no pair ever becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trialloom.llm.components import connected
from trialloom.llm.hash_tables import (
    BITS, Shelf, SortedTable, bucket_of, fill_gaps, hash_table, new_shelf, split_by_bucket, summed, unpack,
)
from trialloom.llm.text import WordHashes, small_batches, word_blocks
from trialloom.session import materialise

#: Shingles counted together by a task before they are sent.
CHUNK = 1_000_000
#: Salts of the global orders; the first finds candidates, the others filter them.
ORDERS = (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x3C6EF372FE94F82B)
#: 64-bit words of a sketch.
SKETCH = 16
LEADER_ROUNDS = 2
#: Sets, and shingles of sets, in a block of a component whose links are counted.
BLOCK_SETS = 256
BLOCK_SHINGLES = 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chain(h: np.ndarray, width: int) -> np.ndarray:
    value = np.full(max(0, len(h) - width + 1), width, dtype=np.uint64)
    for i in range(width if len(value) else 0):
        value = _mix(value * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return value


def shingle_sets(texts: list, k: int, hashes: WordHashes) -> Iterator[list[np.ndarray]]:
    """In blocks of texts, the sorted distinct 64-bit hashes of each text's ``k``-word shingles; all words as one shingle if they are fewer."""
    for _, _, offsets, h in word_blocks(texts, hashes):
        value = _chain(h, k)
        ends = zip(offsets[:-1].tolist(), offsets[1:].tolist())
        yield [np.unique(value[a : b - k + 1]) if b - a >= k else _chain(h[a:b], b - a) if b > a else h[:0] for a, b in ends]


def set_hash(found: np.ndarray) -> int:
    """64 bits that stand for a set; 0 for the empty one."""
    return (xxhash.xxh3_64_intdigest(found.tobytes()) or 1) - (1 << 63) if len(found) else 0


@dataclass
class Frequencies:
    """Logarithms of the frequencies of shingles, from a table of those that occur twice or more."""

    shelf: Shelf
    buckets: int
    opened: dict = field(default_factory=dict)

    def levels(self, sets: list[np.ndarray]) -> list[np.ndarray]:
        """For each set, 0 for a shingle that occurs once, else 1 and more."""
        keys = short_keys(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        bucket, found = bucket_of(keys, self.buckets), np.zeros(len(keys), dtype=np.uint64)
        order = np.argsort(bucket, kind="stable")
        at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for a, b in zip(at, [*at[1:], len(order)]):
            rows = order[a:b]
            number = int(bucket[rows[0]])
            if number not in self.opened:
                table = SortedTable(self.shelf, str(number))
                self.opened[number] = (table, table.values("level"))
            table, level = self.opened[number]
            place = table.find(keys[rows])
            found[rows[place >= 0]] = level[place[place >= 0]]
        return np.split(found, np.cumsum([len(s) for s in sets])[:-1]) if sets else []


def short_keys(shingles: np.ndarray) -> np.ndarray:
    return shingles >> np.uint64(64 - BITS)


def _shared_prefix(found: np.ndarray, level: np.ndarray, salt: int, percent: int) -> np.ndarray:
    """The first tokens of a set under the order of ``salt``, rare before frequent, then by a salted hash, but for those
    of one text only, which are shared with none."""
    length = len(found) - -(-percent * len(found) // 100) + 1
    order = _mix(found ^ np.uint64(salt)) >> np.uint64(8) | level << np.uint64(56)
    at = np.argpartition(order, length - 1)[:length] if length < len(found) else np.arange(len(found))
    return found[at][level[at] > 0]


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", report: dict[str, int] | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``n_links`` and ``component_id``.

    Two rows link when the Jaccard similarity of their sets is ``percent`` / 100 or more; ``component_id`` is the
    smallest id that links lead to. ``n_links`` counts the different sets that the row's set links with; copies of a set
    count once. Texts without words have an empty set, no link and their own id as component.
    Repeated rows are copies of each other; a null id is never the smallest, and a component of null ids only has a
    null id. An empty table gives no rows. Other columns are not read. A dict given as
    ``report`` receives how many pairs the first order proposed and how many each further order left.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = to_arrow_schema(rows.schema).field("id").type
    schema = StructType([rows.schema["id"], *StructType.fromDDL("set_id long, n long, bucket int, part binary").fields])
    names = [f.name for f in schema]
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, -(-chars // 6_000_000))
    shelf = new_shelf(docs.sparkSession, "shingles")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHashes(), [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            parts = list(split_by_bucket(bucket_of(keys, buckets), [keys], counts))
            n = len(parts)
            columns = [pa.array([b for b, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())]
            return pa.RecordBatch.from_arrays([pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *columns], names)

        for batch in batches:
            found, sizes = [], []
            for sets in shingle_sets(batch.column("text").to_pylist(), k, hashes):
                found += [set_hash(s) for s in sets]
                sizes += [len(s) for s in sets]
                held.append(short_keys(np.concatenate(sets)))
                size += len(held[-1])
                if size >= CHUNK:
                    yield flush()
                    held, size = [], 0
            n = len(found)
            columns = [pa.array(found, pa.int64()), pa.array(sizes, pa.int64()), pa.array([-1] * n, pa.int32()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(id_type), *columns], names)
        if size:
            yield flush()

    described = materialise(rows.mapInArrow(describe, schema), "sets")
    found = described.where("bucket < 0").select("id", "set_id", "n")

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        got = [unpack(p, 1) for p in parts["part"]]
        (keys,), counts = summed([np.concatenate([g[0][0] for g in got])], np.concatenate([g[1] for g in got]))
        often = counts > 1
        SortedTable.write(shelf, str(key[0]), keys[often], level=np.minimum(2 * np.log2(counts[often]), 255).astype(np.uint8))
        return pd.DataFrame({"bucket": [key[0]]})

    parts = described.where("bucket >= 0").select("bucket", "part")
    made = parts.groupBy("bucket").applyInPandas(merge, "bucket int").toPandas()
    fill_gaps(shelf, buckets, made["bucket"], level=np.zeros(0, np.uint8))
    frequencies = Frequencies(shelf, buckets)

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # copies within a task are sent once; the memory of what was sent is bounded, as this only saves work
        hashes, sent = WordHashes(), set()
        for batch in batches:
            out = []
            for sets in shingle_sets(batch["text"].tolist(), k, hashes):
                for s, level in zip(sets, frequencies.levels(sets)):
                    if len(s) and (i := set_hash(s)) not in sent:
                        core = float(level.mean())
                        if len(tokens := _shared_prefix(s, level, ORDERS[0], percent)):
                            out.append((i, len(s), core, np.sort(tokens.view(np.int64))))
                        sent.add(i)
            if len(sent) > 1_000_000:
                sent.clear()
            if out:
                yield pd.DataFrame(out, columns=["set_id", "n", "core", "tokens"])

    index = rows.select("text").mapInPandas(prefixes, "set_id long, n int, core double, tokens array<bigint>").select("set_id", "n", "core", F.explode("tokens").alias("token"))
    index = materialise(index, "prefixes")
    shared = index.groupBy("token").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low <> high").select("token")
    index = materialise(index.join(shared, "token").distinct(), "shared-prefixes")

    # the whole sets of candidates only: one row of each is enough, and rows that no candidate needs are passed over
    needed = found.join(index.select("set_id").distinct(), "set_id").groupBy("set_id").agg(F.min("id").alias("id"))
    wanted = hash_table(needed.select(F.xxhash64("id").alias("key")), "key")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            texts = batch["text"][wanted.has(batch["key"].to_numpy())].tolist()
            for block in shingle_sets(texts, k, hashes):
                kept = [(s, level) for s, level in zip(block, frequencies.levels(block)) if len(s)]
                if kept:
                    other = {f"prefix{o}": [_shared_prefix(s, level, salt, percent).astype(np.int32) for s, level in kept] for o, salt in enumerate(ORDERS[1:])}
                    own = {"set_id": [set_hash(s) for s, _ in kept], "tokens": [s.view(np.int64) for s, _ in kept], "bits": [sketch(s) for s, _ in kept]}
                    yield pd.DataFrame(own | other)

    extra = "".join(f", prefix{o} array<int>" for o in range(len(ORDERS) - 1))
    sets = rows.select(F.xxhash64("id").alias("key"), "text").mapInPandas(whole, f"set_id long, tokens array<bigint>, bits array<bigint>{extra}")
    sets = materialise(sets.dropDuplicates(["set_id"]), "candidates")

    groups = connected(_compare(index, sets, percent, {} if report is None else report))
    counts = _count_links(groups.withColumnRenamed("node", "set_id"), sets, percent)
    ids = found.where("n > 0").groupBy("set_id").agg(F.min("id").alias("id"))
    ids = ids.join(groups.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    lowest = ids.groupBy("component").agg(F.min("id").alias("component_id"))
    ids = ids.join(lowest, "component").join(counts, "set_id", "left").select("set_id", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return found.join(ids, "set_id", "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def _filtered(pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """The pairs with ``passed``: under how many of the further orders, one after the other, their prefixes share a token."""
    prefixes = [c for c in sets.columns if c.startswith("prefix")]
    a, b = (sets.select(F.col("set_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in prefixes]) for s in "ab")
    passed = F.lit(len(prefixes))
    for k, c in reversed(list(enumerate(prefixes))):
        passed = F.when(F.arrays_overlap(f"a_{c}", f"b_{c}"), passed).otherwise(F.lit(k))
    return materialise(pairs.join(a, "a").join(b, "b").select("a", "b", passed.alias("passed")), label)


def _links(pairs: DataFrame, sets: DataFrame, percent: int, label: str) -> DataFrame:
    """(a, b) of the pairs whose whole sets are similar."""
    a, b = (sets.select(F.col("set_id").alias(s), F.col("tokens").alias(f"{s}_tokens")) for s in "ab")
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    linked = 100 * common >= percent * (F.size("a_tokens") + F.size("b_tokens") - common)
    return materialise(pairs.join(a, "a").join(b, "b").where(linked).select("a", "b"), label)


def _compare(index: DataFrame, sets: DataFrame, percent: int, report: dict[str, int]) -> DataFrame:
    """(a, b) of links that hold every component together."""
    sized = f"least(n, m) * 100 >= greatest(n, m) * {percent}"
    orders = len(ORDERS) - 1
    tested = links = None

    def verify(pairs: DataFrame, label: str) -> None:
        nonlocal tested, links
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        now = _filtered(pairs, sets, f"pairs-{label}")
        for r in now.groupBy("passed").agg(F.count(F.lit(1)).alias("n")).collect():
            for k in range(r["passed"] + 1):
                report[f"order {k + 1}"] = report.get(f"order {k + 1}", 0) + r["n"]
        found = _links(now.where(F.col("passed") == orders).select("a", "b"), sets, percent, f"links-{label}")
        now = now.select("a", "b")
        tested, links = (now, found) if tested is None else (tested.unionAll(now), links.unionAll(found))

    members = index.withColumn("component", F.col("set_id"))
    for turn in range(LEADER_ROUNDS):
        # one leader per bucket, whatever its size: the most central member, later a central one drawn for the bucket
        draw = F.pmod(F.xxhash64(F.lit(turn), "token", "set_id"), F.lit(1000)) / 1000 if turn else F.lit(0.0)
        rank = F.struct((F.col("core") * (1 + 0.3 * draw)).alias("r"), F.col("set_id").alias("leader"), F.col("component").alias("lead"), F.col("n").alias("m"))
        leaders = members.groupBy("token").agg(F.max(rank).alias("first"), F.min("component").alias("low"), F.max("component").alias("high"))
        leaders = leaders.where("low <> high").select("token", "first.leader", "first.lead", "first.m")
        led = members.join(leaders, "token").where("component <> lead").where(sized)
        verify(led.select(F.least("set_id", "leader").alias("a"), F.greatest("set_id", "leader").alias("b")).distinct(), f"leaders-{turn}")
        members = _grouped(index, links)

    # what is left: pairs of different components. One of the two is outside the bucket's largest component
    sizes = members.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("token").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    open_ = materialise(members.join(main, "token"), "open")
    # each pair in the bucket of its first common token only, told by the tokens that both have in open buckets
    tokens = open_.groupBy("set_id").agg(F.array_sort(F.collect_list("token")).alias("tokens")).join(sets.select("set_id", "bits"), "set_id")
    outer = open_.where("component <> main").join(tokens, "set_id").select("token", "set_id", "component", "n", "tokens", "bits")
    inner = open_.join(tokens, "set_id").select("token", F.col("set_id").alias("other"), F.col("component").alias("theirs"), F.col("n").alias("m"), F.col("tokens").alias("others"), F.col("bits").alias("their_bits"), "main")
    first = F.get(F.array_intersect("tokens", "others"), F.lit(0)) == F.col("token")
    # two outer members meet twice in a bucket: once is enough
    once = (F.col("theirs") == F.col("main")) | (F.col("set_id") < F.col("other"))
    rest = outer.join(inner, "token").where(F.expr("component <> theirs") & F.expr(sized) & once & _may_link("n", "bits", "m", "their_bits", percent) & first)
    verify(rest.select(F.least("set_id", "other").alias("a"), F.greatest("set_id", "other").alias("b")).distinct(), "rest")
    return links


def link_counts(first: np.ndarray, sets: list[np.ndarray], alone: bool, percent: int) -> np.ndarray:
    """How many sets each set links with: those marked ``first`` with those that are not, or all with all if there is one block ``alone``."""
    sizes = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(flat, np.cumsum(sizes)[:-1])
    left = np.arange(len(sets)) if alone else np.flatnonzero(first)
    right = left if alone else np.flatnonzero(~first)
    counts = np.zeros(len(sets), dtype=np.int64)
    if not len(left) or not len(right):
        return counts
    theirs = np.concatenate([own[r] for r in right])
    starts = np.concatenate([[0], np.cumsum(sizes[right])[:-1]])
    mark = np.zeros(int(flat.max()) + 1, dtype=np.int32)
    for l in left.tolist():
        mark[own[l]] = 1
        common = np.add.reduceat(mark[theirs], starts).astype(np.int64)
        mark[own[l]] = 0
        linked = (100 * common >= percent * (sizes[l] + sizes[right] - common)) & (right != l)
        counts[l] += linked.sum()
        if not alone:
            counts[right] += linked
    return counts


def _count_links(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(set_id, n_links) of all sets of ``groups``, from every pair within a component."""
    sizes = groups.join(sets.select("set_id", F.size("tokens").alias("n")), "set_id").groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    sizes = sizes.select("component", F.ceil(F.greatest(F.col("m") / BLOCK_SETS, F.col("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    own = groups.join(sizes, "component").withColumn("own", F.expr("cast(pmod(xxhash64(set_id), blocks) as int)"))
    dealt = own.join(sets.select("set_id", "tokens"), "set_id").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "set_id", "tokens")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []

        def flush() -> pd.DataFrame:
            own, ids, found = zip(*held)
            links = link_counts(np.array(own) == now[1], list(found), now[1] == now[2], percent)
            return pd.DataFrame({"set_id": ids, "links": links})

        for batch in batches:
            out = []
            for component, x, y, *row in batch.itertuples(index=False, name=None):
                if (component, x, y) != now:
                    if held:
                        out.append(flush())
                    now, held = (component, x, y), []
                held.append(row)
            if out:
                yield pd.concat(out)
        if held:
            yield flush()

    dealt = dealt.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y")
    return dealt.mapInPandas(count, "set_id long, links long").groupBy("set_id").agg(F.sum("links").alias("n_links"))


def sketch(found: np.ndarray) -> np.ndarray:
    """A map with a bit for each shingle's hash value modulo its length."""
    marked = np.zeros(64 * SKETCH, dtype=bool)
    marked[(found & np.uint64(64 * SKETCH - 1)).astype(np.int64)] = True
    return np.packbits(marked).view(np.int64)


def _may_link(n: str, mine: str, m: str, theirs: str, percent: int) -> Column:
    """Whether two sizes and sketches leave room for enough common shingles."""

    def lacking(x: str, y: str) -> Column:
        bits = [F.bit_count(F.get(x, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(i))))) for i in range(SKETCH)]
        return reduce(lambda p, q: p + q, bits)

    most = F.least(F.col(n) - lacking(mine, theirs), F.col(m) - lacking(theirs, mine))
    return 100 * most >= percent * (F.col(n) + F.col(m) - most)


def _grouped(index: DataFrame, links: DataFrame) -> DataFrame:
    groups = connected(links).withColumnRenamed("node", "set_id")
    return index.join(groups, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
